"""Window-frame queries: one per frame shape."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barsmith.functions import frames as W
from barsmith.functions.frames import lag, lead
from barsmith.functions.scalar import pct_change
from barsmith.operators import ranking as K
from barsmith.plans.inputs import bars, latest_date
from barsmith.plans.registry import query
from barsmith.plans.sqlbase import METRICS, bars_sql

OVER = "PARTITION BY symbol ORDER BY date"


def _plain(spark, sf):
    return bars(spark, sf)


@query("row_number_latest", bars_sql(f"""
SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS row_num
FROM bars"""))
def _(spark, sf):
    return K.row_number_latest(_plain(spark, sf).select("symbol", "date", "close"))


@query("rank_global", bars_sql("""
SELECT symbol, foreign_buy - foreign_sell AS foreign_net, volume,
       rank() OVER (ORDER BY foreign_buy - foreign_sell DESC) AS net_rank,
       rank() OVER (ORDER BY volume DESC) AS volume_rank
FROM bars"""))
def _(spark, sf):
    b = _plain(spark, sf).select(
        "symbol", (F.col("foreign_buy") - F.col("foreign_sell")).alias("foreign_net"), "volume")
    out = K.with_rank(b, "foreign_net", "net_rank", descending=True)
    return K.with_rank(out, "volume", "volume_rank", descending=True)


@query("pct_rank_avg", bars_sql("""
, r AS (SELECT symbol, date, percent_change, rank() OVER (PARTITION BY date ORDER BY percent_change)
                 AS r, count(*) OVER (PARTITION BY date, percent_change) AS t,
               count(percent_change) OVER (PARTITION BY date) AS n
        FROM metrics WHERE percent_change IS NOT NULL)
SELECT m.symbol, m.date, (r + (t - 1) / 2e0) / n AS pct_rank
FROM metrics m LEFT JOIN r USING (symbol, date)""", METRICS), "pct_rank")
def _(spark, sf):
    b = _plain(spark, sf).select("symbol", "date",
                                 pct_change("close", "prev_close").alias("percent_change"))
    return K.with_pct_rank_avg(b, "percent_change", "pct_rank", by=["date"]).drop("percent_change")


@query("lag_k", bars_sql(f"""
SELECT symbol, date, lag(close, 1) OVER w AS close_1, lag(close, 5) OVER w AS close_5,
       lag(close, 10) OVER w AS close_10 FROM bars WINDOW w AS ({OVER})"""))
def _(spark, sf):
    return _plain(spark, sf).select("symbol", "date", *[lag("close", k).alias(f"close_{k}")
                                                        for k in (1, 5, 10)])


@query("lead_lag_extrema", bars_sql(f"""
SELECT symbol, date, lead(change) OVER w AS next_change,
       coalesce(high > lag(high) OVER w AND high > lead(high) OVER w, false) AS local_high
FROM bars WINDOW w AS ({OVER})"""))
def _(spark, sf):
    top = (F.col("high") > lag("high")) & (F.col("high") > lead("high"))
    return _plain(spark, sf).select("symbol", "date", lead("change").alias("next_change"),
                                    F.coalesce(top, F.lit(False)).alias("local_high"))


ROLLING = (3, 5, 10, 12, 20, 26, 30, 50, 100, 200)


@query("rolling_avg", bars_sql("SELECT symbol, date, " + ", ".join(
    f"avg(close) OVER ({OVER} ROWS {n - 1} PRECEDING) AS avg_{n}" for n in ROLLING)
    + " FROM bars"), " ".join(f"avg_{n}" for n in ROLLING))
def _(spark, sf):
    return _plain(spark, sf).select("symbol", "date",
                                    *[W.avg_n("close", n).alias(f"avg_{n}") for n in ROLLING])


@query("trailing_avg_excl", bars_sql("SELECT symbol, date, " + ", ".join(
    f"avg(volume) OVER ({OVER} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS before_{n}"
    for n in (7, 10, 20, 30)) + " FROM bars"), "before_7 before_10 before_20 before_30", 4)
def _(spark, sf):
    return _plain(spark, sf).select("symbol", "date", *[
        W.avg_before("volume", n).alias(f"before_{n}") for n in (7, 10, 20, 30)])


FRAMES = ((89, 30), (149, 90), (34, 5), (5, 3))


@query("offset_frame_avg", bars_sql("SELECT symbol, date, " + ", ".join(
    f"avg(close) OVER ({OVER} ROWS BETWEEN {a} PRECEDING AND {b} PRECEDING) AS from_{a}_to_{b}"
    for a, b in FRAMES) + " FROM bars"), " ".join(f"from_{a}_to_{b}" for a, b in FRAMES))
def _(spark, sf):
    return _plain(spark, sf).select("symbol", "date", *[
        F.avg("close").over(W.between(a, b)).alias(f"from_{a}_to_{b}") for a, b in FRAMES])


@query("rolling_max_min", bars_sql("SELECT symbol, date, " + ", ".join(
    f"max(high) OVER ({OVER} ROWS {n - 1} PRECEDING) AS high_{n}, "
    f"min(low) OVER ({OVER} ROWS {n - 1} PRECEDING) AS low_{n}" for n in (20, 60, 100))
    + " FROM bars"))
def _(spark, sf):
    cols = []
    for n in (20, 60, 100):
        cols += [F.max("high").over(W.last_n(n)).alias(f"high_{n}"),
                 F.min("low").over(W.last_n(n)).alias(f"low_{n}")]
    return _plain(spark, sf).select("symbol", "date", *cols)


@query("rolling_cond_sum", bars_sql(f"""
SELECT symbol, date,
       CAST(sum(CASE WHEN close > prev_close THEN volume ELSE 0 END) OVER w AS BIGINT) AS up_volume,
       count(*) FILTER (foreign_buy > foreign_sell) OVER w AS bought_days
FROM bars WINDOW w AS ({OVER} ROWS 5 PRECEDING)"""))
def _(spark, sf):
    up = F.when(F.col("close") > F.col("prev_close"), F.col("volume")).otherwise(0)
    bought = F.when(F.col("foreign_buy") > F.col("foreign_sell"), 1)
    return _plain(spark, sf).select("symbol", "date", F.sum(up).over(W.last_n(6)).alias("up_volume"),
                                    F.count(bought).over(W.last_n(6)).alias("bought_days"))


@query("rolling_stddev", bars_sql(f"""
SELECT symbol, date, stddev_samp(close) OVER w AS sd,
       stddev_samp(close) OVER w / nullif(avg(close) OVER w, 0) * 100 AS cv
FROM bars WINDOW w AS ({OVER} ROWS 29 PRECEDING)"""), "sd cv")
def _(spark, sf):
    sd = F.stddev_samp("close").over(W.last_n(30))
    return _plain(spark, sf).select("symbol", "date", sd.alias("sd"),
                                    (sd / W.avg_n("close", 30) * 100).alias("cv"))


@query("cumulative_sum", bars_sql(f"""
SELECT symbol, date, CAST(sum(volume) OVER ({OVER} ROWS UNBOUNDED PRECEDING) AS BIGINT)
         AS volume_to_date FROM bars"""))
def _(spark, sf):
    return _plain(spark, sf).select("symbol", "date",
                                    F.sum("volume").over(W.running()).alias("volume_to_date"))


@query("full_window_avg", bars_sql(f"""
SELECT symbol, date, CASE WHEN count(*) OVER w = 14 THEN avg(close) OVER w END AS avg_14
FROM bars WINDOW w AS ({OVER} ROWS 13 PRECEDING)"""), "avg_14")
def _(spark, sf):
    return _plain(spark, sf).select("symbol", "date",
                                    W.full(F.avg("close"), "close", 14).alias("avg_14"))


@query("partial_window_avg", bars_sql(f"""
SELECT symbol, date, avg(close) OVER ({OVER} ROWS 13 PRECEDING) AS avg_14 FROM bars"""), "avg_14")
def _(spark, sf):
    return _plain(spark, sf).select("symbol", "date", W.avg_n("close", 14).alias("avg_14"))


@query("diff_shift_returns", bars_sql(f"""
SELECT symbol, date, close - lag(close, 5) OVER w AS diff_5,
       lead(close, 1) OVER w / close - 1 AS return_1, lead(close, 5) OVER w / close - 1 AS return_5
FROM bars WINDOW w AS ({OVER})"""), "return_1 return_5")
def _(spark, sf):
    c = F.col("close")
    return _plain(spark, sf).select("symbol", "date", (c - lag("close", 5)).alias("diff_5"),
                                    (lead("close", 1) / c - 1).alias("return_1"),
                                    (lead("close", 5) / c - 1).alias("return_5"))


@query("two_key_window_avg", bars_sql("""
SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS month, date,
       avg(volume) OVER (PARTITION BY symbol, date_trunc('month', date) ORDER BY date
                         ROWS 2 PRECEDING) AS avg_volume_3 FROM bars"""), "avg_volume_3", 4)
def _(spark, sf):
    w = Window.partitionBy("symbol", "month").orderBy("date").rowsBetween(-2, 0)
    out = _plain(spark, sf).withColumn("month", F.trunc("date", "month"))
    return out.select("symbol", "month", "date", F.avg("volume").over(w).alias("avg_volume_3"))


@query("as_of_rank", bars_sql("""
SELECT symbol, volume, rank() OVER (ORDER BY volume DESC) AS volume_rank
FROM bars WHERE date = (SELECT d FROM anchor)"""))
def _(spark, sf):
    day = _plain(spark, sf).filter(F.col("date") == F.lit(latest_date(spark, sf)))
    return K.with_rank(day.select("symbol", "volume"), "volume", "volume_rank", descending=True)
