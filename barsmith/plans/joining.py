"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barsmith.operators import indicators as I
from barsmith.operators import market as M
from barsmith.operators import relational as R
from barsmith.plans.inputs import bars, latest_date, names
from barsmith.plans.news import SENTIMENT, scored_articles, sentiment_table
from barsmith.plans.registry import query
from barsmith.plans.sqlbase import MACD, METRICS, RSI, bars_sql


@query("join_inner_symbol_date", bars_sql("""
SELECT r.symbol, r.date, r.rsi, m.macd_line FROM rsi_tab r
JOIN macd_tab m ON m.symbol = r.symbol AND m.date = r.date""", RSI, MACD), "rsi macd_line")
def _(spark, sf):
    b = bars(spark, sf)
    return R.join_inner_symbol_date(I.rsi_sql(b).select("symbol", "date", "rsi"),
                                    I.macd_sma(b).select("symbol", "date", "macd_line"))


@query("join_left_chain", bars_sql("""
SELECT b.symbol, b.date, b.close, r.rsi, m.macd_line
FROM bars b LEFT JOIN rsi_tab r USING (symbol, date) LEFT JOIN macd_tab m USING (symbol, date)""",
                                   RSI, MACD), "rsi macd_line")
def _(spark, sf):
    b = bars(spark, sf)
    return R.join_left_chain(b.select("symbol", "date", "close"),
                             I.rsi_sql(b).select("symbol", "date", "rsi"),
                             I.macd_sma(b).select("symbol", "date", "macd_line"))


@query("join_full_outer", bars_sql("""
SELECT coalesce(b.symbol, s.ticker) AS symbol, coalesce(b.date, s.date) AS date, b.close,
       s.avg_sentiment
FROM bars b FULL JOIN (SELECT * FROM senti WHERE feed = 'A') s
  ON s.ticker = b.symbol AND s.date = b.date""", SENTIMENT), "avg_sentiment")
def _(spark, sf):
    news = sentiment_table(scored_articles(spark, sf), "A").select(
        F.col("ticker").alias("symbol"), "date", "avg_sentiment")
    return R.join_full_outer(bars(spark, sf).select("symbol", "date", "close"), news)


@query("join_full_outer_3way", bars_sql("""
, a AS (SELECT symbol, date, close AS up FROM bars WHERE close > prev_close),
b AS (SELECT symbol, date, volume AS busy FROM bars WHERE volume > 10000000),
c AS (SELECT symbol, date, frequency AS often FROM bars WHERE frequency >= 3)
SELECT coalesce(ab.symbol, c.symbol) AS symbol, coalesce(ab.date, c.date) AS date, up, busy, often
FROM (SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.date, b.date) AS date, up, busy
      FROM a FULL JOIN b ON a.symbol = b.symbol AND a.date = b.date) ab
FULL JOIN c ON c.symbol = ab.symbol AND c.date = ab.date"""))
def _(spark, sf):
    b = bars(spark, sf)
    return R.join_full_outer_3way(
        b.filter("close > prev_close").select("symbol", "date", F.col("close").alias("up")),
        b.filter("volume > 10000000").select("symbol", "date", F.col("volume").alias("busy")),
        b.filter("frequency >= 3").select("symbol", "date", F.col("frequency").alias("often")),
        ["symbol", "date"])


@query("join_dim_broadcast", bars_sql("SELECT symbol, date, close, name FROM bars"))
def _(spark, sf):
    return R.join_dim(bars(spark, sf).select("symbol", "date", "close"),
                      names(spark, sf))


@query("join_latest_date", bars_sql(
    "SELECT symbol, close, date AS latest_date FROM bars WHERE date = (SELECT d FROM anchor)"))
def _(spark, sf):
    return R.join_latest_date(bars(spark, sf)).select("symbol", "close", "latest_date")


@query("period_first_last_close", bars_sql("""
SELECT symbol, CAST(date_trunc('week', date) AS DATE) AS period_start,
       first(close ORDER BY date) AS period_open, last(close ORDER BY date) AS period_close
FROM bars GROUP BY 1, 2"""))
def _(spark, sf):
    return R.period_first_last_close(bars(spark, sf), "week")


@query("join_date_offset", bars_sql("""
SELECT e.symbol, e.date, e.close AS entry_price, x.close AS exit_price
FROM bars e JOIN bars x ON x.symbol = e.symbol AND x.date = e.date + 5"""))
def _(spark, sf):
    b = bars(spark, sf)
    return R.join_date_offset(b.select("symbol", "date", F.col("close").alias("entry_price")), b, 5,
                              name="exit_price")


BREAK = """, ev AS (
  SELECT symbol, date AS event_date, close AS event_price FROM bars
  WHERE (close - prev_close) / nullif(prev_close, 0) > 0.05e0)"""


@query("join_date_range", bars_sql("""
SELECT ev.symbol, event_date, event_price, b.date, b.high FROM ev
JOIN bars b ON b.symbol = ev.symbol AND b.date > event_date AND b.date <= event_date + 5""", BREAK))
def _(spark, sf):
    b = bars(spark, sf)
    events = b.filter("(close - prev_close) / nullif(prev_close, 0) > 0.05D").select(
        "symbol", F.col("date").alias("event_date"), F.col("close").alias("event_price"))
    return R.join_date_range(events, b.select("symbol", "date", "high"), 1, 5, "event_date").select(
        "symbol", "event_date", "event_price", "date", "high")


@query("cross_join_kpis", bars_sql("""
SELECT (SELECT count(*) FROM bars WHERE change > 0) AS gainers,
       (SELECT count(*) FROM bars WHERE change < 0) AS losers,
       (SELECT max(volume) FROM bars) AS max_volume"""))
def _(spark, sf):
    b = bars(spark, sf)
    return R.cross_join_kpis(
        b.agg(F.count_if(F.col("change") > 0).alias("gainers"),
              F.count_if(F.col("change") < 0).alias("losers")),
        b.agg(F.max("volume").alias("max_volume")))


@query("prior_range_max", bars_sql("""
SELECT b.symbol, b.date, b.close,
       (SELECT max(high) FROM bars p WHERE p.symbol = b.symbol
          AND p.date BETWEEN b.date - 20 AND b.date - 1) AS prior_high,
       (SELECT avg(volume) FROM bars p WHERE p.symbol = b.symbol
          AND p.date BETWEEN b.date - 20 AND b.date - 1) AS prior_avg_volume
FROM bars b"""), "prior_avg_volume")
def _(spark, sf):
    return R.prior_range_max(bars(spark, sf))


@query("running_total", bars_sql("""
SELECT symbol, date, volume,
       CAST(sum(volume) OVER (PARTITION BY symbol ORDER BY date) AS BIGINT) AS volume_to_date
FROM bars"""))
def _(spark, sf):
    return R.running_total(bars(spark, sf).select("symbol", "date", "volume"), "volume",
                           "volume_to_date")


@query("filter_latest_date", bars_sql(
    "SELECT symbol, date, close FROM bars WHERE date = (SELECT max(date) FROM bars)"))
def _(spark, sf):
    b = bars(spark, sf).select("symbol", "date", "close")
    return b.filter(F.col("date") == F.lit(latest_date(spark, sf)))


@query("semi_join_having", bars_sql("""
SELECT symbol, date, volume FROM bars WHERE symbol IN (
  SELECT symbol FROM bars GROUP BY symbol HAVING avg(volume) > 5200000)"""))
def _(spark, sf):
    return R.semi_join_having(bars(spark, sf).select("symbol", "date", "volume"),
                              F.col("v") > 5200000, F.avg("volume").alias("v"))


@query("anti_join_new_rows", bars_sql("""
SELECT symbol, date, close FROM bars b WHERE date >= DATE '2000-06-20' AND NOT EXISTS (
  SELECT 1 FROM bars t WHERE t.date < DATE '2000-07-01' AND t.symbol = b.symbol
    AND t.date = b.date)"""))
def _(spark, sf):
    b = bars(spark, sf).select("symbol", "date", "close")
    return R.anti_join_new_rows(b.filter("date >= DATE '2000-06-20'"),
                                b.filter("date < DATE '2000-07-01'"), ["symbol", "date"])


@query("optional_join", bars_sql("""
SELECT b.symbol, b.date, b.close, r.rsi, CAST(NULL AS VARCHAR) AS macd_signal
FROM bars b LEFT JOIN rsi_tab r USING (symbol, date)""", RSI), "rsi")
def _(spark, sf):
    b = bars(spark, sf)
    out = R.optional_join(b.select("symbol", "date", "close"),
                          I.rsi_sql(b).select("symbol", "date", "rsi"))
    return R.optional_join(out, None, columns={"macd_signal": "string"})


@query("liquid_metrics_join", bars_sql("""
SELECT m.symbol, m.date, m.percent_change, n.s_name AS company FROM metrics m
JOIN supplier n ON 'S' || n.s_suppkey = m.symbol""", METRICS), "percent_change")
def _(spark, sf):
    metrics = M.daily_metrics(bars(spark, sf)).select("symbol", "date",
                                                                   "percent_change")
    return R.join_dim(metrics, names(spark, sf).withColumnRenamed("name", "company"))
