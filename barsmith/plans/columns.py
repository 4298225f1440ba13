"""Projection and predicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barsmith.functions import scalar as S
from barsmith.functions.frames import lag, since
from barsmith.operators.forecast import fill_forward_back
from barsmith.operators.quality import require_columns
from barsmith.params import TIMEFRAMES
from barsmith.plans.inputs import bars, latest_date
from barsmith.plans.registry import query
from barsmith.plans.sqlbase import bars_sql


@query("pct_change", bars_sql("""
SELECT symbol, date, coalesce((close - prev_close) / nullif(prev_close, 0) * 100, 0) AS or_zero,
       (close - prev_close) / nullif(prev_close, 0) * 100 AS or_null,
       CASE WHEN prev_close > 0 THEN (close - prev_close) / prev_close ELSE 0 END AS fraction
FROM bars"""), "or_zero or_null fraction")
def _(spark, sf):
    return bars(spark, sf).select(
        "symbol", "date", S.pct_change_or_zero("close", "prev_close").alias("or_zero"),
        S.pct_change("close", "prev_close").alias("or_null"),
        S.return_fraction("close", "prev_close").alias("fraction"))


@query("foreign_adjust", bars_sql("""
SELECT symbol, date,
  CASE WHEN foreign_buy * 60 + foreign_sell > volume THEN foreign_buy * 60 / 1e2
       ELSE foreign_buy * 60 / 1e0 END AS foreign_buy_adj,
  CASE WHEN foreign_buy * 60 + foreign_sell > volume THEN foreign_sell / 1e2
       ELSE foreign_sell / 1e0 END AS foreign_sell_adj FROM bars"""))
def _(spark, sf):
    # Buying reported in shares exceeds the volume on many bars.
    b = bars(spark, sf).withColumn("foreign_buy", F.col("foreign_buy") * 60)
    return b.select("symbol", "date", S.foreign_in_lots("foreign_buy").alias("foreign_buy_adj"),
                    S.foreign_in_lots("foreign_sell").alias("foreign_sell_adj"))


@query("foreign_participation", bars_sql("""
, x AS (SELECT *, foreign_buy * 60 AS fb FROM bars)
SELECT symbol, date,
       CASE WHEN volume <= 0 THEN 0 WHEN (fb + foreign_sell) / CAST(volume AS DOUBLE) <= 1
            THEN (fb + foreign_sell) * 1e2 / volume
            ELSE (fb + foreign_sell) / CAST(volume AS DOUBLE) END AS participation_pct,
       CASE WHEN foreign_sell > 0 THEN fb / CAST(foreign_sell AS DOUBLE) WHEN fb > 0 THEN 999.99e0
            ELSE 0 END AS buy_sell_ratio FROM x"""), "participation_pct buy_sell_ratio")
def _(spark, sf):
    b = bars(spark, sf).withColumn("foreign_buy", F.col("foreign_buy") * 60)
    return b.select("symbol", "date", (S.foreign_share() * 100).alias("participation_pct"),
                    S.buy_sell_ratio().alias("buy_sell_ratio"))


@query("bid_ask_ratio", bars_sql("""
SELECT symbol, date, CASE WHEN offer_volume > 0 THEN bid_volume / CAST(offer_volume AS DOUBLE) END
         AS bid_ask_ratio FROM bars"""), "bid_ask_ratio")
def _(spark, sf):
    return bars(spark, sf).select("symbol", "date",
                                               S.bid_ask_ratio().alias("bid_ask_ratio"))


@query("price_impact", bars_sql("""
SELECT symbol, date, abs(close - open_price) / nullif(open_price, 0) * 100 AS price_impact
FROM bars"""), "price_impact")
def _(spark, sf):
    return bars(spark, sf).select("symbol", "date",
                                               S.price_impact().alias("price_impact"))


@query("large_block", bars_sql("""
SELECT symbol, date, CASE WHEN volume * 200 > listed_shares THEN 1 ELSE 0 END AS large_block
FROM bars"""))
def _(spark, sf):
    return bars(spark, sf).select("symbol", "date", S.large_block().alias("large_block"))


@query("trade_levels", bars_sql("""
, tf(timeframe, a, b, c) AS (VALUES ('DAILY', 1.05e0, 1.10e0, 0.97e0),
                                    ('WEEKLY', 1.08e0, 1.15e0, 0.95e0),
                                    ('MONTHLY', 1.12e0, 1.20e0, 0.92e0))
SELECT symbol, date, timeframe, close * a AS tp1, close * b AS tp2, close * c AS stop_loss
FROM bars, tf WHERE date = (SELECT d FROM anchor)"""), "tp1 tp2 stop_loss")
def _(spark, sf):
    day = bars(spark, sf).filter(F.col("date") == F.lit(latest_date(spark, sf)))
    rows = F.array(*[F.struct(F.lit(tf.name).alias("timeframe"),
                              *[c.alias(n) for n, c in S.trade_levels("close", tf).items()])
                     for tf in TIMEFRAMES.values()])
    return day.select("symbol", "date", F.inline(rows))


@query("price_action_label", bars_sql("""
SELECT symbol, date, CASE
         WHEN close > open_price AND close >= high * 0.95e0 THEN 'Strong Close'
         WHEN close > (high + low) / 2 THEN 'Above Midpoint'
         WHEN low > lag(high) OVER (PARTITION BY symbol ORDER BY date) THEN 'Gap Up'
         ELSE 'Neutral' END AS price_action FROM bars"""))
def _(spark, sf):
    return bars(spark, sf).select(
        "symbol", "date", S.price_action_label(lag("high")).alias("price_action"))


@query("action_notes", bars_sql("""
SELECT symbol, date, 'Entry: ' || CAST(CAST(close AS BIGINT) AS VARCHAR) || ' | Change: '
       || coalesce(CAST(CAST(change AS BIGINT) AS VARCHAR), '') || ' | Orders: ' || frequency
         AS notes FROM bars"""))
def _(spark, sf):
    return bars(spark, sf).select("symbol", "date", F.concat(
        F.lit("Entry: "), S.text_of(F.col("close").cast("long")), F.lit(" | Change: "),
        S.text_of(F.col("change").cast("long")), F.lit(" | Orders: "),
        S.text_of("frequency")).alias("notes"))


@query("expected_rebound", bars_sql("""
, c AS (SELECT symbol, date, frequency * 5 AS score,
               (close - prev_close) / nullif(prev_close, 0) * 100 AS chg FROM bars)
SELECT symbol, date, CASE WHEN score >= 15 THEN least(abs(chg) * 0.4e0, 15)
                          WHEN score >= 10 THEN least(abs(chg) * 0.3e0, 10)
                          ELSE least(abs(chg) * 0.2e0, 5) END AS expected_rebound_pct
FROM c WHERE chg IS NOT NULL"""), "expected_rebound_pct")
def _(spark, sf):
    out = bars(spark, sf).withColumns({
        "score": F.col("frequency") * 5, "chg": S.pct_change("close", "prev_close")})
    return out.filter("chg IS NOT NULL").select(
        "symbol", "date", S.expected_rebound("chg", "score").alias("expected_rebound_pct"))


@query("lookback_filter", bars_sql("""
SELECT symbol, date, close FROM bars
WHERE date >= (SELECT CAST(d - INTERVAL 2 MONTH AS DATE) FROM anchor)"""))
def _(spark, sf):
    return since(bars(spark, sf), None, latest_date(spark, sf), months=2).select(
        "symbol", "date", "close")


@query("next_business_day", bars_sql("""
SELECT DISTINCT date, date + CASE dayofweek(date) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END
         AS next_day FROM bars"""))
def _(spark, sf):
    return bars(spark, sf).select(
        "date", S.next_business_day("date").alias("next_day")).distinct()


@query("fill_forward_back", bars_sql("""
, g AS (SELECT symbol, date, CASE WHEN frequency >= 4 THEN close END AS quote FROM bars)
SELECT symbol, date, coalesce(
    last_value(quote IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
                                         ROWS UNBOUNDED PRECEDING),
    first_value(quote IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS quote FROM g"""))
def _(spark, sf):
    gaps = bars(spark, sf).select(
        "symbol", "date", F.when(F.col("frequency") >= 4, F.col("close")).alias("quote"))
    return fill_forward_back(gaps, ["quote"])


@query("require_columns", bars_sql("SELECT count(*) AS bars FROM bars"))
def _(spark, sf):
    return require_columns(bars(spark, sf), [
        "symbol", "date", "close", "volume", "foreign_buy", "foreign_sell", "high", "low"]).agg(
        F.count("*").alias("bars"))


@query("score_bins", bars_sql("""
, s AS (SELECT symbol, date, (close - 5000) / 2 AS score FROM bars)
SELECT symbol, date, CASE WHEN score < 0 OR score > 100 THEN NULL WHEN score <= 40
       THEN 'No Signal' WHEN score <= 60 THEN 'Weak' WHEN score <= 80 THEN 'Moderate'
       ELSE 'Strong' END AS band FROM s"""))
def _(spark, sf):
    return bars(spark, sf).select(
        "symbol", "date", S.cut((F.col("close") - 5000) / 2, [0, 40, 60, 80, 100],
                                ["No Signal", "Weak", "Moderate", "Strong"]).alias("band"))
