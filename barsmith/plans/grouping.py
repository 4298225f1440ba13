"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barsmith.operators import relational as R
from barsmith.operators import sentiment as N
from barsmith.plans.inputs import bars, forecasts
from barsmith.plans.market import DIM, FORECASTS
from barsmith.plans.news import SENTIMENT, scored_articles
from barsmith.plans.registry import query
from barsmith.plans.sqlbase import METRICS, bars_sql


def _rollup_sql(unit):
    return bars_sql(f"""
SELECT symbol, CAST(date_trunc('{unit}', date) AS DATE) AS period_start, min(date) AS first_date,
       max(date) AS last_date,
       avg(CASE WHEN prev_close > 0 THEN (close - prev_close) / prev_close ELSE 0 END)
         AS avg_daily_return, CAST(sum(volume) AS BIGINT) AS period_volume
FROM bars GROUP BY 1, 2""")


for _unit in ("week", "month"):
    @query("period_rollup" if _unit == "week" else "period_rollup_month", _rollup_sql(_unit),
           "avg_daily_return")
    def _(spark, sf, _unit=_unit):
        return R.period_rollup(bars(spark, sf), _unit)


@query("conditional_counts", bars_sql("""
SELECT date, count(*) FILTER (close > prev_close) AS gainers,
       count(*) FILTER (close < prev_close) AS losers,
       CAST(sum(CASE WHEN foreign_buy > foreign_sell THEN volume ELSE 0 END) AS BIGINT)
         AS bought_volume FROM bars GROUP BY date"""))
def _(spark, sf):
    return bars(spark, sf).groupBy("date").agg(
        F.count_if(F.col("close") > F.col("prev_close")).alias("gainers"),
        F.count_if(F.col("close") < F.col("prev_close")).alias("losers"),
        F.sum(F.when(F.col("foreign_buy") > F.col("foreign_sell"), F.col("volume")).otherwise(0))
        .alias("bought_volume"))


@query("distinct_symbols", bars_sql(
    "SELECT date, count(DISTINCT symbol) AS symbols FROM bars GROUP BY date"))
def _(spark, sf):
    return bars(spark, sf).groupBy("date").agg(
        F.count_distinct("symbol").alias("symbols"))


@query("guarded_ratio", bars_sql("""
SELECT symbol, coalesce(count(*) FILTER (direction_correct) * 1e2
         / nullif(count(actual_close), 0), 0) AS direction_accuracy_pct
FROM fcd GROUP BY symbol""", METRICS, FORECASTS), "direction_accuracy_pct")
def _(spark, sf):
    from barsmith.operators.forecast import forecast_direction
    from barsmith.operators.market import daily_metrics
    b = bars(spark, sf)
    d = forecast_direction(forecasts(b), daily_metrics(b))
    return d.groupBy("symbol").agg(R.guarded_ratio(
        F.count_if("direction_correct"), F.count("actual_close")).alias("direction_accuracy_pct"))


@query("group_win_rate", bars_sql("""
, res AS (SELECT e.frequency AS buy_score, (x.close - e.close) / e.close * 100 AS pc
          FROM bars e JOIN bars x ON x.symbol = e.symbol AND x.date = e.date + 5)
SELECT buy_score, count(*) AS total_signals, count(*) FILTER (pc > 2) AS win_count,
       count(*) FILTER (pc > 2) * 1e2 / count(*) AS win_rate, avg(pc) AS avg_return
FROM res GROUP BY buy_score"""), "win_rate avg_return")
def _(spark, sf):
    b = bars(spark, sf)
    out = R.join_date_offset(b.select("symbol", "date", "close",
                                      F.col("frequency").alias("buy_score")), b, 5)
    pc = (F.col("offset_close") - F.col("close")) / F.col("close") * 100
    return R.win_rates(out.select("buy_score", pc.alias("percent_change"),
                                  (pc > 2).alias("is_win")))


@query("symbol_profile", bars_sql("""
SELECT symbol, max(high) AS max_high, min(low) AS min_low, avg(volume) AS avg_volume,
       stddev_samp(close) AS std_dev, avg(close) AS avg_price, max(date) AS last_date,
       min(date) AS first_date FROM bars GROUP BY symbol"""), "avg_volume std_dev avg_price", 4)
def _(spark, sf):
    return R.symbol_profile(bars(spark, sf))


@query("error_metrics", bars_sql("""
SELECT symbol, sqrt(avg((predicted_close - actual_close) ** 2)) AS rmse,
       avg(abs(predicted_close - actual_close)) AS mae,
       avg(abs(predicted_close - actual_close) / actual_close) * 100 AS mape,
       count(*) AS prediction_count
FROM fc WHERE actual_close IS NOT NULL GROUP BY symbol""", METRICS, FORECASTS), "rmse mae mape")
def _(spark, sf):
    return R.error_metrics(forecasts(bars(spark, sf)))


@query("having_filter", bars_sql("""
SELECT symbol, max(close * listed_shares) AS market_cap FROM bars GROUP BY symbol
HAVING max(close * listed_shares) >= 3e12"""))
def _(spark, sf):
    return bars(spark, sf).groupBy("symbol").agg(
        F.max(F.col("close") * F.col("listed_shares")).alias("market_cap")).filter(
        "market_cap >= 3e12")


@query("sentiment_fold", bars_sql("""
SELECT ticker, count(*) AS news_count, round(avg(sentiment_score), 9) AS avg_sentiment,
       count(*) FILTER (sentiment = 'Positive') AS positive_count,
       count(*) FILTER (sentiment = 'Negative') AS negative_count,
       count(*) FILTER (sentiment = 'Neutral') AS neutral_count
FROM scored GROUP BY ticker""", SENTIMENT), "avg_sentiment")
def _(spark, sf):
    one_day = scored_articles(spark, sf).withColumn("published", F.lit("2000-01-01").cast("date"))
    return N.ticker_sentiment(one_day).drop("date")


@query("post_event_range_agg", bars_sql("""
, ev AS (SELECT symbol, date AS event_date, close AS event_price FROM bars
         WHERE (close - prev_close) / nullif(prev_close, 0) > 0.05e0)
SELECT ev.symbol, event_date, max(high) AS highest, min(low) AS lowest,
       avg(volume) AS avg_volume, count(*) FILTER (close >= event_price) AS days_above,
       count(*) AS days_observed
FROM ev JOIN bars b ON b.symbol = ev.symbol AND b.date BETWEEN event_date + 1 AND event_date + 5
GROUP BY ev.symbol, event_date"""), "avg_volume")
def _(spark, sf):
    b = bars(spark, sf)
    events = b.filter("(close - prev_close) / nullif(prev_close, 0) > 0.05D").select(
        "symbol", F.col("date").alias("event_date"), F.col("close").alias("event_price"))
    hit = R.join_date_range(events, b.select("symbol", "date", "high", "low", "close", "volume"),
                            1, 5, "event_date")
    return hit.groupBy("symbol", "event_date").agg(
        F.max("high").alias("highest"), F.min("low").alias("lowest"),
        F.avg("volume").alias("avg_volume"),
        F.count_if(F.col("close") >= F.col("event_price")).alias("days_above"),
        F.count("*").alias("days_observed"))


@query("global_kpis", bars_sql("""
SELECT max(date) AS last_date, count(*) AS bars, avg(close) AS avg_close,
       max(volume) AS max_volume FROM bars"""), "avg_close")
def _(spark, sf):
    return bars(spark, sf).agg(
        F.max("date").alias("last_date"), F.count("*").alias("bars"),
        F.avg("close").alias("avg_close"), F.max("volume").alias("max_volume"))


@query("avg_indicator_weight", bars_sql("""
SELECT name AS indicator_name, avg(CASE WHEN change > 0 THEN 1e0 ELSE 0e0 END) AS avg_win_rate
FROM bars GROUP BY name""", DIM), "avg_win_rate")
def _(spark, sf):
    return bars(spark, sf).groupBy(F.col("name").alias("indicator_name")).agg(
        F.avg(F.when(F.col("change") > 0, 1.0).otherwise(0.0)).alias("avg_win_rate"))
