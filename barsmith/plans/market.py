"""Market summary queries."""

from __future__ import annotations

from barsmith.operators import market as M
from barsmith.operators import indicators as I
from barsmith.operators import forecast as F_
from barsmith.plans.inputs import bars, forecasts, latest_date
from barsmith.plans.news import SENTIMENT, SENTIMENT_PRICE, scored_articles, sentiment_table
from barsmith.plans.registry import query
from barsmith.plans.sqlbase import MACD, METRICS, RSI, bars_sql
from barsmith.operators import sentiment as N

DIM = """, dim AS (
  SELECT symbol, last(name ORDER BY date) AS name, last(listed_shares ORDER BY date) AS listed_shares,
         last(tradable_shares ORDER BY date) AS tradable_shares, max(date) AS last_updated_date
  FROM bars GROUP BY symbol)"""

LATEST = "(SELECT d FROM anchor)"


@query("daily_metrics", bars_sql("""
SELECT symbol, name, date, prev_close, open_price, high, low, close, change, percent_change,
       (high - low) / nullif(low, 0) * 100 AS intraday_volatility, high - low AS daily_range,
       (high - low) / nullif(low, 0) * 100 AS low_to_high_percent, volume, value, frequency,
       foreign_net
FROM metrics""", METRICS), "percent_change intraday_volatility low_to_high_percent")
def _(spark, sf):
    return M.daily_metrics(bars(spark, sf))


@query("dim_companies", bars_sql("SELECT * FROM dim", DIM))
def _(spark, sf):
    return M.dim_companies(bars(spark, sf))


@query("performance_daily", bars_sql(f"""
SELECT b.symbol, c.name, b.date AS day, b.prev_close, b.close, b.volume, b.value,
       CASE WHEN b.prev_close > 0 THEN b.close / b.prev_close - 1 ELSE 0 END AS daily_return
FROM bars b JOIN dim c USING (symbol) WHERE b.date = {LATEST}""", DIM), "daily_return")
def _(spark, sf):
    b = bars(spark, sf)
    return M.performance_daily(b, M.dim_companies(b), latest_date(spark, sf))


def _period_sql(unit):
    return bars_sql(f"""
, r AS (SELECT *, CAST(date_trunc('{unit}', date) AS DATE) AS ps,
               CASE WHEN prev_close > 0 THEN close / prev_close - 1 ELSE 0 END AS ret FROM bars),
g AS (SELECT symbol, ps, avg(ret) AS a, CAST(sum(volume) AS BIGINT) AS v,
             first(close ORDER BY date) AS o, last(close ORDER BY date) AS c
      FROM r GROUP BY symbol, ps)
SELECT g.symbol, dim.name, ps AS {unit}_starting, a AS avg_daily_return, v AS {unit}ly_volume,
       o AS {unit}_open, c AS {unit}_close, c / o - 1 AS {unit}ly_return
FROM g JOIN dim USING (symbol) WHERE ps = (SELECT max(ps) FROM g)""", DIM)


for _unit in ("week", "month"):
    @query(f"performance_{_unit}ly", _period_sql(_unit), f"avg_daily_return {_unit}ly_return")
    def _(spark, sf, _unit=_unit):
        b = bars(spark, sf)
        return M.performance_period(b, M.dim_companies(b), _unit, latest_date(spark, sf))


@query("market_kpis", bars_sql(f"""
SELECT count(DISTINCT symbol) AS total_stocks,
       avg((close - prev_close) / prev_close * 100) FILTER (prev_close > 0) AS avg_change,
       CAST(sum(volume) AS BIGINT) AS total_volume, sum(value) AS total_value,
       count(*) FILTER (prev_close > 0 AND close > prev_close) AS gainers,
       count(*) FILTER (prev_close > 0 AND close < prev_close) AS losers
FROM bars WHERE date = {LATEST}"""), "avg_change")
def _(spark, sf):
    return M.market_kpis(bars(spark, sf))


DAY = f""", day AS (SELECT * FROM metrics WHERE date = {LATEST} AND prev_close > 0)"""


@query("top_movers", bars_sql("""
SELECT symbol, name, close, prev_close, percent_change, volume FROM day
ORDER BY abs(percent_change) DESC, symbol LIMIT 15""", METRICS, DAY), "percent_change")
def _(spark, sf):
    return M.top_movers(bars(spark, sf), as_of=latest_date(spark, sf))


for _name, _col, _desc, _beyond in (("top_gainers", "percent_change", True, 5.0),
                                    ("top_losers", "percent_change", False, -5.0),
                                    ("top_value", "value", True, None),
                                    ("top_volume", "volume", True, None)):
    _cmp = f"AND {_col} {'>' if _desc else '<'} {_beyond}" if _beyond else ""

    @query(_name, bars_sql(f"""
SELECT symbol, name, {_col} FROM metrics WHERE date = {LATEST} AND {_col} IS NOT NULL {_cmp}
ORDER BY {_col} {'DESC' if _desc else 'ASC'}, symbol LIMIT 10""", METRICS),
           _col if _beyond else "")
    def _(spark, sf, _col=_col, _desc=_desc, _beyond=_beyond):
        return M.top_by(M.daily_metrics(bars(spark, sf)), _col, 10, latest_date(spark, sf), _desc,
                        _beyond)


HIGHLIGHTS = bars_sql("""
SELECT * FROM (SELECT 'Top Gainer' AS category, symbol, name, percent_change, volume FROM day
               WHERE percent_change > 0 ORDER BY percent_change DESC, symbol LIMIT 3)
UNION ALL
SELECT * FROM (SELECT 'Top Loser', symbol, name, percent_change, volume FROM day
               WHERE percent_change < 0 ORDER BY percent_change, symbol LIMIT 3)
UNION ALL
SELECT * FROM (SELECT 'Most Active', symbol, name, percent_change, volume FROM day
               ORDER BY volume DESC, symbol LIMIT 3)""", METRICS, DAY)


@query("market_highlights", HIGHLIGHTS, "percent_change")
def _(spark, sf):
    return M.market_highlights(M.daily_metrics(bars(spark, sf)), as_of=latest_date(spark, sf))


@query("quick_stats", bars_sql("""
SELECT count(*) FILTER (percent_change > 5) AS big_gainers,
       count(*) FILTER (percent_change < -5) AS big_losers,
       count(*) FILTER (volume > 10000000) AS high_volume_stocks,
       count(*) AS total_active_stocks, avg(volume) AS avg_volume, max(volume) AS max_volume
FROM day WHERE volume > 0""", METRICS, DAY), "avg_volume")
def _(spark, sf):
    return M.quick_stats(bars(spark, sf), latest_date(spark, sf))


@query("volume_leaders", bars_sql("""
SELECT symbol, name, volume, percent_change FROM day ORDER BY volume DESC, symbol LIMIT 8""",
                                  METRICS, DAY), "percent_change")
def _(spark, sf):
    return M.volume_leaders(bars(spark, sf), as_of=latest_date(spark, sf))


@query("stock_movement", bars_sql(f"""
SELECT symbol, name, date, close, prev_close, percent_change, volume, value, high, low, open_price,
       foreign_net
FROM metrics WHERE symbol = 'S3' AND date >= {LATEST} - 30""", METRICS), "percent_change")
def _(spark, sf):
    return M.stock_movement(M.daily_metrics(bars(spark, sf)), "S3", 30, latest_date(spark, sf))


@query("stock_history", bars_sql(f"""
SELECT m.symbol, m.name, m.date, m.open_price, m.high, m.low, m.close, m.volume, m.percent_change,
       m.value, r.rsi, r.rsi_signal, d.macd_line, d.signal_line, d.macd_histogram, d.macd_signal
FROM metrics m LEFT JOIN rsi_tab r USING (symbol, date) LEFT JOIN macd_tab d USING (symbol, date)
WHERE m.symbol = 'S3' AND m.date >= {LATEST} - 120""", METRICS, RSI, MACD),
       "percent_change rsi macd_line signal_line macd_histogram")
def _(spark, sf):
    b = bars(spark, sf)
    return M.stock_history(M.daily_metrics(b), I.rsi_sql(b), I.macd_sma(b), "S3", 120,
                           latest_date(spark, sf))


@query("available_symbols", bars_sql(
    f"SELECT DISTINCT symbol, name FROM bars WHERE date = {LATEST}"))
def _(spark, sf):
    return M.available_symbols(bars(spark, sf), latest_date(spark, sf))


@query("symbols_with_indicators", bars_sql(f"""
SELECT DISTINCT b.symbol, b.name FROM rsi_tab r JOIN bars b USING (symbol, date)
WHERE r.date >= {LATEST} - 30""", RSI))
def _(spark, sf):
    b = bars(spark, sf)
    return M.symbols_with_indicators(M.daily_metrics(b), I.rsi_sql(b), 30, latest_date(spark, sf))


@query("summary_stats", bars_sql("""
SELECT 'close' AS "column", avg(close) AS mean, stddev_samp(close) AS std, min(close) AS min,
       max(close) AS max FROM bars
UNION ALL SELECT 'high', avg(high), stddev_samp(high), min(high), max(high) FROM bars
UNION ALL SELECT 'frequency', avg(frequency), stddev_samp(frequency), min(frequency),
                 max(frequency) FROM bars"""), "mean std")
def _(spark, sf):
    return M.summary_stats(bars(spark, sf), ["close", "high", "frequency"])


@query("liquid_universe", bars_sql(f"""
, base AS (SELECT * FROM bars WHERE date >= {LATEST} - 60 AND volume > 0 AND value >= 5e9)
SELECT symbol, date, close, volume, value, listed_shares FROM base
WHERE symbol IN (SELECT symbol FROM base WHERE date = {LATEST}
                 GROUP BY symbol HAVING max(close * listed_shares) >= 1e12)"""))
def _(spark, sf):
    return M.liquid_universe(bars(spark, sf), latest_date(spark, sf)).select(
        "symbol", "date", "close", "volume", "value", "listed_shares")


FORECASTS = """, fc0 AS (
  SELECT symbol, date AS prediction_date,
         avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND
                          1 PRECEDING) AS predicted_close,
         CASE WHEN date <= (SELECT d FROM anchor) - 5 THEN close END AS actual_close
  FROM bars
), fc AS (
  SELECT *, abs(predicted_close - actual_close) AS prediction_error,
         abs(predicted_close - actual_close) / nullif(actual_close, 0) * 100 AS error_percentage
  FROM fc0 WHERE predicted_close IS NOT NULL
), fcd AS (
  SELECT fc.*, m.close AS previous_close, m.volume, m.percent_change,
         CASE WHEN predicted_close > m.close THEN 'Bullish'
              WHEN predicted_close < m.close THEN 'Bearish' ELSE 'Neutral' END
           AS prediction_direction,
         CASE WHEN actual_close IS NULL THEN NULL ELSE
           coalesce(sign(predicted_close - m.close) * sign(actual_close - m.close) > 0, false) END
           AS direction_correct
  FROM fc LEFT JOIN metrics m ON m.symbol = fc.symbol AND m.date = fc.prediction_date - 1)"""


def dashboard(spark, sf):
    b = bars(spark, sf)
    as_of = latest_date(spark, sf)
    metrics = M.daily_metrics(b)
    technical = I.with_macd_sma(I.with_rsi(metrics))
    news = N.sentiment_price(sentiment_table(scored_articles(spark, sf), "A"), metrics,
                             M.dim_companies(b), as_of)
    ahead = F_.forecast_direction(forecasts(b), metrics)
    return M.signal_dashboard(technical, news, ahead, as_of)


@query("signal_dashboard", bars_sql(f"""
SELECT m.symbol, m.date, m.close, m.volume, m.percent_change, r.rsi, r.rsi_signal, d.macd_line,
       d.macd_signal, d.macd_histogram, n.avg_sentiment, n.positive_percentage,
       n.negative_percentage, n.trading_signal AS news_trading_signal, f.predicted_close,
       f.prediction_direction AS forecast_direction, f.actual_close, f.prediction_error,
       f.error_percentage, f.predicted_close - m.close AS prediction_gap,
       (f.predicted_close - m.close) / nullif(m.close, 0) * 100 AS prediction_gap_pct,
       CASE WHEN d.macd_signal = 'Bullish' AND r.rsi_signal = 'Overbought'
                 AND n.trading_signal LIKE '%Buy Signal' THEN 'Bullish Strong'
            WHEN d.macd_signal = 'Bearish' AND r.rsi_signal = 'Oversold'
                 AND n.trading_signal LIKE '%Sell Signal' THEN 'Bearish Strong'
            WHEN d.macd_signal = 'Bullish' OR r.rsi_signal = 'Overbought'
                 OR n.trading_signal LIKE '%Buy Signal' THEN 'Bullish'
            WHEN d.macd_signal = 'Bearish' OR r.rsi_signal = 'Oversold'
                 OR n.trading_signal LIKE '%Sell Signal' THEN 'Bearish'
            ELSE 'Neutral' END AS final_signal
FROM metrics m
LEFT JOIN rsi_tab r ON r.symbol = m.symbol AND r.date = m.date
LEFT JOIN macd_tab d ON d.symbol = m.symbol AND d.date = m.date
LEFT JOIN senti_price n ON n.symbol = m.symbol AND n.date = m.date
LEFT JOIN fcd f ON f.symbol = m.symbol AND f.prediction_date = m.date
WHERE m.date >= {LATEST} - 90""", METRICS, DIM, RSI, MACD, SENTIMENT, SENTIMENT_PRICE, FORECASTS),
       "percent_change rsi macd_line macd_histogram avg_sentiment positive_percentage "
       "negative_percentage predicted_close prediction_error error_percentage prediction_gap "
       "prediction_gap_pct")
def _(spark, sf):
    return dashboard(spark, sf)
