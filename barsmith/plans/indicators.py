"""Indicator queries."""

from __future__ import annotations

from barsmith.operators import ewm as E
from barsmith.operators import indicators as I
from barsmith.params import DAILY, MONTHLY, WEEKLY
from barsmith.plans.inputs import bars, latest_date
from barsmith.plans.registry import query
from barsmith.plans.sqlbase import MACD, RSI, bars_sql, ewm_macd


@query("rsi_sql", bars_sql("SELECT symbol, date, close, rsi, rsi_signal FROM rsi_tab", RSI), "rsi")
def _(spark, sf):
    return I.rsi_sql(bars(spark, sf))


def _rsi_full_sql(tf, period=14, tail=10):
    return bars_sql(f"""
, st AS (
  SELECT symbol, date, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS chg
  FROM bars WHERE date >= (SELECT d FROM anchor) - {tf.rsi_lookback}
), mn AS (
  SELECT symbol, date, count(chg) OVER w AS k, avg(greatest(chg, 0)) OVER w AS up,
         avg(greatest(-chg, 0)) OVER w AS dn
  FROM (SELECT * FROM st WHERE chg IS NOT NULL)
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS {period - 1} PRECEDING)
), v AS (
  SELECT symbol, date, 100 - 100 / (1 + up / CASE WHEN dn = 0 THEN 1e-10 ELSE dn END) AS rsi,
         row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r
  FROM mn WHERE k = {period}
)
SELECT symbol, date, rsi,
       CASE WHEN rsi <= {tf.oversold} THEN 'Oversold' WHEN rsi >= {tf.overbought}
            THEN 'Overbought' ELSE 'Neutral' END AS rsi_signal
FROM v WHERE r <= {tail}""")


for _tf in (DAILY, WEEKLY, MONTHLY):
    @query("rsi" if _tf is DAILY else f"rsi_{_tf.name.lower()}", _rsi_full_sql(_tf), "rsi")
    def _(spark, sf, _tf=_tf):
        return I.rsi(bars(spark, sf), tf=_tf, as_of=latest_date(spark, sf))


@query("macd_sma", bars_sql(
    "SELECT symbol, date, close, macd_line, signal_line, macd_histogram, macd_signal FROM macd_tab",
    MACD), "macd_line signal_line macd_histogram")
def _(spark, sf):
    return I.macd_sma(bars(spark, sf))


def _macd_ewm_sql(tf):
    t = tf.macd_threshold
    return bars_sql(f"""
SELECT symbol, date, macd_line, signal_line, macd_histogram,
       CASE WHEN macd_histogram > {t} AND prev_hist <= {t} THEN 'Bullish'
            WHEN macd_histogram < -{t} AND prev_hist >= -{t} THEN 'Bearish'
            WHEN macd_histogram > 0 AND macd_histogram > prev_hist THEN 'Bullish'
            WHEN macd_histogram < 0 AND macd_histogram < prev_hist THEN 'Bearish'
            ELSE 'Neutral' END AS macd_signal
FROM em WHERE n >= {tf.macd_min_rows} AND rn > n - 10""",
                    f", lb AS (SELECT * FROM bars WHERE date >= (SELECT d FROM anchor) - "
                    f"{tf.macd_lookback})",
                    ewm_macd("lb", tf.macd_fast, tf.macd_slow, tf.macd_signal))


for _tf in (DAILY, WEEKLY, MONTHLY):
    @query("macd_ewm" if _tf is DAILY else f"macd_ewm_{_tf.name.lower()}", _macd_ewm_sql(_tf),
           "macd_line signal_line macd_histogram")
    def _(spark, sf, _tf=_tf):
        return I.macd_ewm(bars(spark, sf), tf=_tf, as_of=latest_date(spark, sf))


@query("ewm", bars_sql("""
, o AS (SELECT symbol, date, close,
               row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM bars),
r AS (
  SELECT symbol, date, rn, close AS ewm FROM o WHERE rn = 1
  UNION ALL
  SELECT o.symbol, o.date, o.rn, r.ewm * (1 - 2e0 / 13) + o.close * 2e0 / 13
  FROM r JOIN o ON o.symbol = r.symbol AND o.rn = r.rn + 1
)
SELECT symbol, date, ewm FROM r"""), "ewm")
def _(spark, sf):
    return E.ewm(bars(spark, sf), "close", 12)


def _bands_sql(tf, period=20):
    return bars_sql(f"""
, w AS (
  SELECT symbol, date, close, count(*) OVER (PARTITION BY symbol) AS n,
         row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn,
         avg(close) OVER f AS m, stddev_samp(close) OVER f AS sd
  FROM bars WHERE date >= (SELECT d FROM anchor) - {tf.band_lookback}
  WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS {period - 1} PRECEDING)
), b AS (
  SELECT symbol, date, close, m AS middle_band, m + 2 * sd AS upper_band, m - 2 * sd AS lower_band,
         (close - (m - 2 * sd)) / nullif((m + 2 * sd) - (m - 2 * sd), 0) AS percent_b
  FROM w WHERE n >= {tf.band_min_rows} AND rn >= {period}
), l AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r
  FROM b WHERE percent_b IS NOT NULL
)
SELECT symbol, date, middle_band, upper_band, lower_band, percent_b,
       CASE WHEN close > upper_band THEN 'Overbought' WHEN close < lower_band THEN 'Oversold'
            WHEN percent_b > {tf.near_high} THEN 'Near Overbought'
            WHEN percent_b < {tf.near_low} THEN 'Near Oversold' ELSE 'Neutral' END AS bb_signal
FROM l WHERE r <= 10""")


for _tf in (DAILY, WEEKLY, MONTHLY):
    @query("bollinger" if _tf is DAILY else f"bollinger_{_tf.name.lower()}", _bands_sql(_tf),
           "middle_band upper_band lower_band percent_b")
    def _(spark, sf, _tf=_tf):
        return I.bollinger(bars(spark, sf), tf=_tf, as_of=latest_date(spark, sf))


@query("bollinger_bootstrap", bars_sql("""
, w AS (
  SELECT symbol, date, close, avg(close) OVER f AS m, stddev_samp(close) OVER f AS sd
  FROM bars WHERE date >= (SELECT d FROM anchor) - 50
  WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)
)
SELECT symbol, date, m AS middle_band, m + 2 * sd AS upper_band, m - 2 * sd AS lower_band,
       CASE WHEN sd = 0 THEN 0.5 ELSE (close - (m - 2 * sd)) / nullif(4 * sd, 0) END AS percent_b,
       CASE WHEN close > m + 2 * sd THEN 'Overbought' WHEN close < m - 2 * sd THEN 'Oversold'
            ELSE 'Neutral' END AS bb_signal
FROM w WHERE sd IS NOT NULL"""), "middle_band upper_band lower_band percent_b")
def _(spark, sf):
    return I.bollinger_bootstrap(bars(spark, sf), as_of=latest_date(spark, sf))


@query("vwap", bars_sql("""
SELECT symbol, date, close,
       CASE WHEN count(*) OVER w = 20 THEN
         sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0) END AS vwap
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)"""), "vwap")
def _(spark, sf):
    return I.vwap(bars(spark, sf))


ATR = """, tr AS (
  SELECT *, CASE WHEN prev_close IS NULL THEN NULL
       ELSE greatest(high - low, abs(high - prev_close), abs(low - prev_close)) END AS true_range
  FROM bars
), atr AS (
  SELECT *, avg(true_range) OVER (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING) AS atr_14
  FROM tr
), atr_tab AS (
  SELECT *, coalesce(atr_14 - lag(atr_14, 5) OVER (PARTITION BY symbol ORDER BY date), 0)
              AS atr_slope FROM atr)"""


@query("atr", bars_sql("""
SELECT symbol, date, true_range, atr_14, atr_slope,
       CASE WHEN atr_slope < 0 THEN 1 ELSE 0 END AS range_contraction,
       (high - low) / (atr_14 + 1e-9) AS price_tightening
FROM atr_tab""", ATR), "true_range atr_14 atr_slope price_tightening")
def _(spark, sf):
    return I.atr(bars(spark, sf))


FLOW = """, lots AS (
  SELECT *, foreign_buy / CASE WHEN foreign_buy + foreign_sell > volume THEN 1e2 ELSE 1e0 END AS fb,
         foreign_sell / CASE WHEN foreign_buy + foreign_sell > volume THEN 1e2 ELSE 1e0 END AS fs
  FROM bars
), flow AS (
  SELECT *, fb / (fb + fs + 1e-9) AS fbr,
         ((close - low) - (high - close)) / (high - low + 1e-9) AS clv
  FROM lots
), mflow AS (SELECT *, clv * volume * fbr AS mfv FROM flow)"""


@query("ad_line", bars_sql("""
SELECT symbol, date, fbr AS foreign_buy_ratio, clv, mfv AS money_flow_volume,
       sum(mfv) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS ad_line
FROM mflow""", FLOW), "foreign_buy_ratio clv money_flow_volume:2 ad_line:2")
def _(spark, sf):
    return I.ad_line(bars(spark, sf))


@query("ad_line_plain", bars_sql("""
, m AS (
  SELECT symbol, date, CASE WHEN high = low THEN 0 ELSE
    ((close - low) - (high - close)) / nullif(high - low, 0) * volume END AS money_flow_volume
  FROM bars WHERE date >= (SELECT d FROM anchor) - 40)
SELECT *, sum(money_flow_volume) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)
            AS ad_line FROM m"""), "money_flow_volume ad_line", 2)
def _(spark, sf):
    return I.ad_line_plain(bars(spark, sf), as_of=latest_date(spark, sf))


@query("chaikin_mf", bars_sql("""
SELECT symbol, date,
       coalesce(sum(mfv * foreign_buy / (volume + 1e-9)) OVER w / nullif(sum(volume) OVER w, 0), 0)
         AS cmf
FROM mflow WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)""", FLOW), "cmf")
def _(spark, sf):
    return I.chaikin_mf(bars(spark, sf))


@query("order_flow_imbalance", bars_sql("""
SELECT symbol, date, (fb - fs) / (volume + 1e-9) AS ofi,
       sum((fb - fs) / (volume + 1e-9)) OVER (PARTITION BY symbol ORDER BY date
                                              ROWS UNBOUNDED PRECEDING) AS cumulative_ofi
FROM lots""", FLOW), "ofi cumulative_ofi")
def _(spark, sf):
    return I.order_flow_imbalance(bars(spark, sf))


@query("volume_profile", bars_sql("""
, a AS (SELECT *, avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) AS v20
        FROM lots)
SELECT symbol, date, v20 AS avg_volume_20, volume / (v20 + 1e-9) AS relative_volume,
       CASE WHEN volume > listed_shares * 5e-3 THEN 1 ELSE 0 END AS large_block_ratio,
       (fb + fs) / (volume + 1e-9) AS institutional_footprint
FROM a""", FLOW), "avg_volume_20:4 relative_volume institutional_footprint")
def _(spark, sf):
    return I.volume_profile(bars(spark, sf))


@query("support_strength", bars_sql("""
, o AS (SELECT symbol, date, low, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn
        FROM bars),
f AS (SELECT *, min(low) OVER (PARTITION BY symbol ORDER BY rn ROWS 19 PRECEDING) AS lo FROM o)
SELECT f.symbol, f.date, any_value(f.low) AS low,
       CASE WHEN any_value(f.rn) > 20
            THEN least(count(*) FILTER (abs(p.low - f.lo) <= f.lo * 2e-2) / 5e0, 1e0)
            ELSE 0 END AS support_strength
FROM f JOIN o p ON p.symbol = f.symbol AND p.rn BETWEEN f.rn - 19 AND f.rn
GROUP BY f.symbol, f.date"""), "support_strength")
def _(spark, sf):
    return I.support_strength(bars(spark, sf))


SMA = """, sma AS (
  SELECT *, """ + ", ".join(
    f"avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING) AS sma_{n}"
    for n in (5, 10, 20, 50, 100, 200)) + """,
  avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) AS avg_volume_20,
  avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING) AS avg_volume_50
  FROM bars)"""

SMA_COLUMNS = ("sma_5", "sma_10", "sma_20", "sma_50", "sma_100", "sma_200", "avg_volume_20",
               "avg_volume_50")


@query("moving_averages", bars_sql(
    f"SELECT symbol, date, close, {', '.join(SMA_COLUMNS)} FROM sma", SMA), " ".join(SMA_COLUMNS))
def _(spark, sf):
    return I.moving_averages(bars(spark, sf))


TREND = SMA + """, back AS (
  SELECT *, lag(sma_20, 10) OVER w AS s20b, lag(close, 5) OVER w AS c5
  FROM sma WINDOW w AS (PARTITION BY symbol ORDER BY date)
), trend AS (
  SELECT *, CASE WHEN close > sma_20 AND sma_20 > sma_50 AND sma_50 > sma_100 THEN 'STRONG_UPTREND'
                 WHEN close > sma_20 AND sma_20 > s20b THEN 'UPTREND'
                 WHEN close < sma_20 AND sma_20 < sma_50 AND sma_50 < sma_100
                   THEN 'STRONG_DOWNTREND'
                 WHEN close < sma_20 AND sma_20 < s20b THEN 'DOWNTREND'
                 ELSE 'SIDEWAYS' END AS primary_trend,
         CASE WHEN close > c5 THEN 'BULLISH_MOMENTUM' WHEN close < c5 THEN 'BEARISH_MOMENTUM'
              ELSE 'NEUTRAL_MOMENTUM' END AS momentum_direction
  FROM back)"""


@query("trend_state", bars_sql(
    "SELECT symbol, date, close, primary_trend, momentum_direction FROM trend", TREND))
def _(spark, sf):
    return I.trend_state(bars(spark, sf))


def _extreme(column, sign):
    side = " AND ".join(f"{column} {sign} {fn}({column}, {k}) OVER w"
                        for fn in ("lag", "lead") for k in (1, 2, 3, 4))
    return f"CASE WHEN {side} THEN 1 ELSE 0 END"


@query("swing_points", bars_sql(f"""
SELECT symbol, date, high, low, {_extreme('high', '>')} AS swing_high,
       {_extreme('low', '<')} AS swing_low
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)"""))
def _(spark, sf):
    return I.swing_points(bars(spark, sf))


FIB_RATIOS = (("23_6", "0.236e0"), ("38_2", "0.382e0"), ("50", "0.5e0"), ("61_8", "0.618e0"))
FIB = """, rng AS (
  SELECT symbol, date, max(high) OVER w AS hi, min(low) OVER w AS lo
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 99 PRECEDING)
), fib AS (
  SELECT symbol, date, lo AS bull_fib_0, """ + ", ".join(
    f"lo + (hi - lo) * {v} AS bull_fib_{n}, hi - (hi - lo) * {v} AS bear_fib_{n}"
    for n, v in FIB_RATIOS) + """, hi AS bull_fib_100, hi AS bear_fib_0, lo AS bear_fib_100
  FROM rng)"""


@query("fibonacci_levels", bars_sql("SELECT * FROM fib", FIB), " ".join(I.FIB_COLUMNS))
def _(spark, sf):
    return I.fibonacci_levels(bars(spark, sf))


WAVE = RSI + TREND + FIB + """, wave AS (
  SELECT t.*, r.rsi AS rsi_14, f.* EXCLUDE (symbol, date),
    CASE WHEN primary_trend LIKE '%UPTREND' THEN 'BULL_WAVE_' || CASE
           WHEN t.close > bull_fib_100 THEN 5 WHEN t.close > bull_fib_61_8 THEN 4
           WHEN t.close > bull_fib_38_2 THEN 3 WHEN t.close > bull_fib_23_6 THEN 2 ELSE 1 END END
      AS bullish_wave_position,
    CASE WHEN primary_trend LIKE '%DOWNTREND' THEN 'BEAR_WAVE_' || CASE
           WHEN t.close < bear_fib_100 THEN 5 WHEN t.close < bear_fib_61_8 THEN 4
           WHEN t.close < bear_fib_38_2 THEN 3 WHEN t.close < bear_fib_23_6 THEN 2 ELSE 1 END END
      AS bearish_wave_position
  FROM trend t JOIN fib f ON f.symbol = t.symbol AND f.date = t.date
  LEFT JOIN rsi_tab r ON r.symbol = t.symbol AND r.date = t.date
), waves AS (
  SELECT *, coalesce(bullish_wave_position, bearish_wave_position, 'SIDEWAYS_CORRECTION')
              AS wave_position FROM wave)"""


@query("wave_position", bars_sql(
    "SELECT symbol, date, close, primary_trend, bullish_wave_position, bearish_wave_position, "
    "wave_position FROM waves", WAVE))
def _(spark, sf):
    return I.wave_position(bars(spark, sf))


WAVE_SIGNAL = WAVE + """, wsig AS (
  SELECT *, CASE
      WHEN wave_position = 'BULL_WAVE_2' AND rsi_14 >= 30 AND rsi_14 <= 50
           AND momentum_direction = 'BULLISH_MOMENTUM' THEN 'STRONG_BUY'
      WHEN wave_position = 'BULL_WAVE_3' AND rsi_14 > 50
           AND momentum_direction = 'BULLISH_MOMENTUM' THEN 'BUY'
      WHEN wave_position = 'BULL_WAVE_4' AND rsi_14 >= 40 AND rsi_14 <= 60 THEN 'WEAK_BUY'
      WHEN wave_position = 'BEAR_WAVE_2' AND rsi_14 >= 50 AND rsi_14 <= 70
           AND momentum_direction = 'BEARISH_MOMENTUM' THEN 'STRONG_SELL'
      WHEN wave_position = 'BEAR_WAVE_3' AND rsi_14 < 50
           AND momentum_direction = 'BEARISH_MOMENTUM' THEN 'SELL'
      WHEN wave_position = 'BEAR_WAVE_4' AND rsi_14 >= 40 AND rsi_14 <= 60 THEN 'WEAK_SELL'
      WHEN wave_position LIKE '%WAVE_5' THEN 'CAUTION_REVERSAL'
      WHEN primary_trend = 'SIDEWAYS' THEN 'RANGE_TRADING' ELSE 'WAIT' END AS wave_signal,
    CASE WHEN primary_trend = 'STRONG_UPTREND' AND wave_position IN ('BULL_WAVE_3', 'BULL_WAVE_4')
           THEN 'BULL_MARKET'
         WHEN primary_trend = 'STRONG_DOWNTREND'
              AND wave_position IN ('BEAR_WAVE_3', 'BEAR_WAVE_4') THEN 'BEAR_MARKET'
         WHEN wave_position LIKE '%WAVE_5' THEN 'POTENTIAL_REVERSAL'
         WHEN primary_trend = 'SIDEWAYS' THEN 'CORRECTION_PHASE'
         ELSE 'UNDEFINED_PHASE' END AS market_phase
  FROM waves)"""


@query("wave_signal", bars_sql(
    "SELECT symbol, date, primary_trend, wave_position, rsi_14, momentum_direction, wave_signal, "
    "market_phase FROM wsig", WAVE_SIGNAL), "rsi_14")
def _(spark, sf):
    return I.wave_signal(bars(spark, sf))


LEVELS = """, lev0 AS (
  SELECT *, row_number() OVER o AS rn, lag(open_price) OVER o AS po, lag(close) OVER o AS pc,
         avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING) AS v10,
         max(high) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) AS h20,
         min(low) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) AS l20
  FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY date)
), levels AS (
  SELECT *, CASE WHEN rn >= 20 THEN h20 END AS high_20d, CASE WHEN rn >= 20 THEN l20 END AS low_20d,
         rn >= 10 AND volume > 3 * v10 AS volume_shock,
         rn >= 20 AND close < l20 * 1.03e0 AS near_support,
         rn >= 20 AND close > h20 * 0.97e0 AS near_resistance,
         coalesce(open_price < pc AND close > po AND close > open_price AND pc < po, false)
           AS bullish_engulfing
  FROM lev0)"""


@query("price_levels", bars_sql(
    "SELECT symbol, date, high_20d, low_20d, volume_shock, near_support, near_resistance, "
    "bullish_engulfing FROM levels", LEVELS))
def _(spark, sf):
    return I.price_levels(bars(spark, sf))
