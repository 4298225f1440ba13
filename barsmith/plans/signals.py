"""Signal and screen queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barsmith.functions.frames import on_date
from barsmith.operators import indicators as I
from barsmith.operators import signals as G
from barsmith.params import DAILY, MONTHLY, WEEKLY
from barsmith.plans.inputs import bars, latest_date
from barsmith.plans.indicators import FIB_RATIOS, FIB, LEVELS, SMA, WAVE
from barsmith.plans.registry import query
from barsmith.plans.sqlbase import MACD, METRICS, RSI, bars_sql, ewm_macd

LATEST = "(SELECT d FROM anchor)"

RECOMMENDATION = RSI + MACD + METRICS


@query("technical_recommendation", bars_sql("""
SELECT r.symbol, r.date, r.rsi, r.rsi_signal, m.macd_line, m.signal_line, m.macd_histogram,
       m.macd_signal, b.close, b.volume, b.percent_change,
       CASE WHEN rsi < 30 THEN CASE macd_signal WHEN 'Bullish' THEN 'Strong Buy' ELSE 'Buy Signal' END
            WHEN rsi > 70 THEN CASE macd_signal WHEN 'Bearish' THEN 'Strong Sell'
                               ELSE 'Sell Signal' END
            WHEN macd_signal = 'Neutral' THEN 'Hold'
            ELSE 'Weak ' || CASE macd_signal WHEN 'Bullish' THEN 'Buy' ELSE 'Sell' END END
         AS recommendation
FROM rsi_tab r JOIN macd_tab m USING (symbol, date) JOIN metrics b USING (symbol, date)""",
                                            RECOMMENDATION),
       "rsi macd_line signal_line macd_histogram percent_change")
def _(spark, sf):
    return G.technical_recommendation(bars(spark, sf))


OVERSOLD = RSI + MACD + """, screen AS (
  SELECT b.symbol, b.date, r.rsi, r.rsi_signal, m.macd_signal, b.volume AS volume_today
  FROM bars b JOIN rsi_tab r USING (symbol, date) JOIN macd_tab m USING (symbol, date)
  WHERE r.rsi_signal = 'Oversold' AND m.macd_signal = 'Bullish' AND b.volume >
    (SELECT avg(volume) FROM bars p WHERE p.symbol = b.symbol AND p.date >= b.date - 4
       AND p.date < b.date))"""


@query("oversold_bullish", bars_sql("SELECT * FROM screen", OVERSOLD), "rsi")
def _(spark, sf):
    return G.oversold_bullish(bars(spark, sf))


@query("oversold_bullish_screen", bars_sql("""
SELECT * FROM screen WHERE date = (SELECT max(date) FROM bars)
ORDER BY volume_today DESC, symbol LIMIT 20""",
                                           OVERSOLD), "rsi")
def _(spark, sf):
    # No date given: the newest of the bars.
    return G.oversold_bullish_screen(bars(spark, sf))


def history_sql(tf, prefix="", source="bars"):
    """Score of every bar: RSI, MACD, bands and levels rebuilt from the bars."""
    t = tf.macd_threshold
    return LEVELS + ewm_macd(source, tf.macd_fast, tf.macd_slow, tf.macd_signal, f"{prefix}em") + f"""
, {prefix}chg AS (
  SELECT symbol, date, close, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS c,
         row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM bars
), {prefix}ind AS (
  SELECT symbol, date, close, rn, avg(greatest(c, 0)) OVER w14 AS up,
         avg(greatest(-c, 0)) OVER w14 AS dn, avg(close) OVER w20 AS m,
         stddev_samp(close) OVER w20 AS sd FROM {prefix}chg
  WINDOW w14 AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING),
         w20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)
), {prefix}flags AS (
  SELECT i.symbol, i.date, i.close,
    CASE WHEN i.rn > 14
      THEN 100 - 100 / (1 + up / CASE WHEN dn = 0 THEN 1e-10 ELSE dn END) END AS rsi,
    CASE WHEN i.rn >= 20 THEN (i.close - (m - 2 * sd)) / nullif((m + 2 * sd) - (m - 2 * sd), 0) END
      AS percent_b, m, sd, i.rn,
    e.macd_line, e.macd_histogram AS h, e.prev_hist AS p, l.volume_shock, l.near_support,
    l.bullish_engulfing
  FROM {prefix}ind i JOIN {prefix}em e ON e.symbol = i.symbol AND e.date = i.date
  JOIN levels l ON l.symbol = i.symbol AND l.date = i.date
), {prefix}hits AS (
  SELECT *, coalesce(rsi <= {tf.oversold}, false) AS t1,
    p IS NOT NULL AND ((h > {t} AND p <= {t}) OR (h > 0 AND h > p
      AND NOT (h < -{t} AND p >= -{t}))) AS t2,
    coalesce(percent_b IS NOT NULL AND close <= m + 2 * sd
             AND (close < m - 2 * sd OR percent_b < {tf.near_low}), false) AS t6
  FROM {prefix}flags
), {prefix}sig0 AS (
  SELECT *, CAST(least(10, round_even((CAST(t1 AS INT) + CAST(t2 AS INT) + CAST(volume_shock AS INT)
    + 2 * CAST(near_support AS INT) + 2 * CAST(bullish_engulfing AS INT) + CAST(t6 AS INT))
    * 10 / 8e0, 0)) AS INTEGER) AS buy_score FROM {prefix}hits
), {prefix}sig AS (
  SELECT symbol, date, close, buy_score, 0 AS selling_score,
         least(0.95e0, 0.5e0 + buy_score * 0.05e0) AS winning_probability,
         CASE WHEN buy_score >= 8 THEN 'Strong' WHEN buy_score >= 6 THEN 'Moderate'
              WHEN buy_score >= 4 THEN 'Weak' ELSE 'No Signal' END AS signal_strength,
         array_to_string(list_filter([CASE WHEN t1 THEN 'RSI Oversold' END,
           CASE WHEN t2 THEN 'MACD Bullish' END, CASE WHEN volume_shock THEN 'Volume Shock' END,
           CASE WHEN near_support THEN 'Near Support' END,
           CASE WHEN bullish_engulfing THEN 'Bullish Engulfing' END,
           CASE WHEN t6 THEN 'Bollinger Oversold' END], lambda x: x IS NOT NULL), '|') AS triggers
  FROM {prefix}sig0 WHERE buy_score >= 3)"""


def flat(df):
    """Array of triggers as text, which every engine compares alike."""
    return df.withColumn("triggers", F.array_join("indicators_triggered", "|")).drop(
        "indicators_triggered")


SIG = ("symbol, date, buy_score, selling_score, winning_probability, signal_strength, triggers")


@query("signal_history", bars_sql(f"SELECT {SIG} FROM sig", history_sql(DAILY)),
       "winning_probability")
def _(spark, sf):
    return flat(G.signal_history(bars(spark, sf), DAILY))


def last_signals(spark, sf, tf, b=None, win_rates=None):
    """The timeframe's score of each symbol's last bar, from its own indicator tables.

    Scores from 1 on: high scores are rare on these tables.
    """
    b, as_of = b or bars(spark, sf), latest_date(spark, sf)
    return G.buy_score(b, I.rsi(b, tf=tf, as_of=as_of), I.macd_ewm(b, tf=tf, as_of=as_of),
                       I.bollinger(b, tf=tf, as_of=as_of), win_rates, tf=tf, as_of=as_of,
                       min_score=1)


def last_sql(tf, name):
    """Same, built from look-back tables per indicator."""
    t = tf.macd_threshold
    lb = f", {name}_m AS (SELECT * FROM bars WHERE date >= {LATEST} - {tf.macd_lookback})"
    return lb + ewm_macd(f"{name}_m", tf.macd_fast, tf.macd_slow, tf.macd_signal, f"{name}_em") + f"""
, {name}_macd AS (
  SELECT symbol, date FROM {name}_em WHERE n >= {tf.macd_min_rows} AND prev_hist IS NOT NULL
    AND ((macd_histogram > {t} AND prev_hist <= {t})
         OR (macd_histogram > 0 AND macd_histogram > prev_hist
             AND NOT (macd_histogram < -{t} AND prev_hist >= -{t})))
), {name}_rsi AS (
  SELECT symbol, date, CASE WHEN count(c) OVER w = 14 THEN
      100 - 100 / (1 + avg(greatest(c, 0)) OVER w
        / CASE WHEN avg(greatest(-c, 0)) OVER w = 0 THEN 1e-10 ELSE avg(greatest(-c, 0)) OVER w END)
      END AS rsi
  FROM (SELECT symbol, date, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS c
        FROM bars WHERE date >= {LATEST} - {tf.rsi_lookback})
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING)
), {name}_bb AS (
  SELECT symbol, date, close, avg(close) OVER w AS m, stddev_samp(close) OVER w AS sd,
         count(*) OVER w AS k, count(*) OVER (PARTITION BY symbol) AS n
  FROM bars WHERE date >= {LATEST} - {tf.band_lookback}
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)
), {name}_lv AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r,
         count(*) OVER (PARTITION BY symbol) AS n,
         avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING) AS v10,
         min(low) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) AS l20,
         lag(open_price) OVER (PARTITION BY symbol ORDER BY date) AS po,
         lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc
  FROM bars WHERE date >= {LATEST} - {tf.signal_lookback}
), {name}_hit AS (
  SELECT l.symbol, l.date, l.name, l.close, l.volume,
    CAST(coalesce(q.rsi <= {tf.oversold}, false) AS INT) AS t1,
    CAST(d.symbol IS NOT NULL AS INT) AS t2, CAST(l.volume > 3 * v10 AS INT) AS t3,
    2 * CAST(l.close < 1.03e0 * l20 AS INT) AS t4,
    2 * CAST(open_price < pc AND l.close > po AND l.close > open_price AND pc < po AS INT) AS t5,
    CAST(coalesce(g.k = 20 AND g.n >= {tf.band_min_rows} AND g.sd > 0 AND g.close <= g.m + 2 * g.sd
      AND (g.close < g.m - 2 * g.sd
           OR (g.close - (g.m - 2 * g.sd)) / nullif((g.m + 2 * g.sd) - (g.m - 2 * g.sd), 0)
              < {tf.near_low}), false) AS INT) AS t6
  FROM {name}_lv l
  LEFT JOIN {name}_rsi q ON q.symbol = l.symbol AND q.date = l.date
  LEFT JOIN {name}_macd d ON d.symbol = l.symbol AND d.date = l.date
  LEFT JOIN {name}_bb g ON g.symbol = l.symbol AND g.date = l.date
  WHERE l.r = 1 AND l.n >= 20
), {name} AS (
  SELECT *, least(0.95e0, 0.5e0 + buy_score * 0.05e0) AS winning_probability,
    CASE WHEN buy_score >= 8 THEN 'Strong' WHEN buy_score >= 6 THEN 'Moderate'
         WHEN buy_score >= 4 THEN 'Weak' ELSE 'No Signal' END AS signal_strength
  FROM (SELECT *, CAST(round_even((t1 + t2 + t3 + t4 + t5 + t6) * 1.25e0, 0) AS INTEGER)
                    AS buy_score FROM {name}_hit)
  WHERE buy_score >= 1)"""


def _named(name, tf):
    return name if tf is DAILY else f"{name}_{tf.name.lower()}"


for _tf in (DAILY, WEEKLY, MONTHLY):
    @query("buy_score" if _tf is DAILY else f"buy_score_{_tf.name.lower()}", bars_sql(
        "SELECT symbol, date, buy_score, 0 AS selling_score, winning_probability, signal_strength, "
        "CAST((t1 > 0) AS INT) + CAST((t2 > 0) AS INT) + CAST((t3 > 0) AS INT) "
        "+ CAST((t4 > 0) AS INT) + CAST((t5 > 0) AS INT) + CAST((t6 > 0) AS INT) AS trigger_count "
        "FROM one", last_sql(_tf, "one")), "winning_probability")
    def _(spark, sf, _tf=_tf):
        return last_signals(spark, sf, _tf).withColumn(
            "trigger_count", F.size("indicators_triggered")).drop("indicators_triggered")


#: Ranges a few symbols of these tables fall into; the defaults are narrower than all of them.
RANGES = {"DAILY": (1, 24), "WEEKLY": (1, 100), "MONTHLY": (1, 200)}
for _tf in (DAILY, WEEKLY, MONTHLY):
    _lo, _hi = RANGES[_tf.name]

    @query(_named("volatility_liquidity_filter", _tf), bars_sql(f"""
SELECT symbol, (max(high) - min(low)) / min(low) * 100 AS volatility_pct,
       avg(volume) AS avg_volume, stddev_samp(close) / avg(close) * 100 AS price_volatility,
       max(date) AS last_date, min(date) AS first_date, max(date) - min(date) AS days_range
FROM bars WHERE date >= {LATEST} - {_tf.volatility_days} GROUP BY symbol
HAVING avg(volume) >= {min(_tf.volume_min, 5_000_000)}
   AND (max(high) - min(low)) / min(low) * 100 BETWEEN {_lo} AND {_hi}"""),
           "volatility_pct avg_volume:4 price_volatility")
    def _(spark, sf, _tf=_tf):
        lo, hi = RANGES[_tf.name]
        return G.volatility_liquidity_filter(bars(spark, sf), _tf, latest_date(spark, sf),
                                             (float(lo), float(hi)),
                                             min(_tf.volume_min, 5_000_000))


for _tf in (DAILY, WEEKLY, MONTHLY):
    @query(_named("high_probability", _tf), bars_sql(f"""
SELECT s.symbol, s.date, s.buy_score, s.signal_strength, s.winning_probability, s.name, s.close,
       s.volume, r.rsi, m.macd_signal, s.close * {_tf.take_profit_1}::DOUBLE AS tp1,
       s.close * {_tf.take_profit_2}::DOUBLE AS tp2, s.close * {_tf.stop_loss}::DOUBLE AS stop_loss
FROM one s LEFT JOIN rsi_tab r USING (symbol, date) LEFT JOIN macd_tab m USING (symbol, date)
WHERE s.date = {LATEST} AND winning_probability >= 0.55 AND buy_score >= 1
ORDER BY buy_score DESC, winning_probability DESC, symbol LIMIT 10""", last_sql(_tf, "one"), RSI,
                                                     MACD),
           "winning_probability rsi tp1 tp2 stop_loss")
    def _(spark, sf, _tf=_tf):
        b = bars(spark, sf)
        return G.high_probability(last_signals(spark, sf, _tf, b), b, I.rsi_sql(b), I.macd_sma(b),
                                  _tf, latest_date(spark, sf), min_score=1, min_probability=0.55)


def _best_sql(name, tag):
    return (f"(SELECT symbol, name, close, '{tag}' AS tf FROM {name} WHERE date = {LATEST} "
            f"AND winning_probability >= 0.55 AND buy_score >= 1 "
            f"ORDER BY buy_score DESC, winning_probability DESC, symbol LIMIT 5)")


@query("timeframe_confluence", bars_sql(f"""
SELECT symbol, any_value(name) AS name, any_value(close) AS close,
       string_agg(tf, ',' ORDER BY tf) AS timeframes
FROM ({_best_sql('d1', 'Daily')} UNION ALL {_best_sql('w1', 'Weekly')}
      UNION ALL {_best_sql('m1', 'Monthly')})
GROUP BY symbol HAVING count(*) > 1""", last_sql(DAILY, "d1"), last_sql(WEEKLY, "w1"),
                                        last_sql(MONTHLY, "m1")))
def _(spark, sf):
    b = bars(spark, sf)
    found = G.timeframe_confluence(
        {"Daily": last_signals(spark, sf, DAILY, b), "Weekly": last_signals(spark, sf, WEEKLY, b),
         "Monthly": last_signals(spark, sf, MONTHLY, b)}, b, latest_date(spark, sf),
        min_score=1, min_probability=0.55)
    return found.withColumn("timeframes", F.array_join("timeframes", ","))


def _bandar_cte(where=""):
    return f""", bd0 AS (
  SELECT symbol, name, date, close, volume, foreign_buy - foreign_sell AS foreign_net,
    round(avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING
          AND 1 PRECEDING), 0) AS v20,
    (close - prev_close) / nullif(prev_close, 0) * 100 AS pc, prev_close, bid_volume, offer_volume
  FROM bars {where}
), bd1 AS (
  SELECT *, coalesce(CAST(close > prev_close AS INT), 0) AS up,
    coalesce(CAST(volume > 2 * v20 AS INT), 0) + CAST(foreign_net > 0 AS INT)
    + CAST(bid_volume * 2 > offer_volume * 3 AS INT)
    + coalesce(CAST(volume > 1.5e0 * v20 AND abs(pc) < 1 AS INT), 0)
    + coalesce(CAST(close > prev_close AS INT), 0) AS bandar_score
  FROM bd0
), bd AS (
  SELECT symbol, name, date, close, volume / nullif(v20, 0) AS volume_ratio, bandar_score,
    CASE WHEN bandar_score >= 4 THEN 'Sangat Kuat' WHEN bandar_score = 3 THEN 'Kuat'
         WHEN bandar_score = 2 THEN 'Sedang' ELSE 'Lemah' END AS signal_strength,
    CAST(sum(up) OVER (PARTITION BY symbol ORDER BY date ROWS 5 PRECEDING) AS BIGINT)
      AS positive_days_last5, foreign_net,
    lead(pc) OVER (PARTITION BY symbol ORDER BY date) AS next_day_change
  FROM bd1)"""


@query("bandar_history", bars_sql("""
SELECT symbol, date, close, volume_ratio, bandar_score, signal_strength, positive_days_last5,
       foreign_net, next_day_change FROM bd""", _bandar_cte()), "volume_ratio next_day_change")
def _(spark, sf):
    return G.bandar_history(bars(spark, sf)).select(
        "symbol", "date", "close", "volume_ratio", "bandar_score", "signal_strength",
        "positive_days_last5", "foreign_net", "next_day_change")


@query("bandar_score", bars_sql(f"""
SELECT symbol, name, close, volume_ratio, bandar_score, signal_strength, positive_days_last5,
       foreign_net
FROM bd WHERE date = {LATEST} AND bandar_score >= 2 AND volume_ratio > 1.5
ORDER BY bandar_score DESC, volume_ratio DESC, symbol LIMIT 15""",
                                _bandar_cte(f"WHERE date >= {LATEST} - 30")), "volume_ratio")
def _(spark, sf):
    return G.bandar_score(bars(spark, sf), latest_date(spark, sf))


def _advanced_cte(where):
    return f""", ab0 AS (
  SELECT *, foreign_buy - foreign_sell AS net,
    coalesce(avg(volume) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), volume) AS v20,
    coalesce(avg(volume) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), volume) AS v10,
    coalesce(avg(abs(foreign_buy - foreign_sell)) OVER (w ROWS BETWEEN 10 PRECEDING
      AND 1 PRECEDING), abs(foreign_buy - foreign_sell) + 1) AS f10,
    count(*) FILTER (foreign_buy > foreign_sell) OVER (w ROWS 5 PRECEDING) * 1e2 / 6 AS cons
  FROM bars WHERE volume > 0 AND close > 0 AND prev_close > 0 {where}
  WINDOW w AS (PARTITION BY symbol ORDER BY date)
), ab1 AS (
  SELECT *, volume / v20 AS r20, volume / v10 AS r10 FROM ab0
), ab2 AS (
  SELECT *, least(100, greatest(0, (r20 - 1) * 30)) AS s1,
    CASE WHEN r10 > 1.5 THEN least(100, r10 * 20) WHEN r10 > 1.2 THEN least(100, r10 * 15)
         ELSE 0 END AS s2,
    CASE WHEN net > 0 AND f10 > 0 THEN least(100, net / f10 * 25) WHEN net > 0 THEN 50 ELSE 0 END
      AS s3,
    CASE WHEN offer_volume > 0 AND bid_volume > offer_volume
           THEN least(100, (bid_volume / CAST(offer_volume AS DOUBLE) - 1) * 40)
         WHEN bid_volume > 0 AND offer_volume = 0 THEN 70 ELSE 0 END AS s4,
    CASE WHEN r20 > 1.3 AND abs((close - prev_close) / prev_close * 100) < 2.5
         THEN least(100, r20 * 25) ELSE 0 END AS s5,
    CASE WHEN close < prev_close AND r10 > 1.2 THEN 75 WHEN close >= prev_close AND r10 > 1.5
         THEN 60 ELSE 0 END AS s6
  FROM ab1
), ab AS (
  SELECT *, s1 * 0.2e0 + s2 * 0.15e0 + s3 * 0.2e0 + s4 * 0.1e0 + s5 * 0.2e0 + s6 * 0.1e0
            + cons * 0.05e0 AS comp FROM ab2)"""


ADVANCED = ("s1 AS volume_intensity, s2 AS volume_surge, s3 AS foreign_momentum, "
            "s4 AS bid_ask_strength, s5 AS stealth, s6 AS buying_weakness, "
            "cons AS foreign_consistency, comp AS composite_bandar_score, r20 AS volume_ratio")


@query("advanced_bandar_scores", bars_sql(f"SELECT symbol, date, {ADVANCED} FROM ab",
                                          _advanced_cte("")),
       "volume_intensity volume_surge foreign_momentum bid_ask_strength stealth buying_weakness "
       "foreign_consistency composite_bandar_score volume_ratio")
def _(spark, sf):
    return G.with_advanced_bandar(bars(spark, sf)).select(
        "symbol", "date", *G.COMPOSITE_WEIGHTS, "composite_bandar_score", "volume_ratio")


@query("advanced_bandar", bars_sql(f"""
SELECT symbol, name, close, r20 AS volume_ratio, net AS foreign_net, comp AS composite_bandar_score,
  CASE WHEN comp >= 70 THEN 'Sangat Kuat (Tier 1)' WHEN comp >= 55 THEN 'Kuat (Tier 2)'
       WHEN comp >= 40 THEN 'Sedang (Tier 3)' ELSE 'Lemah (Tier 4)' END AS advanced_signal_strength,
  CASE WHEN comp >= 65 AND r20 >= 2 THEN 'Very High Confidence'
       WHEN comp >= 55 AND r20 >= 1.5 THEN 'High Confidence'
       WHEN comp >= 45 AND r20 >= 1.3 THEN 'Medium Confidence'
       WHEN comp >= 35 THEN 'Low-Medium Confidence' ELSE 'Low Confidence' END AS confidence_level,
  CASE WHEN comp >= 65 THEN '1-3 hari' WHEN comp >= 55 THEN '3-7 hari'
       WHEN comp >= 40 THEN '1-2 minggu' ELSE '2+ minggu' END AS expected_timeframe,
  s1 AS volume_intensity, s3 AS foreign_momentum, s5 AS stealth_score, cons AS foreign_consistency
FROM ab WHERE date = {LATEST} AND comp >= 25 AND r20 >= 1.1
ORDER BY comp DESC, r20 DESC, symbol LIMIT 20""", _advanced_cte(f"AND date >= {LATEST} - 30")),
       "volume_ratio composite_bandar_score volume_intensity foreign_momentum stealth_score "
       "foreign_consistency")
def _(spark, sf):
    return G.advanced_bandar(bars(spark, sf), latest_date(spark, sf))


def _rebound_cte(where):
    return RSI + f""", rb0 AS (
  SELECT b.*, r.rsi, foreign_buy - foreign_sell AS foreign_net,
    100 * (b.close / nullif(lag(b.close, 10) OVER w, 0) - 1) AS chg,
    avg(b.close) OVER (w ROWS 2 PRECEDING) AS a3,
    avg(b.close) OVER (w ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS p3,
    volume / nullif(avg(volume) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS vr,
    bid_volume / nullif(CAST(offer_volume AS DOUBLE), 0) AS ba
  FROM (SELECT * FROM bars {where}) b
  LEFT JOIN rsi_tab r ON r.symbol = b.symbol AND r.date = b.date
  WINDOW w AS (PARTITION BY b.symbol ORDER BY b.date)
), rb1 AS (
  SELECT *, CASE WHEN chg <= -20 THEN 5 WHEN chg <= -15 THEN 4 WHEN chg <= -10 THEN 3
                 WHEN chg <= -5 THEN 2 WHEN chg < 0 THEN 1 ELSE 0 END AS q1,
    CASE WHEN rsi <= 25 THEN 5 WHEN rsi <= 30 THEN 4 WHEN rsi <= 35 THEN 3 WHEN rsi <= 40 THEN 2
         ELSE 0 END AS q2,
    CASE WHEN vr >= 3 THEN 5 WHEN vr >= 2 THEN 4 WHEN vr >= 1.5 THEN 3 WHEN vr >= 1.2 THEN 2
         WHEN vr >= 1 THEN 1 ELSE 0 END AS q3,
    CASE WHEN foreign_net > 0 THEN CASE WHEN chg < 0 THEN 3 ELSE 1 END ELSE 0 END AS q4,
    CASE WHEN ba >= 2 THEN 4 WHEN ba >= 1.5 THEN 3 WHEN ba >= 1.2 THEN 2 WHEN ba >= 1 THEN 1
         ELSE 0 END AS q5,
    CASE WHEN chg IS NULL OR chg >= 0 THEN 0 WHEN a3 >= p3 THEN 3 WHEN a3 >= 0.98e0 * p3 THEN 2
         WHEN a3 >= 0.95e0 * p3 THEN 1 ELSE 0 END AS q6
  FROM rb0
), rb AS (
  SELECT symbol, name, date, close, volume, vr AS volume_ratio, rsi, chg AS price_change_10d,
    foreign_net, ba AS bid_ask_ratio, q1 AS price_decline_score, q2 AS rsi_score,
    q3 AS volume_score, q4 AS foreign_flow_score, q5 AS bid_ask_score, q6 AS stabilization_score,
    q1 + q2 + q3 + q4 + q5 + q6 AS rebound_score, (q1 + q2 + q3 + q4 + q5 + q6) / 25e0
      AS rebound_probability,
    CASE WHEN q1 + q2 + q3 + q4 + q5 + q6 >= 15 THEN least(abs(chg) * 0.4e0, 15)
         WHEN q1 + q2 + q3 + q4 + q5 + q6 >= 10 THEN least(abs(chg) * 0.3e0, 10)
         ELSE least(abs(chg) * 0.2e0, 5) END AS expected_rebound_pct
  FROM rb1)"""


REBOUND_ROUND = "volume_ratio rsi price_change_10d bid_ask_ratio rebound_probability expected_rebound_pct"


@query("rebound_history", bars_sql("SELECT * FROM rb", _rebound_cte("")), REBOUND_ROUND)
def _(spark, sf):
    return G.with_rebound(bars(spark, sf), latest_date(spark, sf), 400).select(*G.REBOUND_COLUMNS)


@query("rebound_score", bars_sql(f"""
SELECT * FROM rb WHERE date = {LATEST} AND price_change_10d < -5
  AND (rsi_score > 0 OR volume_score > 0 OR bid_ask_score > 0)
ORDER BY rebound_score DESC, symbol LIMIT 30""", _rebound_cte(f"WHERE date >= {LATEST} - 30")),
       REBOUND_ROUND)
def _(spark, sf):
    return G.rebound_score(bars(spark, sf), latest_date(spark, sf))


@query("wave_overview", bars_sql(f"""
, x AS (
  SELECT m.symbol, m.name, m.close, m.percent_change, m.volume,
    CASE WHEN m.close > s.sma_20 THEN 'UPTREND' WHEN m.close < s.sma_20 THEN 'DOWNTREND'
         ELSE 'SIDEWAYS' END AS trend_direction, r.rsi AS rsi_14, d.macd_signal
  FROM metrics m JOIN sma s USING (symbol, date) JOIN rsi_tab r USING (symbol, date)
  JOIN macd_tab d USING (symbol, date) WHERE m.date = {LATEST}
), y AS (
  SELECT *, CASE WHEN trend_direction = 'UPTREND' AND rsi_14 < 70 AND macd_signal = 'Bullish' THEN 1
                 WHEN trend_direction = 'DOWNTREND' AND rsi_14 > 30 AND macd_signal = 'Bearish'
                 THEN 2 WHEN trend_direction = 'SIDEWAYS' THEN 3 ELSE 4 END AS p FROM x)
SELECT * EXCLUDE (p), ['BULLISH_WAVE', 'BEARISH_WAVE', 'CONSOLIDATION_WAVE', 'MIXED_SIGNAL'][p]
         AS wave_setup
FROM y ORDER BY p, volume DESC, symbol LIMIT 20""", METRICS, SMA, RSI, MACD),
       "percent_change rsi_14")
def _(spark, sf):
    return G.wave_overview(bars(spark, sf), latest_date(spark, sf))


@query("market_bias", bars_sql("""
, f AS (
  SELECT symbol, date,
    CASE primary_trend WHEN 'STRONG_DOWNTREND' THEN -8 WHEN 'DOWNTREND' THEN -5
         WHEN 'STRONG_UPTREND' THEN 8 WHEN 'UPTREND' THEN 5 ELSE 0 END AS trend_score,
    CASE wave_position WHEN 'BEAR_WAVE_4' THEN -3 WHEN 'BEAR_WAVE_2' THEN -6
         WHEN 'BEAR_WAVE_3' THEN -4 WHEN 'BULL_WAVE_2' THEN 6 WHEN 'BULL_WAVE_3' THEN 4
         WHEN 'BULL_WAVE_4' THEN 3 WHEN 'BEAR_WAVE_5' THEN -1 WHEN 'BULL_WAVE_5' THEN -1 ELSE 0 END
      AS wave_score,
    CASE WHEN rsi_14 < 25 THEN 4 WHEN rsi_14 < 30 THEN 2 WHEN rsi_14 > 75 THEN -4
         WHEN rsi_14 > 70 THEN -2 ELSE 0 END AS momentum_score,
    CASE WHEN primary_trend LIKE '%DOWNTREND' THEN CASE WHEN close < bear_fib_61_8 THEN -2
              WHEN close > bear_fib_61_8 THEN 1 ELSE 0 END
         WHEN primary_trend LIKE '%UPTREND' THEN CASE WHEN close > bull_fib_61_8 THEN 2
              WHEN close < bull_fib_61_8 THEN -1 ELSE 0 END ELSE 0 END AS fibonacci_score,
    CASE WHEN volume <= 2 * avg_volume_20 THEN 0 WHEN primary_trend LIKE '%DOWNTREND' THEN -1
         WHEN primary_trend LIKE '%UPTREND' THEN 1 ELSE 0 END AS volume_score
  FROM waves
), t AS (SELECT *, trend_score + wave_score + momentum_score + fibonacci_score + volume_score
                     AS bias_score FROM f)
, k AS (SELECT *, CASE WHEN bias_score <= -10 THEN 1 WHEN bias_score <= -5 THEN 2
  WHEN bias_score <= -2 THEN 3 WHEN bias_score <= 2 THEN 4 WHEN bias_score <= 5 THEN 5
  WHEN bias_score <= 10 THEN 6 ELSE 7 END AS b FROM t)
SELECT * EXCLUDE (b), ['STRONG BEARISH', 'BEARISH', 'WEAK BEARISH', 'NEUTRAL', 'WEAK BULLISH',
  'BULLISH', 'STRONG BULLISH'][b] AS market_bias,
  ['Very High', 'High', 'Medium', 'Low', 'Medium', 'High', 'Very High'][b] AS confidence,
  ['Bearish: 80-90% | Bullish: 10-20%', 'Bearish: 65-75% | Bullish: 25-35%',
   'Bearish: 55-60% | Bullish: 40-45%', 'Bearish: 45-55% | Bullish: 45-55%',
   'Bearish: 40-45% | Bullish: 55-60%', 'Bearish: 25-35% | Bullish: 65-75%',
   'Bearish: 10-20% | Bullish: 80-90%'][b] AS probability
FROM k""", WAVE))
def _(spark, sf):
    return G.market_bias(bars(spark, sf))


def _level_rows():
    rows = []
    for side in ("bull", "bear"):
        for n in ["0", *[n for n, _ in FIB_RATIOS], "100"]:
            rows.append(f"SELECT b.symbol, b.date, b.close, '{side}' AS side, "
                        f"'{n.replace('_', '.')}%' AS level, {side}_fib_{n} AS price FROM last_bar b "
                        "JOIN fib f ON f.symbol = b.symbol AND f.date = b.date")
    return " UNION ALL ".join(rows)


@query("fib_status", bars_sql(f"""
, last_bar AS (SELECT symbol, max(date) AS date, last(close ORDER BY date) AS close FROM bars
               GROUP BY symbol), lv AS ({_level_rows()})
SELECT *, CASE WHEN price <= 0 THEN 'N/A' WHEN close > price OR (close = price AND side = 'bear')
               THEN 'Above' ELSE 'Below' END AS status FROM lv""", FIB), "price")
def _(spark, sf):
    return G.fib_status(bars(spark, sf))


@query("signals_by_strength", bars_sql("""
SELECT signal_strength, count(*) AS signals, avg(winning_probability) AS avg_probability
FROM sig GROUP BY signal_strength""", history_sql(DAILY)), "avg_probability")
def _(spark, sf):
    return G.signal_history(bars(spark, sf), DAILY).groupBy("signal_strength").agg(
        F.count("*").alias("signals"), F.avg("winning_probability").alias("avg_probability"))
