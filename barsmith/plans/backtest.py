"""Backtest, optimisation and forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barsmith.operators import backtest as B
from barsmith.operators import forecast as P
from barsmith.operators import indicators as I
from barsmith.operators import market as M
from barsmith.operators import signals as G
from barsmith.operators.relational import win_rates
from barsmith.params import DAILY, MACD_GRID, MONTHLY, RSI_GRID, WEEKLY
from barsmith.plans.inputs import bars, forecasts, latest_date
from barsmith.plans.market import FORECASTS
from barsmith.plans.registry import query
from barsmith.plans.signals import history_sql, last_signals, last_sql
from barsmith.plans.sqlbase import MACD, METRICS, RSI, bars_sql
from barsmith.plans.storage import work_dir

D = "(SELECT d FROM anchor)"

# Scores of 5 and more are rare on these tables, so the queries take 3 and more.
def results_sql(tf):
    return history_sql(tf) + f""", res AS (
  SELECT s.symbol, s.date AS signal_date, s.buy_score, s.winning_probability,
    e.close AS entry_price, x.close AS exit_price, (x.close - e.close) / e.close * 100
      AS percent_change, (x.close - e.close) / e.close * 100 > {tf.win_pct} AS is_win
  FROM sig s JOIN bars e ON e.symbol = s.symbol AND e.date = s.date
  JOIN bars x ON x.symbol = s.symbol AND x.date = s.date + {tf.hold_days}
  WHERE s.date BETWEEN {D} - {tf.backtest_days} AND {D} - {tf.hold_days} AND s.buy_score >= 3)"""


RESULTS = results_sql(DAILY)

RATES = """, rates AS (
  SELECT buy_score, count(*) AS total_signals, count(*) FILTER (is_win) AS win_count,
         count(*) FILTER (is_win) * 1e2 / count(*) AS win_rate, avg(percent_change) AS avg_return
  FROM res GROUP BY buy_score)"""


def _signals(spark, sf, b, tf=DAILY):
    return G.signal_history(b, tf)


def _results(spark, sf, b, signals=None, tf=DAILY):
    signals = signals if signals is not None else _signals(spark, sf, b, tf)
    return B.backtest(signals, b, tf, latest_date(spark, sf), min_score=3)


def _named(name, tf):
    return name if tf is DAILY else f"{name}_{tf.name.lower()}"


for _tf in (DAILY, WEEKLY, MONTHLY):
    @query(_named("backtest", _tf), bars_sql("SELECT * FROM res", results_sql(_tf)),
           "winning_probability percent_change")
    def _(spark, sf, _tf=_tf):
        return _results(spark, sf, bars(spark, sf), tf=_tf)


@query("buy_score_observed", bars_sql("""
SELECT o.symbol, o.date, o.buy_score,
       coalesce(r.win_rate / 100, o.winning_probability) AS winning_probability
FROM one o LEFT JOIN rates r ON r.buy_score = o.buy_score""", RESULTS, RATES,
                                      last_sql(DAILY, "one")), "winning_probability")
def _(spark, sf):
    """Signals of the last bars; their probability is the win rate that the back-test observed."""
    b = bars(spark, sf)
    rates = win_rates(_results(spark, sf, b))
    return last_signals(spark, sf, DAILY, b, rates).select("symbol", "date", "buy_score",
                                                          "winning_probability")


@query("win_rates", bars_sql("SELECT * FROM rates", RESULTS, RATES), "win_rate avg_return")
def _(spark, sf):
    return win_rates(_results(spark, sf, bars(spark, sf)))


@query("recalibrate_probability", bars_sql(f"""
SELECT s.symbol, s.date, s.buy_score,
  CASE WHEN s.date >= {D} - 60 AND r.win_rate IS NOT NULL THEN round(r.win_rate / 100, 4)
       ELSE s.winning_probability END AS winning_probability
FROM sig s LEFT JOIN rates r USING (buy_score)""", RESULTS, RATES), "winning_probability", 4)
def _(spark, sf):
    b = bars(spark, sf)
    s = _signals(spark, sf, b)
    return B.recalibrate_probability(s, _results(spark, sf, b, s), latest_date(spark, sf),
                                     days=60).select("symbol", "date", "buy_score",
                                                     "winning_probability")


for _tf in (DAILY, WEEKLY, MONTHLY):
    @query(_named("recent_performance", _tf), bars_sql(f"""
SELECT s.symbol, s.date AS signal_date, s.buy_score, s.winning_probability, e.close AS entry_price,
  x.close AS exit_price, (x.close - e.close) / e.close * 100 AS percent_change,
  (x.close - e.close) / e.close * 100 > 2 AS is_win, e.name
FROM sig s JOIN bars e ON e.symbol = s.symbol AND e.date = s.date
JOIN bars x ON x.symbol = s.symbol AND x.date = s.date + {_tf.report_hold_days}
WHERE s.date BETWEEN {D} - {_tf.performance_days} AND {D} - {_tf.report_hold_days}
  AND s.winning_probability >= 0.6
ORDER BY signal_date DESC, percent_change DESC, s.symbol LIMIT 10""", history_sql(_tf)),
           "winning_probability percent_change")
    def _(spark, sf, _tf=_tf):
        b = bars(spark, sf)
        return B.recent_performance(_signals(spark, sf, b, _tf), b, _tf, latest_date(spark, sf),
                                    min_probability=0.6)


@query("performance_by_score", bars_sql(f"""
SELECT buy_score, count(*) AS total_signals, count(*) FILTER (is_win) AS win_count,
       count(*) FILTER (is_win) * 1e2 / count(*) AS win_rate, avg(percent_change) AS avg_return
FROM res WHERE signal_date >= {D} - 60 GROUP BY buy_score""", RESULTS), "win_rate avg_return")
def _(spark, sf):
    return B.performance_by_score(_results(spark, sf, bars(spark, sf)),
                                  latest_date(spark, sf))


def _values(xs):
    return "[" + ", ".join(map(str, xs)) + "]"


@query("param_grid", bars_sql(f"""
SELECT symbol, p AS period, o AS oversold, h AS overbought
FROM (SELECT DISTINCT symbol FROM bars), unnest({_values(RSI_GRID['period'])}) AS a(p),
     unnest({_values(RSI_GRID['oversold'])}) AS b(o), unnest({_values(RSI_GRID['overbought'])}) AS c(h)
"""))
def _(spark, sf):
    return B.param_grid(bars(spark, sf).select("symbol").distinct(), RSI_GRID)


STATS = """count(*) AS n, avg(r1) * 100 AS a1, avg(r5) * 100 AS a5,
         count(*) FILTER (r1 > 0) * 1e2 / count(*) AS w1, count(*) FILTER (r5 > 0) * 1e2 / count(*) AS w5"""
ZEROED = """CASE WHEN n IS NULL THEN 0 ELSE a1 END AS avg_return_1d,
  CASE WHEN n IS NULL THEN 0 ELSE a5 END AS avg_return_5d, coalesce(w1, 0) AS win_rate_1d,
  coalesce(w5, 0) AS win_rate_5d, coalesce(n, 0) AS signal_count,
  coalesce(w5, 0) * 5e-1 + CASE WHEN n IS NULL THEN 0 ELSE a5 END * 5e-1 AS score"""
FORWARD = f""", fwd AS (
  SELECT symbol, date, close, lead(close) OVER w / close - 1 AS r1, lead(close, 5) OVER w / close - 1 AS r5,
    close - lag(close) OVER w AS c, row_number() OVER w AS rn
  FROM bars WHERE date >= {D} - 365 WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


def _rsi_grid_cte():
    parts = " UNION ALL ".join(f"""
  SELECT symbol, r1, r5, {p} AS period, CASE WHEN rn > {p} THEN 100 - 100 / (1 + avg(greatest(c, 0)) OVER w
     / CASE WHEN avg(greatest(-c, 0)) OVER w = 0 THEN 1e-10 ELSE avg(greatest(-c, 0)) OVER w END) END AS rsi
  FROM fwd WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS {p - 1} PRECEDING)"""
                               for p in RSI_GRID["period"])
    return FORWARD + f""", long AS ({parts}), st AS (
  SELECT symbol, period, o AS oversold, {STATS}
  FROM long, unnest({_values(RSI_GRID['oversold'])}) AS t(o) WHERE rsi <= o GROUP BY 1, 2, 3
), rsi_grid AS (
  SELECT s.symbol, p AS period, o AS oversold, h AS overbought, {ZEROED}
  FROM (SELECT DISTINCT symbol FROM bars) s, unnest({_values(RSI_GRID['period'])}) AS a(p),
       unnest({_values(RSI_GRID['oversold'])}) AS b(o),
       unnest({_values(RSI_GRID['overbought'])}) AS c(h)
  LEFT JOIN st ON st.symbol = s.symbol AND st.period = p AND st.oversold = o)"""


GRID_ROUND = "avg_return_1d avg_return_5d win_rate_1d win_rate_5d score"


@query("evaluate_rsi_grid", bars_sql("SELECT * FROM rsi_grid", _rsi_grid_cte()), GRID_ROUND)
def _(spark, sf):
    return B.evaluate_rsi_grid(bars(spark, sf), as_of=latest_date(spark, sf))


def _macd_grid_cte():
    f, s, g = (_values(MACD_GRID[k]) for k in ("fast_period", "slow_period", "signal_period"))
    return FORWARD + f""", cells AS (
  SELECT f, s, g FROM unnest({f}) AS a(f), unnest({s}) AS b(s), unnest({g}) AS c(g)
), mg AS (
  SELECT symbol, rn, r1, r5, f, s, g, close AS ef, close AS es, 0e0 AS sg, 0e0 AS h,
         CAST(NULL AS DOUBLE) AS ph FROM fwd, cells WHERE rn = 1
  UNION ALL
  SELECT symbol, rn, r1, r5, f, s, g, ef, es, sg, ef - es - sg, h FROM (
    SELECT symbol, rn, r1, r5, f, s, g, ef, es, sg + (ef - es - sg) * 2e0 / (g + 1) AS sg, h FROM (
      SELECT n.symbol, n.rn, n.r1, n.r5, m.f, m.s, m.g, m.ef + (n.close - m.ef) * 2e0 / (m.f + 1) AS ef,
             m.es + (n.close - m.es) * 2e0 / (m.s + 1) AS es, m.sg, m.h
      FROM mg m JOIN fwd n ON n.symbol = m.symbol AND n.rn = m.rn + 1))
), ms AS (
  SELECT symbol, f, s, g, {STATS} FROM mg WHERE h > 0 AND ph <= 0 GROUP BY 1, 2, 3, 4
), macd_grid AS (
  SELECT b.symbol, c.f AS fast_period, c.s AS slow_period, c.g AS signal_period, {ZEROED}
  FROM (SELECT DISTINCT symbol FROM bars) b, cells c
  LEFT JOIN ms ON ms.symbol = b.symbol AND ms.f = c.f AND ms.s = c.s AND ms.g = c.g)"""


@query("evaluate_macd_grid", bars_sql("SELECT * FROM macd_grid", _macd_grid_cte()), GRID_ROUND)
def _(spark, sf):
    return B.evaluate_macd_grid(bars(spark, sf), as_of=latest_date(spark, sf))


def _best_sql(indicator, table, names):
    """The best row of each symbol; JSON texts are compared by their fields."""
    pairs = " || ',".join(f"\"{n}\":' || {n}" for n in names)
    return f"""(SELECT '{indicator}' AS indicator, symbol, '{{{pairs} || '}}' AS parameters,
  win_rate_5d, avg_return_5d, signal_count FROM {table}
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(score, 9) DESC NULLS LAST,
                             {', '.join(names)}) = 1)"""


@query("best_parameters", bars_sql(
    f"SELECT * FROM {_best_sql('RSI', 'rsi_grid', list(RSI_GRID))} UNION ALL "
    f"SELECT * FROM {_best_sql('MACD', 'macd_grid', list(MACD_GRID))}",
    _rsi_grid_cte(), _macd_grid_cte().removeprefix(FORWARD)), "win_rate_5d avg_return_5d")
def _(spark, sf):
    """Both indicators; the performance document is taken apart to compare its numbers."""
    b, as_of = bars(spark, sf), latest_date(spark, sf)
    found = {"RSI": B.evaluate_rsi_grid(b, as_of=as_of), "MACD": B.evaluate_macd_grid(b, as_of=as_of)}
    best = B.best_parameters({k: v.withColumn("score", F.round("score", 9)) for k, v in found.items()},
                             {"RSI": list(RSI_GRID), "MACD": list(MACD_GRID)})
    told = F.from_json("performance", "win_rate_5d double, avg_return_5d double, signal_count long")
    return best.withColumn("p", told).select("indicator", "symbol", "parameters", "p.*")


# --- forecasts -------------------------------------------------------------------


def _directions(spark, sf):
    b = bars(spark, sf)
    return P.forecast_direction(forecasts(b), M.daily_metrics(b))


FC_ROUND = "predicted_close prediction_error error_percentage percent_change"


@query("forecast_direction", bars_sql("SELECT * FROM fcd", METRICS, FORECASTS), FC_ROUND)
def _(spark, sf):
    return _directions(spark, sf)


@query("forecast_accuracy", bars_sql("""
, k AS (SELECT symbol, count(*) AS total_predictions, count(actual_close) AS predictions_with_actuals,
    count(*) FILTER (direction_correct) AS correct_direction_predictions,
    avg(error_percentage) AS avg_error_percentage,
    count(*) FILTER (direction_correct) * 1e2 / count(actual_close) AS direction_accuracy_pct
  FROM fcd WHERE actual_close IS NOT NULL GROUP BY symbol),
l AS (SELECT symbol, max(prediction_date) AS latest_prediction_date,
    last(predicted_close ORDER BY prediction_date) AS latest_predicted_close,
    last(prediction_direction ORDER BY prediction_date) AS latest_prediction_direction
  FROM fcd GROUP BY symbol)
SELECT * FROM k LEFT JOIN l USING (symbol)""", METRICS, FORECASTS),
       "avg_error_percentage direction_accuracy_pct latest_predicted_close")
def _(spark, sf):
    return P.forecast_accuracy(_directions(spark, sf))


@query("backfill_actuals", bars_sql("""
SELECT f.symbol, f.prediction_date, f.predicted_close, coalesce(f.actual_close, b.close)
    AS actual_close,
  coalesce(f.prediction_error, abs(f.predicted_close - b.close)) AS prediction_error,
  coalesce(f.error_percentage, abs(f.predicted_close - b.close) / b.close * 100) AS error_percentage
FROM fc f LEFT JOIN bars b ON b.symbol = f.symbol AND b.date = f.prediction_date""", METRICS,
                                    FORECASTS), "predicted_close prediction_error error_percentage")
def _(spark, sf):
    b = bars(spark, sf)
    return P.backfill_actuals(forecasts(b), b)


@query("forecast_error_metrics", bars_sql("""
SELECT symbol, sqrt(avg(power(predicted_close - actual_close, 2))) AS rmse,
  avg(prediction_error) AS mae, avg(error_percentage) AS mape, count(*) AS prediction_count
FROM fc WHERE actual_close IS NOT NULL GROUP BY symbol""", METRICS, FORECASTS), "rmse mae mape")
def _(spark, sf):
    return P.forecast_error_metrics(forecasts(bars(spark, sf)))


def _indicator_rows(b):
    out = I.with_bollinger(I.with_macd_sma(I.with_rsi(b)))
    return out.select("symbol", "date", "rsi", "macd_line", "macd_histogram", "percent_b")


@query("win_features", bars_sql("""
, vr AS (SELECT symbol, date, coalesce(volume / nullif(avg(volume) OVER (PARTITION BY symbol
    ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 0), 1) AS volume_ratio,
    coalesce((close - prev_close) / prev_close * 100, 0) AS daily_change FROM bars)
SELECT r.symbol, r.signal_date AS date, r.buy_score, r.is_win, r.percent_change, v.volume_ratio,
  v.daily_change, coalesce(q.rsi, 0) AS rsi, coalesce(m.macd_line, 0) AS macd_line,
  coalesce(m.macd_histogram, 0) AS macd_histogram, coalesce(f.percent_b, 0) AS percent_b
FROM res r JOIN vr v ON v.symbol = r.symbol AND v.date = r.signal_date
LEFT JOIN rsi_tab q ON q.symbol = r.symbol AND q.date = r.signal_date
LEFT JOIN macd_tab m ON m.symbol = r.symbol AND m.date = r.signal_date
LEFT JOIN flags f ON f.symbol = r.symbol AND f.date = r.signal_date""", RESULTS, RSI, MACD),
       "percent_change volume_ratio daily_change rsi macd_line macd_histogram percent_b")
def _(spark, sf):
    b = bars(spark, sf)
    s = _signals(spark, sf, b)
    return P.win_features(s, _results(spark, sf, b, s), b, _indicator_rows(b))


@query("train_win_classifier")
def _(spark, sf):
    """Win flag of every five-day trade, scored by order count, learnt by a random forest."""
    b = bars(spark, sf)
    every = b.select("symbol", "date", F.col("frequency").alias("buy_score"),
                     F.lit(0.5).alias("winning_probability"))
    res = B.backtest(every, b, DAILY, latest_date(spark, sf), min_score=0)
    # Read by the count, every pass of the fit and both evaluations.
    path = work_dir(spark, "win-features")
    P.win_features(every, res, b, _indicator_rows(b)).write.parquet(path)
    found = P.train_win_classifier(spark.read.parquet(path))
    return found[1] if found else spark.createDataFrame([], "metric string, value double")


@query("minmax_normalize", bars_sql("""
SELECT symbol, date, coalesce((close - min(close) OVER w) / nullif(max(close) OVER w - min(close)
         OVER w, 0), 0) AS close_scaled,
  coalesce((volume - min(volume) OVER w) / nullif(CAST(max(volume) OVER w - min(volume) OVER w
         AS DOUBLE), 0), 0) AS volume_scaled
FROM bars WINDOW w AS (PARTITION BY symbol)"""), "close_scaled volume_scaled")
def _(spark, sf):
    b = bars(spark, sf).select("symbol", "date", "close", "volume")
    return P.minmax_normalize(b, ["close", "volume"]).drop("close", "volume")


SEQUENCES = """
, x AS (SELECT m.symbol, m.date, m.close, CAST(m.volume AS DOUBLE) AS volume, m.percent_change,
               d.macd_line, r.rsi
        FROM metrics m JOIN macd_tab d USING (symbol, date) JOIN rsi_tab r USING (symbol, date)
        WHERE m.percent_change IS NOT NULL),
y AS (SELECT symbol, date, """ + ", ".join(
    f"lag({c}, {k}) OVER w AS {c}_{k}" for c in P.SEQUENCE_FEATURES for k in range(10)) + """,
        lead(close) OVER w AS target, row_number() OVER w AS rn,
        count(*) OVER (PARTITION BY symbol) AS n
      FROM x WINDOW w AS (PARTITION BY symbol ORDER BY date)),
sequences AS (SELECT * EXCLUDE (rn, n), CASE WHEN rn - 10 < floor((n - 10) * 0.8e0) THEN 'train'
                ELSE 'test' END AS split FROM y WHERE rn >= 10 AND target IS NOT NULL)"""


def _sequence_base(b):
    out = I.with_macd_sma(I.with_rsi(M.daily_metrics(b)))
    return out.select("symbol", "date", "close", "volume", "percent_change", "macd_line", "rsi")


@query("sequence_features", bars_sql("SELECT * FROM sequences", METRICS, RSI, MACD, SEQUENCES),
       " ".join(f"{c}_{k}" for c in ("percent_change", "macd_line", "rsi") for k in range(10)))
def _(spark, sf):
    return P.sequence_features(_sequence_base(bars(spark, sf)))


# The normal equations as a list of rows, solved by elimination one column a step.
_INPUTS = ["1e0", *[f"close_{k} / close_0 - 1" for k in range(1, 10)], "macd_line_0 / close_0",
           "rsi_0 / 100", "percent_change_0 / 100"]
_K = len(_INPUTS)
CLOSE_MODEL = f"""
, z AS (SELECT [{", ".join(_INPUTS)}, target / close_0 - 1] AS v FROM sequences
        WHERE split = 'train'),
cells AS (SELECT i, j, sum(v[i] * v[j]) AS s FROM z, range(1, {_K + 1}) a(i), range(1, {_K + 2}) b(j)
          GROUP BY i, j),
damped AS (SELECT c.i, c.j, c.s + CASE WHEN c.i = c.j
             THEN 0.01e0 * n.s * (c.s / n.s - (m.s / n.s) ** 2) ELSE 0 END AS s
           FROM cells c JOIN cells n ON n.i = 1 AND n.j = 1
           JOIN cells m ON m.i = 1 AND m.j = least(c.j, {_K})),
solved(p, a) AS (
  SELECT 1, (SELECT list(r ORDER BY i) FROM (SELECT i, list(s ORDER BY j) AS r FROM damped GROUP BY i))
  UNION ALL
  SELECT p + 1, [[CASE WHEN i = p THEN a[p][j] / a[p][p] ELSE a[i][j] - a[i][p] * a[p][j] / a[p][p] END
                  FOR j IN range(1, {_K + 2})] FOR i IN range(1, {_K + 1})]
  FROM solved WHERE p <= {_K})
"""


@query("next_close_forecast", bars_sql(f"""
SELECT symbol, date + CASE isodow(date) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS prediction_date,
       close_0 * (1 + list_dot_product([{", ".join(_INPUTS)}],
         (SELECT [row[{_K + 1}] FOR row IN a] FROM solved WHERE p = {_K + 1}))) AS predicted_close
FROM y WHERE close_9 IS NOT NULL AND rn = n""", METRICS, RSI, MACD, SEQUENCES, CLOSE_MODEL),
       "predicted_close:5")
def _(spark, sf):
    return P.next_close_forecast(_sequence_base(bars(spark, sf)))


@query("save_model_version", bars_sql("""
, r AS (SELECT min(close) AS lo, max(close) AS hi, min(frequency) AS l2, max(frequency) AS h2
        FROM bars)
SELECT symbol, date, (close - lo) / (hi - lo) AS close_scaled,
       (frequency - l2) / CAST(h2 - l2 AS DOUBLE) AS frequency_scaled, 2 AS version
FROM bars, r"""), "close_scaled frequency_scaled")
def _(spark, sf):
    """Fit a scaler, store two versions, load the latest copy and apply it."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    b = bars(spark, sf).select("symbol", "date", "close", "frequency")
    model = P.fit_scaler(b, ["close", "frequency"])
    path = work_dir(spark, "scaler")
    P.save_model_version(spark, model, path)
    version = P.save_model_version(spark, model, path)
    scaled = PipelineModel.load(f"{path}/latest").transform(b)
    v = vector_to_array("scaled_features")
    return scaled.select("symbol", "date", v[0].alias("close_scaled"),
                         v[1].alias("frequency_scaled"), F.lit(version).alias("version"))
