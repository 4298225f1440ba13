"""Backtests and parameter grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barsmith.functions.frames import full, lead, since
from barsmith.functions.scalar import ratio
from barsmith.operators import indicators as I
from barsmith.operators.ewm import bullish_crossings
from barsmith.operators.ranking import top_k
from barsmith.operators.relational import prior_range, win_rates
from barsmith.params import DAILY, MACD_GRID, RSI_GRID, Timeframe


def _priced(signals: DataFrame, bars: DataFrame, hold: int, next_bar: bool = False,
            keep: Sequence[str] = ()) -> DataFrame:
    """Entry close of the signal date and the exit close ``hold`` days on.

    The exit is the bar of exactly that calendar date; ``next_bar`` takes the
    first bar within the ten days from it instead. Both closes come from one
    pass over the bars, so the signals are joined once.
    """
    def ahead(first: int, last: int):
        return prior_range(lambda c: F.first(c, ignorenulls=True), "close", -first, -last)

    price = bars.select("symbol", "date", *keep, F.col("close").alias("entry_price"),
                        ahead(hold, hold + 10 if next_bar else hold).alias("exit_price"))
    out = signals.join(price, ["symbol", "date"]).filter(F.col("exit_price").isNotNull())
    return out.withColumn("percent_change", (F.col("exit_price") - F.col("entry_price"))
                          / F.nullif(F.col("entry_price"), F.lit(0.0)) * 100)


def backtest(signals: DataFrame, bars: DataFrame, tf: Timeframe = DAILY, as_of=None,
             min_score: int = 5, next_bar: bool = False) -> DataFrame:
    """Outcome of every signal old enough to be closed."""
    day = F.lit(as_of).cast("date")
    s = signals.filter((F.col("date") >= F.date_sub(day, tf.backtest_days))
                       & (F.col("date") <= F.date_sub(day, tf.hold_days))
                       & (F.col("buy_score") >= min_score))
    out = _priced(s, bars, tf.hold_days, next_bar)
    return out.select("symbol", F.col("date").alias("signal_date"), "buy_score",
                      "winning_probability", "entry_price", "exit_price", "percent_change",
                      (F.col("percent_change") > tf.win_pct).alias("is_win"))


def recalibrate_probability(signals: DataFrame, results: DataFrame, as_of,
                            days: int = 7) -> DataFrame:
    """Recent signals take the observed win rate of their score.

    One rate per whole score from 0 to 10: at most eleven rows to broadcast.
    """
    scored = results.filter(F.col("buy_score").between(0, 10)).withColumn(
        "buy_score", F.col("buy_score").cast("int"))
    rates = win_rates(scored).select("buy_score",
                                     F.round(F.col("win_rate") / 100, 4).alias("_rate"))
    recent = F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), days)
    out = signals.join(F.broadcast(rates), "buy_score", "left")
    return out.withColumn("winning_probability", F.when(
        recent, F.coalesce("_rate", "winning_probability")).otherwise(
        F.col("winning_probability"))).select(*signals.columns)


def recent_performance(signals: DataFrame, bars: DataFrame, tf: Timeframe = DAILY, as_of=None,
                       min_probability: float = 0.7, win_pct: float = 2.0,
                       k: int = 10) -> DataFrame:
    """Newest completed signals and how they ended."""
    day = F.lit(as_of).cast("date")
    s = signals.filter((F.col("date") >= F.date_sub(day, tf.performance_days))
                       & (F.col("date") <= F.date_sub(day, tf.report_hold_days))
                       & (F.col("winning_probability") >= min_probability))
    out = _priced(s, bars, tf.report_hold_days, keep=["name"]).select(
        "symbol", F.col("date").alias("signal_date"), "buy_score", "winning_probability",
        "entry_price", "exit_price", "percent_change",
        (F.col("percent_change") > win_pct).alias("is_win"), "name")
    return top_k(out, [F.col("signal_date").desc(), F.col("percent_change").desc()], k)


def performance_by_score(results: DataFrame, as_of=None, days: int = 60) -> DataFrame:
    return win_rates(since(results, days, as_of, date_col="signal_date"))


# --- parameter grids -----------------------------------------------------------


def param_grid(df: DataFrame, grid: dict[str, list[int]]) -> DataFrame:
    """Repeat every row once per parameter combination."""
    out = df
    for name, values in grid.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def _with_forward_returns(bars: DataFrame) -> DataFrame:
    c = F.nullif(F.col("close"), F.lit(0.0))
    return bars.withColumns({"return_1d": lead("close", 1) / c - 1,
                             "return_5d": lead("close", 5) / c - 1})


METRICS = ["avg_return_1d", "avg_return_5d", "win_rate_1d", "win_rate_5d", "signal_count", "score"]


SUMS = ["_n", "_sum_1d", "_known_1d", "_wins_1d", "_sum_5d", "_known_5d", "_wins_5d"]


def _tally(signals: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Sums and counts of forward returns per cell: they add up over cells, means do not."""
    sums = [F.count("*").alias("_n")]
    for d in ("1d", "5d"):
        r = F.col(f"return_{d}")
        sums += [F.sum(r).alias(f"_sum_{d}"), F.count(r).alias(f"_known_{d}"),
                 F.count_if(r > 0).alias(f"_wins_{d}")]
    return signals.groupBy(*cell).agg(*sums)


def _evaluate(tally: DataFrame, all_cells: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Forward-return metrics per grid cell; zeros where a cell never signalled.

    A signal without a known return counts as no win, but not in the mean.
    """
    out = all_cells.join(tally, list(cell), "left")
    none = F.coalesce(F.col("_n"), F.lit(0)) == 0
    found = {"signal_count": F.col("_n")}
    for d in ("1d", "5d"):
        found[f"avg_return_{d}"] = F.col(f"_sum_{d}") / F.nullif(F.col(f"_known_{d}"), F.lit(0)) * 100
        found[f"win_rate_{d}"] = ratio(F.col(f"_wins_{d}"), F.col("_n")) * 100
    out = out.withColumns({m: F.when(none, F.lit(0)).otherwise(found[m]) for m in METRICS[:-1]})
    return out.withColumn("score", F.col("win_rate_5d") * 0.5 + F.col("avg_return_5d") * 0.5)


def evaluate_rsi_grid(bars: DataFrame, grid: dict[str, list[int]] | None = None, as_of=None,
                      days: int = 365) -> DataFrame:
    """Metrics of buying when oversold, per symbol and parameter set.

    RSI is computed once per period. A bar counts once per period, in the bin
    between two neighbouring thresholds; running sums over the bins then give
    every threshold, so finer thresholds add no rows before the shuffle. The
    upper threshold does not enter the metrics, so it is attached afterwards.
    """
    grid = grid or RSI_GRID
    src = _with_forward_returns(I.with_gain_loss(since(bars.select("symbol", "date", "close"), days,
                                                       as_of)))
    by_period = []
    for p in grid["period"]:
        gain, loss = full(F.avg("_gain"), "_gain", p), full(F.avg("_loss"), "_loss", p)
        value = 100 - 100 / (1 + gain / F.when(loss == 0, F.lit(1e-10)).otherwise(loss))
        by_period.append((p, value))
    wide = src.select("symbol", "return_1d", "return_5d",
                      *[v.alias(f"_rsi_{p}") for p, v in by_period])
    rows = F.array(*[F.struct(F.lit(p).alias("period"), F.col(f"_rsi_{p}").alias("rsi"))
                     for p, _ in by_period])
    long = wide.select("symbol", "return_1d", "return_5d", F.inline(rows))
    # Bin i holds the bars that threshold i finds and threshold i - 1 does not.
    limits = sorted(set(grid["oversold"]))
    above = F.size(F.filter(F.lit([float(t) for t in limits]), lambda t: t < F.col("rsi")))
    binned = long.filter(F.col("rsi") <= limits[-1]).withColumn(
        "oversold", F.element_at(F.lit(limits), above + 1))
    cells = param_grid(src.select("symbol").distinct(), {"period": grid["period"],
                                                         "oversold": limits})
    cell = ["symbol", "period", "oversold"]
    upto = Window.partitionBy("symbol", "period").orderBy("oversold").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    tally = cells.join(_tally(binned, cell), cell, "left").select(
        *cell, *[F.sum(c).over(upto).alias(c) for c in SUMS])
    out = _evaluate(tally, cells, cell)
    out = param_grid(out, {"overbought": grid["overbought"]})
    return out.select("symbol", "period", "oversold", "overbought", *METRICS)


def evaluate_macd_grid(bars: DataFrame, grid: dict[str, list[int]] | None = None, as_of=None,
                       days: int = 365) -> DataFrame:
    """Metrics of buying bullish histogram crossings, per symbol and parameter set."""
    grid = grid or MACD_GRID
    names = ["fast_period", "slow_period", "signal_period"]
    cells = [(f, s, g) for f in grid[names[0]] for s in grid[names[1]] for g in grid[names[2]]]
    src = _with_forward_returns(since(bars.select("symbol", "date", "close"), days, as_of))
    hits = bullish_crossings(src, cells, keep=["return_1d", "return_5d"])
    # pandas turns a missing return into NaN, which Spark would count as a win.
    hits = hits.withColumns({c: F.nanvl(c, F.lit(None).cast("double"))
                             for c in ("return_1d", "return_5d")})
    every = param_grid(src.select("symbol").distinct(), {n: grid[n] for n in names})
    return _evaluate(_tally(hits, ["symbol", *names]), every, ["symbol", *names]).select("symbol", *names, *METRICS)


def best_parameters(results: dict[str, DataFrame], params: dict[str, Sequence[str]]) -> DataFrame:
    """Best-scoring parameter set per indicator and symbol, as JSON.

    Equal scores go to the smaller parameters. MAX over a packed row keeps
    one candidate per symbol and task.
    """
    out = None
    for indicator, df in results.items():
        names = list(params[indicator])
        order = F.struct(F.coalesce("score", F.lit(float("-inf"))).alias("s"),
                         *[(-F.col(n)).alias(n) for n in names])
        kept = ["win_rate_5d", "avg_return_5d", "signal_count"]
        best = df.groupBy("symbol").agg(F.max_by(F.struct(*names, *kept), order).alias("_b"))
        row = best.select(
            F.lit(indicator).alias("indicator"), "symbol",
            F.to_json(F.struct(*[F.col(f"_b.{n}").alias(n) for n in names])).alias("parameters"),
            F.to_json(F.struct(*[F.col(f"_b.{k}").alias(k) for k in kept])).alias("performance"))
        out = row if out is None else out.unionByName(row)
    return out
