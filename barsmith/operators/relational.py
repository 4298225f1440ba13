"""Join and aggregation shapes over bars, indicators, signals and news.

No join carries a broadcast hint unless one side is a single row: Spark
broadcasts a side below ``autoBroadcastJoinThreshold`` and shuffles beyond
it, and AQE splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barsmith.functions.frames import running, whole_symbol
from barsmith.functions.scalar import ColumnLike, col, ratio, return_fraction

KEYS = ("symbol", "date")


# --- joins -----------------------------------------------------------------


def join_inner_symbol_date(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, list(KEYS), "inner")


def join_left_chain(base: DataFrame, *others: DataFrame) -> DataFrame:
    """Left joins of several (symbol, date) tables onto the base."""
    out = base
    for other in others:
        out = out.join(other, list(KEYS), "left")
    return out


def join_full_outer(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Full outer join; key columns are taken from whichever side has the row."""
    return left.join(right, list(keys), "full")


def join_full_outer_3way(a: DataFrame, b: DataFrame, c: DataFrame,
                         keys: Sequence[str]) -> DataFrame:
    """Two full joins; the using-join coalesces the keys between them."""
    return a.join(b, list(keys), "full").join(c, list(keys), "full")


def join_dim(facts: DataFrame, dim: DataFrame, how: str = "inner") -> DataFrame:
    return facts.join(dim, "symbol", how)


def latest_date(df: DataFrame, fallback: object = None, date_col: str = "date") -> DataFrame:
    """One row: the latest date, or the fallback when there is none."""
    value = F.max(date_col)
    if fallback is not None:
        value = F.coalesce(value, F.lit(fallback).cast("date"))
    return df.agg(value.alias("latest_date"))


def join_latest_date(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Rows of the latest date, by a broadcast of one row."""
    return (df.crossJoin(F.broadcast(latest_date(df, date_col=date_col)))
            .filter(F.col(date_col) == F.col("latest_date")))


def period_first_last_close(bars: DataFrame, unit: str) -> DataFrame:
    """First and last close of each symbol's period in one aggregation."""
    return bars.groupBy("symbol", F.trunc("date", unit).alias("period_start")).agg(
        F.min_by("close", "date").alias("period_open"),
        F.max_by("close", "date").alias("period_close"))


def join_date_offset(left: DataFrame, bars: DataFrame, days: int, value: str = "close",
                     name: str = "offset_close", date_col: str = "date",
                     how: str = "inner") -> DataFrame:
    """Attach the bar exactly ``days`` calendar days on; an equi join on the shifted date."""
    shifted = bars.select("symbol", F.date_sub("date", days).alias(date_col),
                          F.col(value).alias(name))
    return left.join(shifted, ["symbol", date_col], how)


def join_date_range(events: DataFrame, bars: DataFrame, first: int, last: int,
                    date_col: str) -> DataFrame:
    """Bars dated ``first``..``last`` days after each event.

    The event is repeated once per calendar day of the range, which turns the
    range join into an equi join on (symbol, date): no symbol-wide pairing.
    """
    days = F.sequence(F.lit(first), F.lit(last))
    fanned = (events.withColumn("_k", F.explode(days))
              .withColumn("date", F.date_add(date_col, F.col("_k"))).drop("_k"))
    return fanned.join(bars, ["symbol", "date"], "inner")


def cross_join_kpis(*one_row: DataFrame) -> DataFrame:
    """Side by side of frames that hold exactly one row each."""
    out = one_row[0]
    for other in one_row[1:]:
        out = out.crossJoin(F.broadcast(other))
    return out


def day_number() -> WindowSpec:
    """Date order as an integer, for frames measured in calendar days."""
    return Window.partitionBy("symbol").orderBy(F.unix_date("date"))


def prior_range(agg: Callable[[str], Column], column: str, first: int, last: int) -> Column:
    """Aggregate over the bars dated ``first``..``last`` calendar days before the current one."""
    return agg(column).over(day_number().rangeBetween(-first, -last))


def prior_range_max(bars: DataFrame, days: int = 20) -> DataFrame:
    """Highest high and mean volume of the preceding calendar days."""
    return bars.select("symbol", "date", "close",
                       prior_range(F.max, "high", days, 1).alias("prior_high"),
                       prior_range(F.avg, "volume", days, 1).alias("prior_avg_volume"))


def running_total(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(column).over(running()))


def semi_join_having(bars: DataFrame, having: Column, *aggs: Column,
                     within: DataFrame | None = None) -> DataFrame:
    """Bars of the symbols whose aggregate satisfies ``having``."""
    source = bars if within is None else within
    keep = source.groupBy("symbol").agg(*aggs).filter(having).select("symbol")
    return bars.join(keep, "symbol", "left_semi")


def anti_join_new_rows(updates: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Update rows whose key the target does not hold."""
    return updates.join(target.select(*keys), list(keys), "left_anti")


def optional_join(left: DataFrame, right: DataFrame | None, keys: Sequence[str] = KEYS,
                  columns: dict[str, str] | None = None) -> DataFrame:
    """Left join that is skipped, with typed NULL columns, when the other table is absent."""
    if right is not None:
        return left.join(right, list(keys), "left")
    missing = {c: F.lit(None).cast(t) for c, t in (columns or {}).items()}
    return left.withColumns(missing) if missing else left


# --- aggregations ----------------------------------------------------------


def period_rollup(bars: DataFrame, unit: str) -> DataFrame:
    """Per symbol and period: date range, mean daily return, volume."""
    out = bars.withColumn("_r", return_fraction("close", "prev_close"))
    return out.groupBy("symbol", F.trunc("date", unit).alias("period_start")).agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.avg("_r").alias("avg_daily_return"), F.sum("volume").alias("period_volume"))


def win_rates(results: DataFrame, by: str = "buy_score") -> DataFrame:
    """Signals, wins, win rate and mean return per score."""
    return results.groupBy(by).agg(
        F.count("*").alias("total_signals"),
        F.count_if(F.col("is_win")).alias("win_count"),
        (F.avg(F.when(F.col("is_win"), 1.0).otherwise(0.0)) * 100).alias("win_rate"),
        F.avg("percent_change").alias("avg_return"))


def symbol_profile(bars: DataFrame) -> DataFrame:
    """Range, liquidity and dispersion per symbol."""
    return bars.groupBy("symbol").agg(
        F.max("high").alias("max_high"), F.min("low").alias("min_low"),
        F.avg("volume").alias("avg_volume"), F.stddev_samp("close").alias("std_dev"),
        F.avg("close").alias("avg_price"), F.max("date").alias("last_date"),
        F.min("date").alias("first_date"))


def error_metrics(predictions: DataFrame, predicted: ColumnLike = "predicted_close",
                  actual: ColumnLike = "actual_close", by: Sequence[str] = ("symbol",)) -> DataFrame:
    """RMSE, MAE and MAPE of the rows whose actual value is known."""
    diff = col(predicted) - col(actual)
    return predictions.filter(col(actual).isNotNull()).groupBy(*by).agg(
        F.sqrt(F.avg(diff * diff)).alias("rmse"),
        F.avg(F.abs(diff)).alias("mae"),
        (F.avg(ratio(F.abs(diff), actual)) * 100).alias("mape"),
        F.count("*").alias("prediction_count"))


def guarded_ratio(num: Column, den: Column) -> Column:
    """Quotient of two aggregates in percent; 0 where the divisor is 0."""
    return F.coalesce(ratio(num, den) * 100, F.lit(0.0))


def in_whole_symbol(agg: Column) -> Column:
    return agg.over(whole_symbol())
