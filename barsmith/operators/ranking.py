"""Ranks, top-k and per-symbol selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsmith.functions.frames import by_symbol, tail
from barsmith.functions.scalar import ColumnLike, col


def latest_per(df: DataFrame, key: str = "symbol", order: str = "date") -> DataFrame:
    """Newest row of each key.

    MAX_BY over the packed row keeps one candidate per key and task before
    the shuffle, where a row_number would move and sort every row.
    """
    rest = [c for c in df.columns if c != key]
    packed = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return packed.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def row_number_latest(df: DataFrame) -> DataFrame:
    """Position of each row counted from the newest of its symbol."""
    newest_first = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    return df.withColumn("row_num", F.row_number().over(newest_first))


def top_k(df: DataFrame, order: Sequence[Column], k: int, tie: str = "symbol") -> DataFrame:
    """First k rows; ties fall back to the symbol, so the result is determined."""
    return df.orderBy(*order, F.col(tie).asc()).limit(k)


def tail_n(df: DataFrame, n: int) -> DataFrame:
    return tail(df, n)


def _tally(df: DataFrame, value: str, by: Sequence[str], splits: Sequence[float]) -> DataFrame:
    """Per group and distinct value: rows with it (n), below it, and in the group.

    Equal values collapse before the shuffle. Each group is then summed in
    ``len(splits) + 1`` value ranges instead of one ordered pass: a running
    sum inside the range plus the total of the ranges below. The split points
    are literals, so a recomputed task sees the same ranges.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count("*").alias("_n"))
    points = F.array(*[F.lit(float(s)) for s in splits]) if splits else F.array().cast(
        "array<double>")
    counts = counts.withColumn("_range", F.size(F.filter(points, lambda s: s < F.col(value))))
    totals = counts.groupBy(*by, "_range").agg(F.sum("_n").alias("_t"))
    # At most len(splits) + 1 rows per group from here on.
    ranges = Window.partitionBy(*by)
    totals = totals.select(
        *by, "_range",
        (F.sum("_t").over(ranges.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
         - F.col("_t")).alias("_lower"),
        F.sum("_t").over(ranges).alias("_total"))
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(
        Window.unboundedPreceding, 0)
    out = counts.withColumn("_upto", F.sum("_n").over(inside)).join(totals, [*by, "_range"])
    return out.select(*by, value, "_n", (F.col("_lower") + F.col("_upto") - F.col("_n"))
                      .alias("_below"), "_total")


def split_points(df: DataFrame, value: str, ranges: int = 64) -> list[float]:
    """Approximate quantiles that cut the values into ranges of similar size."""
    probs = [i / ranges for i in range(1, ranges)]
    return sorted(set(df.approxQuantile(value, probs, 0.005)))


def with_rank(df: DataFrame, value: str, name: str, by: Sequence[str] = (),
              descending: bool = False, splits: Sequence[float] | None = None) -> DataFrame:
    """RANK() without an unpartitioned window; NULL values get no rank."""
    splits = split_points(df, value) if splits is None else splits
    tally = _tally(df, value, by, splits)
    below = F.col("_total") - F.col("_below") - F.col("_n") if descending else F.col("_below")
    ranks = tally.select(*by, value, (below + 1).alias(name))
    return df.join(ranks, [*by, value], "left").select(*df.columns, name)


def with_pct_rank_avg(df: DataFrame, value: str, name: str, by: Sequence[str] = (),
                      splits: Sequence[float] | None = None) -> DataFrame:
    """Average rank of ties as a share of the group's non-null rows."""
    splits = split_points(df, value) if splits is None else splits
    tally = _tally(df, value, by, splits)
    share = (F.col("_below") + (F.col("_n") + 1) / 2) / F.col("_total")
    return df.join(tally.select(*by, value, share.alias(name)), [*by, value], "left").select(
        *df.columns, name)


def set_membership(tagged: DataFrame, key: str, tag: str, at_least: int = 2) -> DataFrame:
    """Keys that carry at least so many distinct tags; the tag set is tiny by construction."""
    return (tagged.groupBy(key).agg(F.sort_array(F.collect_set(tag)).alias("tags"))
            .filter(F.size("tags") >= at_least))


def union_tagged(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """UNION ALL of frames with a literal tag each."""
    out = None
    for name, df in parts.items():
        piece = df.withColumn(tag, F.lit(name))
        out = piece if out is None else out.unionByName(piece)
    return out


def positions(df: DataFrame) -> DataFrame:
    return df.withColumn("row_num", F.row_number().over(by_symbol()))


def abs_desc(c: ColumnLike) -> Column:
    return F.abs(col(c)).desc_nulls_last()
