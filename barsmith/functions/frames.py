"""Window frames over one symbol's bars.

(symbol, date) is a key of the bars, so a symbol's window holds at most one
row per trading date: a few hundred a year, however many ticks a hot symbol
prints. Every operator uses the one (symbol, date) specification below, so
stacked windows share a single exchange and a single sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barsmith.functions.scalar import ColumnLike, col


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def whole_symbol() -> WindowSpec:
    return Window.partitionBy("symbol")


def last_n(n: int, spec: WindowSpec | None = None) -> WindowSpec:
    """The current row and the n-1 before it."""
    return (spec or by_symbol()).rowsBetween(-(n - 1), 0)


def before(n: int, spec: WindowSpec | None = None) -> WindowSpec:
    """The n rows before the current one."""
    return (spec or by_symbol()).rowsBetween(-n, -1)


def between(start: int, end: int, spec: WindowSpec | None = None) -> WindowSpec:
    """Rows from ``start`` back to ``end`` back, both inclusive."""
    return (spec or by_symbol()).rowsBetween(-start, -end)


def running(spec: WindowSpec | None = None) -> WindowSpec:
    return (spec or by_symbol()).rowsBetween(Window.unboundedPreceding, 0)


def avg_n(c: ColumnLike, n: int) -> Column:
    return F.avg(col(c)).over(last_n(n))


def avg_before(c: ColumnLike, n: int) -> Column:
    return F.avg(col(c)).over(before(n))


def lag(c: ColumnLike, k: int = 1) -> Column:
    return F.lag(col(c), k).over(by_symbol())


def lead(c: ColumnLike, k: int = 1) -> Column:
    return F.lead(col(c), k).over(by_symbol())


def full(agg: Column, c: ColumnLike, n: int) -> Column:
    """An aggregate over n rows that is NULL until n values are there."""
    return F.when(F.count(col(c)).over(last_n(n)) == n, agg.over(last_n(n)))


def tail(df: DataFrame, n: int) -> DataFrame:
    """Last n rows of each symbol.

    A row is among the last n when nothing follows it n places on: one LEAD
    in the ascending order the other windows already sorted by.
    """
    return df.withColumn("_ahead", lead("date", n)).filter(F.col("_ahead").isNull()).drop("_ahead")


def since(df: DataFrame, days: int | None, as_of=None, months: int | None = None,
          date_col: str = "date") -> DataFrame:
    """Rows dated within the look-back ending at ``as_of``.

    A given ``as_of`` is a literal, so the range reaches the scan. Without it
    the latest date of the input is joined in as a one-row broadcast.
    """
    d = F.col(date_col)
    if as_of is not None:
        end = F.lit(as_of).cast("date")
        out = df.filter(d <= end)
    else:
        latest = df.agg(F.max(date_col).alias("_as_of"))
        out = df.crossJoin(F.broadcast(latest))
        end = F.col("_as_of")
    if months is not None:
        out = out.filter(d >= F.add_months(end, -months))
    elif days is not None:
        out = out.filter(d >= F.date_sub(end, days))
    return out.drop("_as_of")


def on_date(df: DataFrame, as_of=None, back: int = 0, date_col: str = "date") -> DataFrame:
    """Rows of the ``as_of`` date (or ``back`` days earlier)."""
    if as_of is not None:
        return df.filter(F.col(date_col) == F.date_sub(F.lit(as_of).cast("date"), back))
    latest = df.agg(F.max(date_col).alias("_as_of"))
    return (df.crossJoin(F.broadcast(latest))
            .filter(F.col(date_col) == F.date_sub("_as_of", back)).drop("_as_of"))
