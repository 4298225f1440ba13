"""Exponentially weighted means, the one recursion no window frame expresses.

Spark clusters the rows by symbol and sorts them by date; each task then
streams its Arrow batches once and carries the last value of the open symbol
across batch borders. Memory is one batch, whatever the length of a symbol.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _smooth(symbols: np.ndarray, values: np.ndarray, span: float, carry: tuple | None) -> np.ndarray:
    """EWM (adjust=False) per run of equal symbols.

    ``carry`` is (symbol, last mean) of the previous batch. With adjust=False
    a series may be continued by feeding the last mean in as its first value.
    """
    continued = carry is not None and len(symbols) > 0 and symbols[0] == carry[0]
    if continued:
        symbols = np.concatenate(([symbols[0]], symbols))
        values = np.concatenate(([carry[1]], values))
    out = (pd.Series(values).groupby(symbols, sort=False)
           .ewm(span=span, adjust=False).mean().to_numpy())
    return out[1:] if continued else out


def _previous(symbols: np.ndarray, values: np.ndarray, carry: tuple | None) -> np.ndarray:
    """Value of the row before, NaN at a symbol's first row."""
    out = np.full(len(values), np.nan)
    if len(values) > 1:
        same = symbols[1:] == symbols[:-1]
        out[1:][same] = values[:-1][same]
    if carry is not None and len(values) and symbols[0] == carry[0]:
        out[0] = carry[1]
    return out


def _clustered(df: DataFrame) -> DataFrame:
    return df.repartition("symbol").sortWithinPartitions("symbol", "_day")


def _prepare(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Rows as the Python side wants them: date as day number, all else as is."""
    return df.select("symbol", F.unix_date("date").alias("_day"), *keep)


def _restore(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c not in ("symbol", "_day")]
    return df.select("symbol", F.date_from_unix_date("_day").alias("date"), *rest)


def ewm(df: DataFrame, column: str, span: float, keep: Sequence[str] = ()) -> DataFrame:
    """Add ``ewm``: the recursive mean of ``column`` in date order per symbol."""
    src = _prepare(df, [F.col(column).cast("double").alias("_x"), *keep])
    schema = T.StructType([*[f for f in src.schema.fields if f.name != "_x"],
                           T.StructField("ewm", T.DoubleType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = None
        for pdf in batches:
            if pdf.empty:
                continue
            sym = pdf["symbol"].to_numpy()
            pdf["ewm"] = _smooth(sym, pdf["_x"].to_numpy(), span, carry)
            carry = (sym[-1], pdf["ewm"].iloc[-1])
            yield pdf[names]

    return _restore(_clustered(src).mapInPandas(run, schema))


def with_macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9,
              keep: Sequence[str] = (), emit: str | None = None) -> DataFrame:
    """symbol, date, ``keep``, macd_line, signal_line, macd_histogram, prev_macd_histogram.

    ``emit`` names a boolean column: all rows feed the recursion, only the
    flagged ones leave the task.
    """
    src = _prepare(df, [F.col("close").alias("_x"), *keep,
                        *([F.col(emit).alias("_emit")] if emit else [])])
    added = ["macd_line", "signal_line", "macd_histogram", "prev_macd_histogram"]
    schema = T.StructType([*[f for f in src.schema.fields if f.name not in ("_x", "_emit")],
                           *[T.StructField(c, T.DoubleType()) for c in added]])
    names = schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry: dict[str, tuple | None] = {"fast": None, "slow": None, "sig": None, "hist": None}
        for pdf in batches:
            if pdf.empty:
                continue
            sym, close = pdf["symbol"].to_numpy(), pdf["_x"].to_numpy()
            fast_mean = _smooth(sym, close, fast, carry["fast"])
            slow_mean = _smooth(sym, close, slow, carry["slow"])
            line = fast_mean - slow_mean
            sig = _smooth(sym, line, signal, carry["sig"])
            hist = line - sig
            prev = _previous(sym, hist, carry["hist"])
            for name, series in (("fast", fast_mean), ("slow", slow_mean), ("sig", sig),
                                 ("hist", hist)):
                carry[name] = (sym[-1], series[-1])
            pdf = pdf.assign(macd_line=line, signal_line=sig, macd_histogram=hist,
                             prev_macd_histogram=prev)
            yield (pdf[pdf["_emit"].to_numpy(dtype=bool)] if emit else pdf)[names]

    out = _restore(_clustered(src).mapInPandas(run, schema))
    # pandas marks a missing previous value by NaN; Spark compares NaN as largest.
    return out.withColumn("prev_macd_histogram",
                          F.nanvl("prev_macd_histogram", F.lit(None).cast("double")))


def _by_step(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of a batch's rows by place within their series, and where each place begins.

    ``first`` marks the first row of each series. The longest series come first, so those that
    still have a row at a place are the first ones of the place before.
    """
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(first)))
    rank = np.empty(len(starts), dtype=np.int64)
    rank[np.argsort(-lengths, kind="stable")] = np.arange(len(starts))
    place = np.arange(len(first)) - np.repeat(starts, lengths)
    order = np.lexsort((np.repeat(rank, lengths), place))
    return order, np.append(0, np.cumsum(np.bincount(place)))


def _smooth_steps(x: np.ndarray, begins: np.ndarray, span: np.ndarray, mean: np.ndarray,
                  weight: np.ndarray) -> np.ndarray:
    """EWM (adjust=False) of many columns of rows in the order of ``_by_step``, place by place.

    ``mean`` and ``weight`` hold a row per series (NaN and 1 for one that starts here) and end as
    its last ones. The same operations as pandas, a missing value included: it repeats the mean and
    lowers the weight of the past.
    """
    alpha = 1.0 / (1.0 + (span - 1) / 2.0)
    past = 1.0 - alpha
    out = np.empty_like(x)
    plain = not np.isnan(x).any() and (weight == 1.0).all()
    for t, (lo, hi) in enumerate(zip(begins[:-1], begins[1:], strict=True)):
        now, m, w = x[lo:hi], mean[:hi - lo], weight[:hi - lo]
        if plain and t:
            new = (past * m + alpha * now) / (past + alpha)
            m[:] = np.where(m != now, new, m)
        else:
            seen, known = ~np.isnan(now), ~np.isnan(m)
            w[:] = np.where(known, w * past, w)
            new = (w * m + alpha * now) / (w + alpha)
            m[:] = np.where(seen, np.where(known, np.where(m != now, new, m), now), m)
            w[:] = np.where(seen, 1.0, w)
        out[lo:hi] = m
    return out


def bullish_crossings(df: DataFrame, grid: Sequence[tuple[int, int, int]],
                      keep: Sequence[str] = ()) -> DataFrame:
    """Rows where the MACD histogram of a parameter triple turns positive.

    All spans, then all triples, are smoothed at once over all series of a batch; one output row
    per bar and triple that crosses.
    """
    src = _prepare(df, [F.col("close").alias("_x"), *keep])
    schema = T.StructType([
        *[f for f in src.schema.fields if f.name != "_x"],
        *[T.StructField(c, T.IntegerType()) for c in
          ("fast_period", "slow_period", "signal_period")]])
    names = schema.fieldNames()
    spans = sorted({s for f, w, _ in grid for s in (f, w)})
    fast, slow = ([spans.index(cell[k]) for cell in grid] for k in (0, 1))
    periods = np.array(grid, dtype=np.int32).reshape(-1, 3)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            sym = pdf["symbol"].to_numpy()
            first = np.append(True, sym[1:] != sym[:-1])
            order, begins = _by_step(first)
            n, row = int(begins[1]), np.empty(len(order), dtype=np.int64)
            row[order] = np.arange(len(order))
            state = {"mean": np.full((n, len(spans)), np.nan), "weight": np.ones((n, len(spans))),
                     "signal": np.full((n, len(grid)), np.nan),
                     "signal_weight": np.ones((n, len(grid)))}
            before = np.full(len(grid), np.nan)
            if held is not None and sym[0] == last:
                for name, values in state.items():
                    values[row[0]] = held[name]
                before = held["hist"]
            close = pdf["_x"].to_numpy(dtype=float)[order][:, None]
            means = _smooth_steps(np.repeat(close, len(spans), axis=1), begins,
                                  np.array(spans, dtype=float), state["mean"], state["weight"])
            line = means[:, fast] - means[:, slow]
            signal = _smooth_steps(line, begins, periods[:, 2].astype(float), state["signal"],
                                   state["signal_weight"])
            hist = (line - signal)[row]
            prev = np.vstack([before, hist[:-1]])
            prev[first & (np.arange(len(first)) > 0)] = np.nan
            # The series of the last row, by its place among those that begin in this batch.
            open_series = row[np.flatnonzero(first)[-1]]
            last = sym[-1]
            held = {name: values[open_series].copy() for name, values in state.items()}
            held["hist"] = hist[-1]
            with np.errstate(invalid="ignore"):
                at, cell = np.nonzero((hist > 0) & (prev <= 0))
            if len(at):
                yield pdf.iloc[at].assign(
                    fast_period=periods[cell, 0], slow_period=periods[cell, 1],
                    signal_period=periods[cell, 2])[names]

    return _restore(_clustered(src).mapInPandas(run, schema))
