"""Daily bars from a stream of ticks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from barsmith.sources.tables import upsert_path


def daily_bars(ticks: DataFrame, key: str, ts: str, price: str, size: str | None = None,
               seq: str | None = None, watermark: str = "1 day") -> DataFrame:
    """One-day tumbling windows per symbol; the same plan for a batch or a stream.

    The state of a window is one fixed-size row, and windows older than the
    watermark are dropped from it. Ticks are folded on the map side first.
    """
    src = ticks.withWatermark(ts, watermark) if ticks.isStreaming else ticks
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    order = F.struct(at, F.col(seq)) if seq else at
    volume = F.sum(size) if size else F.count("*")
    out = src.groupBy(F.window(ts, "1 day").alias("_w"), F.col(key).alias("symbol")).agg(
        F.min_by(price, order).alias("open_price"), F.max(price).alias("high"),
        F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        volume.alias("volume"), F.count("*").alias("frequency"))
    return out.select(F.col("symbol").cast("string").alias("symbol"),
                      F.col("_w.start").cast("date").alias("date"), "open_price", "high", "low",
                      "close", "volume", "frequency")


def maintain_daily_bars(bars: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep a bar table current: every batch upserts the windows it changed.

    Update mode publishes a day while it is open; the keyed upsert makes a
    replayed batch harmless.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        upsert_path(batch.sparkSession, target, batch, ["symbol", "date"], "date")

    return (bars.writeStream.outputMode("update").foreachBatch(merge)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


FOLDED = ["symbol", "open_price", "open_at", "open_seq", "high", "low", "close", "close_at",
          "close_seq", "volume", "frequency"]
WHOLE = ["open_at", "open_seq", "close_at", "close_seq", "volume", "frequency"]
EMITTED = ("kind string, symbol string, date date, at timestamp, open_price double, high double, "
           "low double, close double, volume long, frequency long")
DAY_MS = 86_400_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Blocks a key gathers before they become one, and ticks gathered before they are folded.
MOST_BLOCKS, MOST_TICKS = 16, 200_000


class _DayKeeper(StatefulProcessor):
    """Folded bars per day and part of the symbols, a timer that emits them, and later ticks.

    The state of a key is a list of blocks of folded bars, one a batch, merged as soon as there are
    ``MOST_BLOCKS``: a call of Python and of the store serves many symbols, and a batch does not
    write again what earlier ones left. The watermark trails the newest tick by ``keep_ms``; a day
    closes once it has passed the end of the day by ``wait_ms - keep_ms``, that is, once a tick
    ``wait_ms`` beyond the day was seen.
    """

    def __init__(self, wait_ms: int, keep_ms: int):
        self.closing = wait_ms - keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getListState("blocks", "block binary")
        self.count = handle.getValueState("count", "n int")

    def _closes(self, day: dt.date) -> int:
        return ((day - dt.date(1970, 1, 1)).days + 1) * DAY_MS + self.closing

    def _held(self) -> pd.DataFrame:
        return _merged([pa.ipc.open_stream(b).read_pandas() for (b,) in self.blocks.get()])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        day, _ = key
        closes = self._closes(day)
        if timerValues.getCurrentWatermarkInMs() >= closes:
            for ticks in rows:
                yield pd.DataFrame({
                    "kind": "late", "symbol": ticks["symbol"], "date": day, "at": ticks["at"],
                    "open_price": ticks["price"], "high": ticks["price"], "low": ticks["price"],
                    "close": ticks["price"], "volume": ticks["size"], "frequency": 1})
            return
        found: list[pd.DataFrame] = []
        waiting, n = [], 0
        for ticks in rows:
            waiting.append(ticks)
            n += len(ticks)
            if n >= MOST_TICKS:
                found = [_merged([*found, _folded_ticks(pd.concat(waiting))])]
                waiting, n = [], 0
        if n:
            found.append(_folded_ticks(pd.concat(waiting)))
        if not found:
            return
        self.blocks.appendValue((_packed(_merged(found)),))
        held = self.count.get()
        if held is None:
            self.handle.registerTimer(closes)
        blocks = (held[0] if held else 0) + 1
        if blocks >= MOST_BLOCKS:
            self.blocks.put([(_packed(self._held()),)])
            blocks = 1
        self.count.update((blocks,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day, _ = key
        if not self.count.exists():
            return
        bars = self._held()
        self.blocks.clear()
        self.count.clear()
        yield bars.assign(kind="bar", date=day, at=pd.NaT)[
            [c.split()[0] for c in EMITTED.split(", ")]]

    def close(self) -> None:
        pass


def _packed(bars: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(bars, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _fold(rows: pd.DataFrame, newest: bool) -> pd.DataFrame:
    """One row a symbol from rows of bars; first and last go by time, then by sequence number.

    Of closes of equal time and number the last row's stays if ``newest``, else the first row's.
    """
    first = rows.sort_values(["open_at", "open_seq"], kind="stable").drop_duplicates("symbol")
    last = rows.sort_values(["close_at", "close_seq"], kind="stable", ascending=newest)
    last = last.drop_duplicates("symbol", keep="last" if newest else "first")
    out = rows.groupby("symbol", sort=False).agg(
        {"high": "max", "low": "min", "volume": "sum", "frequency": "sum"}).reset_index()
    out = out.merge(first[["symbol", "open_price", "open_at", "open_seq"]], on="symbol").merge(
        last[["symbol", "close", "close_at", "close_seq"]], on="symbol")
    return out[FOLDED].astype(dict.fromkeys(WHOLE, "int64"))


def _folded_ticks(ticks: pd.DataFrame) -> pd.DataFrame:
    price, at, seq = ticks["price"], ticks["at_us"], ticks["seq"]
    return _fold(pd.DataFrame({
        "symbol": ticks["symbol"], "open_price": price, "open_at": at, "open_seq": seq,
        "high": price, "low": price, "close": price, "close_at": at, "close_seq": seq,
        "volume": ticks["size"], "frequency": 1}), newest=True)


def _merged(blocks: list[pd.DataFrame]) -> pd.DataFrame:
    """Blocks of folded bars, the oldest first, as one block."""
    if len(blocks) == 1:
        return blocks[0]
    return _fold(pd.concat(blocks, ignore_index=True), newest=False)


def _folded(held: tuple | None, ticks: pd.DataFrame) -> tuple:
    """The folded bar of one symbol with the ticks of a batch added."""
    blocks = [] if held is None else [pd.DataFrame([("", *held)], columns=FOLDED)]
    bars = _merged([*blocks, _folded_ticks(ticks.assign(symbol=""))])
    return tuple(next(bars[FOLDED[1:]].itertuples(index=False, name=None)))


def closing_bars(ticks: DataFrame, key: str, ts: str, price: str, size: str | None = None,
                 seq: str | None = None, wait: dt.timedelta = dt.timedelta(hours=1),
                 keep: dt.timedelta = dt.timedelta(days=7), parts: int = 64) -> DataFrame:
    """A stream of final daily bars, each emitted once, and of the ticks that came too late.

    ``kind`` is ``bar`` or ``late``. A day closes when a tick ``wait`` beyond its end has been seen
    in an earlier batch; all symbols' bars of the day then leave in one batch. Ticks for a closed
    day come out as they are, as long as they are newer than the newest tick less ``keep``; Spark
    drops and counts (``numRowsDroppedByWatermark``) those older still. Ticks without key, time or
    price are left out. State holds an open day's bars in ``parts`` parts by a hash of the symbol,
    each a list of at most ``MOST_BLOCKS`` blocks; a checkpoint keeps to the number it began with.
    """
    src = ticks.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(price).isNotNull())
    at = F.col(ts).cast("timestamp")
    src = src.select(
        F.col(key).cast("string").alias("symbol"), at.cast("date").alias("date"), at.alias("at"),
        F.unix_micros(at).alias("at_us"), F.col(price).cast("double").alias("price"),
        (F.col(size) if size else F.lit(1)).cast("long").alias("size"),
        (F.col(seq) if seq else F.lit(0)).cast("long").alias("seq"))
    wait_ms, keep_ms = (int(x.total_seconds() * 1000) for x in (wait, keep))
    if wait_ms > keep_ms:
        raise ValueError("keep ticks at least as long as days stay open")
    src = src.withColumn("part", F.pmod(F.xxhash64("symbol"), F.lit(parts)).cast("int"))
    return (src.withWatermark("at", f"{keep_ms} milliseconds").groupBy("date", "part")
            .transformWithStateInPandas(_DayKeeper(wait_ms, keep_ms), EMITTED, "append",
                                        "eventtime"))


def store_closing_bars(emitted: DataFrame, target: str, late: str,
                       checkpoint: str) -> StreamingQuery:
    """Final bars into a folder per day, written once, and late ticks into a folder per batch.

    A batch replayed after a failure writes the same folders again.
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        (batch.where("kind = 'bar'").drop("kind", "at").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(target))
        batch.where("kind = 'late'").select(
            "symbol", "date", "at", F.col("close").alias("price"), F.col("volume").alias("size")
        ).write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
        batch.unpersist()

    conf, name = emitted.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, ROCKS)  # timers need this store; a running query keeps what it started with
    try:
        return (emitted.writeStream.outputMode("append").foreachBatch(keep)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        conf.set(name, before)
