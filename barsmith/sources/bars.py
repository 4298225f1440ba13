"""Bars: schema, ingest of daily summary files, bars built from ticks."""

from __future__ import annotations

import codecs
import collections
import csv
import io
import uuid
from collections.abc import Callable, Iterator
from functools import partial, reduce

import pyarrow as pa
import pyarrow.csv as pacsv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barsmith.functions.frames import by_symbol
from barsmith.session import shared_dir
from barsmith.sources.tables import processing_log

# Column order and types of a daily bar.
BAR_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("prev_close", T.DoubleType()),
    T.StructField("open_price", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("change", T.DoubleType()),
    T.StructField("volume", T.LongType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("frequency", T.IntegerType()),
    T.StructField("index_individual", T.DoubleType()),
    T.StructField("weight_for_index", T.DoubleType()),
    T.StructField("foreign_buy", T.LongType()),
    T.StructField("foreign_sell", T.LongType()),
    T.StructField("offer", T.DoubleType()),
    T.StructField("offer_volume", T.LongType()),
    T.StructField("bid", T.DoubleType()),
    T.StructField("bid_volume", T.LongType()),
    T.StructField("listed_shares", T.LongType()),
    T.StructField("tradable_shares", T.LongType()),
    T.StructField("non_regular_volume", T.LongType()),
    T.StructField("non_regular_value", T.DoubleType()),
    T.StructField("non_regular_frequency", T.IntegerType()),
    T.StructField("upload_file", T.StringType()),
])

# Headers of the exchange's summary file (after normalising).
SOURCE_HEADERS = {
    "kode_saham": "symbol",
    "nama_perusahaan": "name",
    "sebelumnya": "prev_close",
    "open_price": "open_price",
    "tertinggi": "high",
    "terendah": "low",
    "penutupan": "close",
    "selisih": "change",
    "volume": "volume",
    "nilai": "value",
    "frekuensi": "frequency",
    "index_individual": "index_individual",
    "weight_for_index": "weight_for_index",
    "foreign_buy": "foreign_buy",
    "foreign_sell": "foreign_sell",
    "offer": "offer",
    "offer_volume": "offer_volume",
    "bid": "bid",
    "bid_volume": "bid_volume",
    "listed_shares": "listed_shares",
    "tradeble_shares": "tradable_shares",
    "non_regular_volume": "non_regular_volume",
    "non_regular_value": "non_regular_value",
    "non_regular_frequency": "non_regular_frequency",
}


def normalise_headers(df: DataFrame) -> DataFrame:
    """Trim, lower-case and underscore the headers, then rename and cast to the bar schema.

    A value that does not parse becomes NULL instead of failing the load.
    """
    seen = {c.strip().lower().replace(" ", "_"): c for c in df.columns}
    wanted = {SOURCE_HEADERS[h]: seen[h] for h in SOURCE_HEADERS if h in seen}
    types = {f.name: f.dataType.simpleString() for f in BAR_SCHEMA}
    cols = [F.col(f"`{raw}`").try_cast(types[name]).alias(name) for name, raw in wanted.items()]
    extra = [c for c in ("date", "upload_file") if c in df.columns]
    return df.select(*cols, *extra)


def file_date(name: Column) -> Column:
    """Date of a name that ends in -YYYYMMDD, with or without an extension; else null."""
    stamp = F.regexp_extract(name, r"-(\d{8})(?:\.[A-Za-z]+)?$", 1)
    return F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd")).cast("date")


def with_file_date(df: DataFrame, file_name: Column | None = None) -> DataFrame:
    """Add ``date`` and ``upload_file`` from a name that ends in -YYYYMMDD.

    Rows of files whose name carries no valid date are skipped.
    """
    name = F.url_decode(F.replace(
        F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))) if file_name is None else file_name
    return (df.withColumns({"date": file_date(name), "upload_file": name})
            .filter(F.col("date").isNotNull()))


#: Text columns that a parsed file may carry into the bar schema, besides the summary's own.
FILE_MARKS = ("file", "problem", "line", "bad_cells")
FILE_COLUMNS = [*SOURCE_HEADERS.values(), "date", "upload_file"]


#: Bytes of a file that are parsed at once; a longer row takes its file whole.
CSV_BLOCK = 4 << 20


def _header(content: pa.Buffer) -> list[str]:
    """The first record, once all of the file is known to be text."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        for k in range(0, content.size, CSV_BLOCK):
            decoder.decode(content[k:k + CSV_BLOCK].to_pybytes())
        decoder.decode(b"", True)
    except UnicodeDecodeError:
        content.to_pybytes().decode("utf-8")  # tells the place in the file
        raise
    text = io.TextIOWrapper(pa.BufferReader(content), encoding="utf-8", newline="")
    header = next(csv.reader(text), None)
    if not header:
        raise ValueError("no header")
    return header


def _records(content: pa.Buffer, names: list[str], block: int) -> Iterator[pa.RecordBatch]:
    """The rows under the header, block by block."""
    options = {
        "parse_options": pacsv.ParseOptions(newlines_in_values=True),
        "convert_options": pacsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()),
                                                strings_can_be_null=False)}
    if content.size < block:
        yield from pacsv.read_csv(
            pa.BufferReader(content), read_options=pacsv.ReadOptions(
                column_names=names, skip_rows_after_names=1, block_size=content.size + 1),
            **options).to_batches()
    else:
        yield from pacsv.open_csv(
            pa.BufferReader(content), read_options=pacsv.ReadOptions(
                column_names=names, skip_rows_after_names=1, block_size=block), **options)


def _parsed(content: pa.Buffer, wanted: list[str]) -> Iterator[list[pa.Array]]:
    """The wanted columns of one CSV file as text, under the file's own header, block by block.

    Raises before the first block if anything is wrong: a large file is passed over twice, so that
    no more than a block of it is held beside its bytes.
    """
    if content.size >= 3 and content[:3].to_pybytes() == b"\xef\xbb\xbf":
        content = content[3:]
    header = _header(content)
    seen: dict[str, int] = {}
    for k, raw in enumerate(header):
        name = raw.strip().lower().replace(" ", "_")
        seen.setdefault(SOURCE_HEADERS.get(name, name), k)
    if "symbol" not in seen:
        raise ValueError("no column of symbols")
    names = [f"c{k}" for k in range(len(header))]
    if content.size < CSV_BLOCK:
        rows = iter([*_records(content, names, CSV_BLOCK)])
    else:
        block = CSV_BLOCK
        try:
            collections.deque(_records(content, names, block), maxlen=0)
        except pa.ArrowInvalid:  # a row longer than a block, or a fault that shows again
            block = content.size + 1
            collections.deque(_records(content, names, block), maxlen=0)
        rows = _records(content, names, block)
    return ([found.column(names[seen[c]]) if c in seen else pa.nulls(found.num_rows, pa.string())
             for c in wanted] for found in rows)


def _parse_task(batches: Iterator[pa.RecordBatch], wanted: list[str]) -> Iterator[pa.RecordBatch]:
    """A row for each file, with what is wrong with it, and its rows if nothing is."""
    names = ["file", "problem", "line", *wanted]
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                blocks, problem = _parsed(content.as_buffer(), wanted), None
            except (ValueError, csv.Error) as wrong:  # decoding and Arrow's errors among them
                blocks, problem = iter(()), f"{type(wrong).__name__}: {wrong}"
            yield pa.RecordBatch.from_arrays(
                [pa.array([file], pa.string()), pa.array([problem], pa.string()),
                 pa.array([0], pa.int64()), *(pa.nulls(1, pa.string()) for _ in wanted)], names=names)
            line = 1
            for columns in blocks:
                n = len(columns[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * n, pa.string()), pa.nulls(n, pa.string()),
                     pa.array(range(line, line + n), pa.int64()), *columns], names=names)
                line += n


def parse_folder(spark: SparkSession, path: str, skip_unreadable: bool = False) -> DataFrame:
    """Every row of the CSV files of a folder as text, with ``file``, ``problem`` and ``line``.

    A file is one row of Spark's binary reader, so any file system Spark knows will do, files are
    spread over tasks by size, and a broken one spoils only itself. Line 0 stands for the file and
    has its ``problem``; a file with one has no other line. Columns go by each file's own header.
    A file's bytes are in memory whole, its rows a block at a time.
    """
    columns = ", ".join(f"`{c}` string" for c in FILE_COLUMNS)
    return (spark.read.format("binaryFile").option("ignoreCorruptFiles", skip_unreadable).load(path)
            .select(_file_name().alias("file"), "content")
            .mapInArrow(partial(_parse_task, wanted=FILE_COLUMNS),
                        f"file string, problem string, line long, {columns}"))


def _file_name() -> Column:
    return F.element_at(F.split("path", "/"), -1)


def typed(parsed: DataFrame) -> DataFrame:
    """Parsed text as bars, dated by column or else by file name, with ``bad_cells`` counted.

    A value that does not parse becomes NULL. Rows without a date in column or name have a
    ``problem`` that says so.
    """
    types = {f.name: f.dataType.simpleString() for f in BAR_SCHEMA}
    text = {c: F.nullif(F.col(c), F.lit("")) for c in FILE_COLUMNS}
    cells = {c: text[c].try_cast(types[c]) for c in SOURCE_HEADERS.values()}
    bad = [F.when(text[c].isNotNull() & v.isNull(), 1).otherwise(0) for c, v in cells.items()]
    day = F.coalesce(text["date"].try_cast("date"), file_date(F.col("file")))
    undated = F.when((F.col("line") > 0) & day.isNull(), F.lit("no date in the file name"))
    return parsed.select(
        "file", F.coalesce("problem", undated).alias("problem"), "line", *[v.alias(c) for c, v in cells.items()],
        day.alias("date"), F.coalesce(text["upload_file"], F.col("file")).alias("upload_file"),
        reduce(lambda x, y: x + y, bad).alias("bad_cells"))


def read_bars(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Read a folder of daily summary files.

    CSV columns arrive as text under each file's own header and are cast one by one, so a bad cell
    or a file without a date cannot stop the rest of the folder; files without a date are skipped.
    A file that cannot be read raises: nothing is left out in silence (``bulk_load`` reports it
    instead). Columns that no file has are NULL.
    """
    if fmt == "parquet":
        raw = spark.read.parquet(path)
        return normalise_headers(raw if "date" in raw.columns else
                                 with_file_date(raw.select("*", "_metadata")))
    parsed = parse_folder(spark, path)
    sound = F.when(F.col("problem").isNotNull(), F.raise_error(
        F.concat_ws(": ", "file", "problem")).cast("boolean")).otherwise(F.lit(True))
    return typed(parsed.where(sound)).where("line > 0 and date is not null").drop(*FILE_MARKS)


def latest_file_only(df: DataFrame) -> DataFrame:
    """Rows of the newest file date."""
    newest = df.agg(F.max("date").alias("_newest"))
    return (df.crossJoin(F.broadcast(newest)).filter(F.col("date") == F.col("_newest"))
            .drop("_newest"))


def bulk_load(spark: SparkSession, path: str,
              process: str = "bulk_load") -> tuple[DataFrame, DataFrame]:
    """All sound files of a folder as bars, and a log row per file: SUCCESS, PARTIAL or ERROR.

    Files are parsed once, into a table in the shared folder that both results read. A file with a
    problem, or that cannot be opened, gives no bars and one ERROR row; cells that did not parse
    make its row PARTIAL. Rows without a symbol are left out. Spark's readers do not list files of
    no bytes; such a file is no error here.
    """
    at = f"{shared_dir(spark).rstrip('/')}/parsed-{uuid.uuid4().hex}"
    found = typed(parse_folder(spark, path, skip_unreadable=True))
    found.write.parquet(at)
    found = spark.read.schema(found.schema).parquet(at)
    sound = F.col("problem").isNull() & (F.col("line") > 0) & F.col("symbol").isNotNull()
    rows = found.where(sound).drop(*FILE_MARKS)
    # The listing alone knows files that could not be opened.
    listed = spark.read.format("binaryFile").load(path).select(_file_name().alias("file"))
    lost = listed.join(found.where("line = 0"), "file", "left_anti").select(
        "file", F.lit("unreadable").alias("problem"), F.lit(0).cast("long").alias("bad_cells"),
        F.lit(False).alias("counted"))
    marked = found.select("file", "problem", F.col("bad_cells").cast("long"),
                          sound.alias("counted")).unionByName(lost)
    log = processing_log(marked, process, F.current_timestamp(), "file",
                         bad=F.col("bad_cells") > 0, counted=F.col("counted"),
                         error=F.col("problem"))
    return rows, log



def bars_from_ticks(ticks: DataFrame) -> DataFrame:
    """Fold ticks into one bar per (symbol, date).

    Input columns: symbol, date, price (double), size (long), amount (double),
    seq (total order inside a symbol's day), is_foreign_buy,
    is_foreign_sell, at_bid, at_offer (booleans).

    Every aggregate has a fixed-size buffer, so the ticks of a hot symbol are
    folded on the map side and at most one row per (symbol, date) and task is
    shuffled.
    """
    size = F.col("size")

    def volume_if(flag: str) -> Column:
        return F.sum(F.when(F.col(flag), size).otherwise(F.lit(0)))

    return ticks.groupBy("symbol", "date").agg(
        F.min_by("price", "seq").alias("open_price"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("size").alias("volume"),
        F.sum("amount").alias("value"),
        F.count("*").cast("int").alias("frequency"),
        volume_if("is_foreign_buy").alias("foreign_buy"),
        volume_if("is_foreign_sell").alias("foreign_sell"),
        volume_if("at_bid").alias("bid_volume"),
        volume_if("at_offer").alias("offer_volume"),
    )


def with_prev_close(df: DataFrame) -> DataFrame:
    if "prev_close" in df.columns:
        return df
    return df.withColumn("prev_close", F.lag("close").over(by_symbol()))


def complete_bars(df: DataFrame) -> DataFrame:
    """Add previous close and change, and fill the columns a feed lacks with typed NULLs."""
    out = with_prev_close(df)
    if "change" not in out.columns:
        out = out.withColumn("change", F.col("close") - F.col("prev_close"))
    missing = {f.name: F.lit(None).cast(f.dataType) for f in BAR_SCHEMA
               if f.name not in out.columns}
    if missing:
        out = out.withColumns(missing)
    return out.select(*[f.name for f in BAR_SCHEMA])


def staging_view(bars: DataFrame, name: str = "stg_bars") -> DataFrame:
    """Register the plain projection of the bars as a view."""
    out = bars.select(*[f.name for f in BAR_SCHEMA])
    out.createOrReplaceTempView(name)
    return out


def store_bucketed(bars: DataFrame, table: str, path: str, buckets: int,
                   describe: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Store bars as a table bucketed by symbol and sorted by date.

    Reading it back, every per-symbol window and every join on symbol finds
    its rows already clustered: no exchange. Rows are spread by the bucketing
    hash before the write, so a task writes one file. A symbol holds one row
    per trading date, which bounds what a single symbol adds to its bucket.

    ``describe`` adds columns that need not travel: it gets the spread bars,
    sorted already, so that a join on symbol in it moves and sorts them no more.
    """
    spread = bars.repartition(buckets, "symbol")
    if describe is not None:
        spread = describe(with_prev_close(spread))
    (complete_bars(spread).write.mode("overwrite")
     .bucketBy(buckets, "symbol").sortBy("symbol", "date")
     .option("path", path).format("parquet").saveAsTable(table))
    return bars.sparkSession.table(table)


def write_bars(bars: DataFrame, path: str, files_per_month: int = 32) -> None:
    """Store bars partitioned by month, sorted by symbol inside a file.

    Monthly folders keep partitions large; the sort gives tight min/max
    statistics for symbol filters. A symbol has at most 31 bars a month, so
    the hash spreads a month evenly.
    """
    (bars.withColumn("month", F.trunc("date", "month"))
     .repartition("month", F.pmod(F.hash("symbol"), F.lit(files_per_month)))
     .sortWithinPartitions("symbol", "date")
     .write.mode("overwrite").partitionBy("month").parquet(path))
