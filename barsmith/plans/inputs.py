"""Bars, articles, forecasts and lookups derived from the given tables."""

from __future__ import annotations

import datetime as dt
import uuid
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.session import shared_dir
from barsmith.sources.bars import bars_from_ticks, store_bucketed

# Seven source days make one trading day; the first source week starts on this Monday.
EPOCH = dt.date(1995, 1, 2)
FIRST_TRADING_DAY = dt.date(2000, 1, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of fewer splits than cores; a large input is left as it is.

    Text scoring is compute-bound, and a file of one row group would be one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _day() -> F.Column:
    return F.datediff(F.col("l_shipdate").cast("date"), F.lit(EPOCH))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as one tick."""
    day, qty = _day(), F.col("l_quantity")
    price = 5000 + F.floor(F.col("l_extendedprice") / qty / 10)
    # Day, any 64-bit order key, line and a tie-break share one decimal: min_by and max_by over it
    # stay hash aggregates, which a struct would make sort aggregates.
    low = F.col("l_linenumber") * 1024 + F.col("l_partkey") % 1024
    seq = (day.cast("decimal(5,0)") * F.lit(Decimal(10 ** 23))
           + F.col("l_orderkey").cast("decimal(19,0)") * F.lit(Decimal(10_000))
           + low.cast("decimal(4,0)")).cast("decimal(38,0)")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"),
        F.date_add(F.lit(FIRST_TRADING_DAY), F.floor(day / 7).cast("int")).alias("date"),
        price.cast("double").alias("price"),
        (qty * 100000).cast("long").alias("size"),
        (F.floor("l_extendedprice") * 100000).cast("double").alias("amount"),
        seq.alias("seq"),
        (F.col("l_returnflag") == "R").alias("is_foreign_buy"),
        (F.col("l_returnflag") == "A").alias("is_foreign_sell"),
        (F.col("l_linestatus") == "O").alias("at_bid"),
        (F.col("l_linestatus") == "F").alias("at_offer"),
    )


def names(spark: SparkSession, sf_dir: str, pieces: int | None = None) -> DataFrame:
    """One name per symbol; grouping also tells Spark that the symbol is a key."""
    named = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"), "s_name")
    if pieces:  # clustered like the bars they are joined to
        named = named.repartition(pieces, "symbol")
    return named.groupBy("symbol").agg(F.max("s_name").alias("name"))


def derive_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of every symbol and trading day, straight from the ticks."""
    return described(bars_from_ticks(ticks(spark, sf_dir)), names(spark, sf_dir))


def described(out: DataFrame, names_: DataFrame) -> DataFrame:
    """Folded bars with the columns that follow from the symbol and the prices."""
    key = F.substring("symbol", 2, 20).cast("long")
    shares = (key % 10 + 1) * 100_000_000
    out = out.withColumns({
        "bid": F.col("low"), "offer": F.col("high"), "listed_shares": shares,
        "tradable_shares": (shares * 0.8).cast("long"), "upload_file": F.lit("ticks")})
    # No hint: Spark broadcasts the names only below its size threshold.
    return out.join(names_, "symbol", "left")


_STORED: dict[tuple, str] = {}
#: Bytes of the tick table that one task folds, and that end in one bucket. Most bars hold a few
#: ticks only, so a task's memory is some twenty times that: its hash table and sorts do not spill.
BYTES_PER_TASK = 16 << 20
SPLIT_CONF = "spark.sql.files.maxPartitionBytes"
FOLD_CONF = "spark.sql.shuffle.partitions"


def fingerprint(spark: SparkSession, sf_dir: str, *names: str) -> tuple[int, ...]:
    """Size and newest change of source tables, nested files too, so that new data is noticed."""
    found: list[int] = []
    for name in names:
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        listed = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
        size = changed = 0
        while listed.hasNext():
            file = listed.next()
            size, changed = size + file.getLen(), max(changed, file.getModificationTime())
        found += [size, changed]
    return tuple(found)


def pieces(spark: SparkSession, tick_bytes: int) -> int:
    """Partitions of what is derived from so many bytes of ticks: a task holds as much, no more."""
    return int(max(spark.sparkContext.defaultParallelism, tick_bytes // BYTES_PER_TASK))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bar table of a tick table: folded once per application, then read.

    It lives in the shared folder, bucketed by symbol. The splits of the ticks
    have a fixed size, and the partitions of the fold and the buckets follow
    the size of the ticks, so what one task holds does not grow with the table.
    """
    marks = fingerprint(spark, sf_dir, "lineitem", "supplier")
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), *marks)
    if key not in _STORED or not spark.catalog.tableExists(_STORED[key]):
        buckets = pieces(spark, marks[0])
        name = f"bars_{uuid.uuid4().hex}"
        before = {c: spark.conf.get(c) for c in (SPLIT_CONF, FOLD_CONF)}
        spark.conf.set(SPLIT_CONF, str(BYTES_PER_TASK))
        # A session with few partitions would fold a large table in few hash tables, which spill.
        spark.conf.set(FOLD_CONF, str(max(int(before[FOLD_CONF]), buckets)))
        try:
            named = names(spark, sf_dir, buckets)
            store_bucketed(bars_from_ticks(ticks(spark, sf_dir)), name,
                           f"{shared_dir(spark).rstrip('/')}/{name}", buckets,
                           lambda folded: described(folded, named))
        finally:
            for conf, value in before.items():
                spark.conf.set(conf, value)
        _STORED[key] = name
    return spark.table(_STORED[key])


_LATEST: dict[tuple, dt.date] = {}


def latest_date(spark: SparkSession, sf_dir: str) -> dt.date:
    """Last trading day, from one column of the tick table; looked up once per state of it.

    A driver-side literal lets every look-back filter reach below the windows.
    """
    key = (sf_dir.rstrip("/"), *fingerprint(spark, sf_dir, "lineitem"))
    if key not in _LATEST:
        last = table(spark, sf_dir, "lineitem").agg(F.max("l_shipdate").cast("date")).first()[0]
        _LATEST[key] = FIRST_TRADING_DAY + dt.timedelta(days=(last - EPOCH).days // 7)
    return _LATEST[key]


TEST_POSITIVE = ["the", "le", "der"]
TEST_NEGATIVE = ["of", "und", "que"]


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a news article; the text is kept whole."""
    listed = table(spark, sf_dir, "supplier").agg(F.count("*").alias("_n"))
    as_of = latest_date(spark, sf_dir)
    age = (F.col("doc_id") % 30).cast("int")
    return (
        spread(table(spark, sf_dir, "documents")).crossJoin(F.broadcast(listed)).select(
            "doc_id",
            F.concat(F.lit("S"), F.col("doc_id") % F.col("_n")).alias("ticker"),
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
            F.col("text").alias("content"),
            F.concat(F.lit("doc://"), F.col("doc_id")).alias("url"),
            F.date_sub(F.lit(as_of), age).alias("published"),
            F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B").alias("feed"),
        )
    )


def forecasts(bars_: DataFrame) -> DataFrame:
    """Mean of the five closes before the bar as its forecast.

    The actual close is still missing on the last five dates.
    """
    from barsmith.functions.frames import by_symbol, before

    last = bars_.agg(F.max("date").alias("_last"))
    out = bars_.withColumns({
        "predicted_close": F.avg("close").over(before(5)),
        "_seen": F.lag("close").over(by_symbol())}).crossJoin(F.broadcast(last))
    actual = F.when(F.col("date") <= F.date_sub("_last", 5), F.col("close"))
    error = F.abs(F.col("predicted_close") - actual)
    return out.filter(F.col("predicted_close").isNotNull()).select(
        "symbol", F.col("date").alias("prediction_date"), "predicted_close",
        actual.alias("actual_close"), error.alias("prediction_error"),
        (error / F.nullif(actual, F.lit(0.0)) * 100).alias("error_percentage"))
