"""Keyed table maintenance on plain files: upserts, partition replacement, logs.

Plain files have no MERGE, so each change is a function
(target, updates) -> new target, and a writer that replaces only the
partitions the updates touch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barsmith.session import shared_dir


def _ranked(rest: Sequence[str], df: DataFrame) -> Column:
    """The row itself as an order; columns that have none of their own compare as JSON."""
    row = F.struct(*rest)
    plain = not any(isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)) for c in rest)
    return row if plain else F.to_json(row)


def last_write(updates: DataFrame, keys: Sequence[str], order: str | Column | None,
               first: bool = False) -> DataFrame:
    """One update per key: the one with the greatest (``first``: least) ``order`` value.

    Without an order, and among updates of the same order, the rows themselves
    are compared, so a replay keeps the same one.
    """
    rest = [c for c in updates.columns if c not in keys]
    if not rest:
        return updates.distinct()
    by = _ranked(rest, updates)
    if order is not None:
        by = F.struct((F.col(order) if isinstance(order, str) else order).alias("o"), by.alias("r"))
    pick = F.min_by if first else F.max_by
    packed = updates.groupBy(*keys).agg(pick(F.struct(*rest), by).alias("_r"))
    return packed.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(
        *updates.columns)


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str],
           update_cols: Sequence[str] | None = None, order: str | None = None) -> DataFrame:
    """Insert new keys, overwrite existing ones.

    With ``update_cols`` only those columns of an existing row change; the
    others keep what the target holds.
    """
    fresh = last_write(updates, keys, order)
    if update_cols is None:
        kept = target.join(fresh.select(*keys), list(keys), "left_anti")
        return kept.select(*target.columns).unionByName(fresh.select(*target.columns))
    rest = [c for c in target.columns if c not in keys]
    new = fresh.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in rest],
                       F.lit(True).alias("_in_new"))
    both = target.withColumn("_in_old", F.lit(True)).join(new, list(keys), "full")
    cols = []
    for c in rest:
        old_first = F.when(F.col("_in_old"), F.col(c)).otherwise(F.col(f"_new_{c}"))
        new_first = F.when(F.col("_in_new"), F.col(f"_new_{c}")).otherwise(F.col(c))
        cols.append((new_first if c in update_cols else old_first).alias(c))
    return both.select(*keys, *cols).select(*target.columns)


def insert_ignore(target: DataFrame, updates: DataFrame, keys: Sequence[str],
                  order: str | Column | None = None) -> DataFrame:
    """Append only rows whose key is new; the first of equal keys in ``order`` wins."""
    new = updates.join(target.select(*keys), list(keys), "left_anti")
    fresh = last_write(new, keys, order, first=True)
    return target.unionByName(fresh.select(*target.columns))


def replace_dates(target: DataFrame, updates: DataFrame, date_col: str = "date") -> DataFrame:
    """Drop the target's rows of every date in the updates, then append the updates."""
    dates = updates.select(date_col).distinct()
    kept = target.join(dates, date_col, "left_anti")
    return kept.select(*target.columns).unionByName(updates.select(*target.columns))


def update_from(target: DataFrame, other: DataFrame, keys: Sequence[str],
                assign: dict[str, Column], where: Column | None = None) -> DataFrame:
    """UPDATE ... FROM: matched target rows take new values where the condition holds.

    ``assign`` and ``where`` may use columns of both sides; the other side's
    non-key columns must have names of their own.
    """
    marked = other.withColumn("_hit", F.lit(True))
    joined = target.join(marked, list(keys), "left")
    cond = F.coalesce(F.col("_hit"), F.lit(False))
    if where is not None:
        cond = cond & F.coalesce(where, F.lit(False))
    return joined.select(*[F.when(cond, assign[c]).otherwise(F.col(c)).alias(c) if c in assign
                           else F.col(c) for c in target.columns])


def dim_upsert(dim: DataFrame, bars: DataFrame) -> DataFrame:
    """Refresh (symbol, name) of the company table from the newest bars."""
    fresh = bars.groupBy("symbol").agg(F.max_by("name", "date").alias("name"))
    return upsert(dim.select("symbol", "name"), fresh, ["symbol"])


# --- writers ---------------------------------------------------------------------


def overwrite_partitions(df: DataFrame, path: str, partition_cols: Sequence[str],
                         pieces: int = 4) -> None:
    """Replace exactly the partitions present in ``df``.

    The rebalance hint gathers a folder's rows into few files, yet lets AQE
    split a folder that is too large for one task. Streaming batches run
    without AQE; there a hash of the row cuts every folder into ``pieces``.
    """
    if df.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true":
        spread = df.hint("rebalance", *partition_cols)
    else:
        spread = df.repartition(*partition_cols, F.pmod(F.xxhash64(*df.columns), F.lit(pieces)))
    (spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_cols).parquet(path))


def full_refresh(df: DataFrame, path: str, partition_cols: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*partition_cols) if partition_cols else writer).parquet(path)


def upsert_path(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str],
                partition_col: str = "date", order: str | None = None) -> None:
    """Upsert into a partitioned folder; untouched partitions are neither read nor rewritten.

    The merged partitions are checkpointed before they replace their source,
    so the write never reads what it overwrites. Applying the same updates
    twice gives the same table.
    """
    if not folder_exists(spark, path):
        overwrite_partitions(last_write(updates, keys, order), path, [partition_col])
        return
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    touched = updates.select(partition_col).distinct()
    current = spark.read.schema(updates.schema).parquet(path).join(touched, partition_col,
                                                                   "left_semi")
    merged = upsert(current.select(*updates.columns), updates, keys, order=order)
    overwrite_partitions(merged.checkpoint(eager=True), path, [partition_col])


def folder_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def ensure_table(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    """The named table or view; an empty typed view is created when there is none."""
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], schema).createOrReplaceTempView(name)
    return spark.table(name)


def temp_table(df: DataFrame, name: str, reused: bool = False) -> DataFrame:
    """Register a frame under a name; kept in memory when several queries read it."""
    out = df.persist() if reused else df
    out.createOrReplaceTempView(name)
    return out


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def processing_log(rows: DataFrame, process: str, at: Column, file_col: str = "upload_file",
                   bad: Column | None = None, counted: Column | None = None,
                   error: Column | None = None) -> DataFrame:
    """One entry per file with its row count and status.

    ``bad`` marks rows that were loaded in part, ``counted`` the rows that were loaded (all), and
    ``error`` says why a file was not: such a file counts no rows.
    """
    true = F.lit(True)
    wrong = F.max(error) if error is not None else F.lit(None).cast("string")
    grouped = rows.groupBy(F.col(file_col).alias("file_name")).agg(
        F.count_if(true if counted is None else counted).alias("_n"),
        (F.count_if(bad) if bad is not None else F.lit(0)).alias("_bad"), wrong.alias("_wrong"))
    failed = F.col("_wrong").isNotNull()
    return grouped.select(
        F.lit(process).alias("process_name"), "file_name", at.alias("process_date"),
        F.when(failed, F.lit(0)).otherwise(F.col("_n")).alias("records_processed"),
        F.when(failed, "ERROR").when(F.col("_bad") == 0, "SUCCESS").otherwise("PARTIAL")
        .alias("status"),
        F.when(failed, F.col("_wrong")).when(
            F.col("_bad") > 0, F.concat(F.col("_bad"), F.lit(" bad rows"))).alias("error_message"))


def log_summary(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("files"),
                   F.sum("records_processed").alias("records_processed"),
                   F.count_if(F.col("status") == "SUCCESS").alias("succeeded"),
                   F.count_if(F.col("status") != "SUCCESS").alias("failed"))


def ingest_metrics(received: DataFrame, inserted: DataFrame, source: str) -> DataFrame:
    """Totals of a load as one JSON document."""
    a = received.agg(F.count("*").alias("processed"))
    b = inserted.agg(F.count("*").alias("inserted"))
    return a.crossJoin(F.broadcast(b)).select(
        F.to_json(F.struct(F.lit(source).alias("source"), "processed", "inserted")).alias("metrics"))


def read_jdbc(spark: SparkSession, url: str, query: str, partition_column: str | None = None,
              bounds: tuple[int, int] | None = None, partitions: int = 16,
              options: dict[str, str] | None = None) -> DataFrame:
    """Read a query over JDBC, split by ranges of a numeric or date column when given."""
    reader = spark.read.format("jdbc").option("url", url).options(**(options or {}))
    if partition_column and bounds:
        return (reader.option("dbtable", f"({query}) q")
                .option("partitionColumn", partition_column)
                .option("lowerBound", bounds[0]).option("upperBound", bounds[1])
                .option("numPartitions", partitions).load())
    return reader.option("query", query).load()
