"""Watch a folder of bar files and merge what arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from barsmith.sources.tables import last_write, upsert_path


def watch_bar_files(spark: SparkSession, folder: str, schema: StructType, target: str,
                    checkpoint: str, fmt: str = "parquet", every: str | None = None,
                    files_per_batch: int | None = None,
                    order: str | None = None) -> StreamingQuery:
    """Upsert each batch of new files into the bar table, kept in monthly folders.

    ``every`` polls for ever at that interval; without it the query takes
    what is there and ends. Of several rows with one key in a batch the last
    written stays: the greatest ``order``, by default the newest file, then the
    last file name, then (Parquet) the last row. The upsert is keyed, so a batch
    replayed after a failure leaves the same table.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    place = ["file_modification_time", "file_path", *(["row_index"] if fmt == "parquet" else [])]
    written = F.struct(*[F.col(f"_metadata.{c}").alias(c) for c in place]).alias("_written")
    keys = ["symbol", "date"]

    def merge(batch: DataFrame, batch_id: int) -> None:
        last = last_write(batch, keys, order or "_written").drop("_written")
        upsert_path(spark, target, last.withColumn("month", F.trunc("date", "month")), keys, "month")

    writer = reader.load(folder).select("*", written).writeStream.foreachBatch(merge).option(
        "checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
