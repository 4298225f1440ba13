"""Trading-signal messages as JSON, to and from Kafka.

The Kafka connector is not part of the base distribution; only the source
and sink functions below need it. Encoding and decoding are plain columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from barsmith.sources.tables import folder_exists

# Fields of a message.
MESSAGE_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("signal_type", T.StringType()),
    T.StructField("probability", T.DoubleType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("data", T.MapType(T.StringType(), T.StringType())),
])


def encode(signals: DataFrame, signal_type: str, at: Column, details: list[str],
           probability: str = "winning_probability") -> DataFrame:
    """One JSON value per signal, keyed by symbol."""
    pairs = [x for c in details for x in (F.lit(c), F.col(c).cast("string"))]
    body = F.struct(
        F.col("symbol"), F.lit(signal_type).alias("signal_type"),
        F.col(probability).alias("probability"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        (F.create_map(*pairs) if pairs else F.create_map()).alias("data"))
    return signals.select(F.col("symbol").alias("key"), F.to_json(body).alias("value"))


def decode(messages: DataFrame, value: str = "value") -> DataFrame:
    """Fields of each message; text that is not a message is skipped."""
    parsed = F.from_json(F.col(value).cast("string"), MESSAGE_SCHEMA, {"mode": "PERMISSIVE"})
    out = messages.select(parsed.alias("m")).select("m.*")
    return out.filter(F.col("symbol").isNotNull() & F.col("signal_type").isNotNull())


def rejected(messages: DataFrame, value: str = "value") -> DataFrame:
    """The messages ``decode`` skips, for a log."""
    parsed = F.from_json(F.col(value).cast("string"), MESSAGE_SCHEMA, {"mode": "PERMISSIVE"})
    bad = F.coalesce(parsed["symbol"].isNull() | parsed["signal_type"].isNull(), F.lit(True))
    return messages.filter(bad)


def kafka_source(spark: SparkSession, servers: str, topics: str | Sequence[str],
                 starting: str = "latest", fail_on_data_loss: bool = True) -> DataFrame:
    """Messages of one or several topics, each row with its ``topic``.

    Offsets that are gone stop the stream unless told otherwise.
    """
    topic = topics if isinstance(topics, str) else ",".join(topics)
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).option("startingOffsets", starting)
            .option("failOnDataLoss", str(fail_on_data_loss).lower()).load())


def signals_to_kafka(encoded: DataFrame, servers: str, topic: str,
                     checkpoint: str | None = None) -> StreamingQuery | None:
    """Write key and value to a topic: a stream when the frame is one, else a batch."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic}
    if encoded.isStreaming:
        return (encoded.writeStream.format("kafka").options(**options)
                .option("checkpointLocation", checkpoint).start())
    encoded.write.format("kafka").options(**options).save()
    return None


def signals_from_kafka(messages: DataFrame, handle: Callable[[DataFrame, int], None],
                       checkpoint: str, log: str | None = None) -> StreamingQuery:
    """Hand every micro-batch of decoded messages to ``handle``.

    With ``log`` the messages that do not decode are kept whole, with topic and
    offset where the source has them, in ``<log>/rejected/batch_id=<n>``, and
    ``<log>/batches/batch_id=<n>`` counts what the batch received, decoded and
    rejected. The count is written last: a batch replayed after a failure is
    done again until it is there, replaces its own folders, and is skipped
    from then on. Batch ids belong to ``checkpoint``; keep one log for each.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        if log is None:
            handle(decode(batch), batch_id)
            return
        counted = f"{log}/batches/batch_id={batch_id}"
        if folder_exists(batch.sparkSession, f"{counted}/_SUCCESS"):
            return
        batch = batch.persist()
        try:
            handle(decode(batch), batch_id)
            rejected(batch).write.mode("overwrite").parquet(f"{log}/rejected/batch_id={batch_id}")
            good = decode(batch).agg(F.count("*").alias("decoded"))
            received = batch.agg(F.count("*").alias("received"))
            (received.crossJoin(good).select("received", "decoded", (
                F.col("received") - F.col("decoded")).alias("rejected"))
             .coalesce(1).write.mode("overwrite").parquet(counted))
        finally:
            batch.unpersist()

    return (messages.writeStream.foreachBatch(step)
            .option("checkpointLocation", checkpoint).start())
