"""Streaming queries: each runs until its input is used up, then returns the table it kept."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from barsmith.functions.scalar import pct_change
from barsmith.plans.inputs import bars, table
from barsmith.plans.registry import query
from barsmith.plans.sqlbase import METRICS, bars_sql
from barsmith.plans.storage import work_dir
from barsmith.streaming import files, messages, ticks

MOVES = """, moves AS (
  SELECT symbol, date, close, percent_change, CASE WHEN percent_change > 0 THEN 0.75e0 ELSE 0.25e0 END
           AS probability FROM metrics WHERE abs(percent_change) > 3)"""


def _moves(spark, sf):
    out = bars(spark, sf).select(
        "symbol", "date", "close", pct_change("close", "prev_close").alias("percent_change"))
    return out.filter(F.abs("percent_change") > 3).withColumn(
        "winning_probability", F.when(F.col("percent_change") > 0, 0.75).otherwise(0.25))


def _encoded(spark, sf):
    moves = _moves(spark, sf)
    return messages.encode(moves, "DAILY", F.col("date").cast("timestamp"), ["close"])


def _drain(query_):
    query_.awaitTermination()


@query("signals_to_kafka", bars_sql("""
SELECT symbol AS key, '{"symbol":"' || symbol || '","signal_type":"DAILY","probability":'
  || probability || ',"timestamp":"' || date || 'T00:00:00","data":{"close":"'
  || CAST(close AS BIGINT) || '.0"}}' AS value FROM moves""", METRICS, MOVES))
def _(spark, sf):
    """Stored signals read as a stream, encoded, and appended to a sink of key and value.

    A file sink stands in for the topic; the encoded frame is the same.
    """
    source, sink = work_dir(spark, "signals"), work_dir(spark, "topic")
    moves = _moves(spark, sf)
    moves.write.parquet(source)
    stream = spark.readStream.schema(moves.schema).parquet(source)
    out = messages.encode(stream, "DAILY", F.col("date").cast("timestamp"), ["close"])
    _drain(out.writeStream.format("parquet").option("path", sink)
           .option("checkpointLocation", work_dir(spark, "ckpt"))
           .trigger(availableNow=True).start())
    return spark.read.schema(out.schema).parquet(sink)


@query("signals_from_kafka", bars_sql("""
SELECT symbol, 'DAILY' AS signal_type, probability, date || 'T00:00:00' AS "timestamp",
       CAST(close AS BIGINT) || '.0' AS close_text
FROM moves WHERE day(date) <> 13""", METRICS, MOVES))
def _(spark, sf):
    """Messages read as a stream and decoded per batch; those of some days arrive cut off."""
    source, sink = work_dir(spark, "messages"), work_dir(spark, "received")
    raw = _encoded(spark, sf)
    cut = F.when(F.col("value").contains("-13T00"), F.expr("left(value, 30)")).otherwise(
        F.col("value"))
    raw.select("key", cut.alias("value")).write.parquet(source)
    stream = spark.readStream.schema("key string, value string").parquet(source)

    def keep(batch, batch_id):
        batch.select("symbol", "signal_type", "probability", "timestamp",
                     F.element_at("data", "close").alias("close_text")).write.mode(
            "overwrite").parquet(f"{sink}/batch={batch_id}")

    done = messages.signals_from_kafka(stream, keep, work_dir(spark, "ckpt"))
    done.processAllAvailable()
    done.stop()
    return spark.read.parquet(sink).drop("batch")


@query("rejected_messages", bars_sql("""
SELECT topic, value, n AS batch_decoded FROM (
  SELECT CASE WHEN close > 7000 THEN 'high' ELSE 'low' END AS topic,
         left('{"symbol":"' || symbol || '","signal_type":"DAILY"', 30) AS value, day(date) AS d
  FROM moves) CROSS JOIN (SELECT count(*) AS n FROM moves WHERE day(date) <> 13)
WHERE d = 13""", METRICS, MOVES))
def _(spark, sf):
    """Cut messages of two topics as the consumer's own log keeps them; the stream is replayed."""
    source, log = work_dir(spark, "messages"), work_dir(spark, "log")
    sent = messages.encode(_moves(spark, sf).withColumn(
        "topic", F.when(F.col("close") > 7000, "high").otherwise("low")), "DAILY",
        F.col("date").cast("timestamp"), ["close", "topic"])
    high = F.col("value").contains('"topic":"high"')
    cut = F.when(F.col("value").contains("-13T00"), F.expr("left(value, 30)")).otherwise(
        F.col("value"))
    sent.select("key", cut.alias("value"), F.when(high, "high").otherwise("low").alias(
        "topic")).write.parquet(source)
    stream = spark.readStream.schema("key string, value string, topic string").parquet(source)
    for _ in range(2):  # a new checkpoint sends batch 0 again
        done = messages.signals_from_kafka(stream, lambda batch, batch_id: None,
                                           work_dir(spark, "ckpt"), log)
        done.processAllAvailable()
        done.stop()
    counts = spark.read.parquet(f"{log}/batches").agg(F.sum("decoded").alias("batch_decoded"))
    return spark.read.parquet(f"{log}/rejected").select("topic", "value").crossJoin(
        F.broadcast(counts))


@query("watch_bar_files", bars_sql("""
SELECT symbol, date, CASE WHEN date >= DATE '2000-06-20' AND date < DATE '2000-07-01'
  THEN close + 1 ELSE close END AS close, volume FROM bars"""))
def _(spark, sf):
    """Two drops of files with overlapping dates; the second corrects the first."""
    folder, target, ckpt = (work_dir(spark, n) for n in ("drop", "bars", "ckpt"))
    b = bars(spark, sf).select("symbol", "date", "close", "volume")
    late = F.col("date") >= F.lit("2000-06-20").cast("date")
    overlap = late & (F.col("date") < F.lit("2000-07-01").cast("date"))
    drops = (b.filter(F.col("date") < F.lit("2000-07-01").cast("date")),
             b.filter(late).withColumn("close", F.when(overlap, F.col("close") + 1).otherwise(
                 F.col("close"))))
    for drop in drops:
        drop.write.mode("append").parquet(folder)
        _drain(files.watch_bar_files(spark, folder, b.schema, target, ckpt))
    return spark.read.parquet(target).select(*b.columns)


TICKS = """
SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(date_trunc('day', ts) AS DATE) AS date,
  first(value ORDER BY ts, event_id) AS open_price, max(value) AS high, min(value) AS low,
  last(value ORDER BY ts, event_id) AS close, count(*) AS volume, count(*) AS frequency
FROM events GROUP BY 1, 2"""


@query("daily_bars_batch", TICKS)
def _(spark, sf):
    return ticks.daily_bars(_events(spark, sf), "user_id", "ts", "value", seq="event_id")


def _events(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")


@query("daily_bars_stream", TICKS)
def _(spark, sf):
    """The event table as a stream of files, folded into the kept bar table batch by batch."""
    source, target = work_dir(spark, "events"), work_dir(spark, "daily")
    events = _events(spark, sf)
    for part in _thirds(events):
        part.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = ticks.daily_bars(stream, "user_id", "ts", "value", seq="event_id", watermark="40 days")
    _drain(ticks.maintain_daily_bars(out, target, work_dir(spark, "ckpt")))
    return spark.read.schema(out.schema).parquet(target)


def _thirds(events):
    """Three parts in time order, cut in the middle of a day."""
    ends = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(
        (F.unix_seconds("a") + (F.unix_seconds("b") - F.unix_seconds("a")) / 3).cast("long"),
        (F.unix_seconds("a") + (F.unix_seconds("b") - F.unix_seconds("a")) / 3 * 2).cast("long")
    ).first()
    second = F.unix_seconds("ts")
    return (events.where(second < ends[0]),
            events.where((second >= ends[0]) & (second < ends[1])),
            events.where(second >= ends[1]))


CLOSING = """
WITH e AS (SELECT *, CAST(date_trunc('day', ts) AS DATE) AS date FROM events),
m AS (SELECT *, event_id % 97 = 0 AND date < (SELECT max(date) - 10 FROM e) AS late FROM e)
SELECT 'bar' AS kind, CAST(user_id AS VARCHAR) AS symbol, date,
  first(value ORDER BY ts, event_id) AS open_price, max(value) AS high, min(value) AS low,
  last(value ORDER BY ts, event_id) AS close, count(*) AS volume
FROM m WHERE NOT late GROUP BY user_id, date
UNION ALL SELECT 'late', CAST(user_id AS VARCHAR), date, value, value, value, value, 1
FROM m WHERE late"""


@query("closing_bars_stream", CLOSING)
def _(spark, sf):
    """Final bars and late ticks: three batches in time order, one of stragglers, and a last tick
    that lets the remaining days close."""
    source, target, late = (work_dir(spark, n) for n in ("events", "closed", "late"))
    events = _events(spark, sf)
    newest = events.agg(F.max("ts").cast("date").alias("newest"))
    marked = events.crossJoin(F.broadcast(newest)).withColumn("straggler", (
        F.col("event_id") % 97 == 0) & (F.col("ts").cast("date") < F.date_sub("newest", 10)))
    plain, stragglers = (marked.where(c).select(events.columns) for c in (
        "not straggler", "straggler"))
    last = newest.select(F.lit(-1).cast("long").alias("event_id"),
                         F.date_add("newest", 9).cast("timestamp").alias("ts"),
                         F.lit(-1).cast("long").alias("user_id"), F.lit(0.0).alias("value"))
    for part in (*_thirds(plain), stragglers, last):
        part.repartition(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = ticks.closing_bars(stream, "user_id", "ts", "value", seq="event_id",
                             wait=dt.timedelta(days=2), keep=dt.timedelta(days=60))
    _drain(ticks.store_closing_bars(out, target, late, work_dir(spark, "ckpt")))
    kept = spark.read.schema(out.drop("kind", "at").schema).parquet(target)
    missed = spark.read.parquet(late)
    price = [F.col("price").alias(c) for c in ("open_price", "high", "low", "close")]
    return kept.select(F.lit("bar").alias("kind"), "symbol", "date", "open_price", "high", "low",
                       "close", "volume").unionByName(missed.select(
                           F.lit("late").alias("kind"), "symbol", "date", *price,
                           F.col("size").alias("volume")))
