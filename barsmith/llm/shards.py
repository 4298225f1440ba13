"""Sharding by a k-d tree over document metadata.

Copies of a text are one point of the tree, weighted by their bytes. A node over the target splits
along its widest metadata dimension at the weighted median, which one aggregation over the
distributed cells finds for all nodes of a level; a node under the target, or of one cell, is a
leaf. The driver holds the tree only, whose size follows from the numbers of shards and leaves.
Leaves go to shards largest first, each to the shard with the fewest bytes so far.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barsmith.llm.store import documents, stored

SHARDS = 8
LEAVES_PER_SHARD = 32
#: Rows numbered together when slots are dealt out.
SLOT_ROWS = 50_000
#: Dimensions and their numbers of values: size in eighths of an octave, source, language, hash.
DIMENSIONS = {"d_size": 512, "d_source": 1024, "d_lang": 256, "d_hash": 1024}


def points(docs: DataFrame) -> DataFrame:
    """Narrow rows: id, size, checksum, the text's key, and metadata as whole numbers."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"),
        F.floor(8 * F.log2(size.cast("double"))).cast("int").alias("d_size"),
        (F.crc32(F.coalesce(F.col("source").cast("string"), F.lit("")).cast("binary"))
         % DIMENSIONS["d_source"]).cast("int").alias("d_source"),
        (F.crc32(F.coalesce(F.col("lang").cast("string"), F.lit("")).cast("binary"))
         % DIMENSIONS["d_lang"]).cast("int").alias("d_lang"),
        F.pmod(F.xxhash64(text, F.lit(1)), F.lit(DIMENSIONS["d_hash"])).cast("int").alias("d_hash"))


def _cuts(rows: DataFrame) -> DataFrame:
    """``node, dim, bytes, low, high, cut`` of every node and dimension: its range and the value
    at its weighted median, from one aggregation. A node has at most as many sums along a
    dimension as that has values."""
    dims = F.explode(F.create_map(*(x for d in DIMENSIONS for x in (F.lit(d), F.col(d)))))
    sums = (rows.select("node", "bytes", dims.alias("dim", "value"))
            .groupBy("node", "dim", "value").agg(F.sum("bytes").alias("bytes")))
    whole = W.partitionBy("node", "dim")
    return (sums.select(
        "node", "dim", "value", "bytes", F.sum("bytes").over(whole.orderBy("value")).alias("below"),
        F.sum("bytes").over(whole).alias("all"), F.max("value").over(whole).alias("high"))
        .groupBy("node", "dim").agg(
            F.sum("bytes").alias("bytes"), F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.min_by("value", F.when(F.col("value") < F.col("high"),
                                     F.abs(2 * F.col("below") - F.col("all")))).alias("cut")))


def _leaves(cells: DataFrame, target: float) -> DataFrame:
    """``cell`` columns with the leaf of each cell; one job a level."""
    rows = cells.withColumn("node", F.lit("1"))
    spark = cells.sparkSession
    final: set[str] = set()
    while True:
        found = _cuts(rows.where(~F.col("node").isin(list(final))) if final else rows).collect()
        best = {}
        for r in found:
            width = ((r.high - r.low) / DIMENSIONS[r.dim], r.dim)
            if r.node not in best or width > best[r.node][0]:
                best[r.node] = (width, r)
        split = [(n, r.dim, r.cut) for n, (width, r) in best.items()
                 if r.bytes > target and width[0] > 0]
        final.update(set(best) - {n for n, _, _ in split})
        if not split:
            return rows
        # As many rows as the level has nodes to split, so a small table however large the input.
        cuts = spark.createDataFrame(sorted(split), "node string, dim string, cut int")
        value = F.coalesce(*(F.when(F.col("dim") == d, F.col(d)) for d in DIMENSIONS))
        rows = stored(rows.join(F.broadcast(cuts), "node", "left").select(
            *DIMENSIONS, "bytes", F.when(F.col("cut").isNull(), F.col("node")).otherwise(
                F.concat("node", F.when(value <= F.col("cut"), "0").otherwise("1")))
            .alias("node")), "kd-level")


def _packed(leaves: list[tuple[str, int]], n_shards: int) -> dict[str, int]:
    heap = [(0, k) for k in range(n_shards)]
    out = {}
    for leaf, size in sorted(leaves, key=lambda x: (-x[1], x[0])):
        load, k = heapq.heappop(heap)
        out[leaf] = k
        heapq.heappush(heap, (load + size, k))
    return out


def shard(docs: DataFrame, n_shards: int = SHARDS,
          leaves_per_shard: int = LEAVES_PER_SHARD) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, leaf``, a row per input row.

    Law ``bytes``: sizes of shards differ by less than the largest leaf. Equal texts share a
    shard, unless together they outweigh a shard: such a group is cut by the hash of the ids into
    parts of at most half a shard or so. A null text has size 1, no checksum, and is equal to
    other null texts. ``slot`` numbers the rows of a shard from 0 without gaps, by hash buckets.
    ``docs`` needs columns doc_id, text, source and lang; nulls count as a value. No rows give no
    rows.
    """
    spark = docs.sparkSession
    rows = stored(points(docs), "points")
    total = rows.agg(F.sum("size"), F.count("*")).first()
    all_bytes, n_rows = total[0] or 0, total[1]
    groups = rows.groupBy("key", "size").agg(
        F.sum(F.col("size").cast("long")).alias("bytes"), F.min("d_source").alias("d_source"),
        F.min("d_lang").alias("d_lang"), F.first("d_size").alias("d_size"),
        F.first("d_hash").alias("d_hash"))
    share = max(1.0, all_bytes / n_shards)
    groups = stored(groups.withColumn("parts", F.when(
        F.col("bytes") > share, F.ceil(2 * F.col("bytes") / share)).otherwise(1).cast("int")),
        "text-groups")
    cells = stored(
        groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("d_hash", F.pmod(F.col("d_hash") + 127 * F.col("part"),
                                     F.lit(DIMENSIONS["d_hash"])))
        .groupBy(*DIMENSIONS).agg(F.sum(F.col("bytes") / F.col("parts")).cast("long").alias("bytes")),
        "cells")
    placed = stored(_leaves(cells, all_bytes / (n_shards * leaves_per_shard)), "leaves")
    sizes = placed.groupBy("node").agg(F.sum("bytes").alias("bytes")).collect()
    home = _packed([(r.node, r.bytes) for r in sizes], n_shards)
    where = spark.createDataFrame(sorted(home.items()), "node string, shard int") if home else \
        spark.createDataFrame([], "node string, shard int")
    # The tree has a bounded number of leaves, so this side is as small as it.
    cell_of = placed.join(F.broadcast(where), "node").select(*DIMENSIONS, "node", "shard")
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id"), F.col("parts"))).otherwise(0)
    text_of = groups.select("key", "size", "parts", *(F.col(d).alias(f"g_{d}") for d in DIMENSIONS))
    put = (rows.select("doc_id", "size", "text_crc32", "key").join(text_of, ["key", "size"])
           .select("doc_id", "size", "text_crc32", F.col("g_d_size").alias("d_size"),
                   F.col("g_d_source").alias("d_source"), F.col("g_d_lang").alias("d_lang"),
                   F.pmod(F.col("g_d_hash") + 127 * part, F.lit(DIMENSIONS["d_hash"]))
                   .cast("int").alias("d_hash"))
           .join(cell_of, list(DIMENSIONS)))
    # Slots: rows are numbered in buckets of a bounded size, which begin where the earlier end.
    n_buckets = max(1, -(-n_rows // SLOT_ROWS))
    put = stored(put.select(
        "doc_id", "size", "text_crc32", "shard", F.col("node").alias("leaf"),
        F.pmod(F.xxhash64("doc_id", "text_crc32", "node"), F.lit(n_buckets)).alias("bucket")), "put")
    begins = (put.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
              .withColumn("begin", F.sum("n").over(
                  W.partitionBy("shard").orderBy("bucket")) - F.col("n")).drop("n"))
    within = W.partitionBy("shard", "bucket").orderBy("leaf", "doc_id", "size", "text_crc32")
    return (put.withColumn("n", F.row_number().over(within)).join(begins, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("begin") + F.col("n") - 1).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "leaf"))


def op5_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
