"""Hard negatives by coordinate pruning over length buckets.

Vectors become integers, sorted by length and cut into buckets. A bucket holds, for each coordinate,
its unit vectors in order of that coordinate. An anchor q that looks for inner products of at least
theta meets a bucket whose longest vector has length l only if theta <= |q| l; there a vector needs
a cosine of at least c = theta / (|q| l), which bounds each of its coordinates:

    q_f c - sqrt((1 - c^2)(1 - q_f^2))  <=  p_f  <=  q_f c + sqrt((1 - c^2)(1 - q_f^2))

(up to 1 where q_f > c, down to -1 where q_f < -c). The lists of the anchor's largest coordinates
are cut to these ranges, vectors found in all of them are candidates, and candidates are verified
with exact integer inner products. Theta starts from the first rows of the bucket and from what the
anchor already knows, so it never cuts off a result.

Two passes: the best rows of the anchor's own label, then for each of these positives the best rows
of other labels in its score band. Buckets and the anchors that meet them are dealt to tasks
together; a task holds one bucket and streams anchors, and sends a few rows an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barsmith.llm.store import stored, table

#: Vectors of a length bucket; every anchor is sent to each bucket that its threshold lets it meet.
BUCKET_ROWS = 1 << 14
#: Coordinates whose sorted lists are intersected.
FOCUS = 6
#: Rows of a bucket that an anchor is compared with to begin with, for a threshold.
SEED_ROWS = 256
#: Room for rounding of the real-valued bounds; candidates are verified in integers.
SLACK = 1e-9
#: Below this, sums of products of integers are exact in 64-bit floats.
EXACT = 1 << 53

VECTOR_SCHEMA = "vec_id long, label long, length double, vector binary"


def _vector_task(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels, lengths, vectors = [], [], [], []
        values = batch.column(2).to_pylist()
        for vec_id, label, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                    values, strict=True):
            if vec_id is None or label is None or x is None or None in x:
                continue
            v = np.asarray(x, dtype=np.float64)
            if not np.isfinite(v).all():
                continue
            v = np.floor(scale * v)
            if len(v) and np.abs(v).max() >= 1 << 31:
                raise OverflowError(f"vector {vec_id} has a component beyond 32 bits")
            ids.append(vec_id)
            labels.append(label)
            lengths.append(float(np.sqrt(v @ v)))
            vectors.append(v.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(labels, pa.int64()),
             pa.array(lengths, pa.float64()), pa.array(vectors, pa.binary())],
            names=["vec_id", "label", "length", "vector"])


class Bucket:
    """Vectors of similar length with a sorted list per coordinate."""

    def __init__(self, ids, labels, vectors: list[bytes], width: int):
        rows = sorted(set(zip(ids, labels, vectors, strict=True)))  # repeated rows count once
        self.ids = np.array([r[0] for r in rows], dtype=np.int64)
        self.labels = np.array([r[1] for r in rows], dtype=np.int64)
        self.values = np.zeros((len(rows), width))
        for k, r in enumerate(rows):
            v = np.frombuffer(r[2], dtype=np.int32)
            self.values[k, :len(v)] = v
        lengths = np.sqrt((self.values ** 2).sum(axis=1))
        self.longest = float(lengths.max(initial=0.0))
        self.peak = float(np.abs(self.values).max(initial=0.0))
        unit = self.values / np.maximum(lengths, 1e-300)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable")
        self.sorted = np.take_along_axis(unit, self.order, axis=0)

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products."""
        if self.peak * np.abs(q).max(initial=0.0) * max(len(q), 1) < EXACT:
            return (self.values[rows] @ q).astype(np.int64)
        whole = [int(x) for x in q]
        out = [sum(a * int(b) for a, b in zip(whole, self.values[r], strict=True)) for r in rows]
        return np.array(out, dtype=np.int64)  # raises beyond 64 bits

    def candidates(self, q: np.ndarray, theta: float) -> np.ndarray:
        """Rows whose inner product with ``q`` may be ``theta`` or more."""
        everything = np.arange(len(self.ids))
        length = float(np.sqrt(q @ q))
        if theta <= 0:
            return everything
        if theta > length * self.longest * (1 + SLACK):
            return everything[:0]
        c = min(1.0, theta / (length * self.longest))
        unit = q / length
        met = np.zeros(len(everything), dtype=np.int8)
        focus = np.argsort(-np.abs(unit))[:FOCUS]
        for f in focus:
            spread = np.sqrt(max(0.0, (1 - c * c) * (1 - unit[f] ** 2)))
            low = -1.0 if unit[f] < -c else unit[f] * c - spread
            high = 1.0 if unit[f] > c else unit[f] * c + spread
            # Shorter vectors of the bucket need a larger cosine, so the range holds them too.
            a, b = np.searchsorted(self.sorted[:, f], [low - SLACK, high + SLACK], "left")
            met[self.order[a:b, f]] += 1
        return np.flatnonzero(met == len(focus))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` first by falling score, then id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _threshold(scores: np.ndarray, k: int, floor: float) -> float:
    """A bound that the ``k`` best of all rows reach."""
    return max(floor, float(np.partition(scores, len(scores) - k)[len(scores) - k])) if len(
        scores) >= k else floor


def _positives(bucket: Bucket, anchor: dict, k: int) -> Iterator[tuple]:
    def fit(rows):
        return rows[(bucket.labels[rows] == anchor["label"]) & (bucket.ids != anchor["id"])[rows]]

    q = anchor["q"]
    seed = fit(np.arange(len(bucket.ids)))[:SEED_ROWS]
    theta = _threshold(bucket.scores(q, seed), k, -np.inf)
    rows = fit(bucket.candidates(q, theta))
    scores = bucket.scores(q, rows)
    for at in _best(scores, bucket.ids[rows], k):
        yield anchor["key"], anchor["id"], int(bucket.ids[rows[at]]), int(scores[at]), 0, 0


def _negatives(bucket: Bucket, anchor: dict, k: int, low: int) -> Iterator[tuple]:
    q = anchor["q"]
    bands = [(p, s, -(-low * s // 100)) for p, s in anchor["positives"] if low * s <= 100 * s]
    if not bands:
        return

    def fit(rows):
        return rows[bucket.labels[rows] != anchor["label"]]

    seed = bucket.scores(q, fit(np.arange(min(SEED_ROWS, len(bucket.ids)))))
    theta = min(_threshold(seed[(seed >= least) & (seed <= s)], k, least) for _, s, least in bands)
    rows = fit(bucket.candidates(q, theta))
    scores = bucket.scores(q, rows)
    for p, s, least in bands:
        inside = np.flatnonzero((scores >= least) & (scores <= s))
        for at in inside[_best(scores[inside], bucket.ids[rows[inside]], k)]:
            yield anchor["key"], anchor["id"], p, s, int(bucket.ids[rows[at]]), int(scores[at])


FOUND_SCHEMA = ("anchor_key long, anchor_id long, positive_id long, positive_score long, "
                "negative_id long, negative_score long")


def _search_task(batches: Iterator[pa.RecordBatch], width: int, k: int,
                 low: int | None) -> Iterator[pa.RecordBatch]:
    """Rows ``bucket, anchor_key, vec_id, label, vector, positives`` in order: the vectors of a
    bucket (null key), then its anchors. ``low`` None: positives; else negatives."""
    at, bucket, held, found = None, None, ([], [], []), []
    names = [c.split()[0] for c in FOUND_SCHEMA.split(", ")]

    def report() -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    for batch in batches:
        for b, key, vec_id, label, vector, positives in zip(
                *(c.to_pylist() for c in batch.columns), strict=True):
            if b != at:
                at, bucket, held = b, None, ([], [], [])
            if key is None:
                for part, x in zip(held, (vec_id, label, vector), strict=True):
                    part.append(x)
                continue
            if bucket is None:
                bucket = Bucket(*held, width)
            q = np.zeros(width)
            v = np.frombuffer(vector, dtype=np.int32)
            q[:len(v)] = v
            anchor = {"key": key, "id": vec_id, "label": label, "q": q,
                      "positives": [(p["id"], p["score"]) for p in positives or ()]}
            found += _positives(bucket, anchor, k) if low is None else _negatives(
                bucket, anchor, k, low)
            if len(found) >= 1 << 15:
                yield report()
                found = []
        yield report()
        found = []


def _search(vectors: DataFrame, anchors: DataFrame, buckets: int, width: int, k: int,
            low: int | None) -> DataFrame:
    """Each anchor against all buckets that its least score lets it meet."""
    stats = vectors.groupBy("bucket").agg(F.max("length").alias("longest"))
    met = (anchors.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
           .join(stats, "bucket")
           .where(F.col("least").isNull()
                  | (F.col("least") <= F.col("length") * F.col("longest") * (1 + SLACK))))
    kind = "array<struct<id:bigint,score:bigint>>"
    both = vectors.select("bucket", F.lit(None).cast("long").alias("anchor_key"), "vec_id", "label",
                          "vector", F.lit(None).cast(kind).alias("positives")).union(
        met.select("bucket", "anchor_key", "vec_id", "label", "vector",
                   F.col("positives").cast(kind)))
    return (both.repartition("bucket")
            .sortWithinPartitions("bucket", F.col("anchor_key").asc_nulls_first())
            .mapInArrow(partial(_search_task, width=width, k=k, low=low), FOUND_SCHEMA))


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80,
                   anchor_every: int = 100, scale: float = 256.0, vec_id: str = "vec_id",
                   label: str = "label", vector: str = "embedding") -> DataFrame:
    """For anchors and their nearest rows of the same label, the hardest rows of other labels.

    Components become ``floor(scale * x)``, scores are integer inner products. Anchors are the rows
    whose id is divisible by ``anchor_every``; positives are an anchor's first ``positives`` other
    rows of its label by falling score, then id; negatives are the first ``negatives`` rows of
    other labels with ``low * positive_score <= 100 * negative_score <= 100 * positive_score``.

    Returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``. Rows with
    a null id, label or vector, or with a null or non-finite component, take no part. Repeated rows
    count once; an anchor has no positive with its own id. Of vectors with different lengths the
    shorter end in zeros; an empty one scores zero everywhere. A component beyond 32 bits or a score
    beyond 64 raises. Ties go to the smaller id. Other columns are not read. No rows, no result.
    """
    packed = rows.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        F.col(f"`{label}`").cast("long").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector")).mapInArrow(
            partial(_vector_task, scale=scale), VECTOR_SCHEMA)
    packed = stored(packed, "vectors")
    n, width = packed.agg(F.count("*"), F.max(F.length("vector"))).first()
    buckets, width = max(1, -(-n // BUCKET_ROWS)), (width or 0) // 4
    vectors = stored(packed.repartitionByRange(buckets, F.desc("length"), "vec_id")
                     .withColumn("bucket", F.spark_partition_id()), "vector-buckets")
    anchors = stored(packed.where(F.col("vec_id") % anchor_every == 0).distinct()
                     .withColumn("anchor_key", F.xxhash64("vec_id", "label", "vector")), "anchors")
    kind = "array<struct<id:bigint,score:bigint>>"
    first = _search(vectors, anchors.withColumn("least", F.lit(None).cast("double"))
                    .withColumn("positives", F.lit(None).cast(kind)),
                    buckets, width, positives, None)
    order = Window.partitionBy("anchor_key").orderBy(F.desc("positive_score"), "positive_id")
    best = (first.select("anchor_key", "positive_id", "positive_score")
            .withColumn("place", F.row_number().over(order)).where(f"place <= {positives}")
            .groupBy("anchor_key").agg(F.collect_list(F.struct(
                F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))
                .alias("positives")))
    # Of the bands of a score s >= 0 the lowest end is that of the smallest s.
    least = F.ceil(F.array_min(F.expr("transform(filter(positives, x -> x.score >= 0), "
                                      "x -> x.score)")) * (low / 100) - 1)
    known = stored(anchors.join(best, "anchor_key").withColumn("least", least.cast("double"))
                   .where("least is not null"), "anchor-positives")
    second = _search(vectors, known, buckets, width, negatives, low)
    order = Window.partitionBy("anchor_key", "positive_id", "positive_score").orderBy(
        F.desc("negative_score"), "negative_id")
    return (second.withColumn("rank", F.row_number().over(order)).where(f"rank <= {negatives}")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
                    "negative_id", "positive_score", "negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all embeddings; a row whose id is divisible by 7 has its label moved on."""
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10)
        .otherwise(F.col("label")).alias("label"), "embedding")
    return hard_negatives(rows)


SQL = """
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
       row_number() OVER (PARTITION BY anchor_id, positive_id
                          ORDER BY score DESC, other)::INTEGER AS rank
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
