"""Near-duplicate documents by MinHash: banded minima, signature checks, full-set confirmation.

1. *Sets.* A row per document with size and hash of its shingle set. Documents with one set are one
   node; the first of a task also sends the minima of :data:`BANDS` x :data:`ROWS` universal hash
   functions, as band keys and as a signature of a byte each, and a parity sketch of the set.
2. *Star.* Nodes with a common band key are a bucket. Each is paired with the smallest node of its
   bucket only, so a bucket of k nodes gives k - 1 pairs. Signatures and sketches rule pairs out,
   the rest is confirmed on the full sets; confirmed links give first components.
3. *Crossing pairs.* A bucket whose nodes are all in one component is closed. In an open bucket
   every pair of nodes from different components is compared by signature and sketch inside a task
   (large buckets in pairs of blocks), in the first bucket they share; only survivors become rows
   and are confirmed on full sets.
   So no link that could join two components stays untried, and pairs within one are not made.
4. *Components* by alternating large-star and small-star over the links of both steps.

Two sets of similarity s share a bucket with probability 1 - (1 - s^ROWS)^BANDS: a pair at 0.85 is
missed once in 10^8, and a pair at 0.5 is compared every other time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm import textscan as ts
from barsmith.llm.graph import components
from barsmith.llm.jaccard import shingle_sets
from barsmith.llm.store import documents, stored

BANDS, ROWS = 40, 6
SEED = 20_011
#: Equal signature bytes that two sets at the threshold have but once in about 10^10 times lie this
#: many standard deviations below their mean.
DEVIATIONS = 6.5
#: Bits of a parity sketch: at least so many, and four to eight a shingle.
SKETCH_BITS = 512
#: Set hashes a task remembers in order not to send the minima of a copy again.
REMEMBERED = 1 << 16
#: Shingles hashed together, so that the arrays stay in the processor's cache.
HASHED_AT_ONCE = 1 << 16
#: Nodes of one bucket that a task compares with each other; more are cut into blocks.
BLOCK = 2048
#: Partners confirmed against one copy of a set.
PARTNERS = 512
#: Bits of the filter that picks the documents whose full sets are needed.
PICK_BITS = 22


def multipliers() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of the universal hash functions; the same in every task."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    return a, rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)


def minima(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minima of all functions (rows) over the segments of ``h`` that begin at ``starts``."""
    out = np.empty((BANDS * ROWS, len(starts)), dtype=np.uint64)
    for k, (a, b) in enumerate(zip(*multipliers(), strict=True)):
        out[k] = np.minimum.reduceat(h * a + b, starts)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """A key per band and segment from the minima of the band's functions."""
    keys = np.empty((BANDS, low.shape[1]), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(low.shape[1], band + 1, dtype=np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = ts.mix(key * np.uint64(0x9E3779B97F4A7C15) + low[k])
        keys[band] = key
    return keys


def set_hash(s: np.ndarray) -> int:
    """64 bits of a set, whatever the order; size included."""
    total = np.add.reduce(ts.mix(s ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(s))
    return int(ts.mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def sketch(s: np.ndarray) -> bytes:
    """Parity of the elements in each of a power of two of cells."""
    bits = max(SKETCH_BITS, 1 << (4 * len(s) - 1).bit_length())
    cells = (s >> np.uint64(17)) & np.uint64(bits - 1)
    odd = np.bincount(cells.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(x: np.ndarray, width: int) -> np.ndarray:
    while x.shape[-1] > width:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def least_equal(percent: int) -> int:
    """Signature bytes that must agree."""
    n, t = BANDS * ROWS, percent / 100
    return int(n * t - DEVIATIONS * (n * t * (1 - t)) ** 0.5)


class Side:
    """Sizes, signatures and sketches of some nodes, as arrays that are compared as a whole."""

    def __init__(self, n, signatures: list[bytes], sketches: list[bytes]):
        self.n = np.asarray(n, dtype=np.int64)
        self.signatures = np.frombuffer(b"".join(signatures), dtype=np.uint8).reshape(
            len(self.n), BANDS * ROWS)
        self.widths = np.array([len(x) for x in sketches], dtype=np.int64)
        self.sketches = [np.frombuffer(x, dtype=np.uint8) for x in sketches]
        self._folds: dict[int, np.ndarray] = {}

    def folded(self, width: int) -> np.ndarray:
        if width not in self._folds:
            self._folds[width] = np.stack([
                _folded(x, width) if len(x) >= width else np.zeros(width, dtype=np.uint8)
                for x in self.sketches])
        return self._folds[width]

    def like(self, k: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Which of ``others`` node ``k`` may be linked with.

        Sizes and sketches rule out for certain: with a Jaccard similarity t no more than
        (1 - t) / (1 + t) (|A| + |B|) elements are in one set only, and each flips one bit.
        """
        a, b = self.n[k], self.n[others]
        others = others[(100 * np.minimum(a, b) >= percent * np.maximum(a, b))]
        equal = (self.signatures[others] == self.signatures[k]).sum(axis=1)
        others = others[equal >= least_equal(percent)]
        found = []
        width_k = self.widths[k]
        for width in np.unique(self.widths[others]):
            same = others[self.widths[others] == width]
            w = int(min(width, width_k))
            table = self.folded(w)
            bits = np.bitwise_count(table[same] ^ table[k]).sum(axis=1, dtype=np.int64)
            found.append(same[bits * (100 + percent) <= (100 - percent) * (a + self.n[same])])
        return np.concatenate(found) if found else others


ROW_SCHEMA = ("doc_id long, n int, node long, bands array<long>, signature binary, "
              "sketch binary, shorts binary")


def _row_task(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        rows = batch.num_rows
        n, node = np.zeros(rows, dtype=np.int32), np.zeros(rows, dtype=np.int64)
        signatures: list[bytes | None] = [None] * rows
        sketches: list[bytes | None] = [None] * rows
        shorts: list[bytes | None] = [None] * rows
        sent = np.zeros(rows, dtype=bool)
        bands = np.zeros((rows, BANDS), dtype=np.int64)
        named = np.asarray(batch.column(0).is_valid())
        waiting: list[tuple[int, np.ndarray]] = []
        held = 0

        def work(waiting) -> None:
            lengths = np.array([len(s) for _, s in waiting])
            low = minima(np.concatenate([s for _, s in waiting]), np.cumsum(lengths) - lengths)
            keys = band_keys(low).view(np.int64)
            last = (low >> np.uint64(24)).astype(np.uint8)
            for k, (r, s) in enumerate(waiting):
                bands[r], sent[r] = keys[:, k], True
                signatures[r] = last[:, k].tobytes()
                sketches[r] = sketch(s)
                shorts[r] = keys[:, k].astype(np.uint32).tobytes()

        for r, s in shingle_sets(batch.column(1), size):
            n[r] = len(s)
            if not len(s):
                continue
            node[r] = key = set_hash(s)
            if not named[r] or key in seen:  # a row without id links nothing
                continue
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.add(key)
            waiting.append((r, s.copy()))
            held += len(s)
            if held >= HASHED_AT_ONCE:
                work(waiting)
                waiting, held = [], 0
        if waiting:
            work(waiting)
        ends = np.zeros(rows + 1, dtype=np.int32)
        np.cumsum(np.where(sent, BANDS, 0), out=ends[1:])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n), pa.array(node),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[sent].ravel())),
             pa.array(signatures, pa.binary()), pa.array(sketches, pa.binary()),
             pa.array(shorts, pa.binary())],
            names=["doc_id", "n", "node", "bands", "signature", "sketch", "shorts"])


PAIR_SCHEMA = "u long, v long"


def _pairs_batch(u: list, v: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())],
                                      names=["u", "v"])


def _star_task(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that may be linked, from rows ``u, v`` and sizes, signatures, sketches of both."""
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        m = batch.num_rows
        if not m:
            continue
        both = Side(cols[2] + cols[5], cols[3] + cols[6], cols[4] + cols[7])
        keep = [k for k in range(m) if len(both.like(k, np.array([m + k]), percent))]
        yield _pairs_batch([cols[0][k] for k in keep], [cols[1][k] for k in keep])


def _crossing(band: int, node, label, part, side: Side, shorts: np.ndarray, whole: bool,
              percent: int) -> Iterator[tuple[int, int]]:
    """Pairs with different labels that may be linked; of two blocks only those across them.

    A pair is left to the first band in which the lower halves of its keys agree: that bucket holds
    both nodes, so it is open too. (Halves that agree by chance lose a pair once in 10^8 times.)
    """
    here = np.uint32(band & 0xFFFFFFFF)
    order = np.argsort(side.n, kind="stable")
    sizes = side.n[order]
    for at, k in enumerate(order):
        top = int(np.searchsorted(sizes, 100 * sizes[at] // percent, "right"))
        others = order[at + 1:top]
        others = others[label[others] != label[k]]
        if not whole:
            others = others[part[others] != part[k]]
        if len(others):
            equal = shorts[others] == shorts[k]
            others = others[shorts[k][equal.argmax(axis=1)] == here]
        for j in side.like(int(k), others, percent) if len(others) else ():
            yield min(node[k], node[j]), max(node[k], node[j])


def _cross_task(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``band, first, second`` (bucket and pair of blocks); a group is at most two
    blocks of rows."""
    held: list[list] = [[] for _ in range(10)]

    def report() -> pa.RecordBatch:
        first, second = held[1][0], held[2][0]
        node, index = np.unique(np.array(held[3], dtype=np.int64), return_index=True)
        label = np.array(held[4], dtype=np.int64)[index]
        part = np.array(held[5], dtype=np.int64)[index]
        side = Side(np.array(held[6])[index], [held[7][i] for i in index],
                    [held[8][i] for i in index])
        shorts = np.frombuffer(b"".join(held[9][i] for i in index), dtype=np.uint32).reshape(
            len(index), BANDS)
        pairs = list(_crossing(held[0][0], node, label, part, side, shorts, first == second,
                               percent))
        return _pairs_batch([p[0] for p in pairs], [p[1] for p in pairs])

    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for row in zip(*cols, strict=True):
            if held[0] and (held[0][0], held[1][0], held[2][0]) != row[:3]:
                yield report()
                held = [[] for _ in range(10)]
            for k, x in enumerate(row):
                held[k].append(x)
    if held[0]:
        yield report()


def _bucket(ids: np.ndarray) -> np.ndarray:
    return (ts.mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - PICK_BITS)).astype(
        np.int64)


def _picked(ids: DataFrame) -> np.ndarray:
    """Flags of the documents to read again: 2^22 at most, however many there are."""
    def marks(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.unique(_bucket(batch.column(0).to_numpy())))], names=["bucket"])
    rows = ids.select("doc_id").mapInArrow(marks, "bucket long").distinct().toPandas()
    wanted = np.zeros(1 << PICK_BITS, dtype=bool)
    wanted[rows["bucket"].to_numpy(dtype=np.int64)] = True
    return np.packbits(wanted)


def _set_task(batches: Iterator[pa.RecordBatch], size: int, picked) -> Iterator[pa.RecordBatch]:
    wanted = np.unpackbits(picked.value).astype(bool)

    def rows(ids, nodes, sets) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())],
            names=["doc_id", "node", "members"])

    for batch in batches:
        ids = batch.column(0)
        take = ids.is_valid().to_numpy(zero_copy_only=False) & wanted[
            _bucket(ids.fill_null(0).to_numpy(zero_copy_only=False))]
        chosen = ids.filter(pa.array(take)).to_pylist()
        out_ids, nodes, sets, held = [], [], [], 0
        for r, s in shingle_sets(batch.column(1).filter(pa.array(take)), size):
            out_ids.append(chosen[r])
            nodes.append(set_hash(s) if len(s) else 0)
            sets.append(s.tobytes())
            held += len(s)
            if held > 1 << 18:
                yield rows(out_ids, nodes, sets)
                out_ids, nodes, sets, held = [], [], [], 0
        yield rows(out_ids, nodes, sets)


def _confirm_task(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows ``u, salt, v, members``: first the set of u with null v, then its partners."""
    own: tuple | None = None
    for batch in batches:
        us, salts, vs = (batch.column(k).to_pylist() for k in range(3))
        members, keep_u, keep_v = batch.column(3), [], []
        for r, (u, salt, v) in enumerate(zip(us, salts, vs, strict=True)):
            s = np.frombuffer(members[r].as_buffer(), dtype=np.uint64)
            if v is None:
                own = (u, salt, s.copy())
            elif own and own[:2] == (u, salt):
                both = len(np.intersect1d(own[2], s, assume_unique=True))
                if 100 * both >= percent * (len(own[2]) + len(s) - both):
                    keep_u.append(u)
                    keep_v.append(v)
        yield _pairs_batch(keep_u, keep_v)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold. A set goes once to each :data:`PARTNERS` of its
    partners, so a node with very many is spread over tasks."""
    many = pairs.groupBy("u").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    dealt = pairs.join(many, "u").select("u", F.pmod(F.xxhash64("v"), F.col("parts"))
                                         .alias("salt"), "v")
    own = (dealt.select("u", "salt").distinct()
           .join(sets.select(F.col("node").alias("u"), "members"), "u")
           .select("u", "salt", F.lit(None).cast("long").alias("v"), "members"))
    partner = (dealt.join(sets.select(F.col("node").alias("v"), "members"), "v")
               .select("u", "salt", "v", "members"))
    return (own.union(partner).repartition("u", "salt")
            .sortWithinPartitions("u", "salt", F.col("v").asc_nulls_first())
            .mapInArrow(partial(_confirm_task, percent=percent), PAIR_SCHEMA).distinct())


def minhash_components(docs: DataFrame, size: int = 3, percent: int = 85, doc_id: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """Link documents whose shingle sets have ``100 |A and B| >= percent |A or B|``.

    Returns ``doc_id, n_shingles, set_id, component_id, kept``, a row per input row: ``set_id`` is
    the smallest doc_id with the same set, ``component_id`` the smallest that links reach, ``kept``
    whether that is the row's own. A text with fewer words than ``size`` is one shingle; null,
    empty and blank texts have none, link with nothing and are kept. Repeated rows link with each
    other and are kept or not together. A row without doc_id has null ids and is kept. Two texts
    with one doc_id are nodes of their own. ``doc_id`` must be an integer; other columns are not
    read, whatever their names. No rows give no rows. Texts of any length are read whole.
    """
    spark = docs.sparkSession
    frame = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                        F.col(f"`{text}`").cast("string").alias("text"))
    rows = stored(frame.mapInArrow(partial(_row_task, size=size), ROW_SCHEMA), "minhash-rows")
    named = rows.where("n > 0 and doc_id is not null")
    nodes = stored(named.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "minhash-nodes")

    sent = named.where("size(bands) > 0")
    keys = sent.select(F.explode("bands").alias("band"), "node")
    shared = (keys.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"))
              .where("low < high").select("band", "low"))
    buckets = stored(keys.join(shared, "band").select("band", "low", "node").distinct(),
                     "minhash-buckets")
    wanted = buckets.select("node").distinct()
    marks = stored(sent.select("node", "n", "signature", "sketch", "shorts").join(wanted, "node")
                   .dropDuplicates(["node"]), "minhash-marks")
    picked = spark.sparkContext.broadcast(_picked(nodes.join(wanted, "node").select("doc_id")))
    sets = stored(frame.mapInArrow(partial(_set_task, size=size, picked=picked),
                                   "doc_id long, node long, members binary")
                  .join(nodes.join(wanted, "node"), ["doc_id", "node"]).select("node", "members"),
                  "minhash-sets")

    star = (buckets.where("node <> low").select(F.col("low").alias("u"), F.col("node").alias("v"))
            .distinct())
    marked = {x: marks.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"),
                              F.col("signature").alias(f"s_{x}"), F.col("sketch").alias(f"k_{x}"))
              for x in "uv"}
    star = stored(star.join(marked["u"], "u").join(marked["v"], "v")
                  .select("u", "v", "n_u", "s_u", "k_u", "n_v", "s_v", "k_v")
                  .mapInArrow(partial(_star_task, percent=percent), PAIR_SCHEMA), "minhash-star")
    links = stored(_confirmed(star, sets, percent), "minhash-links")
    label = components(links)

    held = buckets.select("band", "node").join(label, "node", "left").select(
        "band", "node", F.coalesce("root", "node").alias("label"))
    opened = (held.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                       F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
              .where("low < high").select("band", "blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    blocks = (held.join(opened, "band").withColumn("part", own)
              .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
              .select("band", F.least("part", "other").alias("first"),
                      F.greatest("part", "other").alias("second"), "node", "label", "part"))
    crossing = stored(
        blocks.join(marks, "node")
        .select("band", "first", "second", "node", "label", "part", "n", "signature", "sketch",
                "shorts")
        .repartition("band", "first", "second").sortWithinPartitions("band", "first", "second")
        .mapInArrow(partial(_cross_task, percent=percent), PAIR_SCHEMA).distinct()
        .join(star, ["u", "v"], "left_anti"), "minhash-crossing")
    links = links.union(_confirmed(crossing, sets, percent))
    roots = components(links).withColumnRenamed("root", "found")

    found = nodes.join(roots, "node", "left").select(
        "node", F.col("doc_id").alias("set_id"), F.coalesce("found", "node").alias("found"))
    least = found.groupBy("found").agg(F.min("set_id").alias("component_id"))
    member = found.join(least, "found").select("node", "set_id", "component_id")
    out = rows.select("doc_id", "n", "node").join(member, "node", "left")
    named_row = F.col("doc_id").isNotNull()
    component = F.when(named_row, F.when(F.col("n") > 0, F.col("component_id"))
                       .otherwise(F.col("doc_id")))
    return out.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(named_row, F.when(F.col("n") > 0, F.col("set_id")).otherwise(F.col("doc_id")))
        .alias("set_id"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents: words of three, Jaccard similarity of at least 0.85."""
    return minhash_components(documents(spark, sf_dir)).select(
        "doc_id", "n_shingles", "component_id", "kept", "set_id")


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) BETWEEN 1 AND 2 THEN [array_to_string(words, ' ')]
      ELSE list_distinct([words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]
                          FOR i IN range(1, len(words) - 1)]) END AS shingles
  FROM w WHERE len(words) > 0
), one AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS s FROM sets),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, a.n + b.n AS total, count(*) AS shared
  FROM one a JOIN one b ON a.s = b.s AND a.doc_id <> b.doc_id
       AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY ALL
), links AS (SELECT u, v FROM common WHERE 100 * shared >= 85 * (total - shared)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents WHERE doc_id IS NOT NULL
  UNION SELECT reach.doc_id, links.v FROM reach JOIN links ON links.u = reach.other
), low AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id),
same AS (
  SELECT doc_id, n, min(doc_id) OVER (PARTITION BY k) AS set_id
  FROM (SELECT doc_id, len(shingles) AS n, list_sort(shingles) AS k FROM sets)
)
SELECT d.doc_id, coalesce(same.n, 0)::BIGINT AS n_shingles, low.component_id,
       coalesce(d.doc_id = low.component_id, true) AS kept, coalesce(same.set_id, d.doc_id) AS set_id
FROM documents d LEFT JOIN same USING (doc_id) LEFT JOIN low USING (doc_id)
"""
