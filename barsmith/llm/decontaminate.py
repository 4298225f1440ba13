"""Benchmark decontamination by spaced seeds.

Texts become words of letters and digits in lower case. Fixed masks mark which words of a window
count and which are ignored; windows of test items and of documents with the same hash under the
same mask are seeds. Around each seed, document and item are laid side by side and all maximal
stretches are scored, +1 for an equal word and -SUBSTITUTION for another one, so replaced words
neither hide an overlap nor lengthen it. An overlap is a stretch that loses score wherever it is
cut at its ends, and that has enough equal words.

The masks lose none: such a stretch has a positive score from its first word to any other, and
there are few patterns of equal and replaced words that do so up to the least number of equal
words. One of the masks fits into each of them (a test enumerates them). Fewer equal words leave
fewer patterns, so shorter items have masks of their own.

Items are joined in blocks of at most about BLOCK_WORDS words: a task holds the seeds of one block
and reads the documents against it. A larger benchmark takes more blocks, never more memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm import textscan as ts
from barsmith.llm.store import documents, stored, table

#: Least equal words of an overlap, and masks one of which fits into every overlap with at least so
#: many. 1: the word counts, 0: it is ignored. They hold for this SUBSTITUTION.
MASKS = (
    (12, ("11101101", "11110001001", "11101000101")),
    (9, ("11101101", "111110001", "11101010001", "11110101")),
    (6, ("111101", "111011", "11111")),
    (3, ("111",)),
    (2, ("11",)),
    (1, ("1",)),
)
SUBSTITUTION = 2
#: An overlap has so many equal words, or SHARE of the item's words if that is less.
MIN_WORDS = 13
SHARE = 0.75
BLOCK_WORDS = 1 << 20
#: Words of diagonals compared at once.
COMPARED_AT_ONCE = 1 << 20
#: Longer items are cut into pieces that overlap by twice the least overlap.
PIECE_WORDS = 4096


def _item_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets, _ = ts.buffers(batch.column(1))
        ids, starts, words = [], [], []
        for r in range(batch.num_rows):
            w = ts.scan(ts.alphanumeric(), data, offsets[r:r + 2]).hashes
            for at in range(0, max(1, len(w) - 2 * MIN_WORDS), PIECE_WORDS - 2 * MIN_WORDS):
                if len(w):
                    ids.append(batch.column(0)[r].as_py())
                    starts.append(at)
                    words.append(w[at:at + PIECE_WORDS].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(words, pa.binary())],
            names=["item_id", "start", "words"])


def _seeds(words: np.ndarray, ends: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the counting words at each place where the mask fits before ``ends`` of its text."""
    at = np.arange(len(words))
    at = at[at + len(mask) <= ends]
    h = np.full(len(at), int(mask, 2), dtype=np.uint64)
    for k, mark in enumerate(mask):
        if mark == "1":
            h = ts.mix(h + words[at + k])
    return h, at


def _stretches(same: np.ndarray) -> list[tuple[int, int]]:
    """First word and end of all maximal stretches: those of positive score from either end to any
    word between, as long as they get (the algorithm of Ruzzo and Tompa over runs of equal words)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -SUBSTITUTION))]).tolist()
    out: list[tuple[int, int]] = []
    for start, end in edges.reshape(-1, 2).tolist():
        while True:
            j = len(out) - 1
            while j >= 0 and sums[out[j][0]] >= sums[start]:
                j -= 1
            if j < 0 or sums[out[j][1]] >= sums[end]:
                break
            start = out[j][0]
            del out[j:]
        out.append((start, end))
    return out


class Block:
    """Words and seeds of some test items."""

    def __init__(self, ids: list[int], pieces: list[np.ndarray]):
        self.ids = np.array(ids, dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.words = np.concatenate(pieces) if pieces else np.zeros(0, dtype=np.uint64)
        sizes = np.diff(self.first)
        #: Least equal words of an overlap with the item.
        self.least = np.minimum(MIN_WORDS, np.ceil(SHARE * sizes)).astype(np.int64)
        tier = np.array([next(n for n, _ in MASKS if n <= least) for least in self.least.tolist()],
                        dtype=np.int64)
        owner = np.repeat(np.arange(len(pieces)), sizes)
        #: The masks of the items there are; what two kinds of items share is looked up once.
        self.masks = sorted({m for n, masks in MASKS if n in tier for m in masks})
        found = []
        for mask in self.masks:
            h, at = _seeds(self.words, self.first[1:][owner], mask)
            own = np.isin(tier[owner[at]], [n for n, masks in MASKS if mask in masks])
            found.append(np.stack([h[own], at[own].astype(np.uint64)]))
        h, at = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.uint64)
        order = np.argsort(h, kind="stable")
        h, self.at = h[order], at[order].astype(np.int64)
        keys, where = np.unique(h, return_index=True)
        self.table = ts.SortedHashes(keys)
        count = np.diff(np.append(where, len(h)))
        self.where, self.count = where[self.table.order], count[self.table.order]
        self.owner = owner

    def hits(self, words: ts.Words) -> np.ndarray:
        """Texts, items and diagonals of all seeds, each three once."""
        text = words.text_of_word()
        ends = words.first[1:][text] if len(text) else text
        out = []
        for mask in self.masks:
            h, at = _seeds(words.hashes, ends, mask)
            row = self.table.find(h)
            at, row = at[row >= 0], row[row >= 0]
            n = self.count[row]
            k = np.repeat(self.where[row] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            place, at = self.at[k], np.repeat(at, n)
            out.append(np.stack([text[at], self.owner[place], at - place]))
        found = np.concatenate(out, axis=1) if out else np.zeros((3, 0), dtype=np.int64)
        found = found[:, np.lexsort(found)]
        new = np.ones(found.shape[1], dtype=bool)
        new[1:] = (found[:, 1:] != found[:, :-1]).any(axis=0)
        return found[:, new]

    def overlaps(self, words: ts.Words) -> Iterator[tuple[int, int, int, int, int, int]]:
        """Text, item, equal words, replaced words, first word in the text, and words of the item."""
        text, item, diagonal = self.hits(words)
        lo = np.maximum(words.first[text], self.first[item] + diagonal)
        size = np.minimum(words.first[text + 1], self.first[item + 1] + diagonal) - lo
        done = np.concatenate([[0], np.cumsum(size)])
        a = 0
        while a < len(text):
            b = max(a + 1, int(np.searchsorted(done, done[a] + COMPARED_AT_ONCE, "right")) - 1)
            yield from self._verified(words, text[a:b], item[a:b], diagonal[a:b], lo[a:b], size[a:b])
            a = b

    def _verified(self, words, text, item, diagonal, lo, size):
        ends = np.cumsum(size)
        starts = ends - size
        at = np.repeat(lo - starts, size) + np.arange(int(ends[-1]))
        same = words.hashes[at] == self.words[at - np.repeat(diagonal, size)]
        # The first words of an overlap, up to the least number of equal ones, are no more than this.
        least = self.least[item]
        width = least + (least - 1) // SUBSTITUTION
        sums = np.concatenate([[0], np.cumsum(same)])
        place = np.arange(len(at))
        stop = np.minimum(place + np.repeat(width, size), np.repeat(ends, size))
        dense = np.logical_or.reduceat(sums[stop] - sums[place] >= np.repeat(least, size), starts)
        for k in np.flatnonzero(dense):
            mine = same[starts[k]:ends[k]]
            for start, end in _stretches(mine):
                equal = int(mine[start:end].sum())
                if equal >= least[k]:
                    yield (int(text[k]), int(self.ids[item[k]]), equal, end - start - equal,
                           int(lo[k]) + start - int(words.first[text[k]]),
                           int(self.first[item[k] + 1] - self.first[item[k]]))


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text"):
    """Broadcast Blocks of the items, one at a time; items without id or words are left out."""
    spark = benchmark.sparkSession
    items = stored(benchmark.where(F.col(item_id).isNotNull()).select(
        F.col(item_id).cast("long"), F.col(text).cast("string")).mapInArrow(
        _item_task, "item_id long, start long, words binary"), "items")
    total = items.agg(F.sum(F.length("words"))).first()[0] or 0
    n = max(1, math.ceil(total / 8 / (BLOCK_WORDS / 2)))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "start"), F.lit(n)) == k)
        rows = part.orderBy("item_id", "start").toPandas()
        if len(rows):
            yield spark.sparkContext.broadcast(Block(
                rows["item_id"].tolist(), [np.frombuffer(w, dtype=np.uint64)
                                           for w in rows["words"]]))


def _scan_texts(column: pa.Array) -> Iterator[tuple[int, ts.Words]]:
    data, offsets, _ = ts.buffers(column)
    for a, b in ts.groups(offsets):
        yield a, ts.scan(ts.alphanumeric(), data, offsets[a:b + 1])


OVERLAP = ("doc_id long, item_id long, n_equal long, n_replaced long, first_word long, "
           "item_words long")


def _overlap_task(batches: Iterator[pa.RecordBatch], block) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(batch.column(0)[a + t].as_py(), *rest) for a, words in _scan_texts(batch.column(1))
                for t, *rest in block.value.overlaps(words)]
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                         names=[c.split()[0] for c in OVERLAP.split(", ")])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps: a row per ``doc_id`` and ``item_id``, with the longest stretch.

    ``n_equal`` equal and ``n_replaced`` replaced words lie from word ``first_word`` on. Null and
    empty texts overlap with nothing. Rows with equal doc_id are taken together; ids must be
    integers. An empty benchmark gives no rows.
    """
    frame = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = docs.sparkSession.createDataFrame([], OVERLAP)
    for block in blocks(benchmark):
        out = out.union(frame.mapInArrow(partial(_overlap_task, block=block), OVERLAP))
    best = F.max(F.struct("n_equal", (-F.col("n_replaced")).alias("r"),
                          (-F.col("first_word")).alias("f"), "item_words")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "b.n_equal", (-F.col("b.r")).alias("n_replaced"),
        (-F.col("b.f")).alias("first_word"), "b.item_words")


def _flagged(block, text: F.Column) -> F.Column:
    def run(column: pa.Array) -> pa.Array:
        out = np.zeros(len(column), dtype=bool)
        for a, words in _scan_texts(column):
            for t, *_ in block.value.overlaps(words):
                out[a + t] = True
        return pa.array(out)

    return F.arrow_udf(run, returnType="boolean")(text)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without an overlap with any item, unchanged; null and empty texts stay."""
    for block in blocks(benchmark):
        docs = docs.where(~_flagged(block, F.col("text")))
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
