"""Spelling variants by a trie of letter-group counts.

A word becomes the vector of its code points counted by letter group. One inserted, deleted or
replaced code point changes one count by one, or two counts by one each in opposite directions (or
none, within a group). Words are the leaves of a trie over successive counts; a search walks it
with a budget of one surplus and one deficit and verifies the words of the leaves it reaches.

1. *Words.* Runs of letters are taken, altered and counted with SQL functions; counts fold on the
   map side.
2. *Dealing out.* The first :func:`depth` counts of the vector are a word's cell; the depth follows
   the number of words. A word is a leaf in its own cell and a query in each cell within the
   budget, with what is left of it; large cells are cut into blocks and met block by block.
3. *Search.* A task builds the trie over the other counts of a block, walks it with its queries
   level by level and verifies, first the three code points at either end, of which one end must
   agree. It sends one row for each query that found something: how many near words, and the most
   frequent of them. Pairs never leave the task.
4. *Forms and roots.* Rows of a word are folded; forms are followed by pointer jumping, whose
   rounds are few because frequencies rise at least tenfold with each step.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm import textscan as ts
from barsmith.llm.store import documents, stored

#: Letter groups of about equal use, most telling first; a code point outside them counts by its
#: value. Which letters share a group steers the work, never the result.
GROUPS = ("e", "t", "a", "i", "o", "n", "r", "s", "h", "l", "d", "cu", "mfp", "gwy", "bvkxjqz")
#: Leaves of a block.
BLOCK_WORDS = 1 << 16
#: Queries walked together.
QUERIES_AT_ONCE = 1 << 12
#: Candidate pairs verified together.
PAIRS_AT_ONCE = 1 << 17
#: Longer words are verified one by one instead of in a matrix.
MATRIX_CHARS = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def group_of() -> np.ndarray:
    """Letter group of each code point up to 255."""
    out = np.arange(256) % len(GROUPS)
    for g, letters in enumerate(GROUPS):
        for c in letters:
            out[ord(c)] = out[ord(c.upper())] = g
    return out


_GROUP_OF = group_of()


def count_words(docs: DataFrame, least_chars: int, least_n: int, slip_every: int,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: altered runs of letters with their number of occurrences."""
    runs = docs.select(
        F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(f"`{text}`").cast("string"),
                                       F.lit(f"([A-Za-zÀ-ÿ]{{{least_chars},}})")))
        .alias("run"))
    low = runs.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER))
                      .otherwise(F.col("run")).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run"))
    gone = (h % F.length("run")).cast("int")
    word = F.when(h % slip_every == 0, F.concat(
        F.substring("run", F.lit(1), gone), F.substring("run", gone + 2, F.length("run")))
    ).otherwise(F.col("run")) if slip_every else F.col("run")
    return (low.select(word.alias("word")).where(F.length("word") >= least_chars)
            .groupBy("word").agg(F.count("*").alias("n")).where(f"n >= {least_n}"))


class Words:
    """Words as flat code points (all below 256), read from the UTF-8 buffers of a column."""

    def __init__(self, column: pa.Array):
        self.column = column
        data, offsets, _ = ts.buffers(column)
        data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
        lead = data >= 0xC0  # of U+00C0 to U+00FF: C3, then one byte
        tail = (data & 0xC0) == 0x80
        codes = data.copy()
        at = np.flatnonzero(lead)
        codes[at] = 0xC0 | (data[at + 1] & 0x3F)
        self.flat = codes[~tail]
        self.first = (offsets - np.concatenate([[0], np.cumsum(tail)])[offsets]).astype(np.int64)
        self.lengths = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.lengths)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.lengths)

    def codes(self, k: int) -> np.ndarray:
        return self.flat[self.first[k]:self.first[k + 1]]

    def counts(self) -> np.ndarray:
        """Counts of the letter groups of each word."""
        return np.bincount(self.row() * len(GROUPS) + _GROUP_OF[self.flat],
                           minlength=len(self) * len(GROUPS)).reshape(len(self), len(GROUPS))


def depth(n_words: int) -> int:
    """Counts that make up a cell: about two to three values a count are in use."""
    return int(min(len(GROUPS) - 2, max(2, np.ceil(np.log2(max(2, n_words / BLOCK_WORDS))))))


def _moves(k: int) -> np.ndarray:
    """Changes of ``k`` counts by at most one surplus and one deficit; no change first."""
    eye = np.eye(k, dtype=np.int64)
    out = [np.zeros((1, k), dtype=np.int64), eye, -eye]
    out += [eye[i] - np.delete(eye, i, axis=0) for i in range(k)]
    return np.concatenate(out)


def _cell_keys(counts: np.ndarray) -> np.ndarray:
    """A key of 64 bits of each row of counts, the same for equal rows."""
    key = np.zeros(len(counts), dtype=np.uint64)
    for column in counts.T:
        key = (key ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


CELL_SCHEMA = "word string, n long, cell long, leaf boolean, surplus boolean, deficit boolean"


def _cell_task(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    moves = _moves(k)
    surplus, deficit = ~(moves > 0).any(axis=1), ~(moves < 0).any(axis=1)
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            part = batch.slice(lo, 4096)
            head = Words(part.column(0)).counts()[:, :k]
            near = head[:, None, :] + moves[None, :, :]
            row, move = np.nonzero((near >= 0).all(axis=2))
            leaves = np.arange(part.num_rows)
            cells = np.concatenate([_cell_keys(head), _cell_keys(near[row, move])])
            rows = pa.array(np.concatenate([leaves, row]))
            full = np.ones(len(leaves), dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(rows), part.column(1).take(rows), pa.array(cells),
                 pa.array(np.arange(len(rows)) < len(leaves)),
                 pa.array(np.concatenate([full, surplus[move]])),
                 pa.array(np.concatenate([full, deficit[move]]))],
                names=[c.split()[0] for c in CELL_SCHEMA.split(", ")])


class Trie:
    """Leaves by their counts, level by level: a node is a distinct beginning of a vector."""

    def __init__(self, counts: np.ndarray):
        n, self.levels = counts.shape
        self.width = int(counts.max(initial=0)) + 1
        self.order = np.lexsort(counts.T[::-1])
        ordered = counts[self.order]
        node = np.zeros(n, dtype=np.int64)
        self.edges: list[np.ndarray] = []
        for level in range(self.levels):
            # Sorted rows make sorted edges: parent and count, whose position is the child.
            edge = node * self.width + ordered[:, level]
            new = np.ones(n, dtype=bool)
            new[1:] = edge[1:] != edge[:-1]
            self.edges.append(edge[new])
            node = np.cumsum(new) - 1
        self.first = np.searchsorted(node, np.arange(len(self.edges[-1]) + 1)) if self.levels else (
            np.array([0, n]))

    def walk(self, counts: np.ndarray, surplus: np.ndarray,
             deficit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query and leaf word of each pair whose counts lie within the budget that is left."""
        query = np.arange(len(counts))
        node = np.zeros(len(counts), dtype=np.int64)
        for level in range(self.levels):
            parts = []
            for step, may in ((0, None), (1, surplus), (-1, deficit)):
                at = np.arange(len(query)) if may is None else np.flatnonzero(may)
                value = counts[query[at], level] + step
                fits = (value >= 0) & (value < self.width)
                at, value = at[fits], value[fits]
                edge = node[at] * self.width + value
                child = np.searchsorted(self.edges[level], edge)
                there = child < len(self.edges[level])
                there[there] = self.edges[level][child[there]] == edge[there]
                at, child = at[there], child[there]
                parts.append((query[at], child, surplus[at] & (step != 1),
                              deficit[at] & (step != -1)))
            query, node, surplus, deficit = (np.concatenate(x) for x in zip(*parts, strict=True))
        size = self.first[node + 1] - self.first[node]
        query = np.repeat(query, size)
        within = np.arange(len(query)) - np.repeat(np.cumsum(size) - size, size)
        return query, self.order[np.repeat(self.first[node], size) + within]


class Spelling:
    """Words as rows of code points, aligned at both ends."""

    def __init__(self, words: Words):
        self.words, self.lengths = words, words.lengths
        short = self.lengths <= MATRIX_CHARS
        width = int(self.lengths[short].max(initial=0)) + 1
        self.left = np.zeros((len(words), width), dtype=np.uint8)
        self.right = np.zeros((len(words), width), dtype=np.uint8)
        row = words.row()
        use = short[row]
        row, codes = row[use], words.flat[use]
        at = (np.arange(len(words.flat)) - np.repeat(words.first[:-1], self.lengths))[use]
        self.left[row, at] = codes
        self.right[row, width - self.lengths[row] + at] = codes
        ends = [np.clip(words.first[1:] - 1 - k, 0, None) for k in range(3)]
        starts = [np.minimum(words.first[:-1] + k, len(words.flat) - 1) for k in range(3)]
        self.head, self.tail = (sum(words.flat[x].astype(np.int32) << (8 * k)
                                    for k, x in enumerate(places)) for places in (starts, ends))


def _one_apart_long(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) == len(b):
        return int((a != b).sum()) == 1
    if len(a) < len(b):
        a, b = b, a
    if len(a) != len(b) + 1:
        return False
    apart = np.flatnonzero(a[:-1] != b)
    at = int(apart[0]) if len(apart) else len(b)
    return bool((a[at + 1:] == b[at:]).all())


def one_apart(x: Spelling, i: np.ndarray, y: Spelling, j: np.ndarray) -> np.ndarray:
    """Which pairs differ by exactly one inserted, deleted or replaced code point.

    Words have seven code points or more, or else three at one end need not agree.
    """
    a, b = x.lengths[i], y.lengths[j]
    out = np.zeros(len(i), dtype=bool)
    long = np.maximum(a, b) > MATRIX_CHARS
    for k in np.flatnonzero(long & (np.abs(a - b) <= 1)):
        out[k] = _one_apart_long(x.words.codes(i[k]), y.words.codes(j[k]))
    k = np.flatnonzero(~long & (a == b))
    width = min(x.left.shape[1], y.left.shape[1])
    out[k] = (x.left[i[k], :width] != y.left[j[k], :width]).sum(axis=1) == 1
    k = np.flatnonzero(~long & (np.abs(a - b) == 1))
    apart = x.left[i[k], :width] != y.left[j[k], :width]
    same_front = np.where(apart.any(axis=1), apart.argmax(axis=1), width)
    apart = (x.right[i[k], x.right.shape[1] - width:] != y.right[j[k], y.right.shape[1] - width:])
    apart = apart[:, ::-1]
    same_back = np.where(apart.any(axis=1), apart.argmax(axis=1), width)
    out[k] = same_front + same_back >= np.minimum(a[k], b[k])
    return out


NEAR_SCHEMA = "word string, n_near long, near_n long, near string"


class Block:
    """The leaves of a block, ready to be searched."""

    def __init__(self, column: pa.Array, n: np.ndarray, k: int):
        words = Words(column)
        self.k, self.n, self.column = k, n, column
        self.trie, self.spelling = Trie(words.counts()[:, k:]), Spelling(words)
        self.rank = np.empty(len(n), dtype=np.int64)  # by UTF-8 bytes: by code points
        self.rank[np.asarray(pc.sort_indices(column.cast(pa.binary())))] = np.arange(len(n))

    def search(self, column: pa.Array, surplus: np.ndarray, deficit: np.ndarray) -> pa.RecordBatch:
        words = Words(column)
        mine = Spelling(words)
        query, leaf = self.trie.walk(words.counts()[:, self.k:], surplus, deficit)
        found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for lo in range(0, len(query), PAIRS_AT_ONCE):
            q, x = query[lo:lo + PAIRS_AT_ONCE], leaf[lo:lo + PAIRS_AT_ONCE]
            likely = (mine.head[q] == self.spelling.head[x]) | (
                mine.tail[q] == self.spelling.tail[x])
            q, x = q[likely], x[likely]
            near = one_apart(mine, q, self.spelling, x)
            found[0].append(q[near])
            found[1].append(x[near])
        q, x = (np.concatenate(f) for f in found)
        order = np.lexsort((self.rank[x], -self.n[x], q))  # the best of each query first
        q, x = q[order], x[order]
        which, first, count = np.unique(q, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays(
            [column.take(pa.array(which)), pa.array(count.astype(np.int64)),
             pa.array(self.n[x[first]]), self.column.take(pa.array(x[first]))],
            names=["word", "n_near", "near_n", "near"])


def _near_task(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows ``cell, block, leaf, word, n, surplus, deficit``, the leaves of a block before its
    queries."""
    at, leaves, block = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(c)).astype(np.int64) for c in range(3)]
        edge = np.ones(batch.num_rows, dtype=bool)
        edge[1:] = np.any([key[1:] != key[:-1] for key in keys], axis=0)
        starts = np.append(np.flatnonzero(edge), batch.num_rows)
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            here = (keys[0][lo], keys[1][lo])
            if here != at:
                at, leaves, block = here, [], None
            if keys[2][lo]:
                leaves.append(batch.slice(lo, hi - lo))
                continue
            if block is None:
                rows = pa.Table.from_batches(leaves).combine_chunks().to_batches()[0]
                block, leaves = Block(rows.column(3), np.asarray(rows.column(4)), k), []
            for cut in range(lo, hi, QUERIES_AT_ONCE):
                part = batch.slice(cut, min(QUERIES_AT_ONCE, hi - cut))
                yield block.search(part.column(3), *(
                    part.column(c).to_numpy(zero_copy_only=False) for c in (5, 6)))


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, near_n, near`` of each of ``words(word, n)`` that has near words: their
    number, and the most frequent (ties: smallest in code-point order)."""
    k = depth(words.count())
    cells = stored(words.mapInArrow(partial(_cell_task, k=k), CELL_SCHEMA), "word-cells")
    sizes = (cells.where("leaf").groupBy("cell")
             .agg(F.ceil(F.count("*") / BLOCK_WORDS).cast("int").alias("blocks")))
    # A leaf lies in one block of its cell; a query meets all of them.
    block: Column = F.when(F.col("leaf"), F.array(F.pmod(F.xxhash64("word"), F.col("blocks"))
                                                  .cast("int"))
                           ).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (cells.join(sizes, "cell").withColumn("block", F.explode(block))
             .select("cell", "block", "leaf", "word", "n", "surplus", "deficit"))
    found = (dealt.repartition("cell", "block")
             .sortWithinPartitions("cell", "block", F.desc("leaf"))
             .mapInArrow(partial(_near_task, k=k), NEAR_SCHEMA))
    top = F.min(F.struct((-F.col("near_n")).alias("k"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top")).select(
        "word", "n_near", (-F.col("top.k")).alias("near_n"), F.col("top.near").alias("near"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last word that ``forms(word, form)`` leads to, by pointer jumping."""
    steps = stored(forms.select("word", F.col("form").alias("root")), "word-roots")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = stored(steps.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"),
            F.col("next").isNotNull().alias("moved")), "word-roots")
        steps = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return steps


def spelling_variants(docs: DataFrame, least_chars: int = 7, least_n: int = 2, ratio: int = 10,
                      slip_every: int = 0, doc_id: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """Words of all texts, each with the more frequent word it is likely a variant of.

    Words are maximal runs of ``A-Za-z`` and U+00C0 to U+00FF, only A-Z lower-cased, of at least
    ``least_chars`` code points and ``least_n`` occurrences. ``slip_every`` deletes one code point
    of every so manieth run, chosen by the CRC-32 of ``<doc_id>:<run>`` (null doc_id: empty).

    Returns ``word, n, form, form_n, root, n_near``. Two words are near if they differ by exactly
    one inserted, deleted or replaced code point; ``n_near`` counts near words. ``form`` is the
    near word of largest ``n`` (ties: smallest in code-point order) if that is ``ratio`` times the
    word's own at least, else null; ``root`` follows forms to the last, and is the word itself
    without one. ``least_chars`` must be 7 at least. Null and empty texts have no words; repeated rows count each. Words of any length
    are compared whole. Other columns are not read. No words, no rows. ``ratio`` must be over 1.
    """
    words = stored(count_words(docs, least_chars, least_n, slip_every, doc_id, text), "words")
    near = near_words(words)
    fits = F.col("near_n") >= ratio * F.col("n")
    judged = stored(words.join(near, "word", "left").select(
        "word", "n", F.when(fits, F.col("near")).alias("form"),
        F.when(fits, F.col("near_n")).alias("form_n"),
        F.coalesce("n_near", F.lit(0)).alias("n_near")), "words-judged")
    roots = _roots(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of all documents; every 31st run, by its CRC, loses a code point."""
    return spelling_variants(documents(spark, sf_dir), slip_every=31)


#: The CRC is folded byte by byte. Near words are equal when one of them, or both at one place, lose
#: a code point.
SQL = """
WITH RECURSIVE bits AS (
  SELECT i, list_reduce([i::BIGINT] || [0::BIGINT FOR k IN range(8)],
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) t(i)
), crc AS (SELECT list(v ORDER BY i) AS t FROM bits),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n,
         hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx
  FROM runs WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce([4294967295::BIGINT] || [
      (16 * (strpos('0123456789ABCDEF', hx[2 * p + 1]) - 1)
       + strpos('0123456789ABCDEF', hx[2 * p + 2]) - 1)::BIGINT
      FOR p IN range(length(hx) // 2)],
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h
  FROM counted, crc
), slipped AS (
  SELECT CASE WHEN h % 31 = 0
      THEN run[1:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word, n
  FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 7
  GROUP BY word HAVING sum(n) >= 2
), parts AS (
  SELECT word, -1 AS p, word AS part FROM words
  UNION ALL SELECT word, p, word[1:p] || word[p + 2:]
  FROM words, unnest(range(length(word))) t(p)
), near AS (
  SELECT DISTINCT a.word, b.word AS other FROM parts a JOIN parts b USING (part)
  WHERE a.word <> b.word AND (a.p = -1 OR b.p = -1 OR a.p = b.p)
), best AS (
  SELECT near.word, count(*) AS n_near, max(w.n) AS top,
         arg_min(other, (-w.n, other)) AS other
  FROM near JOIN words w ON w.word = near.other GROUP BY near.word
), judged AS (
  SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN top >= 10 * n THEN other END AS form, CASE WHEN top >= 10 * n THEN top END AS form_n
  FROM words LEFT JOIN best USING (word)
), follow(word, here, form) AS (
  SELECT word, word, form FROM judged
  UNION ALL SELECT f.word, j.word, j.form FROM follow f JOIN judged j ON j.word = f.form
)
SELECT j.word, j.form, f.here AS root, j.n, j.n_near, j.form_n
FROM judged j JOIN follow f ON f.word = j.word AND f.form IS NULL
"""
