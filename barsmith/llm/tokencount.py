"""Token counts by dynamic programming shared in a trie.

The distinct pre-tokens of a stretch of text (the units of the encoder) are sorted and inserted in
a trie, level by level. The forward score of a node is the best unigram score of the prefix it
stands for: it depends on the prefix alone, so it is computed once however many pre-tokens share
it. From every node that ends a character the piece trie is walked down in step with the
pre-token trie. The score of a terminal node holds the token count of its pre-token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm import pieces as P
from barsmith.llm import textscan as ts
from barsmith.llm.encode import REMEMBERED, UNITS_AT_ONCE, vocabulary
from barsmith.llm.store import documents


def forward_counts(p: P.Pieces, words: list[bytes]) -> np.ndarray:
    """Tokens of each of ``words``, which must be sorted, distinct and not empty."""
    n = len(words)
    data = np.frombuffer(b"".join(words) + b"\0", dtype=np.uint8)
    size = np.fromiter(map(len, words), dtype=np.int64, count=n)
    first = np.cumsum(size) - size
    counts = np.zeros(n, dtype=np.int64)
    alive = np.arange(n)
    node = np.zeros(n, dtype=np.int64)
    best = np.zeros(1, dtype=np.int64)
    # Walks down the piece trie: where they are, the score they began with, the piece state, and
    # for a character taken byte by byte how many of its bytes are still to come.
    at = np.zeros(1, dtype=np.int64)
    base = np.zeros(1, dtype=np.int64)
    state = np.zeros(1, dtype=np.int64)
    depth = 0
    raw_at = raw_left = raw_value = np.zeros(0, dtype=np.int64)
    fresh = np.ones(1, dtype=bool)
    while len(alive):
        byte = data[first[alive] + depth].astype(np.int64)
        new = np.ones(len(alive), dtype=bool)
        new[1:] = (node[1:] != node[:-1]) | (byte[1:] != byte[:-1])
        child = np.cumsum(new) - 1
        parent, letter = node[new], byte[new]
        # Children of a node stand together, as the words are sorted.
        child_first = np.searchsorted(parent, np.arange(len(best)))
        child_count = np.searchsorted(parent, np.arange(len(best)), "right") - child_first
        begin = np.flatnonzero(fresh[parent] & (best[parent] > P.NONE))
        lead = letter[begin]
        width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
        value = best[parent[begin]] + p.unknown - width

        def down(where):
            k = child_count[where]
            row = np.repeat(np.arange(len(where)), k)
            within = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            return row, child_first[where][row] + within

        row, to = down(at)
        state = p.step(state[row], letter[to])
        live = state >= 0
        at, state, base = to[live], state[live], base[row[live]]
        row, to = down(raw_at)
        raw_at = np.concatenate([to, begin])
        raw_left = np.concatenate([raw_left[row] - 1, width - 1])
        raw_value = np.concatenate([raw_value[row], value])
        best = np.full(len(parent), P.NONE, dtype=np.int64)
        score = p.score[state]
        ends = score != P.NONE
        np.maximum.at(best, at[ends], base[ends] + score[ends])
        done = raw_left == 0
        np.maximum.at(best, raw_at[done], raw_value[done])
        raw_at, raw_left, raw_value = raw_at[~done], raw_left[~done], raw_value[~done]
        fresh = best > P.NONE
        start = np.flatnonzero(fresh)
        at = np.concatenate([at, start])
        base = np.concatenate([base, best[start]])
        state = np.concatenate([state, np.zeros(len(start), dtype=np.int64)])
        depth += 1
        over = size[alive] == depth
        counts[alive[over]] = (-best[child[over]]) & ((1 << P.COUNT_BITS) - 1)
        alive, node = alive[~over], child[~over]
    return counts


class Counter:
    """Counts tokens of texts and remembers terminal counts of pre-tokens met before."""

    def __init__(self, p: P.Pieces):
        self.p = p
        self.known: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = sorted(w.encode() for w in words if w not in self.known)
        for a in range(0, len(new), UNITS_AT_ONCE):
            part = new[a:a + UNITS_AT_ONCE]
            counts = forward_counts(self.p, part)
            self.known.update(zip((w.decode() for w in part), counts.tolist(), strict=True))

    def rows(self, texts: list[str]) -> list[tuple[int, int]]:
        cuts = [P.units(t) if t else [] for t in texts]
        self.learn(set().union(*cuts))
        known = self.known
        return [(sum([known[u] for u in cut]), len(cut)) for cut in cuts]


_counters: dict[int, Counter] = {}


def count_batch(p: P.Pieces, column: pa.Array) -> pa.StructArray:
    if id(p) not in _counters:
        _counters.clear()
        _counters[id(p)] = Counter(p)
    data, offsets, nulls = ts.buffers(column)
    rows: list[tuple[int, int]] = []
    for a, b in ts.groups(offsets):
        rows += _counters[id(p)].rows([
            data[offsets[r]:offsets[r + 1]].tobytes().decode("utf-8", "replace")
            for r in range(a, b)])
    counts = np.array(rows, dtype=np.int64).reshape(-1, 2)
    return pa.StructArray.from_arrays(
        [pa.array(counts[:, 0].copy(), mask=nulls), pa.array(counts[:, 1].copy(), mask=nulls)],
        names=["n_tokens", "n_pretokens"])


def token_counts(docs: DataFrame, model: str = P.MODEL) -> DataFrame:
    """All columns of ``docs`` with ``n_tokens`` and ``n_pretokens`` of its whole text.

    The counts equal the number of pieces the encoder gives. A null text has null, an empty one
    zero. Columns of these names are replaced.
    """
    pieces = vocabulary(docs.sparkSession, model)
    count = F.arrow_udf(lambda column: count_batch(pieces.value, column),
                        returnType="struct<n_tokens long, n_pretokens long>")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_tokens", "n_pretokens")]
    return (docs.select(*kept, count(F.col("text")).alias("_counts"))
            .select(*kept, "_counts.n_tokens", "_counts.n_pretokens"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
