"""N-gram Jaccard join by grouped prefixes.

Documents become sets of word shingles. Sets in a fixed global order (common shingles last, then
by hash) that reach the threshold share a shingle in their prefixes, the first
``n - ceil(t n) + 1`` of each. Documents with the same set have the same prefix and size and form
one group; only groups are joined, and members are expanded from the verified groups.

1. *Common shingles.* Tasks count shingles and report those met repeatedly; those with at least
   a 2^-22th of all shingles are common. At most 2^22 can be, so the list may be broadcast. It
   only steers the order: any list gives the same links.
2. *Groups.* A row per document: size, set hash and, for those with an id, a parity sketch of two
   to four bits a shingle, and its prefix unless the task has sent the same set before.
3. *Star.* Prefix shingles are dealt out by hash and sorted; a run holds the groups that send one
   shingle. Each is paired with the first group of its run only, that with the fewest rarer
   shingles, which most near copies are close to; so a run of k groups gives k - 1 pairs. Sizes,
   places and sketches rule pairs out. Each set difference flips one sketch bit, so
   more differing bits than the threshold allows rules a pair out, and never a true link.
4. *Verification* reads the documents of the remaining pairs again, sends each set to its pairs and
   intersects the two whole sets, as 48-bit hashes. The links give first components.
5. *Crossing pairs.* Of a run of more than two groups the pairs across components are compared by
   size and place inside a task (long runs in pairs of blocks), and where they are many by sketch
   too; only survivors become rows and are verified like those of the stars. So no link that could join two components stays
   untried, and near copies in one component are not paired one by one.
6. *Expansion*: components over groups, joined back to the members. The links of a group lie inside
   its component; there they are counted in pairs of blocks of sets, a row per group and block.
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
from barsmith.llm.store import documents, stored

#: Shingles with a share of at least one in so many are common; hence also the bound of their list.
COMMON_SHARE = 1 << 22
#: Counters a task holds before it reports and starts again.
COUNTED_AT_ONCE = 1 << 22
#: Set hashes a task remembers in order not to send a copy's prefix again.
REMEMBERED = 1 << 16
#: Bits of the filter that picks which documents are scanned again for verification.
PICK_BITS = 20
#: Bits of the filter that picks which groups are sent with their sketches.
MARK_BITS = 24
#: A narrow side of a join is broadcast up to so many rows, counted first; beyond it is shuffled.
BROADCAST_ROWS = 200_000
#: Least bits of a parity sketch; a larger set has two to four bits a shingle.
SKETCH_BITS = 256
PAIRS_AT_ONCE = 1 << 18
#: Groups of one run that a task pairs with each other; longer runs are cut into blocks.
BLOCK = 2048
#: Pairs a row that runs may give before their sketches are compared; those of fuller ones after.
PAIRS_PER_ROW = 4
#: Sets, and shingles of them, in a block of a component whose links are counted.
BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 21
#: Shingles by which a task multiplies two blocks at once.
COLUMNS = 4096


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of each text; no words give an empty set."""
    data, offsets, _ = ts.buffers(column)
    alphabet = ts.spaced(lower=True)
    for lo, hi in ts.groups(offsets):
        words = ts.scan(alphabet, data, offsets[lo:hi + 1])
        h, at = ts.windows(words, size)
        text = words.text_of_word()[at]
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        h, text = h[new], text[new]
        ends = np.searchsorted(text, np.arange(hi - lo + 1))
        n_words = np.diff(words.first)
        for r in range(hi - lo):
            if 0 < n_words[r] < size:
                whole = np.full(1, n_words[r], dtype=np.uint64)
                for k in range(words.first[r], words.first[r + 1]):
                    whole = ts.mix(whole + words.hashes[k:k + 1])
                yield lo + r, whole
            else:
                yield lo + r, h[ends[r]:ends[r + 1]]


def _count_task(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    n = total = 0

    def report() -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts > 1
        return pa.RecordBatch.from_arrays(
            [pa.array(keys[often].view(np.int64)), pa.array(counts[often].astype(np.int64)),
             pa.nulls(int(often.sum()), pa.int64())], names=["shingle", "n", "total"])

    for batch in batches:
        for _, s in shingle_sets(batch.column(0), size):
            held.append(s.copy())
            n += len(s)
            if n >= COUNTED_AT_ONCE:
                yield report()
                held, n, total = [], 0, total + n
    if held:
        yield report()
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                                      pa.array([total + n])], names=["shingle", "n", "total"])


def common_shingles(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """Sorted hashes of common shingles, rarest order first kept beside as ranks; at most 2^22."""
    counts = stored(docs.select(text).mapInArrow(
        partial(_count_task, size=size), "shingle long, n long, total long"), "shingle-counts")
    total = counts.agg(F.sum("total")).first()[0] or 0
    often = (counts.where("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n"))
             .where(F.col("n") * COMMON_SHARE >= total).where("n >= 8").toPandas())
    keys = often["shingle"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    return np.stack([keys[order], often["n"].to_numpy(dtype=np.int64).view(np.uint64)[order]])


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def _ordered(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    if not len(common[0]):
        return s
    at = np.minimum(np.searchsorted(common[0], s), len(common[0]) - 1)
    weight = np.where(common[0][at] == s, common[1][at], 0)
    return s[np.lexsort((s, weight))]


def _set_hash(s: np.ndarray) -> int:
    h = np.add.reduce(ts.mix(s + np.uint64(0xA5))) if len(s) else np.uint64(0)
    return int(ts.mix(np.array([h], dtype=np.uint64)).view(np.int64)[0])


def _sketch(s: np.ndarray) -> bytes:
    bits = max(SKETCH_BITS, 1 << (2 * len(s) - 1).bit_length())
    ones = np.bincount(((s >> np.uint64(23)) & np.uint64(bits - 1)).astype(np.int64),
                       minlength=bits) & 1
    return np.packbits(ones.astype(np.uint8)).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Differing bits of two sketches, the longer folded to the length of the shorter: no more
    than the elements that are in one set only."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


GROUP_SCHEMA = "doc_id long, n int, hash long, prefix array<long>, sketch binary"


def _group_task(batches: Iterator[pa.RecordBatch], size: int, percent: int,
                common) -> Iterator[pa.RecordBatch]:
    ranks = common.value
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        n_rows = batch.num_rows
        n = np.zeros(n_rows, dtype=np.int32)
        hashes = np.zeros(n_rows, dtype=np.int64)
        sketches: list[bytes | None] = [None] * n_rows
        parts: list[np.ndarray] = []
        lengths = np.zeros(n_rows, dtype=np.int64)
        named = np.asarray(batch.column(0).is_valid())
        for r, s in shingle_sets(batch.column(1), size):
            n[r] = len(s)
            if not len(s):
                continue
            hashes[r] = _set_hash(s)
            if not named[r]:  # joins nothing, so it must not stand for copies with an id
                continue
            sketches[r] = _sketch(s)
            key = (int(hashes[r]), len(s))
            if key not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(key)
                p = _ordered(s, ranks)[:prefix_length(len(s), percent)]
                parts.append(p)
                lengths[r] = len(p)
        ends = np.zeros(n_rows + 1, dtype=np.int32)
        np.cumsum(lengths, out=ends[1:])
        flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n), pa.array(hashes),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
             pa.array(sketches, pa.binary())], names=["doc_id", "n", "hash", "prefix", "sketch"])


PAIR_SCHEMA = "hash_a long, n_a int, hash_b long, n_b int"


def _possible(n_a, pos_a, n_b, pos_b, percent: int) -> np.ndarray:
    """Which pairs of rows of one shingle can reach the threshold by size and position.

    At the first shingle two sets share, what follows in each must hold the whole overlap.
    """
    least = -(-percent * (n_a.astype(np.int64) + n_b) // (100 + percent))
    return ((100 * np.minimum(n_a, n_b).astype(np.int64) >= percent * np.maximum(n_a, n_b).astype(
        np.int64)) & (np.minimum(n_a - pos_a, n_b - pos_b) >= least))


class _Pairs:
    """Pairs of groups, each once in about :data:`PAIRS_AT_ONCE`."""

    def __init__(self):
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, h_a, n_a, h_b, n_b) -> None:
        swap = (h_a > h_b) | ((h_a == h_b) & (n_a > n_b))
        a, b = np.stack([h_a, n_a.astype(np.int64)]), np.stack([h_b, n_b.astype(np.int64)])
        self.held.append(np.concatenate([np.where(swap, b, a), np.where(swap, a, b)]).T)
        self.n += len(h_a)

    def taken(self, least: int = 0) -> np.ndarray | None:
        """The pairs, if there are more than ``least``."""
        if self.n <= least:
            return None
        rows = np.unique(np.concatenate(self.held), axis=0)
        self.held, self.n = [], 0
        return rows


RUN_SCHEMA = "token long, hash long, n int, pos int, at int, hash_b long, n_b int"


def _run_rows(token, h, n, pos, at) -> pa.RecordBatch:
    none = pa.nulls(len(token), pa.int64()), pa.nulls(len(token), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(token), pa.array(h), pa.array(n), pa.array(pos), pa.array(at.astype(np.int32)), *none],
        names=[c.split()[0] for c in RUN_SCHEMA.split(", ")])


def _star_rows(rows: np.ndarray) -> pa.RecordBatch:
    k = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.nulls(k, pa.int64()), pa.array(rows[:, 0]), pa.array(rows[:, 1].astype(np.int32)),
         pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.array(rows[:, 2]),
         pa.array(rows[:, 3].astype(np.int32))], names=[c.split()[0] for c in RUN_SCHEMA.split(", ")])


def _star_task(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by ``token, pos, hash, n``: pairs of a run's groups with its first, without
    ``token``; and the groups of runs of three or more, ``at`` their place in it.

    Runs pass through: held are two groups at most, and the first and last of an unfinished run.
    """
    rest = [np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int32, np.int32)]
    begun: tuple | None = None  # first group, number of groups and last group of such a run
    pairs = _Pairs()

    def work(cols: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal rest, begun
        token, h, n, pos = cols
        new = np.ones(len(token), dtype=bool)  # a set may have been sent by several tasks
        new[1:] = (token[1:] != token[:-1]) | (h[1:] != h[:-1]) | (n[1:] != n[:-1])
        if begun and len(token):
            new[0] = (token[0], h[0], n[0]) != begun[5:]
        token, h, n, pos = (c[new] for c in cols)
        if not len(token):
            rest = [token, h, n, pos]
            return
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(token))))
        h_1, n_1, pos_1, before = h[starts], n[starts], pos[starts], np.zeros(len(starts), dtype=int)
        if begun and begun[0] == token[0]:
            h_1[0], n_1[0], pos_1[0], before[0] = begun[1:5]
        size = np.diff(np.append(starts, len(token))) + before
        at = np.arange(len(token)) - starts[run] + before[run]
        stop = len(token)
        if last or size[-1] > 2:
            begun = (token[-1], h_1[-1], n_1[-1], pos_1[-1], size[-1], token[-1], h[-1], n[-1])
        else:
            stop, begun = starts[-1], None
        rest = [c[stop:] for c in (token, h, n, pos)]
        many = size[run[:stop]] > 2
        yield _run_rows(*(c[:stop][many] for c in (token, h, n, pos, at)))
        k = run[:stop]
        other = np.flatnonzero((at[:stop] > 0) & _possible(
            n_1[k], pos_1[k], n[:stop], pos[:stop], percent))
        if len(other):
            pairs.add(h_1[k[other]], n_1[k[other]], h[other], n[other])

    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        yield from work([np.concatenate([a, b]) for a, b in zip(rest, new, strict=True)], False)
        rows = pairs.taken(PAIRS_AT_ONCE)
        if rows is not None:
            yield _star_rows(rows)
    yield from work(rest, True)
    rows = pairs.taken()
    if rows is not None:
        yield _star_rows(rows)


def _asking(run, n, label, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows that ask those of their run, and where the ones of compatible size begin and end;
    rows of a run's most frequent label wait for the others to ask."""
    order = np.lexsort((label, run))
    new = np.flatnonzero(np.concatenate([[True], (run[order][1:] != run[order][:-1]) | (
        label[order][1:] != label[order][:-1])]))
    count = np.diff(np.append(new, len(run)))
    by = np.lexsort((-count, run[order][new]))
    firsts = by[np.concatenate([[True], np.diff(run[order][new][by]) != 0])]
    most = np.empty(int(run[-1]) + 1, dtype=np.int64)
    most[run[order][new][firsts]] = label[order][new][firsts]
    asks = np.flatnonzero(label != most[run])
    place = (run << 32) + n
    own, sizes = run[asks] << 32, n[asks].astype(np.int64)
    low = np.searchsorted(place, own + -(-percent * sizes // 100))
    return asks, low, np.searchsorted(place, own + 100 * sizes // percent, "right")


def _crossing(run, n, pos, label, part, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of one run, sorted by run and size, with different labels and, in a pair
    of blocks, from both."""
    asks, low, top = _asking(run, n, label, percent)
    asked = np.zeros(len(run), dtype=bool)
    asked[asks] = True
    done = np.concatenate([[0], np.cumsum(top - low)])
    lo = 0
    while lo < len(asks):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + PAIRS_AT_ONCE, "right")) - 1)
        c = (top - low)[lo:hi]
        i = np.repeat(asks[lo:hi], c)
        j = np.arange(int(c.sum())) - np.repeat(done[lo:hi] - done[lo], c) + np.repeat(low[lo:hi], c)
        keep = (label[i] != label[j]) & (~asked[j] | (i < j)) & ((part[i] != part[j]) | (part[i] < 0))
        i, j = i[keep], j[keep]
        keep = _possible(n[i], pos[i], n[j], pos[j], percent)
        yield i[keep], j[keep]
        lo = hi


class _Sketches:
    """Sketches of several widths, compared pair by pair as a whole."""

    def __init__(self, sketches):
        self.sketches = [np.frombuffer(x, dtype=np.uint8) for x in sketches]
        self.width = np.array([len(x) for x in sketches], dtype=np.int64)
        self.tables: dict[int, np.ndarray] = {}

    def folded(self, width: int) -> np.ndarray:
        """All sketches of at least this width, folded to it; zeros for the others."""
        if width not in self.tables:
            table = np.zeros((len(self.sketches), width), dtype=np.uint8)
            for k, x in enumerate(self.sketches):
                while len(x) > width:
                    x = x[:len(x) // 2] ^ x[len(x) // 2:]
                if len(x) == width:
                    table[k] = x
            self.tables[width] = table
        return self.tables[width]

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Differing bits of each pair, the longer sketch folded to the length of the shorter."""
        out = np.zeros(len(i), dtype=np.int64)
        width = np.minimum(self.width[i], self.width[j])
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            table = self.folded(int(w))
            step = max(1, (1 << 24) // int(w))
            for lo in range(0, len(at), step):
                k = at[lo:lo + step]
                out[k] = np.bitwise_count(table[i[k]] ^ table[j[k]]).sum(axis=1, dtype=np.int64)
        return out


CROSS_SCHEMA = ("token long, first int, second int, n int, hash long, pos int, label long, part int, "
                "hash_b long, n_b int")


def _cross_task(batches: Iterator[pa.RecordBatch], percent: int,
                sketched: bool) -> Iterator[pa.RecordBatch]:
    """Pairs across components, without ``token``, from rows sorted by ``token, first, second, n``:
    runs and pairs of their blocks. Without sketches runs of many pairs come out as they are.
    Held are a batch and an unfinished run, at most two blocks."""
    pairs = _Pairs()
    rest: list[np.ndarray] | None = None
    names = [c.split()[0] for c in CROSS_SCHEMA.split(", ")]

    def report(rows: np.ndarray) -> pa.RecordBatch:
        none = {k: pa.nulls(len(rows), pa.int64() if k in (0, 6) else pa.int32())
                for k in (0, 1, 2, 5, 6, 7)}
        told = {3: pa.array(rows[:, 1].astype(np.int32)), 4: pa.array(rows[:, 0]),
                8: pa.array(rows[:, 2]), 9: pa.array(rows[:, 3].astype(np.int32))}
        return pa.RecordBatch.from_arrays([(none | told)[k] for k in range(10)], names=names)

    def work(cols: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal rest
        new = np.ones(len(cols[0]), dtype=bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:3]])
        starts = np.flatnonzero(new)
        stop = len(new) if last or not len(starts) else int(starts[-1])
        rest = [c[stop:] for c in cols]
        if not stop:
            return
        cols = [c[:stop] for c in cols]
        run = np.cumsum(new[:stop]) - 1
        if not sketched:
            asks, low, top = _asking(run, cols[3], cols[6], percent)
            length = np.bincount(run)
            most = np.bincount(run[asks], top - low, minlength=len(length))
            full = (most > PAIRS_PER_ROW * length)[run]
            if full.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[full]) for c in cols]
                    + [pa.nulls(int(full.sum()), pa.int64()), pa.nulls(int(full.sum()), pa.int32())],
                    names=names)
            some = ~full & (most > 0)[run]
            if not some.any():
                return
            cols = [c[some] for c in cols]
            run = np.unique(run[some], return_inverse=True)[1].astype(np.int64)
        _, first, second, n, h, pos, label, part = cols[:8]
        part = np.where(first == second, -1, part)
        if sketched:
            sketches = _Sketches(cols[8])
        for i, j in _crossing(run, n, pos, label, part, percent):
            if sketched:
                both = n[i].astype(np.int64) + n[j]
                keep = sketches.apart(i, j) * (100 + percent) <= (100 - percent) * both
                i, j = i[keep], j[keep]
            if len(i):
                pairs.add(h[i], n[i], h[j], n[j])
            rows = pairs.taken(PAIRS_AT_ONCE)
            if rows is not None:
                yield report(rows)

    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        yield from work(new if rest is None else [
            np.concatenate([a, b]) for a, b in zip(rest, new, strict=True)], False)
    if rest is not None:
        yield from work(rest, True)
    rows = pairs.taken()
    if rows is not None:
        yield report(rows)


NEAR_SCHEMA = "hash_a long, n_a int, doc_a long, hash_b long, n_b int, doc_b long"


def _near_task(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches allow |A xor B| <= (1 - t) / (1 + t) (|A| + |B|)."""
    for batch in batches:
        both = batch.column(1).to_numpy().astype(np.int64) + batch.column(4).to_numpy()
        bits = np.fromiter((apart(a, b) for a, b in zip(
            batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True)),
            dtype=np.int64, count=batch.num_rows)
        keep = pa.array(bits * (100 + percent) <= (100 - percent) * both)
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in range(6)],
                                         names=[c.split()[0] for c in NEAR_SCHEMA.split(", ")])


def _bucket(ids: np.ndarray) -> np.ndarray:
    return (ts.mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - PICK_BITS)).astype(
        np.int64)


def _set_task(batches: Iterator[pa.RecordBatch], size: int, picked) -> Iterator[pa.RecordBatch]:
    wanted = picked.value
    for batch in batches:
        ids = batch.column(0)
        known = ~np.asarray(ids.is_null())
        take = known & wanted[_bucket(ids.fill_null(0).to_numpy(zero_copy_only=False))]
        texts = batch.column(1).filter(pa.array(take))
        keys, ns, sets, held = [], [], [], 0
        for _, s in shingle_sets(texts, size):
            keys.append(_set_hash(s))
            ns.append(len(s))
            sets.append(_packed(s))
            held += len(s)
            if held > 1 << 18:
                yield _set_rows(keys, ns, sets)
                keys, ns, sets, held = [], [], [], 0
        yield _set_rows(keys, ns, sets)


def _packed(s: np.ndarray) -> bytes:
    """The upper 48 bits of sorted hashes, six bytes each."""
    return np.ascontiguousarray(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(buffer) -> np.ndarray:
    out = np.zeros((buffer.size // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(buffer, dtype=np.uint8).reshape(-1, 6)
    return out.view(">u8").ravel().astype(np.uint64)


def _set_rows(keys, ns, sets) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(ns, pa.int32()), pa.array(sets, pa.binary())],
        names=["hash", "n", "members"])


def _verify_task(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows ``u, v, second, members`` with the two sides of a pair next to each other."""
    held = None
    for batch in batches:
        us, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        side, members = batch.column(2).to_pylist(), batch.column(3)
        keep_u, keep_v = [], []
        for r in range(batch.num_rows):
            pair = (us[r], vs[r])
            if not side[r]:
                held = (pair, _unpacked(members[r].as_buffer()))
            elif held and held[0] == pair:
                x, y = held[1], _unpacked(members[r].as_buffer())
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep_u.append(pair[0])
                    keep_v.append(pair[1])
                held = None
        yield pa.RecordBatch.from_arrays(
            [pa.array(keep_u, pa.int64()), pa.array(keep_v, pa.int64())], names=["u", "v"])


def _shared_sizes(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections of the first ``split`` sets with the others (or themselves)."""
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    ids, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # A shingle of one set only is in no intersection.
    number = np.cumsum(often > 1) - 1
    kept = often[column] > 1
    of, column = of[kept], number[column[kept]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    rest = len(sets) - split
    out = np.zeros((split, rest or split), dtype=np.int64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        table = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        table[of[a:b], column[a:b] - lo] = 1
        out += (table[:split] @ (table[split:] if rest else table).T).astype(np.int64)
    return out


def _degree_task(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows ``root, first, second, part, hash, n, members`` sorted by the first four: links of each
    set with those of the other block, or of its own in the pair of a block with itself."""
    held: list[tuple] = []

    def report() -> pa.RecordBatch:
        sets = [_unpacked(x) for *_, x in held]
        sizes = np.array([len(x) for x in sets], dtype=np.int64)
        split = sum(row[3] == row[1] for row in held)
        links = np.zeros(len(held), dtype=np.int64)
        if 0 < split and (split < len(held) or held[0][1] == held[0][2]):
            own = split == len(held)
            both = _shared_sizes(sets, split)
            other = sizes if own else sizes[split:]
            near = 100 * both >= percent * (sizes[:split, None] + other - both)
            if own:
                np.fill_diagonal(near, False)
            links[:split] = near.sum(axis=1)
            if not own:
                links[split:] = near.sum(axis=0)
        return pa.RecordBatch.from_arrays(
            [pa.array([row[4] for row in held], pa.int64()),
             pa.array([row[5] for row in held], pa.int32()), pa.array(links)],
            names=["hash", "n", "links"])

    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in range(6)]
        members = batch.column(6)
        for r, row in enumerate(zip(*cols, strict=True)):
            if held and held[0][:3] != row[:3]:
                yield report()
                held = []
            held.append((*row, members[r].as_buffer()))
    if held:
        yield report()


def _degrees(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``hash, n, links`` of the groups of ``hash, n, group_id, root``: how many others each links
    to."""
    many = groups.groupBy("root").agg(
        F.count("*").alias("k"), (F.min("group_id") < F.max("group_id")).alias("ids"), F.greatest(
            F.ceil(F.count("*") / BLOCK_SETS),
            F.ceil(F.sum(F.col("n").cast("long")) / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    inside = groups.join(many.where("k > 1"), "root")
    # Two with different ids are in one component by their link alone.
    two = inside.where("k = 2 and ids").select("hash", "n", F.lit(1).cast("long").alias("links"))
    own = F.pmod(F.xxhash64("hash", "n"), F.col("blocks")).cast("int")
    dealt = (inside.where("k > 2 or not ids").withColumn("part", own)
             .join(sets, ["hash", "n"])
             .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
             .select("root", F.least("part", "other").alias("first"),
                     F.greatest("part", "other").alias("second"), "part", "hash", "n", "members"))
    counted = (dealt.repartition("root", "first", "second")
               .sortWithinPartitions("root", "first", "second", "part")
               .mapInArrow(partial(_degree_task, percent=percent), "hash long, n int, links long")
               .groupBy("hash", "n").agg(F.sum("links").alias("links")))
    return two.union(counted)


def _picked(ends: DataFrame) -> np.ndarray:
    """Marks of the documents to scan again: a fixed 2^20 flags however many documents there are."""
    def marks(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.unique(_bucket(batch.column(0).to_numpy())))], names=["bucket"])
    rows = ends.select("doc_id").mapInArrow(marks, "bucket long").distinct().toPandas()
    wanted = np.zeros(1 << PICK_BITS, dtype=bool)
    wanted[rows["bucket"].to_numpy(dtype=np.int64)] = True
    return wanted


def _small_side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _mark_task(batches: Iterator[pa.RecordBatch], marks, halve: bool) -> Iterator[pa.RecordBatch]:
    """The rows ``doc_id, hash, n, sketch`` with a marked hash, their sketches folded once."""
    bits = marks.value
    for batch in batches:
        at = batch.column(1).to_numpy().view(np.uint64) >> np.uint64(64 - MARK_BITS)
        shift = (7 - (at & np.uint64(7))).astype(np.uint8)
        batch = batch.filter(pa.array((bits[at >> np.uint64(3)] >> shift & 1).astype(bool)))
        if halve:
            short = pa.array([_halved(x) for x in batch.column(3).to_pylist()], pa.binary())
            batch = batch.set_column(3, "sketch", short)
        yield batch


def _halved(sketch: bytes) -> bytes:
    if 8 * len(sketch) <= SKETCH_BITS:
        return sketch
    x = np.frombuffer(sketch, dtype=np.uint8)
    return (x[:len(x) // 2] ^ x[len(x) // 2:]).tobytes()


def _wanted(groups: DataFrame, hashes: DataFrame, halve: bool = False) -> DataFrame:
    """``doc_id, hash, n, sketch`` of all groups whose hash is one of ``hashes``, and some others:
    fixed marks pick them where they lie, so the sketches of most groups are not shuffled."""
    rows = hashes.toDF("hash").select(
        F.shiftrightunsigned("hash", 64 - MARK_BITS).alias("mark")).distinct().toPandas()
    flags = np.zeros(1 << MARK_BITS, dtype=bool)
    flags[rows["mark"].to_numpy(dtype=np.int64)] = True
    marks = groups.sparkSession.sparkContext.broadcast(np.packbits(flags))
    return groups.select("doc_id", "hash", "n", "sketch").mapInArrow(
        partial(_mark_task, marks=marks, halve=halve), "doc_id long, hash long, n int, sketch binary")


def _near_pairs(pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches do not rule out a link, with the ids of both groups."""
    groups = _wanted(groups, pairs.select("hash_a").union(pairs.select("hash_b")))
    side = {x: groups.select(F.col("hash").alias(f"hash_{x}"), F.col("n").alias(f"n_{x}"),
                             F.col("doc_id").alias(f"doc_{x}"),
                             F.col("sketch").alias(f"sketch_{x}")) for x in "ab"}
    return (pairs.join(side["a"], ["hash_a", "n_a"]).join(side["b"], ["hash_b", "n_b"])
            .select("hash_a", "n_a", "doc_a", "hash_b", "n_b", "doc_b", "sketch_a", "sketch_b")
            .mapInArrow(partial(_near_task, percent=percent), NEAR_SCHEMA))


def _near_sets(frame: DataFrame, near: DataFrame, size: int) -> DataFrame:
    """``hash, n, members`` of the groups of ``near``, read again from their first documents."""
    ends = near.select(F.col("doc_a").alias("doc_id")).union(near.select("doc_b"))
    picked = frame.sparkSession.sparkContext.broadcast(_picked(ends))
    wanted = near.select(F.col("hash_a").alias("hash"), F.col("n_a").alias("n")).union(
        near.select("hash_b", "n_b")).distinct()
    return stored(frame.mapInArrow(partial(_set_task, size=size, picked=picked),
                                   "hash long, n int, members binary")
                  .join(wanted, ["hash", "n"], "left_semi").dropDuplicates(["hash", "n"]), "sets")


def _verified(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``u, v``: ids of the groups whose whole sets reach the threshold."""
    sides = [near.select(F.col(f"hash_{x}").alias("hash"), F.col(f"n_{x}").alias("n"),
                         F.xxhash64("hash_a", "n_a", "hash_b", "n_b").alias("pair"),
                         F.col("doc_a").alias("u"), F.col("doc_b").alias("v"),
                         F.lit(x == "b").alias("second")) for x in "ab"]
    return (sets.join(_small_side(sides[0].union(sides[1])), ["hash", "n"])
            .select("u", "v", "second", "members", "pair").repartition("u", "v")
            .sortWithinPartitions("u", "v", "pair", "second").drop("pair")
            .mapInArrow(partial(_verify_task, percent=percent), "u long, v long").distinct())


def _crossing_pairs(runs: DataFrame, groups: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups in one run, not in one component, that may be linked."""
    # A group without links has its hash for a label.
    linked = stored(groups.select("hash", "n", "doc_id").join(
        roots.withColumnRenamed("node", "doc_id"), "doc_id").select("hash", "n", "root"), "labels")
    # Blocks of the runs that are longer than one.
    long = stored(runs.where(F.col("at") >= BLOCK).groupBy("token")
                  .agg((F.floor(F.max("at") / BLOCK) + 1).cast("int").alias("blocks")), "long-runs")
    blocks = (runs.join(_small_side(linked), ["hash", "n"], "left")
              .withColumn("label", F.coalesce("root", "hash"))
              .join(_small_side(long), "token", "left")
              .withColumn("part", F.floor(F.col("at") / BLOCK).cast("int"))
              .withColumn("other", F.explode(F.expr("sequence(0, coalesce(blocks, 1) - 1)")))
              .select("token", F.least("part", "other").alias("first"),
                      F.greatest("part", "other").alias("second"), "n", "hash", "pos", "label",
                      "part"))

    def crossed(rows: DataFrame, sketched: bool) -> DataFrame:
        return (rows.repartition("token", "first", "second")
                .sortWithinPartitions("token", "first", "second", "n")
                .mapInArrow(partial(_cross_task, percent=percent, sketched=sketched), CROSS_SCHEMA))

    found = stored(crossed(blocks, False), "crossing-runs")
    full = found.where("token is not null").drop("hash_b", "n_b")
    full = full.join(_wanted(groups, full.select("hash"), halve=True).drop("doc_id"), ["hash", "n"])
    told = crossed(full.select(*blocks.columns, "sketch"), True)
    return found.where("token is null").union(told).select(
        F.col("hash").alias("hash_a"), F.col("n").alias("n_a"), "hash_b", "n_b").distinct()


def jaccard_join(docs: DataFrame, size: int = 5, percent: int = 75, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Link documents whose shingle sets have ``100 |A and B| >= percent |A or B|``.

    Returns ``doc_id, n_shingles, group_id, component_id, group_links``, a row per input row.
    ``group_id`` is the smallest doc_id with the same set; ``group_links`` counts the other sets
    it links to. A text with fewer words than ``size`` is one shingle; null, empty and blank
    texts have no shingle and link with nothing. Equal rows link with each other. A row without
    doc_id has no ids of group and component, nor links. ``doc_id`` must be an integer; other
    columns are not read. No rows give no rows.
    """
    spark = docs.sparkSession
    frame = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                        F.col(f"`{text}`").cast("string").alias("text"))
    common = spark.sparkContext.broadcast(common_shingles(frame, "text", size))
    rows = stored(frame.mapInArrow(
        partial(_group_task, size=size, percent=percent, common=common), GROUP_SCHEMA), "groups")
    groups = stored(rows.where("n > 0 and doc_id is not null").groupBy("hash", "n").agg(
        F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch")), "group-keys")
    postings = (rows.where("doc_id is not null and size(prefix) > 0")
                .select(F.posexplode("prefix").alias("pos", "token"), "hash", "n")
                .select("token", "hash", "n", "pos"))
    runs = stored(postings.repartition("token").sortWithinPartitions("token", "pos", "hash", "n")
                  .mapInArrow(partial(_star_task, percent=percent), RUN_SCHEMA), "runs")
    star = stored(runs.where("token is null").select(
        F.col("hash").alias("hash_a"), F.col("n").alias("n_a"), "hash_b", "n_b").distinct(), "stars")
    near = stored(_near_pairs(star, groups, percent), "near-pairs")
    sets = _near_sets(frame, near, size)
    links = stored(_verified(near, sets, percent), "links")

    crossing = stored(_crossing_pairs(runs.where("token is not null"), groups, components(links), percent)
                      .join(star, ["hash_a", "n_a", "hash_b", "n_b"], "left_anti"), "crossing")
    near = stored(_near_pairs(crossing, groups, percent), "near-pairs")  # adds the ids
    if not near.isEmpty():
        more = _near_sets(frame, near, size)
        links = stored(links.union(_verified(near, more, percent)).distinct(), "links")
        sets = sets.union(more.join(sets, ["hash", "n"], "left_anti"))
    roots = components(links).select(F.col("node").alias("group_id"), "root")
    linked = stored(groups.select("hash", "n", F.col("doc_id").alias("group_id"))
                    .join(roots, "group_id", "left"), "linked-groups")
    degree = _degrees(linked.withColumn("root", F.coalesce("root", "group_id")), sets, percent)
    found = linked.join(degree, ["hash", "n"], "left")
    out = rows.select("doc_id", "n", "hash").join(found, ["hash", "n"], "left")
    named = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(named, F.coalesce("group_id", "doc_id")).alias("group_id"),
        F.when(named, F.coalesce("root", "group_id", "doc_id")).alias("component_id"),
        F.when(named, F.coalesce("links", F.lit(0))).alias("group_links"))


def _with_key(docs: DataFrame, key: str) -> DataFrame:
    """Add a key: the doc_id, unless several texts share it.

    Then the text of the smallest hash keeps the id and each other one gets a number of 62 hash
    bits above 2^62, so m such texts meet by chance in about m^2 / 2^63 of all runs.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    shared = (docs.where("doc_id is not null").groupBy("doc_id")
              .agg(F.min(text).alias("_first"), F.max(text).alias("_last"))
              .where("_first <> _last").select(F.col("doc_id").alias("_shared"), "_first"))
    shared = stored(shared, "shared-ids")
    if shared.isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    own = F.lit(1 << 62) + F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))),
                                  F.lit(1 << 62))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                        F.col("doc_id").cast("long").alias("_id"), text.alias("_text"),
                        own.alias("_own"))
    joined = named.join(shared, F.col("_id") == F.col("_shared"), "left")
    same = F.col("_first").isNull() | (F.col("_text") == F.col("_first"))
    return joined.select("_row.*", F.when(same, F.col("_id")).otherwise(F.col("_own")).alias(key))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """Documents without near duplicates: one of each component stays, that with the smallest id.

    Repeated rows of that id: one row stays. Different texts under one doc_id are documents of
    their own, all but one ranked behind every plain id. Documents without words, and rows without
    doc_id, all stay.
    """
    key = "_key"
    while key in docs.columns:
        key += "_"
    keyed = _with_key(docs, key)
    joined = jaccard_join(keyed, size, percent, doc_id=key).withColumnRenamed("doc_id", key)
    gone = joined.where(f"n_shingles > 0 and {key} <> component_id").select(key).distinct()
    kept = keyed.join(gone, key, "left_anti")
    again = (joined.where(f"n_shingles > 0 and {key} is not null").groupBy(key)
             .agg(F.count("*").alias("n")).where("n > 1").select(key))
    if not again.isEmpty():
        repeated = kept.join(again, key, "left_semi").dropDuplicates([key])
        kept = kept.join(again, key, "left_anti").unionByName(repeated)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents: words of five, Jaccard similarity of at least 0.75."""
    return jaccard_join(documents(spark, sf_dir)).select(
        "doc_id", "n_shingles", "component_id", "group_id", "group_links")
