"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A space goes before a text, and the text falls into units that no piece can reach over (runs of
spaces with what follows), so the best segmentation of a text is that of its units. A task encodes
the distinct units of a stretch of text together: every position of every unit walks the
trie in step, and the best paths are relaxed by the position in the unit, all units at once.
A character without a piece becomes the pieces of its bytes.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm import pieces as P
from barsmith.llm import textscan as ts
from barsmith.llm.store import documents


def _matches(p: P.Pieces, data: np.ndarray, inside: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, length, score and id of every piece in ``data``; ``inside`` marks bytes of units."""
    leads = ((data & 0xC0) != 0x80) & inside
    at = np.flatnonzero(leads)
    state = np.zeros(len(at), dtype=np.int64)
    starts, lengths, scores, ids = [], [], [], []
    single = np.zeros(len(data), dtype=bool)
    for k in range(p.longest):
        state = p.step(state, data[at + k].astype(np.int64))
        live = state >= 0
        at, state = at[live], state[live]
        if not len(at):
            break
        score = p.score[state]
        ends = score != P.NONE
        starts.append(at[ends])
        lengths.append(np.full(int(ends.sum()), k + 1, dtype=np.int64))
        scores.append(score[ends])
        ids.append(p.id[state[ends]])
        whole = at[ends][(data[at[ends] + k + 1] & 0xC0) != 0x80]
        single[whole[_char_length(data[whole]) == k + 1]] = True
        go = inside[at + k + 1]
        at, state = at[go], state[go]
    alone = np.flatnonzero(leads & ~single)
    starts.append(alone)
    lengths.append(_char_length(data[alone]))
    scores.append(p.unknown - lengths[-1])
    ids.append(np.full(len(alone), -1, dtype=np.int64))
    return tuple(np.concatenate(x) for x in (starts, lengths, scores, ids))


def _char_length(lead: np.ndarray) -> np.ndarray:
    return 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)


def best_paths(p: P.Pieces, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all units one after another, and where each unit begins (one more).

    Of equal paths the one with the fewest pieces wins, then the one whose last pieces begin
    first.
    """
    data = np.frombuffer(b"\0".join(units) + b"\0" * (p.longest + 2), dtype=np.uint8)
    sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
    first = np.cumsum(sizes + 1) - (sizes + 1)
    inside = np.ones(len(data), dtype=bool)
    inside[first + sizes] = False
    inside[int(first[-1] + sizes[-1]) if units else 0:] = False
    start, length, score, ids = _matches(p, data, inside)
    offset = start - first[np.searchsorted(first, start, "right") - 1]
    order = np.lexsort((length, offset))
    start, length, score, ids, offset = (x[order] for x in (start, length, score, ids, offset))
    best = np.full(len(data) + 1, P.NONE, dtype=np.int64)
    best[first] = 0
    back = np.zeros(len(data) + 1, dtype=np.int64)
    steps = np.searchsorted(offset, np.arange(int(offset[-1]) + 2 if len(offset) else 1))
    for a, b in zip(steps[:-1], steps[1:], strict=True):
        # Ends of one unit differ within a step, so no end is written twice.
        end = start[a:b] + length[a:b]
        value = best[start[a:b]] + score[a:b]
        up = value > best[end]
        best[end[up]] = value[up]
        back[end[up]] = a + np.flatnonzero(up)
    at = first + sizes
    unit = np.arange(len(units))
    got_unit, got_match = [], []
    while True:
        go = at > first[unit]
        at, unit = at[go], unit[go]
        if not len(at):
            break
        m = back[at]
        got_unit.append(unit)
        got_match.append(m)
        at = start[m]
    if not got_unit:
        return np.zeros(0, dtype=np.int32), np.zeros(len(units) + 1, dtype=np.int64)
    unit, match = np.concatenate(got_unit)[::-1], np.concatenate(got_match)[::-1]
    order = np.argsort(unit, kind="stable")
    unit, match = unit[order], match[order]
    out = ids[match]
    plain = out >= 0
    n = np.where(plain, 1, length[match])
    at = np.cumsum(n) - n
    flat = np.empty(int(n.sum()), dtype=np.int64)
    flat[at[plain]] = out[plain]
    lost = np.flatnonzero(~plain)
    for k in range(4):
        has = lost[length[match[lost]] > k]
        flat[at[has] + k] = p.byte_ids[data[start[match[has]] + k]]
    ends = np.zeros(len(units) + 1, dtype=np.int64)
    np.cumsum(np.bincount(unit, weights=n, minlength=len(units)).astype(np.int64), out=ends[1:])
    return flat.astype(np.int32), ends


def gather(flat: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Slices ``ends[r]:ends[r + 1]`` of ``flat`` for all rows, one after another."""
    n = np.diff(ends)[rows]
    total = np.cumsum(n)
    at = np.arange(int(total[-1]) if len(n) else 0)
    return flat[at + np.repeat(ends[rows] - (total - n), n)]


#: Units a task remembers; when it holds more, it forgets all and goes on.
REMEMBERED = 1 << 19
UNITS_AT_ONCE = 1 << 15


class Numbers(dict):
    """Numbers its keys in the order they are first asked for."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


class Encoder:
    """Encodes texts and remembers the pieces of units met before, and which decode to themselves."""

    def __init__(self, p: P.Pieces):
        self.p = p
        self.piece_bytes = _piece_bytes(p)
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.flat = np.zeros(0, dtype=np.int32)
        self.ends = np.zeros(1, dtype=np.int64)
        self.lossy = np.zeros(0, dtype=bool)

    def learn(self) -> None:
        """Pieces of the units numbered since the last call."""
        have = len(self.ends) - 1
        if len(self.known) == have:
            return
        new = [u.encode() for u in islice(reversed(self.known), len(self.known) - have)][::-1]
        flats, ends, total, lossy = [self.flat], [self.ends], len(self.flat), [self.lossy]
        for at in range(0, len(new), UNITS_AT_ONCE):
            units = new[at:at + UNITS_AT_ONCE]
            flat, end = best_paths(self.p, units)
            flats.append(flat)
            ends.append(end[1:] + total)
            lossy.append(self.decoded_otherwise(units, flat, end))
            total += len(flat)
        self.flat, self.ends = np.concatenate(flats), np.concatenate(ends)
        self.lossy = np.concatenate(lossy)

    def decoded_otherwise(self, units: list[bytes], flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which units their pieces do not decode to."""
        data, at = self.piece_bytes
        back = gather(data, at, flat).tobytes()
        cuts = np.concatenate([[0], np.cumsum(np.diff(at)[flat])])[ends].tolist()
        return np.fromiter((back[a:b] != u for u, a, b in
                            zip(units, cuts[:-1], cuts[1:], strict=True)), bool, len(units))

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece ids of all texts, their numbers, and which texts decode to something else.

        An empty text has no pieces. A decoded text is its decoded units one after another.
        """
        if len(self.known) > REMEMBERED:
            self.forget()
        rows, counts = [], []
        number = self.known.__getitem__
        for text in texts:
            cut = P.units(text) if text else []
            rows.append(np.fromiter(map(number, cut), dtype=np.int64, count=len(cut)))
            counts.append(len(cut))
        self.learn()
        which = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        borders = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        sums = np.concatenate([[0], np.cumsum(np.diff(self.ends)[which])])
        lossy = np.concatenate([[0], np.cumsum(self.lossy[which])])
        return (gather(self.flat, self.ends, which), np.diff(sums[borders]),
                np.diff(lossy[borders]) > 0)


_encoders: dict[int, Encoder] = {}


def encoder(p: P.Pieces) -> Encoder:
    """The encoder of this process for a vocabulary."""
    if id(p) not in _encoders:
        _encoders.clear()
        _encoders[id(p)] = Encoder(p)
    return _encoders[id(p)]


def encode_batch(p: P.Pieces, column: pa.Array) -> pa.StructArray:
    """``piece_ids`` of each text, and ``lossless``: whether they decode to the text."""
    data, offsets, nulls = ts.buffers(column)
    own = encoder(p)
    parts, lengths = [np.zeros(0, dtype=np.int32)], [np.zeros(1, dtype=np.int64)]
    lossless = np.ones(len(column), dtype=bool)
    for a, b in ts.groups(offsets):
        texts = []
        for r in range(a, b):
            raw = data[offsets[r]:offsets[r + 1]].tobytes()
            texts.append(raw.decode("utf-8", "replace"))
            lossless[r] = "\ufffd" not in texts[-1] or texts[-1].encode() == raw
        flat, n, lossy = own.rows(texts)
        parts.append(flat)
        lengths.append(n)
        lossless[a:b] &= ~lossy
    at = np.cumsum(np.concatenate(lengths)).astype(np.int32)
    mask = pa.array(nulls) if nulls.any() else None
    ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts)), mask=mask)
    return pa.StructArray.from_arrays([ids, pa.array(lossless, mask=nulls)],
                                      names=["piece_ids", "lossless"])


PIECES_AT_ONCE = 1 << 18


def _piece_bytes(p: P.Pieces) -> tuple[np.ndarray, np.ndarray]:
    table = [bytes([b]) if b >= 0 else t for t, b in zip(p.text, p.is_byte, strict=True)]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in table])])
    return np.frombuffer(b"".join(table), dtype=np.uint8), ends


def decode_batch(p: P.Pieces, column: pa.ListArray) -> pa.Array:
    flat, ends = _piece_bytes(p)
    out: list[str | None] = []
    for ids in column:
        if not ids.is_valid:
            out.append(None)
            continue
        row = ids.values.to_numpy(zero_copy_only=False)
        row = row[(row >= 0) & (row < len(p.text))]
        text = b"".join(gather(flat, ends, row[at:at + PIECES_AT_ONCE]).tobytes()
                        for at in range(0, len(row), PIECES_AT_ONCE))
        out.append((text[1:] if text[:1] == b" " else text).decode("utf-8", "replace"))
    return pa.array(out, pa.string())


def vocabulary(spark: SparkSession, model: str = P.MODEL):
    """The trie of a model file, broadcast: its size is that of the vocabulary."""
    return spark.sparkContext.broadcast(P.load(P.checked(model)))


def encode(pieces, text: F.Column) -> F.Column:
    """Piece ids of a text column, and whether they decode to it: nulls for null."""
    return F.arrow_udf(lambda column: encode_batch(pieces.value, column),
                       returnType="piece_ids array<int>, lossless boolean")(text)


def decode(pieces, ids: F.Column) -> F.Column:
    """Text of a piece id column. Byte pieces make UTF-8, malformed parts become U+FFFD.

    The space the encoder puts before a text goes; ids outside the vocabulary are skipped.
    """
    return F.arrow_udf(lambda column: decode_batch(pieces.value, column),
                       returnType="string")(ids)


def tokenize(docs: DataFrame, model: str = P.MODEL) -> DataFrame:
    """All columns of ``docs`` but the text, with ``piece_ids``, ``n_pieces`` and ``lossless``.

    ``lossless`` is whether decoding gives the text back; a task decodes each distinct unit once
    and compares there. A null text has null in all three. Columns of these names are replaced.
    """
    pieces = vocabulary(docs.sparkSession, model)
    new = {"piece_ids", "n_pieces", "lossless"}
    keep = [c for c in docs.columns if c.lower() not in new | {"text"}]
    free = "_encoded"
    while free in {c.lower() for c in keep}:
        free += "_"
    found = docs.select(*(F.col(f"`{c}`") for c in keep),
                        encode(pieces, F.col("text")).alias(free))
    ids = F.col(f"{free}.piece_ids")
    return found.select(*(F.col(f"`{c}`") for c in keep), ids.alias("piece_ids"),
                        F.when(ids.isNotNull(), F.size(ids)).alias("n_pieces"),
                        F.col(f"{free}.lossless").alias("lossless"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(documents(spark, sf_dir).select("doc_id", "text"))
