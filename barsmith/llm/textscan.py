"""Words of UTF-8 texts as 64-bit hashes, found with array operations on the Arrow buffers.

A word is a maximal run of the bytes that an :class:`Alphabet` admits. Texts are scanned in
slices of a quarter of a megabyte that end between words, so memory follows the slice and the number
of words, never eight times the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words, and what each byte counts as."""

    inside: np.ndarray
    value: np.ndarray


def spaced(lower: bool) -> Alphabet:
    """Words between ASCII white space; ``lower`` reads A-Z as a-z."""
    inside = np.ones(256, dtype=bool)
    inside[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    value = _BYTE_VALUES.copy()
    if lower:
        value[65:91] = value[97:123]
    return Alphabet(inside, value)


def alphanumeric() -> Alphabet:
    """Words of ASCII letters and digits and all bytes over 127; letters in lower case.

    Trailing bytes 80-9F count as A0-BF: that is the case of Latin-1 and most Cyrillic letters,
    and few other words differ in it alone.
    """
    inside = np.zeros(256, dtype=bool)
    inside[48:58] = inside[65:91] = inside[97:123] = inside[128:] = True
    value = _BYTE_VALUES.copy()
    value[65:91] = value[97:123]
    value[0x80:0xA0] = value[0xA0:0xC0]
    return Alphabet(inside, value)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLICE_BYTES * 2, 1 << int(n).bit_length())
    if size not in _cache:
        _cache.clear()
        _cache[size] = (_powers(_P, size), _powers(_P_INVERSE, size))
    return _cache[size]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets (one more than rows) and the mask of nulls of a string column."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if not pa.types.is_large_string(column.type) and not pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=bool)
    _, ends, bytes_ = column.buffers()
    offsets = np.frombuffer(ends, dtype=width)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bytes_, dtype=np.uint8) if bytes_ else np.zeros(0, dtype=np.uint8)
    nulls = np.asarray(column.is_null())
    return data, offsets, nulls


def _cuts(inside: np.ndarray, data: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Slices of [lo, hi) that end where no word goes on; a longer word makes a longer slice."""
    at = lo
    while at < hi:
        end = min(hi, at + SLICE_BYTES)
        while end < hi and inside[data[end]]:
            block = data[end:min(hi, end + SLICE_BYTES)]
            stop = np.flatnonzero(~inside[block])
            end += int(stop[0]) if len(stop) else len(block)
            if len(stop):
                break
        yield at, end
        at = end


def _slice_words(alphabet: Alphabet, data: np.ndarray, lo: int, hi: int, breaks: np.ndarray):
    part = data[lo:hi]
    word = alphabet.inside[part]
    edge = np.empty(len(part) + 1, dtype=bool)
    edge[0], edge[-1] = word[0], False
    edge[1:-1] = word[1:] & ~word[:-1]
    cut = breaks - lo
    cut = cut[(cut > 0) & (cut < len(part))]
    edge[cut] = word[cut]
    starts = np.flatnonzero(edge)
    if not len(starts):
        return starts, starts, np.zeros(0, dtype=np.uint64)
    last = np.empty(len(part), dtype=bool)
    last[-1] = word[-1]
    last[:-1] = word[:-1] & (~word[1:] | edge[1:-1])
    ends = np.flatnonzero(last) + 1
    power, inverse = _power_tables(len(part))
    sums = np.empty(len(part) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(alphabet.value[part] * power[:len(part)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    return starts + lo, ends + lo, hashes


@dataclass
class Words:
    """Words of many texts in order: text r has those from ``first[r]`` to ``first[r + 1]``."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def scan(alphabet: Alphabet, data: np.ndarray, offsets: np.ndarray) -> Words:
    lo, hi = int(offsets[0]), int(offsets[-1])
    parts = [_slice_words(alphabet, data, a, b,
                          offsets[np.searchsorted(offsets, a):np.searchsorted(offsets, b, "right")])
             for a, b in _cuts(alphabet.inside, data, lo, hi)]
    if parts:
        starts, ends, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        starts = ends = np.zeros(0, dtype=np.int64)
        hashes = np.zeros(0, dtype=np.uint64)
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets))


def groups(offsets: np.ndarray, limit: int = 2 * SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes; a longer text makes a run of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(n, end)
        at = min(n, end)


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of one text, and the first word of each."""
    n = np.diff(words.first)
    at = np.arange(len(words.hashes))
    text = words.text_of_word()
    at = at[at + size <= words.first[1:][text]] if len(n) else at
    h = np.full(len(at), size, dtype=np.uint64)
    for k in range(size):
        h = mix(h + words.hashes[at + k])
    return h, at


class SortedHashes:
    """Sorted hashes with a directory by their top bits, so a search is one or two comparisons."""

    def __init__(self, keys: np.ndarray):
        """``keys``: distinct values; ``order`` sorts rows that belong to them."""
        hashes = mix(keys)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.bits = max(8, int(len(keys)).bit_length() + 1)
        tops = self.hashes >> np.uint64(64 - self.bits)
        self.start = np.searchsorted(tops, np.arange((1 << self.bits) + 1, dtype=np.uint64))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        if not len(self.hashes):
            return np.full(len(keys), -1, dtype=np.int64)
        h = mix(keys)
        top = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.start[top], self.start[top + 1]
        out = np.full(len(keys), -1, dtype=np.int64)
        rest = np.flatnonzero(at < end)
        at, end, h = at[rest], end[rest], h[rest]
        while len(rest):
            there = self.hashes[at]
            hit = there == h
            out[rest[hit]] = at[hit]
            go = (there < h) & (at + 1 < end)
            rest, at, end, h = rest[go], at[go] + 1, end[go], h[go]
        return out
