"""A vocabulary of scored pieces as a double-array trie, and how texts are cut into units.

The model file's ranks become log probabilities by Zipf's law, since the public vocabulary is a
merge list without likelihoods: ``log p = -log(rank + ZIPF) - log Z``. Scores are fixed-point
integers with the piece count in their low bits: the best segmentation has the highest score and
among those the fewest pieces, exactly, in whatever order scores are added.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
ZIPF = 2.7
SCALE = 10_000
COUNT_BITS = 20
#: Of a character without a piece, relative to the least likely piece, in nats.
UNKNOWN = 10.0
NONE = -(1 << 62)
#: Places tried at once for a node with several children.
WINDOW = 512
#: A unit is a run of spaces with the characters after it: no piece reaches over its borders.
#: A unit also ends after LONGEST_UNIT characters, which keeps its piece count in COUNT_BITS.
LONGEST_UNIT = 100_000
UNIT = re.compile(f" {{1,{LONGEST_UNIT}}}[^ ]{{0,{LONGEST_UNIT}}}|[^ ]{{1,{LONGEST_UNIT}}}")


@dataclass(frozen=True)
class Pieces:
    """Double-array trie over UTF-8 bytes; ``score`` and ``id`` of the states that end a piece.

    A character without a piece scores ``unknown`` less its bytes, for each of which it takes a
    piece.
    """

    base: np.ndarray
    check: np.ndarray
    score: np.ndarray
    id: np.ndarray
    unknown: int
    byte_ids: np.ndarray
    longest: int
    text: list[bytes]
    is_byte: np.ndarray
    crossing: tuple[str, ...]

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next states, or -1."""
        to = self.base[state] + byte
        return np.where(self.check[to] == state, to, -1)


def double_array(keys: list[bytes], score: list[int], ids: list[int]):
    """Base, check, score and id arrays of the trie of distinct non-empty keys."""
    children: list[dict[int, int]] = [{}]
    node_score, node_id = [NONE], [-1]
    for key, s, i in zip(keys, score, ids, strict=True):
        at = 0
        for b in key:
            nxt = children[at].get(b)
            if nxt is None:
                nxt = len(children)
                children[at][b] = nxt
                children.append({})
                node_score.append(NONE)
                node_id.append(-1)
            at = nxt
        node_score[at], node_id[at] = s, i
    size = 3 * len(children) + 4 * WINDOW
    base = np.zeros(size, dtype=np.int64)
    check = np.full(size, -1, dtype=np.int64)
    out_score = np.full(size, NONE, dtype=np.int64)
    out_id = np.full(size, -1, dtype=np.int64)
    used = np.zeros(size, dtype=bool)
    used[0] = True
    slot = {0: 0}
    queue, free, top = [0], 256, 0
    window = np.arange(WINDOW)
    while queue:
        node = queue.pop()
        at = slot[node]
        out_score[at], out_id[at] = node_score[node], node_id[node]
        kids = children[node]
        if not kids:
            continue
        codes = np.sort(np.fromiter(kids, dtype=np.int64, count=len(kids)))
        while used[free]:
            free += 1
        if len(codes) == 1:
            b = max(0, free - int(codes[0]))
            while used[b + codes[0]]:
                b += 1
        else:
            # Near the end of what is used; nodes with one child fill the holes further down.
            tries = window + max(0, max(free, top - 4 * WINDOW) - int(codes[0]))
            while not (fits := ~used[tries[:, None] + codes].any(axis=1)).any():
                tries += WINDOW
            b = int(tries[np.argmax(fits)])
        base[at] = b
        top = max(top, b + int(codes[-1]))
        for c, kid in kids.items():
            used[b + c] = True
            check[b + c] = at
            slot[kid] = b + c
            queue.append(kid)
    last = int(np.flatnonzero(used)[-1]) + 257
    return base[:last], check[:last], out_score[:last], out_id[:last]


def weight(log_p: float) -> int:
    return (round(log_p * SCALE) << COUNT_BITS) - 1


@lru_cache(maxsize=2)
def load(model: str = MODEL) -> Pieces:
    """The trie of a model file, built once in each process."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    keys, ranks, ids = [], [], []
    text, is_byte = [b""] * n, np.full(n, -1, dtype=np.int64)
    byte_ids = np.full(256, -1, dtype=np.int64)
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            is_byte[i] = int(piece[3:5], 16)
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            text[i] = piece.replace(MARK, " ").encode()
            keys.append(text[i])
            ranks.append(-sp.get_score(i))
            ids.append(i)
    order = np.argsort(np.argsort(np.array(ranks), kind="stable"), kind="stable")
    logs = -np.log(order + ZIPF)
    logs -= np.log(np.exp(logs).sum())
    base, check, score, out_id = double_array(keys, [weight(x) for x in logs], ids)
    crossing = tuple(k.decode() for k in keys if re.search("[^ ] ", k.decode()))
    return Pieces(base, check, score, out_id, weight(float(logs.min()) - UNKNOWN) + 1, byte_ids,
                  max(map(len, keys)), text, is_byte, crossing)


def checked(model: str = MODEL) -> str:
    """The path, if its vocabulary fits: byte pieces for all bytes and no piece over two units."""
    p = load(model)
    if p.crossing or (p.byte_ids < 0).any():
        raise ValueError(f"{os.path.basename(model)}: pieces that hold a space after other "
                         "characters, or a byte without a piece")
    return model


def units(text: str) -> list[str]:
    """Units of a text with a space put before it.

    Pieces hold spaces where the file has marks, so a mark that stands in a text has no piece and
    falls back to its bytes: decoding gives it back.
    """
    return UNIT.findall(" " + text)
