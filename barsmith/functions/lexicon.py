"""Lexicon sentiment as column expressions, and the word lists."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from barsmith.functions.scalar import ColumnLike, col, first_match

# --- fixed values: word lists (an entry listed twice counts twice) ------------

POSITIVE_ID = [
    "naik", "untung", "profit", "positif", "optimis", "meningkat", "berkembang", "pesat",
    "melejit", "melonjak", "surplus", "prospek", "menjanjikan", "apresiasi", "bullish",
    "pemulihan", "efisien", "potensi", "tumbuh", "menguat", "mendongkrak", "terbaik",
    "gemilang", "cemerlang", "eskalasi", "tahan banting", "mempertahankan", "mendominasi",
    "daya tarik", "prospektif", "rekor", "tertinggi", "puncak", "laba", "keuntungan", "prestasi",
    "berkembang", "bertumbuh", "peningkatan", "dividend", "dividen", "bonus", "rekor", "sukses",
    "berhasil", "capaian", "kemajuan", "prestasi", "capaian", "kemajuan", "bangkit",
    "penguatan", "penguatan",
]

NEGATIVE_ID = [
    "turun", "rugi", "negatif", "pesimis", "menurun", "merosot", "anjlok", "krisis", "gagal",
    "turunkan", "defisit", "bearish", "koreksi", "resesi", "lambat", "tekanan", "kesulitan",
    "meredup", "terpuruk", "tertekan", "krisis likuiditas", "bubar", "hancur", "downtrend",
    "bersedih", "jatuh", "rugi besar", "pesimisme", "deklinasi", "melemah", "tergelincir",
    "penurunan", "kerugian", "terpangkas", "merosot", "terhambat", "rontok", "fluktuatif",
    "gejolak", "volatil", "kekhawatiran", "kekecewaan", "merugi", "kolaps", "bangkrut",
    "pailit", "delisting", "suspend", "terjun", "meluncur", "ambrol", "ambruk", "tumbang",
    "mati",
]

POSITIVE_EN = [
    "rise", "profit", "positive", "optimistic", "increase", "growth", "rapid", "surge", "jump",
    "surplus", "prospect", "promising", "appreciation", "bullish", "recovery", "efficient",
    "potential", "grow", "strengthen", "boost", "best", "outstanding", "brilliant",
    "escalation", "resilient", "maintain", "dominate", "attractive", "prospective", "record",
    "highest", "peak", "gain", "dividend", "bonus", "success", "achievement", "progress",
    "achievement", "upturn", "upward",
]

NEGATIVE_EN = [
    "fall", "loss", "negative", "pessimistic", "decrease", "decline", "plunge", "crisis",
    "fail", "reduce", "deficit", "bearish", "correction", "recession", "slow", "pressure",
    "difficulty", "fade", "struggle", "stressed", "liquidity crisis", "dissolve", "crash",
    "downtrend", "sad", "drop", "major loss", "pessimism", "declination", "weaken", "slip",
    "decrease", "loss", "cut", "plummet", "impede", "collapse", "fluctuate", "volatility",
    "volatile", "concern", "disappointment", "lose", "collapse", "bankrupt", "bankruptcy",
    "delisting", "suspend", "dive", "tumble", "crash", "crisis", "fail",
]

MONTHS_ID = {
    "Januari": "January", "Februari": "February", "Maret": "March", "April": "April",
    "Mei": "May", "Juni": "June", "Juli": "July", "Agustus": "August", "September": "September",
    "Oktober": "October", "November": "November", "Desember": "December",
}

# ------------------------------------------------------------------------------


DEFAULT_POSITIVE = POSITIVE_ID
DEFAULT_NEGATIVE = NEGATIVE_ID
BILINGUAL_POSITIVE = DEFAULT_POSITIVE + POSITIVE_EN
BILINGUAL_NEGATIVE = DEFAULT_NEGATIVE + NEGATIVE_EN


def one_pass_pattern(entries: Iterable[str]) -> str:
    """Regular expression that captures, at each place of a text, the longest entry there.

    The entries' trie written as nested alternatives: no two begin with the same character, so a
    place costs one walk down the trie however long the list. The capture stands in a lookahead,
    which takes no characters: entries inside or across other entries are met at their own place.
    """
    trie: dict = {}
    for entry in filter(None, entries):
        node = trie
        for char in entry:
            node = node.setdefault(char, {})
        node[""] = {}

    def written(node: dict) -> str:
        ways = [re.escape(char) + written(below) for char, below in sorted(node.items()) if char]
        if not ways:
            return ""
        body = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})"
        return body + ("?" if "" in node else "")

    def one_of(chars: Iterable[str]) -> str:
        return "[" + "".join(re.escape(c) for c in sorted(chars)) + "]"

    # Most places fail on the first two characters, which two classes tell fastest.
    seconds = {char for below in trie.values() for char in below}
    gate = one_of(trie) + ("" if "" in seconds else one_of(seconds))
    return f"(?={gate})(?=({written(trie)}))"


def entries_found(text: Column, entries: Iterable[str]) -> Column:
    """Distinct longest entries at any place of the text, in one pass over it."""
    entries = [e for e in entries if e]
    if not entries:
        return F.array().cast("array<string>")
    return F.array_distinct(F.regexp_extract_all(text, F.lit(one_pass_pattern(entries)), F.lit(1)))


def hits(found: Column, entries: Sequence[str]) -> Column:
    """Number of list entries in a text with these longest entries; one listed twice counts twice.

    An entry is in the text if it begins one of the longest; an empty entry is in every text. The
    outer function goes over ``found``, so the pass is not repeated per entry where the optimizer
    puts its expression in here. The list is one array literal: the expression stays small.
    """
    listed = [e for e in entries if e]
    if not listed:
        return F.lit(len(entries))
    words, places = F.lit(listed), F.lit(list(range(len(listed))))
    begun = F.transform(found, lambda f: F.filter(
        places, lambda i: F.startswith(f, F.get(words, i))))
    return F.size(F.array_distinct(F.flatten(begun))) + (len(entries) - len(listed))


def sentiment_columns(pos: ColumnLike, neg: ColumnLike) -> dict[str, Column]:
    """Label and signed score from the two hit counts."""
    p, n = col(pos), col(neg)
    both = F.nullif((p + n).cast("double"), F.lit(0.0))
    return {
        "sentiment": first_match([(p > n, "Positive"), (n > p, "Negative")], "Neutral"),
        "sentiment_score": first_match([(p > n, p / both), (n > p, -n / both)], 0.0),
    }


def parse_published(text: ColumnLike) -> Column:
    """Timestamp of an Indonesian news date, NULL when no known form fits.

    Forms: 'Weekday, d Month yyyy HH:mm WIB', the same without weekday or zone,
    with seconds, date only, and ISO.
    """
    t = F.trim(col(text))
    for local, english in MONTHS_ID.items():
        t = F.replace(t, F.lit(local), F.lit(english))
    t = F.regexp_replace(t, r"^[^,]*, ", "")
    t = F.regexp_replace(t, r" WIB$", "")
    forms = ("d MMMM yyyy HH:mm", "d MMMM yyyy HH:mm:ss", "d MMMM yyyy", "yyyy-MM-dd HH:mm:ss",
             "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in forms])
