"""Quality rules learned as an ordered decision list.

``text_stats`` measures every text once, with array operations on its bytes. ``learn_rules`` runs
sequential covering over the labelled rows: a rule grows by the threshold condition with the best
information gain on two thirds of them, loses its last conditions while that helps on the other
third, and is taken if it is precise there; the rows it covers leave and the next rule is grown.
All counts come from Spark aggregations over every labelled row; only counts by feature and
threshold reach the driver. ``decision`` turns the list into one chain of conditional expressions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm import textscan as ts
from barsmith.llm.store import documents, stored, table

#: Thresholds tried for each feature: the quantiles of the labelled rows.
CUTS = 32
MAX_RULES = 8
MAX_CONDITIONS = 4
MIN_PRECISION = 0.9
#: A rule must cover one in so many of the bad labelled rows.
MIN_COVER = 200

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_upper", "n_marks", "n_digits", "n_distinct")
SYMBOLS = b"#*$%&|<>"
FEATURES = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def _classes() -> np.ndarray:
    """Byte to counted class: rows are word_chars, symbols, upper case, marks, digits."""
    out = np.zeros((5, 256), dtype=np.int64)
    out[0] = [(b & 0xC0) != 0x80 and b not in b" \t\n\v\f\r" for b in range(256)]
    out[1] = [b in SYMBOLS for b in range(256)]
    out[2, 65:91] = 1
    out[3] = [32 < b < 127 and not chr(b).isalnum() for b in range(256)]
    out[4, 48:58] = 1
    return out


def _class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes of each class by text, a slice at a time."""
    classes = _classes()
    out = np.zeros((5, len(offsets) - 1), dtype=np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    for at in range(lo, hi, ts.SLICE_BYTES):
        end = min(hi, at + ts.SLICE_BYTES)
        first, last = (int(np.searchsorted(offsets, at, "right")) - 1,
                       int(np.searchsorted(offsets, end, "left")))
        edges = np.clip(offsets[first:last + 1], at, end) - at
        for k in range(5):
            sums = np.concatenate([[0], np.cumsum(classes[k][data[at:end]])])
            out[k, first:last] += np.diff(sums[edges])
    return out


def _repeated(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of entries whose (text, hash) is there twice, and of entries after the first such."""
    order = np.lexsort((np.arange(len(h)), h, text))
    t, k = text[order], h[order]
    same = (t[1:] == t[:-1]) & (k[1:] == k[:-1])
    later = np.concatenate([[False], same]) if len(h) else np.zeros(0, dtype=bool)
    twice = later.copy()
    twice[:-1] |= later[1:]
    out = np.zeros((2, len(h)), dtype=bool)
    out[0, order], out[1, order] = twice, later
    return out[0], out[1]


def _measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    out = np.zeros((len(COUNTS), n), dtype=np.int64)
    words = ts.scan(ts.spaced(lower=False), data, offsets)
    out[0] = np.diff(words.first)
    out[1], out[2], out[6], out[7], out[8] = _class_counts(data, offsets)
    everything = ts.spaced(lower=False)
    inside = np.ones(256, dtype=bool)
    inside[0x0A] = False
    lines = ts.scan(ts.Alphabet(inside, everything.value), data, offsets)
    filled = (np.searchsorted(words.starts, lines.ends)
              > np.searchsorted(words.starts, lines.starts))
    line_text = lines.text_of_word()[filled]
    out[5] = np.bincount(line_text, minlength=n)
    _, later = _repeated(line_text, lines.hashes[filled])
    out[3] = np.bincount(line_text[later], minlength=n)
    h, at = ts.windows(words, 3)
    text = words.text_of_word()
    twice, _ = _repeated(text[at], h)
    steps = np.bincount(at[twice], minlength=len(text) + 4)[:len(text) + 4]
    covered = np.convolve(steps, [1, 1, 1])[:len(text)] > 0
    out[4] = np.bincount(text[covered], minlength=n)
    _, later = _repeated(text, words.hashes)
    out[9] = out[0] - np.bincount(text[later], minlength=n)
    return out


def _stats_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets, _ = ts.buffers(batch.column(1))
        parts = [_measure(data, offsets[a:b + 1]) for a, b in ts.groups(offsets)]
        counts = np.concatenate(parts, axis=1) if parts else np.zeros((len(COUNTS), 0), np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c) for c in counts)], names=["doc_id", *COUNTS])


def text_stats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of every whole text; a null text counts nothing."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _stats_task, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """``feature <= cut`` or, with ``above``, ``feature > cut``."""

    feature: str
    above: bool
    cut: float

    def column(self) -> F.Column:
        value = F.expr(FEATURES[self.feature]) if self.feature in FEATURES else F.col(self.feature)
        return value > self.cut if self.above else value <= self.cut


Rule = tuple[Condition, ...]


def _all(rule: Rule) -> F.Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule), F.lit(True))


def decision(rules: list[Rule]) -> F.Column:
    """Number of the first rule that holds, or null: one ordered conditional expression."""
    out = None
    for k, rule in enumerate(rules):
        out = F.when(_all(rule), F.lit(k)) if out is None else out.when(_all(rule), F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def _gain(p1: int, n1: int, p0: int, n0: int) -> float:
    if not p1:
        return 0.0
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))


def _grown(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    """Add the best condition until the rule is pure, long, or nothing helps."""
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS:
        bins = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"{f}_bin").alias("bin"))
                                   for f in cuts))).alias("b")
        counts: dict[tuple[str, int], tuple[int, int]] = {}
        for r in (rows.where(_raw(rule)).select("bad", bins).groupBy("b.feature", "b.bin")
                  .agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()):
            counts[r.feature, r.bin] = (r.p, r.n)
        best = (0.0, None)
        for f, cs in cuts.items():
            by = [counts.get((f, k), (0, 0)) for k in range(len(cs) + 1)]
            p0, n0 = sum(x[0] for x in by), sum(x[1] for x in by)
            if not p0 or not n0:
                return rule
            p = n = 0
            for k, cut in enumerate(cs):  # bin k: the k-th cut is the first not below the value
                p, n = p + by[k][0], n + by[k][1]
                for above, (p1, n1) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                    best = max(best, (_gain(p1, n1, p0, n0), Condition(f, above, cut)),
                               key=lambda x: x[0])
        if best[1] is None or best[0] <= 1e-9:
            return rule
        rule = (*rule, best[1])
    return rule


def _raw(rule: Rule) -> F.Column:
    """The rule over a frame that holds the features as columns."""
    return reduce(lambda a, b: a & b, ((F.col(c.feature) > c.cut) if c.above else
                                       (F.col(c.feature) <= c.cut) for c in rule), F.lit(True))


def _pruned(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The beginning of the rule with the best (p - n) / (p + n) on rows it was not grown on."""
    begins = [rule[:k] for k in range(1, len(rule) + 1)]
    sums = rows.agg(*(F.sum((_raw(x) & (F.col("bad") == b)).cast("long"))
                      for x in begins for b in (1, 0))).first()
    scored = [(x, sums[2 * k] or 0, sums[2 * k + 1] or 0) for k, x in enumerate(begins)]
    return max(scored, key=lambda s: ((s[1] - s[2]) / max(1, s[1] + s[2]), s[1]))


def learn_rules(labelled: DataFrame) -> list[Rule]:
    """Rules for the bad rows of ``doc_id, bad (0 or 1), counts``; none if one class is missing."""
    feats = {**FEATURES, "n_words": "n_words"}
    rows = stored(labelled.select(
        (F.crc32(F.col("doc_id").cast("string")) % 3 == 0).alias("prune"), F.col("bad").cast("long"),
        *(F.expr(e).cast("double").alias(f) for f, e in feats.items())), "labelled")
    shares = [k / CUTS for k in range(CUTS + 1)]
    both = [rows.where(F.col("bad") == b).agg(*(F.percentile_approx(f, shares, 10000).alias(f)
                                                for f in feats)).first() for b in (0, 1)]
    if any(q[0] is None for q in both):
        return []
    points = {f: sorted({float(c) for q in both for c in q[f]}) for f in feats}
    # Half-way between neighbouring quantiles of the two classes: a gap between them is cut in its middle.
    cuts = {f: [(a + b) / 2 for a, b in zip(q, q[1:], strict=False)] for f, q in points.items()
            if len(q) > 1}
    # Bin k of a feature: its first k cuts are below the value.
    rows = stored(rows.select("*", *(F.expr(
        f"size(filter(array({', '.join(f'{c!r}D' for c in cs)}), c -> c < {f}))").alias(f"{f}_bin")
        for f, cs in cuts.items())), "binned")
    n_bad = rows.where("bad = 1").count()
    rules: list[Rule] = []
    left = rows
    while len(rules) < MAX_RULES:
        rule = _grown(left.where("not prune"), cuts)
        if not rule:
            break
        rule, p, n = _pruned(left.where("prune"), rule)
        if p < MIN_PRECISION * (p + n) or p * MIN_COVER < n_bad / 3 or not p:
            break
        rules.append(rule)
        left = left.where(~_raw(rule))
    return rules


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of every text with ``base_failed``, ``rule`` and ``kept``.

    A text fails the base with under 50 words, or with more than half of its words in repeated
    three-word windows; so null and empty texts fail. Of the rest, those that a learned rule
    covers go, and ``rule`` is its number. ``labels`` has ``doc_id, quality``: 0 is bad; nulls
    are skipped and of contradicting labels the lower holds. Without labels of both kinds
    nothing but the base decides.
    """
    stats = stored(text_stats(docs), "stats")
    bad = (labels.where("quality is not null and doc_id is not null").groupBy("doc_id")
           .agg((F.min("quality") == 0).cast("int").alias("bad")))
    rules = learn_rules(stats.where(~base_failed()).join(bad, "doc_id"))
    return (stats.withColumn("base_failed", base_failed())
            .withColumn("rule", F.when(~F.col("base_failed"), decision(rules)))
            .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "rule")
