"""Spelling variants, MinHash near-duplicates and hard negatives against brute force and SQL."""

import random
import re
import zlib
from collections import Counter

import oracle
import pytest

from barsmith.llm import minhash, negatives, queries, variants
from barsmith.plans.registry import Entry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_minhash", "op13_hard_negatives"])
def test_equals_sql(spark, name):
    entry = Entry(name, queries.QUERIES[name], queries.ORACLE_SQL[name])
    ok, note = oracle.compare(spark, oracle.connect(SMALL), entry, SMALL)
    assert ok, note


# --- MinHash ---------------------------------------------------------------------------------

def shingles(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def components_of(rows, percent=85, size=3):
    """Component of each row by comparing all pairs of rows."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            both = len(a & b)
            if rows[i][0] is not None and rows[j][0] is not None and a and b and (
                    100 * both >= percent * len(a | b)):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(sets[i]), low.get(find(i)) if d is not None else None)
            for i, (d, _) in enumerate(rows)]


def noisy(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_minhash_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)  # buckets in many pairs of blocks
    monkeypatch.setattr(minhash, "PARTNERS", 3)
    rng = random.Random(5)
    rows = []
    for group in range(4):
        base = [f"b{group}x{rng.randrange(400)}" for _ in range(rng.choice([40, 150, 400]))]
        rows += [(len(rows) + k, noisy(rng, base, rng.choice([0, 1, 2, 3, 5, 8])))
                 for k in range(30)]
    rng.shuffle(rows)
    got = minhash.minhash_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == Counter(
        components_of(rows))


def test_minhash_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    rows += [(90, "a b c " * 60_000), (91, "A b c " * 60_000), (92, " ".join(
        f"w{i}" for i in range(150_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 as n", "2 as node", "3 as component_id", "4 as kept", "5 as bands")
    got = minhash.minhash_components(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(
        components_of(rows))
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert minhash.minhash_components(docs.limit(0)).count() == 0


def test_minhash_two_texts_of_one_id_stay_apart(spark):
    a, b = " ".join("abcdefghij"), " ".join("klmnopqrst")
    got = minhash.minhash_components(spark.createDataFrame(
        [(1, a), (2, a), (2, b), (3, b)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [
        (1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False)]


# --- Spelling variants -----------------------------------------------------------------------

def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def variants_of(docs, slip):
    n = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if slip and h % slip == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            if len(run) >= 7:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    form, count = {}, {}
    for w in n:
        others = [x for x in n if near(w, x)]
        count[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], count[w], n.get(form[w])))
    return out


def got_variants(docs, **kw):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n)
            for r in variants.spelling_variants(docs, **kw).collect()}


@pytest.mark.parametrize("block", [1 << 15, 4])
def test_variants_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(variants, "BLOCK_WORDS", block)
    rng = random.Random(3)
    letters = "aeionrstÀéÿß"
    words = ["".join(rng.choice(letters) for _ in range(rng.choice([7, 8, 9, 30])))
             for _ in range(25)]
    words += ["x" * 80 + "abc", "resumés", "RESUMÉS"]
    docs = []
    for d in range(60):
        text = []
        for _ in range(60):
            w = words[int(rng.random() ** 3 * len(words))]
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k:],
                                w[:k] + rng.choice(letters) + w[k + 1:]])
            text.append(w)
        docs.append((rng.choice([d, d, None]), rng.choice([" ", "-", "1"]).join(text)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = variants_of(docs, 31)
    assert any(w[1] and w[2] != w[1] for w in want) or any(w[1] for w in want)
    assert got_variants(frame, slip_every=31) == want
    assert got_variants(frame) == variants_of(docs, 0)


def test_variants_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    rows += [(50, "lettering " * 100_000), (51, "z" * 300_000), (52, "z" * 300_000),
             (53, "z" * 299_999), (54, "z" * 299_999)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 as word", "2 as n", "3 as cell")
    assert got_variants(docs) == variants_of(rows, 0)
    assert variants.spelling_variants(docs.limit(0)).count() == 0


def test_roots_follow_forms_to_the_end(spark):
    forms = spark.createDataFrame([(str(i), str(i + 1)) for i in range(12)], "word string, form string")
    assert {(r.word, r.root) for r in variants._roots(forms).collect()} == {
        (str(i), "12") for i in range(12)}


# --- Hard negatives --------------------------------------------------------------------------

def negatives_of(rows, every=100, low=80, k=5):
    def whole(x):
        return tuple(int(256 * c // 1) for c in x)

    rows = sorted({(i, lab, whole(v)) for i, lab, v in rows
                   if i is not None and lab is not None and v is not None
                   and all(c is not None and abs(c) < float("inf") for c in v)})
    out = set()
    for i, lab, q in rows:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j, other) for j, other, v in rows
                        if j != i)
        for s, p in [(-s, j) for s, j, other in scored if other == lab][:k]:
            fit = [(-t, j) for t, j, other in scored if other != lab and low * s <= -100 * t <= 100 * s]
            out |= {(i, p, rank + 1, j, s, t) for rank, (t, j) in enumerate(fit[:k])}
    return out


def got_negatives(frame, **kw):
    return {tuple(r) for r in negatives.hard_negatives(frame, **kw).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score",
        "negative_score").collect()}


SCHEMA = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("bucket,seed", [(1 << 14, 256), (40, 8)])
def test_negatives_equal_brute_force(spark, monkeypatch, bucket, seed):
    monkeypatch.setattr(negatives, "BUCKET_ROWS", bucket)
    rng = random.Random(bucket)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    rows = []
    for i in range(400):
        c, size = rng.choice(centres), rng.choice([0.1, 1, 1, 3])
        rows.append((i, rng.randrange(3), [size * (x + rng.gauss(0, 0.3)) for x in c]))
    rows += [(i + 1000, lab, v) for i, lab, v in rows[:60]]  # ties
    rows += rows[:40] + [(None, 1, [1.0]), (500, None, [1.0]), (501, 1, None), (502, 1, []),
                         (503, 1, [1.0, None]), (504, 1, [float("nan")]), (505, 2, [float("inf")]),
                         (600, 1, [0.0] * 12), (700, 2, [3.0, 1.0]), (800, 9, [1.0] * 12)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as bucket", "'x' as least")
    padded = [(i, lab, v and v + [0.0] * (12 - len(v)) if v != [] else [0.0] * 12)
              for i, lab, v in rows]
    want = negatives_of(padded, every=10)
    assert len(want) > 200
    assert got_negatives(frame, anchor_every=10) == want
    assert got_negatives(frame.limit(0)) == set()


def test_negatives_of_large_components(spark):
    rows = [(i, i % 2, [8e6 - i, 5e6 + 3 * i, -7e6 + i]) for i in range(20)]
    assert got_negatives(spark.createDataFrame(rows, SCHEMA), anchor_every=5) == negatives_of(rows, 5)


def test_pruning_keeps_all_above_the_threshold():
    import numpy as np
    rng = np.random.default_rng(1)
    v = rng.integers(-200, 200, (500, 16)).astype(np.int32)
    bucket = negatives.Bucket(list(range(500)), [0] * 500, [x.tobytes() for x in v], 16)
    pruned = 0
    for q in rng.integers(-200, 200, (40, 16)).astype(float):
        scores = bucket.scores(q, np.arange(500))
        for theta in np.quantile(scores, [0.5, 0.9, 0.99, 1.0]):
            kept = set(bucket.candidates(q, float(theta)).tolist())
            assert kept >= set(np.flatnonzero(scores >= theta).tolist())
            pruned += 500 - len(kept)
    assert pruned > 0
