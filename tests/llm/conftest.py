import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, and a clashing column."""
    base = "the quick brown fox jumps over the lazy dog and runs far away home"
    rows = [(1, base, "en", "a"), (2, base, "en", "b"), (2, base, "en", "b"), (3, None, "en", "a"),
            (4, "", None, "a"), (5, " \t\n ", "de", None), (None, base, None, None),
            (6, "two words", "en", "a"), (7, "TWO words", "en", "a"), (8, "é" * 40, "fr", "a"),
            (9, (base + "\n") * 30, "en", "a"), (10, "word " * 3000, "en", "a"),
            (11, base + " indeed", "en", "a"), (12, "日本語 😀▁", "xx", "a"),
            (13, "x" * 3000, "en", "c")]
    return spark.createDataFrame(
        [(i, t, lang, s, len(t or ""), "clash") for i, t, lang, s in rows],
        SCHEMA + ", N_PIECES string")
