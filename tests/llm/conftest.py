"""Small tables for the corpus operators."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Null, empty, blank, ties and repeats, a long word, letters beyond ASCII, control characters.
ODD = [None, "", "  \t\n ", "a", "a", "A", "x" * 20_000, "naïve café déjà vu — ünïcode \U0001f600 end", "tab\tnew\nline\rfeed\x0bvt\x0cff", "one two three", "one two three", "a.b@c.de +1 (555) 010-9999 10.0.0.256"]


def words(r: random.Random, n: int) -> str:
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(r.randrange(30)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    r = random.Random(4)
    texts = [*ODD, *[words(r, r.randrange(1, 300)) for _ in range(60)]]
    texts += [texts[20], texts[20], texts[25] + " more words here", "\n".join([words(r, 12)] * 6), words(r, 30_000)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[30], rows[30], (None, "text without id", None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
