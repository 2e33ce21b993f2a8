"""Phrases counted from coded windows, against plain Python."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

from corvane.operators import ngrams, phrases

TEXTS = [
    (1, None, "a"), (2, "", "a"), (3, "one", "b"), (4, "one two", None), (5, "One, two! 'Three'", "a"), (6, "one two three four five six", "b"),
    (7, "one two three four five six", None), (8, "the the the the the the the", "a"), (9, "the the the", "b"), (10, "x" * 70 + " y one two", None),
    (11, "x" * 70 + " y one two", "c"), (12, " ".join(["of the", "in the"] * 40), "b"), (13, "one two three four five", "b"),
]


def expected(rows):
    counts, sources = Counter(), defaultdict(set)
    for _, text, source in rows:
        words = [w.strip("'") for w in "".join(c if c.isalpha() or c == "'" else " " for c in (text or "").lower()).split()]
        for n in (2, 3, 4, 5):
            for i in range(len(words) - n + 1):
                g = (n, " ".join(words[i : i + n]))
                counts[g] += 1
                sources[g] |= {source} - {None}
    return counts, sources


@pytest.mark.parametrize("common,windows", [(60_000, 1_000_000), (0, 20), (3, 5)])
def test_recurring_phrases(spark, monkeypatch, common, windows):
    monkeypatch.setattr(phrases, "COMMON", common)
    monkeypatch.setattr(phrases, "WINDOWS", windows)
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, source string").repartition(3)
    counts, sources = expected(TEXTS)
    found = {(r.n, r.gram): (r["count"], r.sources) for r in phrases.recurring_phrases(docs).collect()}
    assert found == {g: (c, len(sources[g])) for g, c in counts.items() if c >= 2}
    totals = {n: [0, 0, 0] for n in (2, 3, 4, 5)}
    for r in phrases.phrase_totals(docs).collect():
        totals[r.n] = [a + b for a, b in zip(totals[r.n], r[1:])]
    for n in totals:
        own = [c for g, c in counts.items() if g[0] == n]
        assert totals[n] == [len(own), sum(c >= 2 for c in own), sum(c for c in own if c >= 2)]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert phrases.recurring_phrases(docs).collect() == []


@pytest.mark.parametrize("query", [ngrams.agg03, ngrams.phrases_by_length])
def test_no_phrase_is_shuffled_as_text(spark, sf_dir, query):
    """Each place's phrases of all lengths as rows of an exchange took over four times the input on disk."""
    plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "gram" not in "".join(x for x in plan.split("\n") if "Exchange hashpartitioning" in x)
