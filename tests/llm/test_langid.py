from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from corvane.llm import langid as L
from tests.llm import odd

WORDS = {"xx": "oro moro loro toro soro".split(), "yy": "ikki pikki tikki nikki".split(), "zz": "ach bach dach lach".split()}


def docs(n=300, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        text = " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "a", "e"]) for _ in range(rng.randint(3, 60)))
        out.append((i, text, lang))
    return out


@pytest.fixture(scope="module")
def model():
    return L.fit([(lang, L.words(t)) for _, t, lang in docs()])


def test_held_out_accuracy(spark):
    df = spark.createDataFrame(docs(), "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in L.identify(df).collect()}
    held = [(i, lang) for i, _, lang in docs() if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(found[i].held_out for i, _ in held)
    assert sum(r.held_out for r in found.values()) == len(held)
    assert np.mean([found[i].lang_pred == lang for i, lang in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())


def test_code_switching_is_seen_word_by_word(model):
    text = "oro moro loro toro ikki pikki tikki nikki"
    emit = model.scores(L.words(text))[None]
    post = L.forward_backward(emit, model.turns.astype(float), model.start.astype(float), np.array([8]))[:, 0]
    names = [model.languages[k] for k in post.argmax(axis=1)]
    assert names == ["xx"] * 4 + ["yy"] * 4


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    emit, turns, start = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = np.array([4, 2])
    got = L.forward_backward(emit, turns, start, lengths)
    for r, n in enumerate(lengths):
        p = np.zeros((n, 3))
        for path in product(range(3), repeat=int(n)):
            w = np.exp(start[path[0]] + sum(emit[r, i, k] for i, k in enumerate(path)) + sum(turns[a, b] for a, b in zip(path, path[1:], strict=False)))
            for i, k in enumerate(path):
                p[i, k] += w
        assert np.allclose(got[:n, r], p / p.sum(axis=1, keepdims=True))


@pytest.mark.parametrize("n", [2, 6, 7, 12, 13, 400])
def test_long_texts_by_blocks_equal_one_pass(monkeypatch, n):
    monkeypatch.setattr(L, "BLOCK", 6)
    monkeypatch.setattr(L, "HELD", 3)
    rng = np.random.default_rng(n)
    scores, ids = rng.normal(scale=6, size=(9, 3)), rng.integers(0, 9, n)
    turns, start = rng.normal(scale=2, size=(3, 3)), rng.normal(size=3)
    want = L.forward_backward(scores[ids][None], turns, start, np.array([n]))[:, 0].sum(axis=0)
    assert np.allclose(L.long_sums(scores, ids, turns, start), want)


def test_a_very_long_text_equals_a_plain_run(model):
    rng = random.Random(4)
    ws = [w for lang in ("xx", "yy") for w in WORDS[lang]] + ["other"]
    text = " ".join(rng.choice(ws) for _ in range(500_000))
    (lang,), (score,) = L.Predictor(model).documents([text])
    emit = model.scores(L.words(text))[None]
    sums = L.forward_backward(emit, model.turns.astype(float), model.start.astype(float), np.array([500_000])).sum(axis=(0, 1))
    assert lang == model.languages[int(sums.argmax())]
    assert score == pytest.approx(sums.max() / 500_000)


@pytest.mark.parametrize("text", ["½²", "Ⅷ", "12 34", "_", "①", "٣", "", None, "\u0301"])
def test_no_letter_is_no_language(model, text):
    assert L.Predictor(model).documents([text])[0] == ["und"]
    assert L.words("a½b Ⅷx²") == ["a", "b", "x"]


def test_predictions_equal_a_run_of_each_text(spark):
    """The query's rows against the model fitted apart and one sequence a text."""
    df = spark.createDataFrame(docs(80) + [(80, None, "xx"), (None, "oro moro", "xx"), (3, "ikki", "yy"), (3, "ikki", "yy")], "doc_id long, text string, lang string")
    own = L.fit(L.training_sample(df))
    rows = L.identify(df).collect()
    assert len(rows) == 84
    texts = {}
    for r in df.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    for r in rows:
        found = []
        for text in texts[r.doc_id]:
            ws = L.words(text)
            if ws:
                sums = L.forward_backward(own.scores(ws)[None], own.turns.astype(float), own.start.astype(float), np.array([len(ws)])).sum(axis=(0, 1))
                found.append((own.languages[int(sums.argmax())], sums.max() / len(ws)))
            else:
                found.append(("und", 0.0))
        assert any(r.lang_pred == lang and abs(r.score - score) < 1e-4 for lang, score in found)


def test_the_sample_is_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE", 10)
    df = spark.createDataFrame([(7, "oro moro loro", "xx")] * 500 + [(8, f"ikki {i}", "yy") for i in range(500)], "doc_id long, text string, lang string")
    assert 0 < len(L.training_sample(df)) < 40


def test_odd_documents(spark):
    found = {r.doc_id: r for r in L.identify(odd.frame(spark)).collect()}
    assert len(found) == 120
    assert [found[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3
    assert all(found[i].score == 0 for i in (0, 1, 2))
    assert found[7].lang_pred == "en"
    assert L.identify(odd.empty(spark)).count() == 0
    kept = L.accepted(odd.frame(spark))
    assert kept.columns == odd.frame(spark).columns
    assert {r.doc_id for r in kept.collect()} == set(range(3, 120))
