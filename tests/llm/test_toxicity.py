from __future__ import annotations

import random

import numpy as np

from corvane.llm import toxicity as T
from tests.llm import odd


def docs(n=500, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(5)) for _ in range(300)]
    insults = ["grobble", "snarfle", "wozzle"]
    out, labels = [], []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(10, 80))
        toxic, low = i % 7 == 0, i % 5 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(insults).upper() + "!")
        out.append((i, " ".join(w + "###" if low else w for w in words)))
        labels.append((i, int(not low), int(toxic)))
    return out, labels


def test_held_out_accuracy_of_the_chain(spark):
    rows, marks = docs()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = T.toxicity_labels(spark.createDataFrame([m for m in marks if m[0] < 350], "doc_id long, quality int, toxic int"))
    found = {r.doc_id: r for r in T.toxicity(df, labels, T.CATEGORIES).collect()}
    rest = [m for m in marks if m[0] >= 350]
    assert np.mean([found[i].is_toxic == bool(t) for i, _, t in rest]) > 0.97
    assert np.mean([found[i].is_toxic_junk == (bool(t) and not q) for i, q, t in rest]) > 0.97
    assert np.mean([found[i].is_toxic_prose == (bool(t) and bool(q)) for i, q, t in rest]) > 0.95
    assert all(0 <= r.p_toxic <= 1 for r in found.values())


def test_later_models_see_earlier_probabilities():
    rng = np.random.default_rng(0)
    first = rng.integers(0, 2, 400)
    rows = T.Rows([[int(f)] for f in first], np.zeros((400, 1)))
    chain = T.Chain(rows, {"a": first, "b": first}, np.arange(400) % T.FOLDS, 2)
    assert [len(m.dense) for m in chain.models] == [1, 2]
    p = chain.predict(rows)
    assert ((p[:, 1] > chain.limits[1]) == (first == 1)).all()


def test_three_categories_of_a_caller(spark):
    """Insults and threats, some unlabelled, and either of them; held-out rows."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(5)) for _ in range(300)]
    rows, labels, gold = [], [], {}
    for i in range(900):
        words = rng.choices(vocabulary, k=rng.randint(10, 60))
        insult, threat = i % 6 == 0, i % 10 < 3
        if insult:
            words[rng.randrange(len(words))] = rng.choice(["grobble", "snarfle"])
        if threat:
            words[rng.randrange(len(words))] = rng.choice(["zunkwill", "zunkdo"])
        if insult and not any(w in ("grobble", "snarfle") for w in words):
            words.append("grobble")
        rows.append((i, " ".join(words)))
        gold[i] = (insult, threat, insult or threat)
        if i < 600:
            labels.append((i, int(insult) if i % 4 else None, int(threat) if i % 5 else None, int(insult or threat)))
    names = ["offensive", "insult", "threat"]
    marks = spark.createDataFrame(labels, "doc_id long, insult int, threat int, offensive int")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    chain, index = T.fit(df, marks, names)
    assert chain.names == ["insult", "threat", "offensive"]  # the rarest first
    found = {r.doc_id: r for r in T.score(df, chain, index, names).collect()}
    assert list(found[0].asDict()) == ["doc_id", "p_offensive", "is_offensive", "p_insult", "is_insult", "p_threat", "is_threat"]
    for k, name in enumerate(["insult", "threat", "offensive"]):
        assert np.mean([found[i][f"is_{name}"] == gold[i][k] for i in range(600, 900)]) > 0.95
    # the last model leans on the probabilities of the kinds
    assert (chain.models[2].dense[-2:] > 0).all()
    # the query's scores equal the chain's, a row at a time
    for i in (0, 1, 2, 777):
        ws = T.distinct_words(rows[i][1])
        one = T.Rows([sorted(index[w] for w in ws & index.keys())], np.array([T.rates(rows[i][1])]))
        assert np.allclose(chain.predict(one)[0], [found[i].p_insult, found[i].p_threat, found[i].p_offensive])


def test_labels_without_quality_still_count(spark):
    labels = spark.createDataFrame([(1, None, 1), (2, 0, 1), (3, 1, 0), (4, None, 0), (5, 1, None)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: tuple(r)[1:] for r in T.toxicity_labels(labels).collect()}
    assert found == {1: (1, None, None), 2: (1, 0, 1), 3: (0, 0, 0), 4: (0, 0, 0), 5: (None, None, None)}


def test_rows_of_one_id_do_not_fill_the_sample(spark, monkeypatch):
    monkeypatch.setattr(T, "SAMPLE", 50)
    rows = [(1, f"grobble text {i}") for i in range(600)] + [(i, f"plain text {i}") for i in range(2, 40)]
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 40)], "doc_id long, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = T.toxicity(df, labels, ["toxic"]).collect()
    assert len(found) == len(rows)


def test_odd_documents(spark):
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(60)] + [(3, None, None)], "doc_id long, quality int, toxic int")
    found = T.toxicity(odd.frame(spark), T.toxicity_labels(labels), T.CATEGORIES).collect()
    assert len(found) == 120
    assert not any(r.is_toxic for r in found if r.doc_id in (0, 1, 2))
    assert T.toxicity(odd.empty(spark), T.toxicity_labels(labels), T.CATEGORIES).count() == 0
    none = T.toxicity(odd.frame(spark), T.toxicity_labels(labels.limit(0)), T.CATEGORIES).collect()
    assert {r.p_toxic for r in none} == {0.0}


def test_words_are_looked_up_in_the_row(spark, sf_dir, monkeypatch):
    """No join on words: a row for each word of the sample would pass through it."""
    from corvane.llm import toxicity as T
    from pyspark.sql.classic.dataframe import DataFrame

    joined, join = [], DataFrame.join
    monkeypatch.setattr(DataFrame, "join", lambda self, other, on=None, how=None: (joined.append(on), join(self, other, on, how))[1])
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    chain, index = T.fit(docs, T.toxicity_labels(labels), T.CATEGORIES)
    assert chain is not None and index
    assert "doc_id" in joined and "word" not in joined
