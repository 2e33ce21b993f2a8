from __future__ import annotations

import random
import re

from corvane.llm import decontaminate as D
from tests.llm import odd


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, items):
    out = set()
    for d, t in docs:
        own = shingles(t)
        for i, b in items:
            s = shingles(b)
            if s and len(s & own) >= 0.8 * len(s) - 1e-9:
                out.add((d, i, len(s & own), len(s)))
    return out


def cases(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    line = lambda n: " ".join(word() for _ in range(n))
    items = [(i, line(rng.choice((6, 9, 15, 33, 60)))) for i in range(20)] + [(20, "two words"), (21, ""), (22, None), (23, "Two, WORDS!")]
    docs = []
    for d in range(120):
        text = line(rng.randint(0, 200))
        item = items[rng.randrange(20)][1].split()
        kind = rng.randrange(5)
        if kind == 0:
            text += " " + " ".join(item) + ". " + line(30)
        elif kind == 1:
            item[rng.randrange(len(item))] = "changed"
            text += " " + " ".join(item)
        elif kind == 2:
            text += " " + " ".join(item[: len(item) // 2])
        docs.append((d, text))
    return docs + [(200, None), (201, ""), (202, "two words"), (203, "here two words there more of it")], items


def test_equals_brute_force(spark, monkeypatch):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    for rows in (D.BROADCAST_ROWS, 0):  # broadcast, and shuffled
        monkeypatch.setattr(D, "BROADCAST_ROWS", rows)
        found = {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in D.contained_items(d, i).collect()}
        assert found == brute(docs, items)
    kept = {r.doc_id for r in D.decontaminate(d, i).collect()}
    assert kept == {x for x, _ in docs} - {x for x, *_ in brute(docs, items)}


def test_repeated_rows_and_null_ids(spark, monkeypatch):
    line = lambda *n: " ".join(f"w{i}" for i in n)
    docs = [(1, line(*range(30))), (1, line(*range(20, 60))), (1, line(*range(30))), (None, line(*range(100))), (None, None), (2, line(3))]
    items = [(7, line(*range(10, 50))), (8, line(*range(10, 50))), (8, line(*range(10, 50))), (9, line(*range(5, 25))), (None, line(*range(5, 25))), (10, line(*range(5, 25)) + " " + line(*range(5, 25)))]
    merged: dict = {}
    for d, t in docs:
        merged[d] = merged.get(d, set()) | shingles(t)
    own: dict = {}
    for i, t in items:
        if i is not None:
            own[i] = own.get(i, set()) | shingles(t)
    want = {(d, i, len(a & b), len(b)) for d, a in merged.items() for i, b in own.items() if b and len(a & b) >= 0.8 * len(b) - 1e-9}
    assert len({d for d, *_ in want}) == 2 and len({i for _, i, *_ in want}) == 4
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    for rows in (D.BROADCAST_ROWS, 0):
        monkeypatch.setattr(D, "BROADCAST_ROWS", rows)
        assert {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in D.contained_items(d, i).collect()} == want
        assert [r.doc_id for r in D.decontaminate(d, i).collect()] == [2]


def test_partitions_have_their_own_bounds(spark):
    _, items = cases()
    i = spark.createDataFrame(items, "item_id long, text string")
    shingles_, sketch, _ = D.item_sketches(i)
    sizes = {r["item"]: r["n"] for r in shingles_.collect()}
    parts: dict = {}
    for r in sketch.collect():
        parts.setdefault(r["part"], []).append(r)
        assert 2 ** (r["part"] - 1) <= sizes[r["item"]] < 2 ** r["part"]
        assert r["least"] <= -(-4 * sizes[r["item"]] // 5)
    assert len(parts) > 3 and len({rows[0]["least"] for rows in parts.values()}) == len(parts)
    # a document under a partition's bound is not sent to it
    short = spark.createDataFrame([(1, " ".join(items[4][1].split()[:6]))], "doc_id long, text string")
    own = {r["item"] for r in D.candidates(short, sketch).collect()}
    assert all(sizes[x] * 0.4 <= 2 for x in own)


def test_odd_documents(spark):
    items = spark.createDataFrame([(1, odd.texts()[8])], "item_id long, text string")
    found = D.contained_items(odd.frame(spark), items)
    assert {r.doc_id for r in found.collect()} >= {8, 9, 10}
    assert D.contained_items(odd.empty(spark), items).count() == 0
    assert D.contained_items(odd.frame(spark), items.limit(0)).count() == 0
    assert D.decontaminate(odd.frame(spark), items).columns == odd.frame(spark).columns
