from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import substring_dedup as S
from tests.llm import odd


def brute(docs):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: (d[0], d[1] or "")):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        runs = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def cases(n=150, seed=4):
    rng = random.Random(seed)
    ws = ["alpha", "beta", "gamma", "delta", "é", "zeta", "eta", "theta"]
    line = lambda k: " ".join(rng.choice(ws) for _ in range(k))
    shared = [line(40) for _ in range(3)]
    kinds = [
        lambda: line(rng.randint(0, 80)),
        lambda: line(rng.randint(0, 30)) + shared[0] + line(rng.randint(0, 30)),
        lambda: shared[1][: rng.randint(90, 180)] + line(10),
        lambda: shared[2],
        lambda: "ab" * rng.randint(0, 200),
        lambda: "x" * rng.randint(0, 300),
        lambda: "",
    ]
    return [(i, rng.choice(kinds)()) for i in range(n)]


def results(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.deduplicate(df).collect()}


@pytest.mark.parametrize("block", [1 << 21, 300])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    docs = cases()
    assert results(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)) == brute(docs)


def test_odd_documents(spark):
    docs = [(i, t) for i, t, *_ in odd.rows()]
    assert results(odd.frame(spark)) == brute(docs)
    assert S.deduplicate(odd.empty(spark)).count() == 0


def test_repeated_ids_equal_brute_force(spark):
    a, b = "one passage of text " * 8, "".join(chr(97 + i * i % 26) + str(i) for i in range(90))
    docs = [(5, a), (5, a), (3, b), (3, b + a), (3, None), (7, "short"), (7, "short"), (1, b[:120])]
    docs += [(i % 9 + 10, t) for i, t in cases(60, 8)]
    # each row by a key of its own: brute() tells rows apart by the key, in the order of (id, text)
    ordered = sorted(docs, key=lambda d: (d[0], d[1] or ""))
    want = brute(list(enumerate(t for _, t in ordered)))
    rows = S.deduplicate(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, rows)) == sorted((ordered[k][0], *v) for k, v in want.items())


@pytest.mark.parametrize("depth", [3, 20])
def test_two_stage_order_equals_sorting(depth):
    rng = random.Random(3)
    for _ in range(150):
        x = np.array([rng.randint(1, rng.choice([2, 3, 6])) for _ in range(rng.randint(1, 60))] + [0])
        order = S.two_stage_order(x, depth)
        assert sorted(order.tolist()) == list(range(len(x)))
        keys = [tuple(x[i : i + depth]) for i in order]
        assert keys == sorted(keys)


def test_repeated_windows_equal_brute_force():
    rng = random.Random(5)
    base = bytes(rng.choice(b"abcd") for _ in range(168))
    spans = [(d, 10 * d, base[a : a + rng.randint(100, 168 - a)] + bytes(rng.choice(b"xy") for _ in range(3))) for d in range(60) for a in (rng.randint(0, 60),)]
    seen: set = set()
    want = set()
    for d, s, b in sorted(spans):
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                want.add((d, s + i))
            seen.add(b[i : i + 100])
    docs, starts = S.repeated_windows(spans)
    assert set(zip(docs.tolist(), starts.tolist(), strict=True)) == want


def test_what_may_repeat_has_all_that_does():
    rng = random.Random(11)
    part = bytes(rng.choice(b"abc") for _ in range(140))
    texts = [bytes(rng.choice(b"xyz") for _ in range(80)) + part[rng.randint(0, 70) :][: rng.randint(40, 140)] + bytes(rng.choice(b"xyz") for _ in range(80)) for _ in range(60)]
    spans, anchors = [], []
    for d, t in enumerate(texts):
        data = np.frombuffer(t, np.uint8)
        _, low, end, a, _ = S.records(data, np.array([0]), np.array([len(t)]))
        for i in range(len(low)):
            spans.append((d, int(low[i]), t[low[i] : end[i]]))
            anchors.append(int(a.view(np.int64)[i]))
    spans.append((99, 0, spans[0][2]))  # an anchor that is no gram: stays whole
    anchors.append(5)
    tried = S.may_repeat(anchors, spans)
    assert (99, 0, spans[0][2]) in tried and sum(len(b) for _, _, b in tried) < sum(len(b) for _, _, b in spans)
    windows = lambda some: sorted((d, s + i, b[i : i + 100]) for d, s, b in some for i in range(len(b) - 99))
    every, kept = windows(spans[:-1]), windows([t for t in tried if t[0] != 99])
    times: dict = {}
    for _, _, w in every:
        times[w] = times.get(w, 0) + 1
    assert {x for x in every if times[x[2]] > 1} <= set(kept) <= set(every)
    assert len(kept) == len(set(kept))


def test_halves_share_keys_of_equal_windows():
    """Each window is in one half; equal windows of two documents have the same keys down to whole windows."""
    rng = random.Random(7)
    part = bytes(rng.choice(b"abc") for _ in range(150))
    texts = [bytes(rng.choice(b"xyz") for _ in range(rng.randint(0, 90))) + part + bytes(rng.choice(b"xyz") for _ in range(90)) for _ in range(2)]
    keys = []
    for data in texts:
        own: dict[bytes, set] = {}
        at = data.index(part) + 55
        waiting = [(0, max(0, at - 68), min(len(data), at + 100), at, 32, ())]
        while waiting:
            a, low, end, core, size, path = waiting.pop()
            starts = list(range(low, end - 99))
            if size == 100:
                assert starts == [core]
                own.setdefault(data[core : core + 100], set()).add(path)
                continue
            parts = list(S.halves(a, low, end, data, core, size))
            split = []
            for key, _, packed in parts:
                s = packed >> 24
                e, c, n = s + (packed >> 16 & 255), s + (packed >> 8 & 255), packed & 255
                assert size < n <= 100
                assert all(w <= c and c + n <= w + 100 for w in range(s, e - 99))
                split += range(s, e - 99)
                waiting.append((key, s, e, c, n, (*path, key)))
            assert sorted(split) == starts
        keys.append(own)
    shared = keys[0].keys() & keys[1].keys()
    assert len(shared) >= 51
    assert all(keys[0][w] == keys[1][w] for w in shared)


@pytest.mark.parametrize("spans", [1, 3])
def test_hot_anchors_equal_brute_force(spark, monkeypatch, spans):
    monkeypatch.setattr(S, "SPANS", spans)
    rng = random.Random(9)
    ws = ["alpha", "beta", "gamma", "delta", "zeta", "eta", "theta", "iota", "kappa"]
    line = lambda k: " ".join(rng.choice(ws) for _ in range(k))
    common = [line(9), line(16), line(40)]
    docs = [(i, line(rng.randint(0, 25)) + common[i % 3][rng.randint(0, 9) :] + line(rng.randint(0, 25))) for i in range(150)]
    docs += [(200, "ab" * 150), (201, "x" * 260), (202, "x" * 300)]
    assert results(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)) == brute(docs)


def test_null_ids_come_first(spark):
    text = "".join(chr(97 + i * i % 26) + str(i) for i in range(90))
    rows = S.deduplicate(spark.createDataFrame([(4, text), (None, text), (None, text + "x"), (None, None)], "doc_id long, text string")).collect()
    found = sorted(((r.doc_id is not None, r.n_bytes, r.n_removed) for r in rows))
    n = len(text)
    assert found == [(False, 0, 0), (False, n, 0), (False, n + 1, n), (True, n, n)]


def test_classes_over_batch_edges():
    rows = [(1, 1, 5, 50), (1, 1, 6, 60), (1, 2, 7, 70), (2, 1, 8, 80), (3, 1, 9, 90), (3, 1, 9, 91), (4, S.COVERED, 1, 2), (5, 1, 3, 3), (5, 2, 4, 4), (5, 2, 4, 5)]
    want = None
    for size in (1, 2, 3, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + size]], pa.int64()) for k in range(4)], ["a", "x", "doc_id", "span"]) for i in range(0, len(rows), size)]
        got = sorted((r["kind"], r["doc_id"], r["span"]) for b in S._classes(iter(batches)) for r in b.to_pylist())
        want = want or got
        assert got == want
    assert want == [(0, 1, 2), (0, 4, 5), (0, 6, 60), (0, 9, 91), (1, 3, 3), (1, 4, 4), (1, 5, 50), (1, 7, 70)]
