from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from corvane.llm import simhash as S
from corvane.llm.common import components
from tests.llm import odd


def plain_fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), seed=42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(fps: dict[int, int]) -> dict[int, int]:
    top = {i: i for i in fps}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def test_the_code_is_perfect_and_near_indices_meet():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 400)
    for bits in [*combinations(range(23), 1), *combinations(range(23), 2)]:
        a, b = S.decoded(x)[0], S.decoded(x ^ sum(1 << i for i in bits))[0]
        assert (a[:, :, None] == b[:, None, :]).any((1, 2)).all()
        if len(bits) == 1:
            assert (a == b[:, :1]).any(1).all()


def test_linked_fingerprints_share_a_key():
    rng = np.random.default_rng(1)
    for errors in range(5):
        for _ in range(150):
            f = rng.integers(0, 1 << 63, dtype=np.uint64)
            g = f
            for i in rng.choice(64, errors, replace=False):
                g ^= np.uint64(1) << np.uint64(i)
            if f == g:
                continue
            k, r, s = S.keys_of(np.array([f, g]))
            a = {(x, y) for x, y, z in zip(k.tolist(), s.tolist(), r.tolist(), strict=True) if z == 0}
            b = {(x, y) for x, y, z in zip(k.tolist(), s.tolist(), r.tolist(), strict=True) if z == 1}
            assert any((x, 0) in b if not y else (x, 3 - y) in b for x, y in a)


@pytest.mark.parametrize("size", [3, 40])
def test_spanning_links_connect_the_same(size):
    rng = np.random.default_rng(size)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fps = np.array([base[i % 3] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 3, replace=False))) for i in range(size)])
    want = plain_components(dict(enumerate(map(int, fps))))
    top = {i: i for i in range(size)}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    links = S.spanning_links(fps)
    assert len(links) < size
    for a, b in links:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    assert {i: find(i) for i in range(size)} == want


def _star(spark, monkeypatch, n):
    rng = np.random.default_rng(3)
    centre = np.uint64(0x0123456789ABCDEF)
    fps = {int(centre)}
    while len(fps) < n:
        fps.add(int(centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))))
    fps |= {int(f) for f in rng.integers(0, 1 << 62, 30, dtype=np.uint64)}
    return sorted(fps)


def test_large_buckets_give_the_same_components(spark, monkeypatch):
    fps = _star(spark, monkeypatch, 200)
    batch_rows = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(batch_rows, "fp long").repartition(2)
    want = plain_components(dict(enumerate(fps)))
    # the streaming pass, with a bucket of eight
    monkeypatch.setattr(S, "BUCKET", 8)
    import pyarrow as pa

    k, r, s = S.keys_of(np.array(fps, np.uint64))
    order = np.argsort(k, kind="stable")
    signed = np.array(fps, np.uint64).view(np.int64)
    whole = pa.RecordBatch.from_arrays([pa.array(k[order]), pa.array(signed[r[order]]), pa.array(s[order])], ["key", "fp", "side"])
    parts = [whole.slice(i, 97) for i in range(0, whole.num_rows, 97)]
    found = pa.Table.from_batches(list(S._buckets(iter(parts)))).to_pylist()
    links = [(r["a"], r["b"]) for r in found if r["key"] is None]
    hot = [(r["key"], r["a"], r["hot"]) for r in found if r["key"] is not None]
    assert hot
    frame = spark.createDataFrame(hot, "key long, fp long, side byte")
    links += [(x.a, x.b) for x in S._block_pairs(frame).collect()]
    place = {int(v): i for i, v in enumerate(signed)}
    top = {i: i for i in range(len(fps))}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = find(place[int(a)]), find(place[int(b)])
        top[max(x, y)] = min(x, y)
    assert {i: find(i) for i in range(len(fps))} == want
    assert df.count() == len(fps)


def test_refined_keys_are_shared():
    """One error in two segments and up to two in the third: the longer keys of either side meet."""
    rng = np.random.default_rng(5)
    for x, y, z in ((0, 1, 2), (0, 2, 1), (1, 2, 0)):
        for third in (0, 1, 2):
            for _ in range(60):
                f = rng.integers(0, 1 << 63, dtype=np.uint64)
                bits = [S.SEGMENTS[x][0] + int(rng.integers(S.SEGMENTS[x][1])), S.SEGMENTS[y][0] + int(rng.integers(S.SEGMENTS[y][1]))]
                bits += [S.SEGMENTS[z][0] + int(b) for b in rng.choice(S.SEGMENTS[z][1], third, replace=False)]
                g = f ^ np.uint64(sum(1 << b for b in bits))
                k, r, s = S.keys_of(np.array([f, g]))
                mixed = k >> 36 >= S._MIXED
                long, fps, sides = S.refined(k[mixed], np.array([f, g])[r[mixed]], s[mixed])
                a = {(i, j) for i, j, p in zip(long.tolist(), sides.tolist(), fps, strict=True) if p == f}
                b = {(i, j) for i, j, p in zip(long.tolist(), sides.tolist(), fps, strict=True) if p == g}
                assert any((i, 3 - j) in b for i, j in a)


@pytest.mark.parametrize("few", [200_000, 0])
def test_hot_fingerprints_and_null_ids(spark, monkeypatch, few):
    monkeypatch.setattr(S, "HOT", 5)
    monkeypatch.setattr(S, "BROADCAST_ROWS", few)
    base = "one two three four five six seven eight nine ten"
    rows = [(i, None) for i in range(5, 30)] + [(None, base), (40, base), (41, base + " x"), (None, "alone here and there"), (3, "q w e r t y"), (3, "q w e r t y"), (3, "other text of the id"), (50, "other text of the id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = S.near_duplicates(df).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    group = plain_components(dict(enumerate(fps)))
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[group[k]] = min(i, least.get(group[k], i))
    want = sorted((i or -1, f"{fps[k]:016x}", least.get(group[k]) or -1) for k, (i, _) in enumerate(rows))
    assert sorted((r.doc_id or -1, r.fingerprint, r.component_id or -1) for r in found) == want
    # one row of each group stays, that of the smallest id
    kept = S.keep_first(df).collect()
    assert len(kept) == len(set(group.values()))
    order = {}
    for k, (i, t) in enumerate(rows):
        key = (i is None, i or 0, fps[k] - (1 << 64) if fps[k] >> 63 else fps[k], t or "")
        order[group[k]] = min(key, order.get(group[k], key))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept) == sorted((a, b, t) for a, b, _, t in order.values())


def test_exact_copies_of_one_id_leave_one(spark):
    df = spark.createDataFrame([(1, "t u v w"), (1, "t u v w"), (2, "t u v w")], "doc_id long, text string")
    assert [tuple(r) for r in S.keep_first(df).collect()] == [(1, "t u v w")]


def test_operator_equals_brute_force(spark):
    rows = odd.rows(150)
    found = {r.doc_id: r for r in S.near_duplicates(odd.frame(spark, 150)).collect()}
    fps = {i: plain_fingerprint(t) for i, t, *_ in rows}
    assert {i: f"{f:016x}" for i, f in fps.items()} == {i: r.fingerprint for i, r in found.items()}
    assert {i: r.component_id for i, r in found.items()} == plain_components(fps)
    kept = S.keep_first(odd.frame(spark, 150))
    assert {r.doc_id for r in kept.collect()} == set(plain_components(fps).values())
    assert kept.columns == odd.frame(spark).columns


def test_empty_and_repeated(spark):
    assert S.near_duplicates(odd.empty(spark)).count() == 0
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in S.near_duplicates(df).collect()) == [(1, 1), (1, 1), (2, 2)]


def test_components_of_paths_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    got = {r.node: r.component for r in found.collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
