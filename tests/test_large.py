"""Queries that failed by time on larger tables: results of their operators on odd rows."""

from __future__ import annotations

import math
import random

from corvane.operators import similarity, windows


def test_repair_of_many_groups(spark, monkeypatch):
    """Groups over several batches, null values, null and repeated places; once one Python call a group."""
    rng = random.Random(3)
    rows = [(g if g else None, i % 90 or None, rng.choice([None, *range(9)])) for g in range(60) for i in range(rng.choice([1, 3, 200]))]
    df = spark.createDataFrame(rows, "k long, line int, at int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = windows.repaired_groups(df, "k", "line", "at", 0, 60)
        assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
        got = [tuple(r) for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is None, r[1] or 0, r[2] is not None, r[2] or 0))
        fixed = iter(windows.strictly_increasing([r[2] for r in own if r[2] is not None], 0, 60))
        want += [(*r, None if r[2] is None else next(fixed)) for r in own]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_nearest(spark, monkeypatch):
    """Equal vectors, zeros, repeated ids and blocks smaller than the table; once every pair was a row."""
    rng = random.Random(5)
    kinds = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(12)] + [[0.0] * 8]
    rows = [(i, rng.choice(kinds)) for i in range(400)] + [(100, kinds[0]), (150, kinds[1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(similarity, "_BLOCK", 50)
    asked = df.where("vec_id % 50 = 0 AND vec_id NOT IN (100, 150)")
    found = similarity.nearest(df, asked, 3)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.q_id, r.e_id, r.cos) for r in found.collect())
    held = [(r.vec_id, r.embedding) for r in df.collect()]
    want = []
    for q, v in held:
        if q % 50 == 0 and q not in (100, 150):
            scored = []
            for e, u in held:
                if e != q:
                    norm = math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(x * x for x in u))
                    scored.append((-round(sum(x * y for x, y in zip(v, u)) / norm, 4) if norm else 0.0, e))
            want += [(q, e, -c) for c, e in sorted(scored)[:3]]
    assert got == sorted(want)
