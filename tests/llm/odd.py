"""Documents with all that may go wrong: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, span long, w string, found string"


def texts(n: int = 120, seed: int = 5) -> list[str | None]:
    rng = random.Random(seed)
    ws = "alpha beta gamma delta epsilon zeta eta theta iota kappa é ñandú Straße".split()
    line = lambda k: " ".join(rng.choice(ws) for _ in range(k))
    passage = line(40)
    out: list[str | None] = [None, "", " \n\t", "word", "x" * 300, line(4), "Word Word Word Word Word Word"]
    out += [line(30000)]  # very long
    base = line(60)
    out += [base, base, base + ".", base.replace("beta", "zeta", 1), base.upper()]
    while len(out) < n:
        kind = rng.randrange(4)
        out.append([line(rng.randint(1, 80)), line(20) + "\n" + passage + "\n" + line(20), passage, line(rng.randint(5, 300))][kind])
    return out


def rows(n: int = 120, seed: int = 5) -> list[tuple]:
    own = texts(n, seed)
    out = [(i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or ""), "k", 1, "w", None) for i, t in enumerate(own)]
    return out


def frame(spark, n: int = 120, seed: int = 5):
    return spark.createDataFrame(rows(n, seed), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
