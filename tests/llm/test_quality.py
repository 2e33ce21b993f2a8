from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from corvane.llm import quality as Q
from tests.llm import odd


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_counts_equal_brute_force():
    rng = random.Random(1)
    cases = ["a b c a b c", "a a a a", "x\nx\n\nx", "a b c d a b c x b c d", "#|<>"] + [
        " ".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(200)
    ] + [t or "" for t in odd.texts()]
    for text in cases:
        assert Q.statistics(text)[:5] == brute(text), text


def docs(n=300):
    rng = random.Random(4)
    out, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 120))]
        junk = i % 6 == 0
        out.append((i, " ".join(w + rng.choice(["###", "$$$", "***"]) if junk else w for w in words)))
        labels.append((i, int(not junk)))
    return out, labels


def test_junk_is_rejected_and_good_kept(spark):
    rows, labels = docs()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marked = spark.createDataFrame(labels[::2], "doc_id long, quality int")
    found = {r.doc_id: r for r in Q.quality_verdicts(df, marked).collect()}
    assert np.mean([found[i].kept for i, q in labels if q]) > 0.97
    assert np.mean([not found[i].kept for i, q in labels if not q]) > 0.97
    assert all(0 < r.score <= 1 for r in found.values())


def test_odd_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    found = {r.doc_id: r for r in Q.quality_verdicts(odd.frame(spark), none).collect()}
    for i, text in enumerate(odd.texts()):
        r = found[i]
        n = brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.base_failed and r.kept)
    assert Q.quality_verdicts(odd.empty(spark), none).count() == 0


def test_isolated_rows_score_high():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(size=(500, 2)), [[9.0, 9.0]]])
    scores = Q.IsolationForest(rows).scores(rows)
    assert scores.argmax() == 500
    assert scores[500] > 0.7 > scores[:500].mean()


def test_thresholds_from_all_labelled_rows(spark):
    """Scores of all rows are counted, none of them sampled; counts give the threshold that the scores themselves give."""
    import numpy as np

    from corvane.llm import quality as Q

    rng = np.random.default_rng(1)
    scores, good = np.round(rng.uniform(0.3, 0.7, 3000), 2), rng.random(3000) < 0.8
    values = np.unique(scores)
    counts = [np.array([((scores == v) & kind).sum() for v in values]) for kind in (good, ~good)]
    assert Q.counted_threshold(values, *counts) == Q.threshold(scores[good], scores[~good])
    assert Q.counted_quantile(values, counts[0], 0.995) == np.quantile(scores[good], 0.995)

    n = 25_000  # more than the 20,000 that were taken before
    names = [*Q.COUNTS, *Q.MORE]
    rows = spark.range(n).selectExpr(*[f"id % {7 + i} + {50 + i} AS {c}" for i, c in enumerate(names)], "id % 10 > 0 AS good")
    held = rows.select(*names).limit(300).toPandas()
    forest = Q.IsolationForest(Q.features({c: held[c].to_numpy() for c in names}), 4)
    found, n_good, n_bad = Q.scores_counted(rows, {0: (list(range(8)), forest)})[0]
    assert (n_good.sum(), n_bad.sum()) == (22_500, 2500) and (np.diff(found) > 0).all()
