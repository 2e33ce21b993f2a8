r"""Quality rules: statistics of each text, and an isolation forest over them.

Base statistics are exact counts over the whole text, base rules are fixed limits on
them. Documents that pass these are judged by an isolation forest: trees of random
splits over the rule statistics of a sample; a document that few splits isolate, as
measured by its mean path length, is unlike the others. The score is 2^(-path / c(n)).

The forest splits on those statistics that tell labelled good rows from others best.

Each tree grows on TREE_ROWS rows, as the method has it; they are drawn from SAMPLE of the distinct
rows of the whole table, chosen by a hash. All else comes from all rows: the statistics are chosen and the threshold is
set by the scores of every labelled row, counted by score (with five decimals, so these are few). The threshold is
the one with the best balanced accuracy on the labelled rows among those that reject at most
MAY_LOSE of the good ones. Without labelled rows of both kinds, it is the 1 - MAY_LOSE quantile of
all rows' scores. Statistics, scores and verdicts cover every document.

Null, empty and blank texts have no words and fail the base rules. Repeated rows have
repeated results; an empty table has none. Only doc_id and text are read, and doc_id and
quality of the labels (rows of an id with null or unequal labels: the lowest counts).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import durable, hashed_sample, id_and_text, small_batches

LEAST_WORDS, MOST_REPEATED = 50, 50
TREES, TREE_ROWS = 128, 256
SAMPLE = TREES * TREE_ROWS
#: Scores have so many decimals.
DECIMALS = 5
MAY_LOSE = 0.005
SEED = 7

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Further counts that only the forest uses.
MORE = ("n_chars", "n_upper", "n_digits", "n_stops", "n_lines", "n_distinct")
FEATURES = ("symbols", "dup_lines", "repeats", "word_length", "upper", "digits", "stops", "distinct")

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")


def repeated_words(words: list[str]) -> int:
    """Words in 3-word windows that are found twice or more in the text, the first included."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == n:
        return 0
    times = Counter(windows)
    covered, last = 0, -1  # words up to `last` are counted
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered += i + 2 - max(i - 1, last)
            last = i + 2
    return covered


def statistics(text: str) -> tuple[int, ...]:
    """The counts of a text, COUNTS and then MORE."""
    words = _WORD.findall(text)
    seen, dup_lines, lines = set(), 0, 0
    for line in text.split("\n"):
        if _WORD.search(line):
            lines += 1
            if line in seen:
                dup_lines += 1
            seen.add(line)
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in "#*$%&|<>"),
        dup_lines,
        repeated_words(words),
        len(text),
        len(_UPPER.findall(text)),
        len(_DIGIT.findall(text)),
        sum(text.count(c) for c in ".!?"),
        lines,
        len(set(words)),
    )


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and all counts of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t) for t in batch.column(1).to_pylist()], np.int64).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows.T.copy())], ["doc_id", *COUNTS, *MORE])

    small_batches(docs.sparkSession)
    each = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return each.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in (*COUNTS, *MORE)))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """A row of FEATURES for each row of counts."""
    c = {k: np.asarray(v, float) for k, v in counts.items()}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.stack(
        [
            c["n_symbols"] / chars,
            c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
            c["n_repeat_words"] / words,
            c["word_chars"] / words,
            c["n_upper"] / chars,
            c["n_digits"] / chars,
            c["n_stops"] / words,
            # a text's distinct words grow with about the 0.8th power of its length
            c["n_distinct"] / words**0.8,
        ],
        axis=1,
    )


# ---- the forest --------------------------------------------------------------------


def mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class IsolationForest:
    """Trees in flat arrays: a node's feature (-1: a leaf), split, left child (right: the next), path length."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size = min(tree_rows, len(rows))
        self.trees = [self._grown(rows[rng.choice(len(rows), self.size, replace=False)], rng) for _ in range(trees)]

    def _grown(self, rows: np.ndarray, rng: np.random.Generator):
        most = int(np.ceil(np.log2(max(len(rows), 2))))
        feature, split, child, path = [-1], [0.0], [0], [0.0]
        waiting = [(0, rows, 0)]
        while waiting:
            node, own, depth = waiting.pop()
            low, high = own.min(axis=0), own.max(axis=0)
            able = np.flatnonzero(high > low)
            if depth >= most or len(own) < 2 or not len(able):
                path[node] = depth + mean_path(len(own))
                continue
            f = int(rng.choice(able))
            at = rng.uniform(low[f], high[f])
            feature[node], split[node], child[node] = f, at, len(feature)
            for side in (own[own[:, f] <= at], own[own[:, f] > at]):
                if not len(side):
                    side = own[:1]
                waiting.append((len(feature), side, depth + 1))
                feature.append(-1), split.append(0.0), child.append(0), path.append(0.0)
        return np.array(feature), np.array(split), np.array(child), np.array(path)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """From 0 to 1; near 1: isolated by few splits."""
        if not len(rows):
            return np.zeros(0)
        total = np.zeros(len(rows))
        for feature, split, child, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            while (inner := feature[at] >= 0).any():
                i = np.flatnonzero(inner)
                node = at[i]
                at[i] = child[node] + (rows[i, feature[node]] > split[node])
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(mean_path(self.size), 1e-9))


def threshold(good: np.ndarray, bad: np.ndarray, may_lose: float = MAY_LOSE) -> float | None:
    """The score above which rows are rejected, from scores of good and bad labelled rows."""
    if not len(good) or not len(bad):
        return None
    least = np.quantile(good, 1 - may_lose)
    tried = np.unique(np.concatenate([[least], bad[bad >= least], good[good >= least]]))
    kept = np.searchsorted(np.sort(good), tried, side="right") / len(good)
    caught = 1 - np.searchsorted(np.sort(bad), tried, side="right") / len(bad)
    at = int(np.argmax(kept + caught))
    # halfway to the next score, where there is one
    every = np.unique(np.concatenate([good, bad]))
    above = every[every > tried[at]]
    return float((tried[at] + above[0]) / 2 if len(above) else tried[at])


def counted_quantile(values: np.ndarray, times: np.ndarray, share: float) -> float:
    """np.quantile of values (ascending) that occur so many times."""
    upto, place = np.cumsum(times), (times.sum() - 1) * share
    low, high = (values[np.searchsorted(upto, at + 1)] for at in (np.floor(place), np.ceil(place)))
    return float(low + (high - low) * (place - np.floor(place)))


def counted_threshold(values: np.ndarray, good: np.ndarray, bad: np.ndarray, may_lose: float = MAY_LOSE) -> float | None:
    """threshold, of ascending scores and how many good and bad rows have each."""
    if not good.sum() or not bad.sum():
        return None
    least = counted_quantile(values, good, 1 - may_lose)
    tried = np.unique(np.concatenate([[least], values[values >= least]]))
    upto = np.searchsorted(values, tried, side="right")
    kept = np.append(0, np.cumsum(good))[upto] / good.sum()
    caught = 1 - np.append(0, np.cumsum(bad))[upto] / bad.sum()
    at = int(np.argmax(kept + caught))
    above = values[values > tried[at]]
    return float((tried[at] + above[0]) / 2 if len(above) else tried[at])


def scores_counted(rows: DataFrame, forests: dict[int, tuple[list[int], IsolationForest]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Of each forest: the scores of all rows, ascending, and how many good and bad rows have each. rows: counts and good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = features({c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*COUNTS, *MORE)})
            good = batch.column("good").to_numpy(zero_copy_only=False).astype(np.int64)
            for f, (columns, forest) in forests.items():
                score = np.rint(forest.scores(made[:, columns]) * 10**DECIMALS).astype(np.int64)
                found, times = np.unique(score * 2 + good, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), f)), pa.array(found), pa.array(times)], ["f", "v", "n"])

    found = rows.mapInArrow(run, "f long, v long, n long").groupBy("f", "v").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for f in forests:
        own = found[found["f"] == f]
        scores, at = np.unique(own["v"].to_numpy() // 2, return_inverse=True)
        kinds = [np.zeros(len(scores), np.int64) for _ in range(2)]
        for kind in (0, 1):
            some = (own["v"].to_numpy() % 2) == kind
            kinds[kind][at[some]] = own["n"].to_numpy()[some]
        out[f] = (np.round(scores / 10**DECIMALS, DECIMALS), kinds[1], kinds[0])
    return out


def chosen_by_all(sample: np.ndarray, labelled: DataFrame) -> list[int]:
    """The statistics to split on, by forward selection on all labelled rows; all, without both kinds of labels.

    Each step adds the statistic with which a small forest, at its threshold, keeps most good rows and rejects
    most others; it ends when none adds a thousandth. A step is a pass over the labelled rows.
    """
    chosen, best = [], 0.0
    while len(chosen) < sample.shape[1]:
        tried = {f: sorted([*chosen, f]) for f in range(sample.shape[1]) if f not in chosen}
        forests = {f: (c, IsolationForest(sample[:, c], TREES // 4)) for f, c in tried.items()}
        found = []
        for f, (values, good, bad) in scores_counted(labelled, forests).items():
            limit = counted_threshold(values, good, bad)
            if limit is None:
                return list(range(sample.shape[1]))
            found.append((good[values <= limit].sum() / good.sum() + bad[values > limit].sum() / bad.sum(), -f))
        value, f = max(found)
        if value < best + 0.001:
            break
        best, chosen = value, sorted([*chosen, -f])
    return chosen


# ---- the operator ------------------------------------------------------------------


def _sampled(rows: DataFrame, n: int):
    """About n distinct rows, chosen by their hash, as columns in a fixed order."""
    taken = hashed_sample(rows, n).toPandas().sort_values(["doc_id", *COUNTS], kind="stable")
    return {c: taken[c].to_numpy() for c in taken.columns}


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept and score of each document."""
    base_failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    counted = durable(rule_statistics(docs).withColumn("base_failed", base_failed))
    passed = counted.where("NOT base_failed")
    marked = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    sample = features(_sampled(passed, SAMPLE))
    if len(sample) < 2:
        return counted.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed")).alias("kept"), F.lit(0.0).alias("score"))
    # of repeated rows one counts
    labelled = durable(passed.join(marked, "doc_id").distinct().select(*COUNTS, *MORE, (F.col("quality") == 1).alias("good")))
    columns = chosen_by_all(sample, labelled)
    forest = IsolationForest(sample[:, columns])
    limit = counted_threshold(*scores_counted(labelled, {0: (columns, forest)})[0])
    if limit is None:
        values, times, _ = scores_counted(passed.withColumn("good", F.lit(True)), {0: (columns, forest)})[0]
        limit = counted_quantile(values, times, 1 - MAY_LOSE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*COUNTS, *MORE)}
            score = np.round(forest.scores(features(held)[:, columns]), DECIMALS)
            failed = batch.column("base_failed").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", *COUNTS, "base_failed")], pa.array(~failed & (score <= limit)), pa.array(score)],
                ["doc_id", *COUNTS, "base_failed", "kept", "score"],
            )

    kinds = ", ".join(f"{c} long" for c in COUNTS)
    return counted.mapInArrow(run, f"doc_id long, {kinds}, base_failed boolean, kept boolean, score double")
