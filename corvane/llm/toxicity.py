r"""Toxicity: a classifier chain of linear models over words.

Categories are those that the caller names; they are predicted in the order of their
positive labels, the rarest first, so that a general category sees the probabilities of
its kinds. The model of each category is a logistic regression over the words of a text and their beginnings (present or not), three rates
of its characters and the probabilities of all earlier categories. To train it on
probabilities like those it will see, earlier ones are predicted out of fold: the sample
is dealt into FOLDS by a hash of the id, and a fold's probabilities come from a model
fitted on the others. The models that predict are then fitted on the whole sample.

A label may be null: a row takes part in training and thresholds of those categories that
it has labels for. Rows of an id in the labels count as one, its largest label of each.

Bounds: the sample has about SAMPLE labelled documents at most (ids chosen by a hash, and
of their distinct rows as many again, so that an id with many rows can't fill it); the
vocabulary has at most VOCABULARY words, those that tell the categories apart best by
their log-likelihood ratio in the sample. Every document is scored on its whole text. The threshold of a category is the out-of-fold probability with the best
balanced accuracy among those that at most MAY_ACCUSE of the sample's rows without the
category exceed.

Null, empty and blank texts have no words; they are scored by the intercepts like any
other, and never flagged. Repeated rows, and rows of one id or none, have a result each.
Without a labelled row of either kind a category has the probability of the kind there is,
0 without any label. Only doc_id and text of the documents are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import durable, hashed_sample, rows_of, small_batches

SAMPLE, VOCABULARY = 8000, 16_384
#: Least log-likelihood ratio of a word of the vocabulary: by chance, one word of ten thousand has as much.
LEAST_RATIO = 15.0
FOLDS, STEPS, RATE, DECAY = 5, 120, 0.1, 3e-4
MAY_ACCUSE = 0.001
#: Lengths of the word beginnings that are features beside the words.
PREFIXES = (4, 5)

_WORD = re.compile(r"[^\W\d_]+")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")


def distinct_words(text: str | None) -> set[str]:
    """The words of a text, and the first letters of the longer ones, as their forms share these."""
    words = set(_WORD.findall((text or "").lower()))
    return words.union(*({"^" + w[:n] for w in words if len(w) >= n} for n in PREFIXES))


def rates(text: str | None) -> tuple[float, ...]:
    """Shares of symbols, capitals and digits, in each ten characters."""
    text = text or ""
    n = max(len(text), 1) / 10
    return (sum(text.count(c) for c in "#*$%&|<>") / n, len(_UPPER.findall(text)) / n, len(_DIGIT.findall(text)) / n)


class Rows:
    """Sparse rows: the vocabulary's words in each text, and dense columns beside them."""

    def __init__(self, words: list[list[int]], dense: np.ndarray):
        self.n, self.dense = len(words), dense
        self.row = np.repeat(np.arange(self.n), [len(w) for w in words])
        self.word = np.array([w for ws in words for w in ws], np.int64)

    def take(self, which: np.ndarray) -> Rows:
        place = np.full(self.n, -1)
        place[which] = np.arange(len(which))
        out = Rows.__new__(Rows)
        held = place[self.row] >= 0
        out.n, out.dense, out.row, out.word = len(which), self.dense[which], place[self.row[held]], self.word[held]
        return out

    def beside(self, column: np.ndarray) -> Rows:
        out = Rows.__new__(Rows)
        out.n, out.row, out.word = self.n, self.row, self.word
        out.dense = np.column_stack([self.dense, column])
        return out


class Linear:
    """A logistic regression on Rows, its classes weighted alike."""

    def __init__(self, rows: Rows, gold: np.ndarray, words: int):
        self.words, self.dense, self.bias = np.zeros(words), np.zeros(rows.dense.shape[1]), 0.0
        n_yes = int(gold.sum())
        self.constant = None
        if n_yes in (0, len(gold)):
            self.constant = float(n_yes > 0)
            return
        weight = np.where(gold == 1, 0.5 / n_yes, 0.5 / (len(gold) - n_yes))
        state = [np.zeros(words + len(self.dense) + 1) for _ in range(2)]
        for step in range(1, STEPS + 1):
            slack = weight * (gold - self.predict(rows))
            g = np.concatenate(
                [
                    np.bincount(rows.word, slack[rows.row], words) - DECAY * self.words,
                    rows.dense.T @ slack - DECAY * self.dense,
                    [slack.sum()],
                ]
            )
            state[0] += 0.1 * (g - state[0])
            state[1] += 0.01 * (g * g - state[1])
            move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
            self.words += move[:words]
            self.dense += move[words:-1]
            self.bias += move[-1]

    def predict(self, rows: Rows) -> np.ndarray:
        if self.constant is not None:
            return np.full(rows.n, self.constant)
        z = np.bincount(rows.row, self.words[rows.word], rows.n) + rows.dense @ self.dense + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def threshold(p: np.ndarray, gold: np.ndarray) -> float:
    yes, no = np.sort(p[gold == 1]), np.sort(p[gold == 0])
    if not len(yes) or not len(no):
        return 1.0
    least = float(np.quantile(no, 1 - MAY_ACCUSE))
    tried = np.unique(np.concatenate([[least], yes[yes > least], no[no > least]]))
    caught = 1 - np.searchsorted(yes, tried, side="right") / len(yes)
    spared = np.searchsorted(no, tried, side="right") / len(no)
    at = int(np.argmax(caught + spared))
    every = np.unique(np.concatenate([yes, no]))
    above = every[every > tried[at]]
    return float((tried[at] + above[0]) / 2 if len(above) else tried[at])


class Chain:
    """Models of the categories in order; each sees the probabilities of those before it.

    gold: a column of 0, 1 or -1 (no label) for each category.
    """

    def __init__(self, rows: Rows, gold: dict[str, np.ndarray], folds: np.ndarray, words: int):
        self.names, self.models, self.limits = list(gold), [], []
        for name in self.names:
            labelled = np.flatnonzero(gold[name] >= 0)
            self.models.append(Linear(rows.take(labelled), gold[name][labelled], words))
            outside = np.zeros(rows.n)
            for k in range(FOLDS):
                other, own = labelled[folds[labelled] != k], np.flatnonzero(folds == k)
                if len(own) and len(other):
                    outside[own] = Linear(rows.take(other), gold[name][other], words).predict(rows.take(own))
            self.limits.append(threshold(outside[labelled], gold[name][labelled]))
            rows = rows.beside(outside)

    def predict(self, rows: Rows) -> np.ndarray:
        """A column of probabilities for each category."""
        found = []
        for model in self.models:
            found.append(model.predict(rows))
            rows = rows.beside(found[-1])
        return np.column_stack(found)


def vocabulary(texts: DataFrame, categories: list[str]) -> list[str]:
    """Words of the sample that tell a category apart, of its labelled rows: (words, categories) to at most VOCABULARY words."""
    of_words = texts.select(F.explode("words").alias("word"), *categories).groupBy("word")
    sums = [x for c in categories for x in (F.sum(c).alias(f"y_{c}"), F.count(c).alias(f"n_{c}"))]
    totals, counted = texts.agg(*sums).first(), of_words.agg(*sums)
    # log-likelihood ratio of each word against each category: 2 * sum of seen * ln(seen / expected)
    worth = [F.lit(0.0), F.lit(0.0)]
    for c in categories:
        yes, n = float(totals[f"y_{c}"] or 0), float(totals[f"n_{c}"])
        if not n:
            continue
        has, seen = F.coalesce(F.col(f"y_{c}"), F.lit(0)), F.col(f"n_{c}")
        cells = [(has, yes * seen / n), (seen - has, (n - yes) * seen / n)]
        cells += [(F.lit(yes) - has, yes * (n - seen) / n), (F.lit(n - yes) - seen + has, (n - yes) * (n - seen) / n)]
        worth.append(2 * sum(F.when((o > 0) & (e > 0), o * F.log(o / e)).otherwise(0.0) for o, e in cells))
    best = counted.withColumn("worth", F.greatest(*worth)).where(F.col("worth") >= LEAST_RATIO)
    return [r["word"] for r in best.orderBy(F.desc("worth"), "word").limit(VOCABULARY).collect()]


def fit(docs: DataFrame, labels: DataFrame, categories: list[str]) -> tuple[Chain | None, dict[str, int]]:
    """The chain and its vocabulary; labels: doc_id and a column of 0, 1 or null for each category."""
    held = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in categories])
    held = held.where(F.col("doc_id").isNotNull()).dropna("all", subset=categories)
    held = held.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories])
    # about SAMPLE rows at most, of an id and a few numbers each: a bounded broadcast
    chosen = F.broadcast(hashed_sample(held, SAMPLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, 512):
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        *[part.column(c) for c in categories],
                        pa.array([sorted(distinct_words(t)) for t in texts], pa.list_(pa.string())),
                        pa.array([list(rates(t)) for t in texts], pa.list_(pa.float64())),
                    ],
                    ["doc_id", "key", *categories, "words", "rates"],
                )

    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = hashed_sample(own.where(F.col("text").isNotNull()).join(chosen, "doc_id").select("doc_id", "text", *categories), SAMPLE)
    kinds = ", ".join(f"{c} int" for c in categories)
    own = own.select("doc_id", "text", F.xxhash64("text").alias("key"), *categories)
    sample = durable(own.mapInArrow(run, f"doc_id long, key long, {kinds}, words array<string>, rates array<double>"))
    words = vocabulary(sample, categories)
    index = {w: i for i, w in enumerate(words)}
    if not words:
        return None, index
    # only the vocabulary's words of a text come to the driver; they are looked up inside the row
    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(index[w] for w in ws if w in index) for ws in batch.column("words").to_pylist()]
            at = batch.schema.get_field_index("words")
            yield batch.set_column(at, "words", pa.array(own, pa.list_(pa.int32())))

    fold = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(FOLDS)).alias("fold")
    known = sample.select("doc_id", "key", *categories, "words", "rates", fold)
    rows = known.mapInArrow(looked_up, f"doc_id long, key long, {kinds}, words array<int>, rates array<double>, fold long").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["key"]))
    made = Rows([r["words"] for r in rows], np.array([r["rates"] for r in rows]))
    gold = {c: np.array([-1 if r[c] is None else r[c] for r in rows]) for c in categories}
    order = sorted(categories, key=lambda c: (int((gold[c] == 1).sum()), categories.index(c)))
    return Chain(made, {c: gold[c] for c in order}, np.array([r["fold"] for r in rows]), len(words)), index


def score(docs: DataFrame, chain: Chain | None, index: dict[str, int], categories: list[str]) -> DataFrame:
    """doc_id, a probability p_<category> and a flag is_<category> for each category."""
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if chain is None:
        none = [x for c in categories for x in (F.lit(0.0).alias(f"p_{c}"), F.lit(False).alias(f"is_{c}"))]
        return each.select("doc_id", *none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, 512):
                texts = part.column(1).to_pylist()
                own = [distinct_words(t) for t in texts]
                made = Rows([sorted(index[w] for w in ws & index.keys()) for ws in own], np.array([rates(t) for t in texts]))
                p = chain.predict(made)
                some = np.array([bool(ws) for ws in own])
                columns = [part.column(0)]
                for k in map(chain.names.index, categories):
                    columns += [pa.array(p[:, k].copy()), pa.array((p[:, k] > chain.limits[k]) & some)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[x for c in categories for x in (f"p_{c}", f"is_{c}")]])

    small_batches(docs.sparkSession)
    return each.mapInArrow(run, "doc_id long, " + ", ".join(f"p_{c} double, is_{c} boolean" for c in categories))


def toxicity(docs: DataFrame, labels: DataFrame, categories: list[str]) -> DataFrame:
    """Fit the chain on the labels and score all documents; see the module."""
    chain, index = fit(docs, labels, categories)
    return score(docs, chain, index, categories)


def toxicity_labels(labels: DataFrame) -> DataFrame:
    """The categories that the labels table allows: toxic, and its kinds by the text that carries it.

    The table has one toxic column, no insults, threats or the like; beside it, quality tells
    toxic prose from toxic junk. Both kinds are 0 where toxic is 0, null where quality is null.
    """
    toxic, quality = F.col("toxic").cast("int"), F.col("quality").cast("int")
    return labels.select(
        "doc_id",
        toxic.alias("toxic"),
        F.when(toxic == 0, 0).otherwise(toxic * quality).alias("toxic_prose"),
        F.when(toxic == 0, 0).otherwise(toxic * (1 - quality)).alias("toxic_junk"),
    )


CATEGORIES = ["toxic", "toxic_prose", "toxic_junk"]
