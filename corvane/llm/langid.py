r"""Language ID: a linear-chain conditional random field labels the words of a text.

Words are runs of letters of the lower-cased text. A word's score for a language is the
sum of weights of its features: all character n-grams of 2 to 4 characters of the word
with a mark at either end (those at the ends are its affixes), hashed to BUCKETS, and the
word itself if it is in the lexicon (words frequent in the training texts of some
language). Transitions between the languages of neighbouring words are learned too. The
forward-backward algorithm gives each word's probability of each language; a document's
language is the one with the largest sum over its words, and its score is the mean
probability of that language.

Training texts have one language each, so code-switched sequences are made of them: runs
of words of different documents joined, beside runs of one document. The model is fitted
by gradient ascent on the conditional log-likelihood (Adam), which needs no library.

Bound of the training sample: about SAMPLE distinct documents a language (chosen by a hash,
so that a language with fewer gives all; equal rows count once), each with its whole text.
The model is BUCKETS weights a language and at most LEXICON words, whatever the corpus.

Everything is predicted on whole texts. A text of more than LONG words is cut into blocks
that are worked on side by side: the product of the transition and word scores over a
block carries what stands before it to what stands behind, and back. This is the same
forward-backward over all its words, not an estimate.

Only text and non-null lang of documents with crc32(doc_id as text) mod 3 <> 1 are
learned from (a null doc_id counts as empty text); lang, source and doc_id are no input of
a prediction. `und` is predicted for null texts and texts without a letter (Unicode
category L), with score 0; without any training text, for all. Repeated rows, and rows of
one id, have a result each, an empty table none. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import rows_of, small_batches

BUCKETS = 1 << 17
SAMPLE = 120
LEXICON = 5000
RUN, STEPS, RATE, DECAY = 32, 40, 0.1, 1e-4
SEED = 11
#: Words whose scores a worker keeps.
CACHE = 200_000
#: Words of a text beyond which it is worked on by blocks, words in a block, blocks held at once.
LONG, BLOCK, HELD = 1 << 15, 256, 256
UNKNOWN = "und"
#: In the filter: documents with a lower score, little above that of a guess, are rejected.
LEAST_SCORE = 0.3

_WORD = re.compile(r"[^\W\d_]+")
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def words(text: str | None) -> list[str]:
    """The runs of letters of the lower-cased text."""
    found = _WORD.findall((text or "").lower())
    if not found or "".join(found).isalpha():
        return found
    # the expression also takes numerals that are no digits, as in fractions
    return [w for own in found for w in ([own] if own.isalpha() else "".join(c if c.isalpha() else " " for c in own).split())]


def ngrams(of: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of all n-grams of these words, for all words at once."""
    joined = "\x02" + "\x03\x02".join(of) + "\x03"
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.cumsum(chars == 2) - 1
    buckets, rows = [], []
    h = chars
    for n in (2, 3, 4):
        if len(chars) < n:
            break
        h = h[: len(chars) - n + 1] * np.uint64(1000003) + chars[n - 1 :]
        inside = owner[: len(h)] == owner[n - 1 :]
        mixed = (h[inside] + np.uint64(n)) * _P1
        buckets.append(((mixed ^ mixed >> _P2) % np.uint64(BUCKETS)).astype(np.int64))
        rows.append(owner[: len(h)][inside])
    return np.concatenate(buckets), np.concatenate(rows)


class Crf:
    """languages, weights (BUCKETS, languages), lexicon (word to weights), transitions, start and bias."""

    def __init__(self, languages: list[str], lexicon: list[str]):
        n = len(languages)
        self.languages = languages
        self.lexicon = {w: i for i, w in enumerate(lexicon)}
        self.weights = np.zeros((BUCKETS, n), np.float32)
        self.known = np.zeros((len(lexicon) + 1, n), np.float32)
        self.turns = np.zeros((n, n), np.float32)
        self.start = np.zeros(n, np.float32)

    def scores(self, of: list[str]) -> np.ndarray:
        """A row of scores for each of these words."""
        out = np.zeros((len(of), len(self.languages)))
        if of:
            buckets, rows = ngrams(of)
            for k in range(out.shape[1]):
                out[:, k] = np.bincount(rows, self.weights[buckets, k], len(of))
            out += self.known[[self.lexicon.get(w, -1) for w in of]]
        return out


def forward_backward(emit: np.ndarray, turns: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Posteriors (places, rows, languages) of padded sequences, longest first.

    emit: scores. At each place only the sequences that reach it are worked on.
    """
    n, most, k = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    t = np.exp(turns - turns.max())
    alive = np.searchsorted(-lengths, -np.arange(most), side="left")  # sequences longer than a place
    ahead, back = np.empty((most, n, k)), np.ones((most, n, k))
    a = e[:, 0] * np.exp(start - start.max())
    ahead[0] = a / a.sum(axis=1, keepdims=True)
    for i in range(1, most):
        m = alive[i]
        a = (ahead[i - 1, :m] @ t) * e[:m, i]
        a /= a.sum(axis=1, keepdims=True)
        ahead[i, :m] = a
    for i in range(most - 2, -1, -1):
        m = alive[i + 1]
        b = (back[i + 1, :m] * e[:m, i + 1]) @ t.T
        b /= b.sum(axis=1, keepdims=True)
        back[i, :m] = b
    for i in range(most):
        p = ahead[i, : alive[i]] * back[i, : alive[i]]
        p /= p.sum(axis=1, keepdims=True)
        ahead[i, : alive[i]] = p
        ahead[i, alive[i] :] = 0
    return ahead


def long_sums(scores, ids: np.ndarray, turns: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The sum of the posteriors of one long sequence, by blocks; scores: of each number in `ids`.

    A block's product of (transition, word) matrices takes the vector in front of it to its
    end, and the vector behind it to its start; with these, all blocks are worked on at once.
    """
    t = np.exp(turns - turns.max())
    k = len(start)

    def weights(numbers: np.ndarray) -> np.ndarray:
        own = scores[numbers].astype(float)
        return np.exp(own - own.max(axis=-1, keepdims=True))

    first, rest = weights(ids[:1])[0] * np.exp(start - start.max()), ids[1:]
    first /= first.sum()
    n_blocks = -(-len(rest) // BLOCK)
    ids_of = lambda b, c: rest[b * BLOCK : c * BLOCK]

    def padded(b: int, c: int) -> tuple[np.ndarray, int]:
        """Weights (place, block, language) of the blocks from b to c, and the length of the last."""
        own = ids_of(b, c)
        e = np.ones(((c - b) * BLOCK, k))
        e[: len(own)] = weights(own)
        return e.reshape(c - b, BLOCK, k).transpose(1, 0, 2), (len(own) - 1) % BLOCK + 1

    # the product of each block
    products = np.empty((n_blocks, k, k))
    for b in range(0, n_blocks, HELD):
        c = min(n_blocks, b + HELD)
        e, last = padded(b, c)
        m = np.broadcast_to(np.eye(k), (c - b, k, k))
        for i in range(BLOCK):
            more = (m @ t) * e[i][:, None, :]
            if c == n_blocks and i >= last:
                more[-1] = m[-1]
            m = more / more.sum(axis=(1, 2), keepdims=True)
        products[b:c] = m
    ahead, back = np.empty((n_blocks, k)), np.ones((n_blocks, k))
    v = first
    for b in range(n_blocks):
        ahead[b] = v
        v = v @ products[b]
        v /= v.sum()
    for b in range(n_blocks - 1, 0, -1):
        w = products[b] @ back[b]
        back[b - 1] = w / w.sum()
    # posteriors inside the blocks
    p = first * (products[0] @ back[0]) if n_blocks else first
    total = p / p.sum()
    for b in range(0, n_blocks, HELD):
        c = min(n_blocks, b + HELD)
        e, last = padded(b, c)
        there = np.ones((BLOCK, c - b), bool)
        if c == n_blocks:
            there[last:, -1] = False
        a, own = ahead[b:c], np.empty((BLOCK, c - b, k))
        for i in range(BLOCK):
            a = (a @ t) * e[i]
            a /= a.sum(axis=1, keepdims=True)
            own[i] = a
        w = back[b:c].copy()
        for i in range(BLOCK - 1, -1, -1):
            p = own[i] * w
            p /= p.sum(axis=1, keepdims=True)
            total = total + p[there[i]].sum(axis=0)
            before = (w * e[i]) @ t.T
            before /= before.sum(axis=1, keepdims=True)
            w = np.where(there[i][:, None], before, w)
    return total


def fit(sample: list[tuple[str, list[str]]]) -> Crf | None:
    """A model of (language, words) documents."""
    sample = [(lang, ws) for lang, ws in sample if ws]
    if not sample:
        return None
    rng = np.random.default_rng(SEED)
    languages = sorted({lang for lang, _ in sample})
    by = {lang: Counter() for lang in languages}
    for lang, ws in sample:
        by[lang].update(ws)
    total = Counter()
    for c in by.values():
        total.update(c)
    # frequent somewhere: seen at least three times in a language
    frequent = sorted((w for c in by.values() for w, n in c.items() if n >= 3), key=lambda w: (-total[w], w))
    lexicon = list(dict.fromkeys(frequent))[:LEXICON]
    model = Crf(languages, lexicon)
    k = len(languages)
    if k == 1:
        return model
    # equal runs: half from one document, half from two or more
    number = {lang: i for i, lang in enumerate(languages)}
    runs, gold = [], []
    for lang, ws in sample:
        for at in range(0, len(ws), RUN):
            piece = ws[at : at + RUN]
            if len(piece) >= 4 or at == 0:
                runs.append(piece)
                gold.append([number[lang]] * len(piece))
    for _ in range(len(runs)):
        i, j = rng.integers(0, len(runs), 2)
        cut = int(rng.integers(1, RUN))
        a, b = runs[i][:cut], runs[j][cut:] or runs[j][:4]
        runs.append(a + b)
        gold.append(gold[i][: len(a)] + [gold[j][0]] * len(b))
    order = sorted(range(len(runs)), key=lambda r: -len(runs[r]))
    runs, gold = [runs[i] for i in order], [gold[i] for i in order]
    lengths = np.array([len(r) for r in runs])
    distinct = {w: i for i, w in enumerate(dict.fromkeys(w for r in runs for w in r))}
    n, most = len(runs), int(lengths.max())
    ids, want = np.zeros((n, most), np.int64), np.zeros((n, most), np.int64)
    there = np.arange(most)[None, :] < lengths[:, None]
    ids[there] = [distinct[w] for r in runs for w in r]
    want[there] = [g for r in gold for g in r]
    buckets, rows = ngrams(list(distinct))
    known = np.array([model.lexicon.get(w, -1) for w in distinct])
    hit = np.zeros((n, most, k))
    hit[there, want[there]] = 1
    turned = np.zeros((k, k))
    both = there[:, 1:]
    np.add.at(turned, (want[:, :-1][both], want[:, 1:][both]), 1)
    started = np.bincount(want[:, 0], minlength=k)
    scale = 1.0 / there.sum()
    parts = {"weights": model.weights, "known": model.known, "turns": model.turns, "start": model.start}
    moments = {name: (np.zeros_like(p), np.zeros_like(p)) for name, p in parts.items()}
    for step in range(1, STEPS + 1):
        emit = np.zeros((len(distinct), k))
        for j in range(k):
            emit[:, j] = np.bincount(rows, model.weights[buckets, j], len(distinct))
        emit += model.known[known] * (known >= 0)[:, None]
        scored = emit[ids]
        post = forward_backward(scored, model.turns.astype(float), model.start.astype(float), lengths).transpose(1, 0, 2)
        slack = (hit - post) * there[:, :, None]
        of_word = np.stack([np.bincount(ids.ravel(), slack[:, :, j].ravel(), len(distinct)) for j in range(k)], axis=1)
        grads = {
            "weights": np.stack([np.bincount(buckets, of_word[rows, j], BUCKETS) for j in range(k)], axis=1),
            "known": np.zeros_like(model.known),
            "turns": turned - _expected_turns(scored, model, lengths, there),
            "start": started - post[:, 0].sum(axis=0),
        }
        np.add.at(grads["known"], known[known >= 0], of_word[known >= 0])
        for name, p in parts.items():
            g = grads[name] * scale * 100 - DECAY * p
            first, second = moments[name]
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            p += RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    model.known[-1] = 0
    return model


def _expected_turns(scored: np.ndarray, model: Crf, lengths: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Expected number of turns from each language to each other, by a forward and a backward pass."""
    n, most, k = scored.shape
    e = np.exp(scored - scored.max(axis=2, keepdims=True))
    t = np.exp(model.turns.astype(float) - model.turns.max())
    ahead = np.empty((most, n, k))
    a = e[:, 0] * np.exp(model.start - model.start.max())
    ahead[0] = a / a.sum(axis=1, keepdims=True)
    for i in range(1, most):
        a = (ahead[i - 1] @ t) * e[:, i]
        ahead[i] = a / a.sum(axis=1, keepdims=True)
    total = np.zeros((k, k))
    back = np.ones((n, k))
    for i in range(most - 1, 0, -1):
        live = there[:, i][:, None]
        right = np.where(live, back * e[:, i], 1.0)
        joint = ahead[i - 1][:, :, None] * t[None] * right[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        total += joint[there[:, i]].sum(axis=0)
        before = right @ t.T
        back = np.where(live, before / before.sum(axis=1, keepdims=True), 1.0)
    return total


class Predictor:
    """Scores batches of texts; keeps the scores of words it has seen, up to a bound."""

    def __init__(self, model: Crf):
        self.model = model
        self.row: dict[str, int] = {}
        self.held = np.zeros((1024, len(model.languages)), np.float32)

    def _rows(self, of: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of words in a table of scores, and the table."""
        row = self.row
        new = list(dict.fromkeys(w for w in of if w not in row))
        if len(row) + len(new) > CACHE:
            row.clear()
            new = list(dict.fromkeys(of))
        if new:
            need = len(row) + len(new)
            if need > len(self.held):
                grown = np.zeros((max(need, 2 * len(self.held)), self.held.shape[1]), np.float32)
                grown[: len(self.held)] = self.held
                self.held = grown
            base = len(row)
            for at in range(0, len(new), 20_000):
                part = new[at : at + 20_000]
                self.held[base + at : base + at + len(part)] = self.model.scores(part)
            row.update(zip(new, range(base, need), strict=True))
        return np.array([row[w] for w in of], np.int64), self.held

    def documents(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        k = len(self.model.languages)
        split = [words(t) for t in texts]
        out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        order = sorted((i for i, w in enumerate(split) if w), key=lambda i: -len(split[i]))
        turns, start = self.model.turns.astype(float), self.model.start.astype(float)
        at = 0
        while at < len(order):
            # texts of like length together: the padded block is bounded
            longest = len(split[order[at]])
            end = at + (1 if longest > LONG else min(len(order) - at, 400_000 // longest))
            group = order[at:end]
            at = end
            if longest > LONG:
                ids, held = self._rows(split[group[0]])
                sums = long_sums(held, ids, turns, start)[None]
                lengths = np.array([longest])
            else:
                lengths = np.array([len(split[i]) for i in group])
                ids, held = self._rows([w for i in group for w in split[i]])
                emit = np.zeros((len(group), longest, k), np.float32)
                emit[np.arange(longest)[None, :] < lengths[:, None]] = held[ids]
                sums = forward_backward(emit, turns, start, lengths).sum(axis=0)
            best = sums.argmax(axis=1)
            for i, b, s, n in zip(group, best.tolist(), sums.max(axis=1).tolist(), lengths.tolist(), strict=True):
                out[i], score[i] = self.model.languages[b], min(1.0, s / n)
        return out, score


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_sample(docs: DataFrame) -> list[tuple[str, list[str]]]:
    """(language, words) of about SAMPLE distinct documents a language, chosen by their hash; whole texts."""
    own = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    able = own.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in able.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    span = 1 << 24
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, span if n <= SAMPLE else max(1, SAMPLE * span // n)).otherwise(share)
    chosen = able.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(span)) < share).distinct()
    rows = sorted(chosen.collect(), key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, r["text"]))
    return [(r["lang"], words(r["text"])) for r in rows]


def predict(docs: DataFrame, model: Crf | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Predictor(model)
        for batch in batches:
            for part in rows_of(batch, 512):
                langs, score = made.documents(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(score)],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    small_batches(docs.sparkSession)
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    if model is None:
        return each.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return each.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the documents' own labels and predict all of them; see the module."""
    return predict(docs, fit(training_sample(docs)))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows whose language is known with at least LEAST_SCORE, with their columns, in one pass."""
    model = fit(training_sample(docs))
    if model is None:
        return docs.limit(0)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Predictor(model)
        for batch in batches:
            for part in rows_of(batch, 512):
                langs, score = made.documents(part.column(place).to_pylist())
                yield part.filter(pa.array([lang != UNKNOWN and s >= LEAST_SCORE for lang, s in zip(langs, score, strict=True)]))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
