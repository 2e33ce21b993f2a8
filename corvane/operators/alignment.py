"""Sequence alignment: grouped functions where a result depends on the row before it.

Each works on one group that its data bounds (a chapter, a page, a pair of texts); Spark
distributes the groups.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import english_words
from corvane.operators.tokens import TOK, neighbour
from corvane.plans.registry import query
from corvane.sources.tables import table

GAP, FLOOR, BAND = 0.35, 0.3, 6
#: Rows of hashes that may be broadcast.
SEED_ROWS = 200_000


def monotonic_alignment(scores: np.ndarray) -> tuple[list[int], list[float]]:
    """For each row a column, never decreasing, with the largest sum; and the row's best score less its second best.

    The best of columns up to j is a running maximum, so it takes rows * columns steps.
    """
    rows, columns = scores.shape
    if not rows or not columns:
        return [], []
    total = scores[0].astype(float).copy()
    back = np.zeros((rows, columns), int)
    for i in range(1, rows):
        best = np.maximum.accumulate(total)
        # the first column that reached the running maximum
        came = np.maximum.accumulate(np.where(np.append(True, best[1:] > best[:-1]), np.arange(columns), 0))
        back[i] = came
        total = best + scores[i]
    path = [int(total.argmax())]
    for i in range(rows - 1, 0, -1):
        path.append(int(back[i][path[-1]]))
    path.reverse()
    # of the row, whichever column was chosen
    best = -np.sort(-scores, axis=1)
    return path, [float(r[0] - (r[1] if columns > 1 else 0.0)) for r in best]


def banded_alignment(left: list, right: list, similar: Callable, gap: float = GAP, floor: float = FLOOR, band: int = BAND) -> list[tuple[int | None, int | None]]:
    """Pairs of places (or one and none): a match is worth its similarity, a gap costs.

    Only cells within the band around the diagonal are looked at; of equal choices a match is
    preferred, then a gap on the right.
    """
    n, m = len(left), len(right)
    slope = m / n if n else 0.0
    wide = band + abs(n - m) // 4
    value: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for i in range(n + 1):
        centre = round(i * slope)
        for j in range(max(0, centre - wide), min(m, centre + wide) + 1):
            if not i and not j:
                continue
            choices = []
            if i and j and (i - 1, j - 1) in value:
                s = similar(left[i - 1], right[j - 1])
                if s >= floor:
                    choices.append((value[i - 1, j - 1][0] + s, "m"))
            if i and (i - 1, j) in value:
                choices.append((value[i - 1, j][0] - gap, "l"))
            if j and (i, j - 1) in value:
                choices.append((value[i, j - 1][0] - gap, "r"))
            if choices:
                order = {"m": 2, "l": 1, "r": 0}
                value[i, j] = max(choices, key=lambda c: (c[0], order[c[1]]))
    i, j, path = n, m, []
    while i or j:
        step = value[i, j][1] if (i, j) in value else "l" if i else "r"
        if step == "m":
            i, j = i - 1, j - 1
            path.append((i, j))
        elif step == "l":
            i -= 1
            path.append((i, None))
        else:
            j -= 1
            path.append((None, j))
    return path[::-1]


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs that increases on both sides."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: (pairs[k][0], -pairs[k][1]))
    for k in order:
        at = bisect_left(tails, pairs[k][1])
        before[k] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(pairs[k][1])
            ends.append(k)
        else:
            tails[at], ends[at] = pairs[k][1], k
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(pairs[k])
        k = before[k]
    return chain[::-1]


def matched_tokens(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal tokens in order: tokens that either side has once are anchors, between them the same again.

    A stretch without such anchors is matched by its equal ends and a longest common subsequence.
    """
    out: list[tuple[int, int]] = []
    waiting = [(0, len(a), 0, len(b))]
    while waiting:
        i, i2, j, j2 = waiting.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i >= i2 or j >= j2:
            continue
        left, right = Counter(a[i:i2]), Counter(b[j:j2])
        place = {t: k for k, t in enumerate(b[j:j2], j) if right[t] == 1}
        anchors = longest_increasing([(k, place[t]) for k, t in enumerate(a[i:i2], i) if left[t] == 1 and t in place])
        if anchors:
            edges = [(i - 1, j - 1), *anchors, (i2, j2)]
            out += anchors
            waiting += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:], strict=False)]
        else:
            out += _long_subsequence(a, b, i, i2, j, j2)
    return sorted(out)


def _long_subsequence(a: list[str], b: list[str], i: int, i2: int, j: int, j2: int) -> list[tuple[int, int]]:
    """A longest common subsequence in linear space: the stretch is halved (Hirschberg) until its matrix is small."""
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(t, len(number)) for t in side], np.int64) for side in (a[i:i2], b[j:j2]))

    def lengths(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        row = np.zeros(len(q) + 1, np.int64)
        for t in p:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (q == t)))
        return row

    out: list[tuple[int, int]] = []
    waiting = [(0, len(x), 0, len(y))]
    while waiting:
        p, p2, q, q2 = waiting.pop()
        if p >= p2 or q >= q2:
            continue
        if p2 - p == 1:
            at = np.flatnonzero(y[q:q2] == x[p])
            out += [(i + p, j + q + int(at[0]))] if len(at) else []
        elif (p2 - p) * (q2 - q) <= 640_000:
            out += _common_subsequence(a, b, i + p, i + p2, j + q, j + q2)
        else:
            half = (p + p2) // 2
            cut = q + int((lengths(x[p:half], y[q:q2]) + lengths(x[half:p2][::-1], y[q:q2][::-1])[::-1]).argmax())
            waiting += [(p, half, q, cut), (half, p2, cut, q2)]
    return out


def _common_subsequence(a: list[str], b: list[str], i: int, i2: int, j: int, j2: int) -> list[tuple[int, int]]:
    rows, columns = i2 - i, j2 - j
    best = np.zeros((rows + 1, columns + 1), np.int32)
    same = np.array([[a[i + p] == b[j + q] for q in range(columns)] for p in range(rows)])
    for p in range(rows - 1, -1, -1):
        for q in range(columns - 1, -1, -1):
            best[p, q] = best[p + 1, q + 1] + 1 if same[p, q] else max(best[p + 1, q], best[p, q + 1])
    out, p, q = [], 0, 0
    while p < rows and q < columns:
        if same[p, q]:
            out.append((i + p, j + q))
            p, q = p + 1, q + 1
        elif best[p + 1, q] >= best[p, q + 1]:
            p += 1
        else:
            q += 1
    return out


def bead_alignment(left: list[int], right: list[int], score: Callable[[int, int, int, int], float]) -> list[tuple[int, int, int, int]]:
    """Beads (from, to on the left; from, to on the right) of 1:1, 1:2, 2:1, 1:0 and 0:1 with the largest sum."""
    shapes = [(1, 1), (1, 2), (2, 1), (1, 0), (0, 1)]
    n, m = len(left), len(right)
    best = np.full((n + 1, m + 1), -np.inf)
    came: dict[tuple[int, int], tuple[int, int]] = {}
    best[0, 0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            for p, q in shapes:
                if i >= p and j >= q and best[i - p, j - q] > -np.inf:
                    s = best[i - p, j - q] + score(i - p, i, j - q, j)
                    if s > best[i, j]:
                        best[i, j], came[i, j] = s, (p, q)
    out, i, j = [], n, m
    while i or j:
        p, q = came[i, j]
        out.append((i - p, i, j - q, j))
        i, j = i - p, j - q
    return out[::-1]


#: Steps along two sequences: both on, or one word of either side left out; and what they cost.
_STEPS = ((1, 1, 0), (2, 1, 1), (1, 2, 1))


def _walked(left: list[str], right: list[str], i: int, j: int, way: int, per_error: int) -> list[tuple[int, int, int]]:
    """Where a run may end that starts at a pair of equal words and goes on one way: (left, right, errors so far).

    Equal words come first, then a word left out on the left, then on the right. If neither goes on,
    both words are taken for a substitution, which can't end a run; at the end of one side, a word
    that is left over on the other may. It stops with two errors more than the length allows.
    """
    ends, errors, from_i = [(i, j, 0)], 0, i
    inside = lambda p, q: 0 <= p < len(left) and 0 <= q < len(right)
    while True:
        for p, q, cost in _STEPS:
            if inside(i + way * p, j + way * q) and left[i + way * p] == right[j + way * q]:
                i, j, errors = i + way * p, j + way * q, errors + cost
                ends.append((i, j, errors))
                break
        else:
            on_left, on_right = 0 <= i + way < len(left), 0 <= j + way < len(right)
            if not on_left and not on_right:
                return ends
            i, j, errors = i + way * on_left, j + way * on_right, errors + 1
            if errors > (abs(i - from_i) + 1) // per_error + 1:
                return ends
            if not (on_left and on_right):
                ends.append((i, j, errors))


def _without_edges(left: list[str], right: list[str], run: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    """A run of equal lengths without substitutions at its ends."""
    a, b, c, d = run
    while b - a == d - c and a < b:
        if left[a] != right[c]:
            a, c = a + 1, c + 1
        elif left[b - 1] != right[d - 1]:
            b, d = b - 1, d - 1
        else:
            break
    return a, b, c, d


def fuzzy_runs(left: list[str], right: list[str], least: int = 4, per_error: int = 6, function_words: frozenset[str] = frozenset()) -> list[tuple[int, int, int, int]]:
    """Runs of both sequences that are alike: (left from, to, right from, to), ends exclusive.

    Seeds are equal content words and equal runs of `least` words. A run grows both ways over equal
    words, words that one side lacks and substitutions, one error for `per_error` words of the left
    side at most; the longest for each seed counts. Runs shorter than `least` or inside others are dropped.
    """
    places: dict = {}
    for j, w in enumerate(right):
        if w not in function_words:
            places.setdefault(w, []).append(j)
        if j + least <= len(right):
            places.setdefault(tuple(right[j : j + least]), []).append(j)
    seeds = [(i, j) for i, w in enumerate(left) if w not in function_words for j in places.get(w, ())]
    seeds += [(i, j) for i in range(len(left) - least + 1) for j in places.get(tuple(left[i : i + least]), ())]
    found: set[tuple[int, int, int, int]] = set()
    for i, j in dict.fromkeys(seeds):
        ahead, back = _walked(left, right, i, j, 1, per_error), _walked(left, right, i, j, -1, per_error)
        best = None
        # a way on that is shorter than what is found can't help
        for a, c, e in reversed(back):
            for b, d, f in reversed(ahead):
                if b + 1 - a <= (best[1] - best[0] if best else least - 1):
                    break
                run = _without_edges(left, right, (a, b + 1, c, d + 1))
                size = run[1] - run[0]
                if size >= least and e + f <= size // per_error and (best is None or size > best[1] - best[0]):
                    best = run
        if best:
            found.add(best)
    kept: list[tuple[int, int, int, int]] = []
    for r in sorted(found, key=lambda r: (r[0] - r[1], r[2] - r[3], r)):
        if not any(k[0] <= r[0] and r[1] <= k[1] and k[2] <= r[2] and r[3] <= k[3] for k in kept):
            kept.append(r)
    return sorted(kept)


def run_score(words: list[str], function_words: set[str]) -> int:
    """Three for each word that is no function word."""
    return 3 * sum(w not in function_words for w in words)


def proximity_windows(
    slots: list[list[tuple[int, int]]],
    window: int,
    units: list[tuple[int, int]],
    ordered: bool = False,
    sides: list[str] | None = None,
    same: list[int] | None = None,
) -> list[list[tuple[int, int]]]:
    """For each hit of the first slot, a choice of a hit of every other slot near it.

    Hits are (start, span). All starts lie within `window` of the least of them; spans lie in the
    unit (of `units`, half-open ranges) of the first hit; sides say near, before or after the first
    hit; `ordered` wants each slot behind the one before; slots with the same number in `same`
    share no word. Windows are tried from their least start upwards, so a later hit of a slot is
    found where an earlier one does not fit the others.
    """
    sides = sides or ["near"] * len(slots)
    same = same or list(range(len(slots)))
    out = []
    for start, span in slots[0]:
        unit = next(((lo, hi) for lo, hi in units if lo <= start < hi), None)
        if unit is None or start + span > unit[1]:
            continue
        fits = [
            [
                (s, n)
                for s, n in hits
                if unit[0] <= s and s + n <= unit[1] and abs(s - start) <= window
                and (sides[k] != "after" or s >= start + span) and (sides[k] != "before" or s + n <= start)
            ]
            for k, hits in enumerate(slots)
        ]
        fits[0] = [(start, span)]
        firsts = sorted({s for hits in fits for s, _ in hits if s <= start})
        choice = None
        for low in firsts:
            choice = _chosen([[h for h in hits if low <= h[0] <= low + window] for hits in fits], ordered, sides, same)
            if choice:
                break
        if choice:
            out.append(choice)
    return out


def _chosen(fits, ordered, sides, same, taken=()):
    k = len(taken)
    if k == len(fits):
        return list(taken)
    hits = fits[k][::-1] if sides[k] == "before" else fits[k]
    for s, n in hits:
        if ordered and taken and s < taken[-1][0] + taken[-1][1]:
            continue
        if any(same[q] == same[k] and s < t + m and t < s + n for q, (t, m) in enumerate(taken)):
            continue
        if found := _chosen(fits, ordered, sides, same, (*taken, (s, n))):
            return found
    return None


# ---- as grouped operators ----------------------------------------------------------


@query(
    "q10_three_word_windows",
    f"""WITH {TOK}, h AS (SELECT doc_id, pos, word FROM tok WHERE word IN ('the', 'was', 'with')),
    l AS (SELECT a.doc_id, a.pos anchor, h.pos low FROM h a JOIN h ON h.doc_id = a.doc_id AND h.pos BETWEEN a.pos - 12 AND a.pos
      WHERE a.word = 'the' AND (h.word <> 'the' OR h.pos = a.pos)),
    c AS (SELECT l.doc_id, anchor, low, min(b.pos) b, min(c.pos) c FROM l JOIN h b ON b.doc_id = l.doc_id AND b.word = 'was' AND b.pos BETWEEN low AND low + 12
      JOIN h c ON c.doc_id = l.doc_id AND c.word = 'with' AND c.pos BETWEEN low AND low + 12 GROUP BY 1, 2, 3)
    SELECT doc_id, anchor, least(anchor, b, c) first, greatest(anchor, b, c) last FROM c
    QUALIFY row_number() OVER (PARTITION BY doc_id, anchor ORDER BY low) = 1""",
)
def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words within twelve words of each other, in any order, in one document.

    Inside the row of a document: each anchor looks at the words beside it only. Windows are tried
    from their least start upwards, as in proximity_windows.
    """
    window = 12
    docs = table(spark, sf_dir, "documents").select("doc_id", english_words(F.col("text")).alias("w"))
    docs = docs.where(F.array_contains("w", "the") & F.array_contains("w", "was") & F.array_contains("w", "with"))

    def beside(anchor: Column) -> Column:
        base = F.greatest(anchor - window, F.lit(0))
        near = F.slice("w", base + 1, F.lit(2 * window + 1))
        spots = lambda t: F.transform(_places(near, t), lambda p: p + base)
        return F.struct(anchor.alias("anchor"), spots("was").alias("b"), spots("with").alias("c"))

    def chosen(x: Column) -> Column:
        lows = F.array_sort(F.filter(F.concat(F.array(x["anchor"]), x["b"], x["c"]), lambda p: p <= x["anchor"]))
        first = lambda spots, low: F.get(F.filter(spots, lambda p: (p >= low) & (p <= low + window)), F.lit(0))
        tried = F.transform(lows, lambda low: F.struct(first(x["b"], low).alias("b"), first(x["c"], low).alias("c")))
        good = F.get(F.filter(tried, lambda t: t["b"].isNotNull() & t["c"].isNotNull()), F.lit(0))
        return F.struct(x["anchor"].alias("anchor"), good.alias("g"))

    anchors = docs.select("doc_id", F.explode(F.transform(_places(F.col("w"), "the"), beside)).alias("x"))
    found = anchors.where((F.size("x.b") > 0) & (F.size("x.c") > 0)).select("doc_id", chosen(F.col("x")).alias("y")).where("y.g IS NOT NULL")
    spots = [F.col("y.anchor").cast("long"), F.col("y.g.b").cast("long"), F.col("y.g.c").cast("long")]
    return found.select("doc_id", spots[0].alias("anchor"), F.least(*spots).alias("first"), F.greatest(*spots).alias("last"))


def _places(words: Column, word: str) -> Column:
    """The places of a word in an array of words."""
    indexed = F.transform(words, lambda x, i: F.when(x == word, i))
    return F.filter(indexed, lambda p: p.isNotNull())


@query("aln03_monotonic_alignment")
def aln03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of a conversation aligned to its answers in order, by shared words."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", english_words(F.col("text")).alias("w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        a, b = pdf[pdf["role"] == "user"], pdf[pdf["role"] == "assistant"]
        sets = [[set(w) for w in side["w"]] for side in (a, b)]
        scores = np.array([[len(x & y) / max(1, len(x | y)) for y in sets[1]] for x in sets[0]]).reshape(len(a), len(b))
        path, margins = monotonic_alignment(scores)
        turns_b = b["turn"].to_numpy()
        rows = [(int(pdf["conv_id"].iloc[0]), int(t), int(turns_b[j]), round(m, 4)) for t, j, m in zip(a["turn"], path, margins, strict=False)]
        return pd.DataFrame(rows, columns=["conv_id", "turn", "partner", "margin"])

    return turns.groupBy("conv_id").applyInPandas(run, "conv_id long, turn long, partner long, margin double")


@query("aln12_token_diff")
def aln12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words each turn shares, in order, with the turn before it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", english_words(F.col("text")).alias("a"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))

    def run(batches):
        for pdf in batches:
            matched = [len(matched_tokens(list(r.a), list(r.b))) for r in pdf.itertuples()]
            yield pdf[["conv_id", "turn"]].assign(matched=matched)

    return turns.join(after, ["conv_id", "turn"]).mapInPandas(run, "conv_id long, turn long, matched long")


@query("aln08_banded_alignment")
def aln08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document aligned to the lines of the next one of its source, by shared words, within a band.

    A null text is an empty one.
    """
    pairs = _line_pairs(spark, sf_dir).select("doc_id", F.split("a", "\n").alias("a"), F.split("b", "\n").alias("b"))

    def similar(p: set, q: set) -> float:
        both = len(p & q)
        return both / max(1, len(p) + len(q) - both)

    def run(batches):
        for pdf in batches:
            sides = [[[set(x.lower().split()) for x in side] for side in (r.a, r.b)] for r in pdf.itertuples()]
            counts = [sum(i is not None and j is not None for i, j in banded_alignment(a, b, similar)) for a, b in sides]
            yield pdf[["doc_id"]].assign(matched=counts)

    return pairs.select("doc_id", "a", "b").mapInPandas(run, "doc_id long, matched long")


@query("aln14_bead_alignment")
def aln14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of a question and its answer aligned in beads by their lengths."""
    from corvane.functions.text import sentences

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.transform(sentences(F.col("text")), F.length).alias("s"))
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("s").alias("a"))
    answered = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s").alias("b"))

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                a, b = list(r.a), list(r.b)

                def score(i, i2, j, j2, a=a, b=b):
                    x, y = sum(a[i:i2]), sum(b[j:j2])
                    return -0.5 if not x or not y else 1 - abs(x - y) / max(x, y) - 0.1 * (i2 - i + j2 - j - 2)

                beads = bead_alignment(a, b, score)
                rows.append((r.conv_id, r.turn, len(beads), sum(i2 - i == 1 and j2 - j == 1 for i, i2, j, j2 in beads)))
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "beads", "one_to_one"])

    return asked.join(answered, ["conv_id", "turn"]).mapInPandas(run, "conv_id long, turn long, beads long, one_to_one long")


@query("jn17_fuzzy_spans")
def jn17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotations of benchmark items in documents, of eight words at least, extended over errors and gaps.

    A run of eight words or more has one error for six words at most, so four words in a row are
    equal in it (see the tests): pairs meet by the hashes of their four-word runs, the items' side
    broadcast if it is small. Only pairs that share one are extended, with their texts beside them.
    """
    n = 4
    words = frozenset("the and of to a in is".split())

    def worded(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, english_words(F.col("text")).alias("w"))

    def seeds(df: DataFrame, key: str) -> DataFrame:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>"))
        return df.select(key, F.explode(starts).alias("i"), "w").select(key, F.xxhash64(F.slice("w", F.col("i"), F.lit(n))).alias("h")).distinct()

    docs, items = worded(table(spark, sf_dir, "documents"), "doc_id"), worded(table(spark, sf_dir, "benchmark"), "item_id")
    asked = seeds(items, "item_id")
    asked = F.broadcast(asked) if asked.limit(SEED_ROWS + 1).count() <= SEED_ROWS else asked
    pairs = seeds(docs, "doc_id").join(asked, "h").select("doc_id", "item_id").distinct()
    both = pairs.join(docs.withColumnRenamed("w", "a"), "doc_id").join(items.withColumnRenamed("w", "b"), "item_id")

    def run(batches):
        for pdf in batches:
            rows = [
                (r.doc_id, r.item_id, *span, run_score(list(r.a)[span[0] : span[1]], words))
                for r in pdf.itertuples()
                for span in fuzzy_runs(list(r.a), list(r.b), 8, function_words=words)
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "lo", "hi", "item_lo", "item_hi", "score"])

    kinds = "doc_id long, item_id long, lo long, hi long, item_lo long, item_hi long, score long"
    return both.select("doc_id", "item_id", "a", "b").mapInPandas(run, kinds)


# ---- seeds, windows, plans ---------------------------------------------------------

# Least similarity of a seed, of an accepted match and of any; least margin, least share of matched lines.
SEED_SIMILARITY, ACCEPTED, LOW, MARGIN, COVERED = 0.6, 0.55, 0.3, 0.1, 0.4
SEED_LETTERS = 3
TOKEN_BAND, TOKEN_GAP = 12, 0.6


def shared_words(a: set, b: set) -> float:
    return len(a & b) / max(1, len(a | b))


def unique_seeds(lines: list[list[str]], window: list[list[str]]) -> list[tuple[int, int, float]]:
    """(line, window line, similarity): lines tied by their rarest word, if the window has it on one line only.

    Equally rare words: the first in the alphabet. Of these ties, the longest chain that ascends on
    both sides stays; of equally long ones that with the larger sum of similarities.
    """
    spots: dict[str, list[int]] = {}
    for k, line in enumerate(window):
        for w in set(line):
            spots.setdefault(w, []).append(k)
    ties = []
    for i, line in enumerate(lines):
        known = [(len(spots[w]), w) for w in set(line) if len(w) >= SEED_LETTERS and w in spots]
        if known and min(known)[0] == 1:
            k = spots[min(known)[1]][0]
            s = shared_words(set(line), set(window[k]))
            if s >= SEED_SIMILARITY:
                ties.append((i, k, s))
    # the best chain that ends in each tie: (length, sum, tie before)
    chains: list[tuple[int, float, int]] = []
    for at, (_, k, s) in enumerate(ties):
        best = (1, s, -1)
        for b in range(at):
            if ties[b][1] < k and (chains[b][0] + 1, chains[b][1] + s) > best[:2]:
                best = (chains[b][0] + 1, chains[b][1] + s, b)
        chains.append(best)
    out, at = [], max(range(len(ties)), key=lambda t: (chains[t][0], chains[t][1], -t), default=-1)
    while at >= 0:
        out.append(ties[at])
        at = chains[at][2]
    return out[::-1]


def window_coverage(lines: list[set], window: list[set]) -> float:
    """The mean similarity of a window's lines to the lines aligned to them; 0 for those without one."""
    if not window:
        return 0.0
    pairs = banded_alignment(lines, window, shared_words)
    return sum(shared_words(lines[i], window[j]) for i, j in pairs if i is not None and j is not None) / len(window)


def best_window(lines: list[set], chapters: list[list[set]], hint: int | None = None) -> tuple[int, float]:
    """The chapter that lines belong to, and its coverage: the hinted one if it is covered well, else the best of all."""
    if hint is not None and 0 <= hint < len(chapters) and (own := window_coverage(lines, chapters[hint])) >= COVERED:
        return hint, own
    found = [window_coverage(lines, c) for c in chapters]
    at = max(range(len(found)), key=lambda k: (found[k], -k), default=-1)
    return at, found[at] if found else 0.0


def row_state(partners: int, similarity: float, margin: float, beside_gap: bool) -> str:
    """matched (accepted as it is), low (to be looked at), merged, or missing."""
    if not partners or partners == 1 and similarity < LOW:
        return "missing"
    if partners > 1:
        return "merged"
    return "matched" if similarity >= ACCEPTED and margin >= MARGIN and not beside_gap else "low"


def relined(flow: list[str], rows: list[list[str]]) -> tuple[list[list[str]], float]:
    """A flow of words cut into as many rows as there are, each word to the row of the word it matches.

    Words that match none go to the row of the word before them (the first row, at the start). Also
    the share of the rows' words that are matched.
    """
    owner = [k for k, row in enumerate(rows) for _ in row]
    words = [w for row in rows for w in row]
    out: list[list[str]] = [[] for _ in rows]
    at, matched = 0, 0
    for i, j in banded_alignment(flow, words, lambda a, b: float(a == b), TOKEN_GAP, 1.0, TOKEN_BAND):
        if i is None:
            continue
        if j is not None:
            at, matched = owner[j], matched + 1
        if out:
            out[at].append(flow[i])
    return out, matched / max(1, len(words))


def _lines(text: str | None) -> list[list[str]]:
    return [line.lower().split() for line in (text or "").split("\n") if line.strip()]


def _line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, a, b): the texts of each document and of the next one of its source."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("a"))
    nxt = neighbour(docs.select("source", "doc_id"), ["source"], "doc_id", "next", behind=True).where("next IS NOT NULL")
    pairs = nxt.join(docs.select("doc_id", "a"), "doc_id").join(docs.select(F.col("doc_id").alias("next"), F.col("a").alias("b")), "next")
    return pairs.select("doc_id", "a", "b")


@query("aln09_unique_seeds")
def aln09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties between the lines of a document and of the next one of its source, by words that are on one line only."""

    def run(batches):
        for pdf in batches:
            rows = [(r.doc_id, i, k, round(s, 6)) for r in pdf.itertuples() for i, k, s in unique_seeds(_lines(r.a), _lines(r.b))]
            yield pd.DataFrame(rows, columns=["doc_id", "line", "partner", "similarity"])

    return _line_pairs(spark, sf_dir).mapInPandas(run, "doc_id long, line long, partner long, similarity double")


@query("aln10_best_window")
def aln10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each answer, the question of its conversation whose sentences cover it best; the one before it is the hint."""
    from corvane.functions.text import sentences

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.transform(sentences(F.col("text")), english_words).alias("s"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        sets = [(int(t), r, [set(x) for x in s]) for t, r, s in zip(pdf["turn"], pdf["role"], pdf["s"], strict=True)]
        asked = [(t, s) for t, r, s in sets if r == "user"]
        rows = []
        for t, r, s in sets:
            if r == "assistant" and asked:
                hint = next((k for k in range(len(asked) - 1, -1, -1) if asked[k][0] < t), None)
                at, cover = best_window(s, [own for _, own in asked], hint)
                rows.append((int(pdf["conv_id"].iloc[0]), t, asked[at][0], round(cover, 6)))
        return pd.DataFrame(rows, columns=["conv_id", "turn", "window", "coverage"])

    return turns.groupBy("conv_id").applyInPandas(run, "conv_id long, turn long, window long, coverage double")


@query("aln11_relined")
def aln11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a question's answer cut into the question's lines; as many rows as it has sentences."""
    from corvane.functions.text import sentences

    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.transform(sentences(F.col("text")), english_words).alias("rows"))
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), english_words(F.col("text")).alias("flow"))

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                rows, cover = relined(list(r.flow), [list(x) for x in r.rows])
                out += [(r.conv_id, r.turn, k, len(row), round(cover, 6)) for k, row in enumerate(rows)]
            yield pd.DataFrame(out, columns=["conv_id", "turn", "row", "words", "coverage"])

    return asked.join(said, ["conv_id", "turn"]).mapInPandas(run, "conv_id long, turn long, row long, words long, coverage double")


@query("aln04_chapter_alignment")
def aln04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's questions as anchors in the text of its answers: offset, tier and confidence."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        asked = pdf[pdf["role"] == "user"]
        rows = chapter_anchors(list(zip(asked["turn"], asked["text"], strict=True)), " ".join(pdf[pdf["role"] == "assistant"]["text"]))
        return pd.DataFrame([(int(pdf["conv_id"].iloc[0]), *r) for r in rows], columns=["conv_id", "turn", "offset", "confidence", "margin"])

    return turns.groupBy("conv_id").applyInPandas(run, "conv_id long, turn long, offset long, confidence string, margin double")


#: A margin above this makes an anchor reliable.
MARGIN_OK = 0.05


def chapter_anchors(references: list[tuple[int, str]], prose: str, fixed: dict[int, int] | None = None) -> list[tuple[int, int, str, float]]:
    """(reference, offset, confidence, margin): references in order placed at sentence starts of a text.

    The first is the chapter itself, at 0 and certain; others are reliable by their margin, or
    uncertain. Offsets in `fixed` were confirmed by a reader and count before all. Of references at one
    offset the most trusted stays, and one that would go back behind an earlier one is dropped.
    """
    starts, at = [], 0
    for part in re.findall(r"[^.!?]*[.!?]+\s*|[^.!?]+$", prose):
        starts.append((at + len(part) - len(part.lstrip()), part))
        at += len(part)
    if not references or not starts:
        return []
    words = lambda t: set(re.findall("[a-z']+", t.lower()))
    scores = np.array([[shared_words(words(t), words(s)) for _, s in starts] for _, t in references])
    path, margins = monotonic_alignment(scores)
    trust = {"certain": 3, "confirmed": 2, "reliable": 1, "uncertain": 0}
    made = []
    for k, ((name, _), j, m) in enumerate(zip(references, path, margins, strict=True)):
        offset, told = (0, "certain") if not k else (starts[j][0], "reliable" if m > MARGIN_OK else "uncertain")
        if fixed and name in fixed:
            offset, told = min(max(0, fixed[name]), len(prose)), "confirmed"
        made.append((int(name), int(offset), told, round(float(m), 6)))
    kept: dict[int, tuple] = {}
    for a in made:
        if a[1] not in kept or trust[a[2]] > trust[kept[a[1]][2]]:
            kept[a[1]] = a
    out, far = [], -1
    for a in made:
        if kept.get(a[1]) == a and a[1] > far:
            out.append(a)
            far = a[1]
    return out


def tick_windows(lines: DataFrame, by: str, n: str, every: int = 5) -> DataFrame:
    """(by, tick, line): the lines above, at and below each tick (line 1 and every fifth), inside the group."""
    w = Window.partitionBy(by).orderBy(n)
    tick = (F.col(n) == 1) | (F.col(n) % every == 0)
    found = lines.select(by, n, F.lag(n).over(w).alias("up"), F.lead(n).over(w).alias("down"), tick.alias("tick")).where("tick")
    return found.select(by, F.col(n).alias("tick"), F.explode(F.array_compact(F.array("up", n, "down"))).alias("line"))


@query(
    "aln07_tick_windows",
    """WITH l AS (SELECT DISTINCT l_orderkey k, l_linenumber n FROM lineitem), w AS (SELECT k, n, lag(n) OVER o up, lead(n) OVER o down FROM l WINDOW o AS (PARTITION BY k ORDER BY n))
    SELECT k, n tick, unnest(list_filter([up, n, down], lambda x: x IS NOT NULL)) line FROM w WHERE n = 1 OR n % 5 = 0""",
)
def aln07(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).distinct()
    return tick_windows(lines, "k", "n")


@query("aln07_batches")
def aln07_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole orders of a customer, in order, put into batches of at most 30 lines of tick windows."""
    from corvane.operators.windows import greedy_pages

    lines = aln07(spark, sf_dir).select("k", "line").distinct().groupBy("k").agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("k"))
    return greedy_pages(orders.join(lines, "k"), "o_custkey", "k", "n", 30)
