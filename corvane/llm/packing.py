r"""Best-fit packing of documents into sequences, by a grouping genetic algorithm.

Documents become pieces of at most CAPACITY tokens (see `pieces`). Which pieces share a
sequence depends on their lengths alone, and there are at most CAPACITY lengths: so the
algorithm works on the histogram of lengths, whatever the number of documents. A solution
is a set of bins, kept as patterns (the lengths in a bin, descending) with the number of
bins of each pattern.

The genetic algorithm is the grouping kind (bins are the genes):

* first solutions: best-fit of the lengths, and bins filled as exactly as the lengths that
  are left allow (the longest piece, and the sum of others that comes nearest to the room
  beside it), each in descending order and in disturbed orders;
* crossover: whole well-filled bins of one parent are injected into a child; the bins of
  the other parent that would use a piece twice are removed, all others kept; the pieces
  displaced by this are packed again by best-fit, into bins with room first;
* mutation: the least filled bins and some others are dissolved and packed again, by best-fit
  or by exact filling;
* fitness: fewest bins, then the mean square of their fill.

Islands are Spark tasks; each evolves a population of its own (its seed is its number)
for some epochs. After an epoch the best solution of each island moves to the next one
in a ring. What the driver sees of an epoch is one solution for each island: patterns of
a bounded number of lengths, not documents.

Documents then get their place without any further shuffle of bins: piece number r among
the pieces of its length (a rank that is summed over buckets of pieces, so a length that
a third of all rows have is spread over tasks) goes to slot number r of that length.

Null and empty texts are the end id alone. Repeated rows of an id are documents of their
own, told apart by their text and an order among equals. An empty table gives an empty
table. Only doc_id and text are read.
"""

from __future__ import annotations

import bisect
import pickle
import random
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import durable, id_and_text, small_batches

CAPACITY = 1024
END_ID = 2
#: Islands, epochs, generations in an epoch, solutions on an island.
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 6, 3, 10, 6
#: Most patterns of a solution that moves or is returned; the rest is packed again.
PATTERNS = 20_000

Solution = dict[tuple[int, ...], int]


# ---- pieces ------------------------------------------------------------------------


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of the documents: (doc_id, piece, start, length, ids_crc32).

    A document's ids are its tokens and the end id. A document longer than the capacity
    is cut so that all pieces but the first are full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corvane.llm.tokens import crc32, encoder

        encode = encoder("byte_bpe", tokenizer_path).packed
        tail = struct.pack("<I", end_id)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packed = encode(text) + tail
                n = len(packed) // 4
                start, piece = 0, 0
                while start < n:
                    size = (n - start) % capacity or capacity if piece == 0 else capacity
                    row = (doc_id, piece, start, size, crc32(packed[4 * start : 4 * (start + size)]))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    start, piece = start + size, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    small_batches(docs.sparkSession)
    each = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return each.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---- the genetic algorithm on histograms -------------------------------------------


class _Bins:
    """Bins by pattern, with an index by room, for best-fit of many equal pieces at once."""

    def __init__(self, capacity: int, bins: Solution | None = None):
        self.capacity, self.rooms, self.by_room = capacity, [], {}
        self.done: Solution = {}
        for pattern, n in (bins or {}).items():
            self.add(pattern, n)

    def add(self, pattern: tuple[int, ...], n: int) -> None:
        room = self.capacity - sum(pattern)
        if room == 0:
            self.done[pattern] = self.done.get(pattern, 0) + n
            return
        if room not in self.by_room:
            self.by_room[room] = {}
            bisect.insort(self.rooms, room)
        own = self.by_room[room]
        own[pattern] = own.get(pattern, 0) + n

    def best_fit(self, size: int, n: int) -> None:
        """Each of n pieces goes to the bin with the least room that holds it, or a new one."""
        while n:
            at = bisect.bisect_left(self.rooms, size)
            if at == len(self.rooms):
                per_bin = self.capacity // size
                if n >= per_bin:
                    self.add((size,) * per_bin, n // per_bin)
                if n % per_bin:
                    self.add((size,) * (n % per_bin), 1)
                return
            room = self.rooms[at]
            own = self.by_room[room]
            pattern, held = own.popitem()
            fits = room // size
            filled = min(held, n // fits)
            if filled:
                if held > filled:
                    own[pattern] = held - filled
            else:  # the last few, into one bin
                filled, fits = 1, n
                if held > 1:
                    own[pattern] = held - 1
            if not own:
                del self.by_room[room]
                self.rooms.pop(at)
            self.add(tuple(sorted(pattern + (size,) * fits, reverse=True)), filled)
            n -= filled * fits

    def solution(self) -> Solution:
        out = dict(self.done)
        for own in self.by_room.values():
            out |= own
        return out


def best_fit(sizes: dict[int, int], capacity: int, order: list[int] | None = None, bins: Solution | None = None) -> Solution:
    held = _Bins(capacity, bins)
    for size in order if order is not None else sorted(sizes, reverse=True):
        if sizes.get(size):
            held.best_fit(size, sizes[size])
    return held.solution()


def exact_fill(sizes: dict[int, int], capacity: int, rng: random.Random | None = None, bins: Solution | None = None) -> Solution:
    """Bins of the longest piece left and the pieces whose sum comes nearest to the room beside it.

    With rng, lengths are tried in a disturbed order and a pattern is not used as often as it could be.
    """
    left = {s: n for s, n in sizes.items() if n}
    out = dict(bins or {})
    order = sorted(left, reverse=True)
    while left:
        order = [s for s in order if s in left]
        longest = order[0]
        room = capacity - longest
        # sums that can be reached, as bits, and the piece each was first reached by
        sums, by, inside = 1, {}, (1 << (room + 1)) - 1
        for size in order if rng is None else sorted(order, key=lambda s: -s * rng.uniform(0.5, 1.0)):
            new = sums
            for _ in range(min(left[size] - (size == longest), room // size)):
                new = new << size & inside & ~sums
                if not new:
                    break
                sums |= new
                bits = new
                while bits:
                    low = bits & -bits
                    by[low.bit_length() - 1] = size
                    bits ^= low
            if sums >> room & 1:
                break
        own, at = Counter([longest]), sums.bit_length() - 1
        while at:
            own[by[at]] += 1
            at -= by[at]
        n = min(left[s] // c for s, c in own.items())
        n = n if rng is None else rng.randint(1, n)
        pattern = tuple(sorted(own.elements(), reverse=True))
        out[pattern] = out.get(pattern, 0) + n
        for s, c in own.items():
            left[s] -= c * n
            if not left[s]:
                del left[s]
    return out


def fitness(solution: Solution, capacity: int) -> tuple[int, float]:
    bins = sum(solution.values())
    return -bins, sum(n * (sum(p) / capacity) ** 2 for p, n in solution.items()) / max(1, bins)


def _left(sizes: dict[int, int], solution: Solution) -> dict[int, int]:
    left = dict(sizes)
    for pattern, n in solution.items():
        for size, c in Counter(pattern).items():
            left[size] -= c * n
    return left


def _take(wanted: list[tuple[tuple[int, ...], int]], left: dict[int, int], into: Solution) -> None:
    """Bins of a parent, in this order, as many as the pieces that are left allow."""
    for pattern, n in wanted:
        own = Counter(pattern)
        n = min([n, *(left[size] // c for size, c in own.items())])
        if n > 0:
            into[pattern] = into.get(pattern, 0) + n
            for size, c in own.items():
                left[size] -= c * n


def crossover(giver: Solution, taker: Solution, sizes: dict[int, int], capacity: int, rng: random.Random) -> Solution:
    """A child: well-filled bins of the giver, the taker's bins that remain possible, best-fit for the rest."""
    full = sorted(giver, key=lambda p: (-sum(p), p))
    cut = full[: max(1, int(len(full) * rng.uniform(0.2, 0.8)))]
    chosen = [(p, max(1, int(giver[p] * rng.uniform(0.4, 1.0)))) for p in cut if rng.random() < 0.7]
    left, child = dict(sizes), {}
    _take(chosen, left, child)
    _take([(p, taker[p]) for p in sorted(taker, key=lambda p: (-sum(p), p))], left, child)
    return best_fit(left, capacity, None, child)


def mutated(solution: Solution, sizes: dict[int, int], capacity: int, rng: random.Random) -> Solution:
    """Dissolves all but the fullest bins, and a few of these, and packs their pieces again."""
    kept: Solution = {}
    share = rng.uniform(0.02, 0.3)
    for pattern, n in solution.items():
        gone = n if sum(pattern) < capacity - rng.choice((0, 1, 4, 16)) else int(n * share)
        if n > gone:
            kept[pattern] = n - gone
    left = {s: n for s, n in _left(sizes, kept).items() if n}
    if rng.random() < 0.5:
        return exact_fill(left, capacity, rng, kept)
    order = sorted(left, key=lambda s: -s * rng.uniform(0.9, 1.0))
    return best_fit(left, capacity, order, kept)


def evolve(sizes: dict[int, int], capacity: int, population: list[Solution], generations: int, rng: random.Random) -> list[Solution]:
    if not population:
        population = [best_fit(sizes, capacity), exact_fill(sizes, capacity)]
    while len(population) < POPULATION:
        order = sorted(sizes, key=lambda s: -s * rng.uniform(0.85, 1.0))
        population.append(exact_fill(sizes, capacity, rng) if len(population) % 2 else best_fit(sizes, capacity, order))
    least = -(-sum(s * n for s, n in sizes.items()) // capacity)
    key = lambda s: fitness(s, capacity)
    population = sorted(population, key=key, reverse=True)[:POPULATION]
    for _ in range(generations):
        if sum(population[0].values()) <= least:
            break
        a, b = rng.sample(range(len(population)), 2)
        child = crossover(population[a], population[b], sizes, capacity, rng)
        other = mutated(population[rng.randrange(2)], sizes, capacity, rng)
        population = sorted([*population, child, other], key=key, reverse=True)[:POPULATION]
    return population


def pack_sizes(spark, sizes: dict[int, int], capacity: int = CAPACITY) -> Solution:
    """The best solution that the islands find for a histogram of lengths."""
    if not sizes:
        return {}
    whole = {(s,): n for s, n in sizes.items() if s == capacity}
    part = {s: n for s, n in sizes.items() if s != capacity}
    if not part:
        return whole

    def live(epoch: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for island, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    rng = random.Random(1000 * epoch + island)
                    own = evolve(part, capacity, pickle.loads(blob), GENERATIONS, rng)
                    yield pa.RecordBatch.from_pydict({"island": pa.array([island], pa.int32()), "blob": [pickle.dumps([_bounded(s) for s in own[:2]])]})

        return run

    def _bounded(solution: Solution) -> Solution:
        if len(solution) <= PATTERNS:
            return solution
        kept = dict(sorted(solution.items(), key=lambda x: (-sum(x[0]), x[0]))[:PATTERNS])
        return best_fit({s: n for s, n in _left(part, kept).items() if n}, capacity, None, kept)

    own: list[list[Solution]] = [[] for _ in range(ISLANDS)]
    least = -(-sum(s * n for s, n in part.items()) // capacity)
    for epoch in range(EPOCHS):
        rows = [(i, pickle.dumps(own[i] + own[i - 1][:1])) for i in range(ISLANDS)]  # the neighbour's best moves in
        islands = spark.createDataFrame(rows, "island int, blob binary").repartition(ISLANDS, "island")
        for row in islands.mapInArrow(live(epoch), "island int, blob binary").collect():
            own[row["island"]] = pickle.loads(row["blob"])
        if min(sum(s[0].values()) for s in own) <= least:
            break
    best = max((s[0] for s in own), key=lambda s: fitness(s, capacity))
    return best | whole


# ---- places ------------------------------------------------------------------------


def slots(solution: Solution) -> dict[str, np.ndarray]:
    """For each pattern and length in it: the ranks that it takes, its first bin, and the place in a bin."""
    used: Counter[int] = Counter()
    rows, bin_at = [], 0
    for pattern in sorted(solution, reverse=True):
        n, at = solution[pattern], 0
        for size, c in sorted(Counter(pattern).items(), reverse=True):
            rows.append((size, used[size], c, bin_at, at))
            used[size] += c * n
            at += size * c
        bin_at += n
    rows.sort()
    names = ("length", "rank", "each", "bin", "at")
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(names)}


def ranked(items: DataFrame, buckets: int) -> DataFrame:
    """items with `rank`, from 0, among those of the same length; equal lengths are spread over buckets."""
    spread = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sized = spread.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sized.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return (
        spread.withColumn("r", F.row_number().over(inside) - 1)
        .join(bases, ["length", "bucket"])
        .withColumn("rank", F.col("base") + F.col("r"))
        .drop("bucket", "r", "base")
    )


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces."""
    spark = docs.sparkSession
    items = durable(pieces(docs, tokenizer_path, capacity))
    # at most `capacity` rows, whatever the number of documents
    sizes = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    found = slots(pack_sizes(spark, sizes, capacity))
    keys = found["length"] << 42 | found["rank"] if sizes else np.zeros(0, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank")}
            k = np.searchsorted(keys, columns["length"] << 42 | columns["rank"], side="right") - 1
            inside = columns["rank"] - found["rank"][k]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")],
                    pa.array(found["bin"][k] + inside // found["each"][k]),
                    pa.array(found["at"][k] + inside % found["each"][k] * columns["length"]),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    n = sum(sizes.values())
    numbered = ranked(items, max(1, n // 200_000 + 8))
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
