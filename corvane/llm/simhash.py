r"""SimHash near-duplicates: keys from Golay-decoded segments, joined and verified.

Fingerprint: 64 bits over the XXH64 (seed 42) of the text's 4-word shingles, repeats
included; a bit is set if it is set in over half of them. Two documents are linked if
their fingerprints differ in at most 4 bits; a component is what links reach.

Keys. A fingerprint has three segments A, B, C of 22, 21 and 21 bits, each a word of the
perfect binary Golay code (23 bits, 4096 codewords, any two at least 7 bits apart; the
missing bits are zero). `base` of a segment is the index of the one codeword within 3
bits; `near` are the indices of all codewords within 4 bits: one, or six if the nearest
is 3 bits away. Two facts about that code (tests check both on all error patterns):

* words 1 bit apart: base of either is in near of the other;
* words 1 or 2 bits apart: near of both share an index.

Pigeonhole. Of 4 or fewer errors, the two segments with the fewest have at most 2
together: either one has none and the other at most 2, or both have 1. So a linked pair
shares a key of one of these kinds, and none is missed:

* (exact bits of one segment, near index of another): 6 ordered pairs of segments;
* (near index of one, base index of another), from one side, and (base, near) from the
  other: 3 pairs of segments, both roles.

Buckets. Only distinct fingerprints have keys, so exact copies of a text cost one. A
bucket of up to BUCKET members is compared in its task. A larger one of the second kind,
whose keys have fewer bits, is refined first: both segments have an error at least where
no key of the first kind is shared, so the third has at most 2, and a near index of it
joins the key. What is still larger is dealt out as pairs of blocks of BUCKET / 2 members,
each compared in a task of its own, so no task holds more than a bucket. No pair leaves a
task unless it was verified, and of these only as many as connect the members (a spanning
forest): rows stay linear in members, components are exact, and no cap drops a member.

Null, empty and blank texts have fingerprint zero, linked like any other. Repeated rows
of an id have one result row each, with their own fingerprint; the id names the component.
Documents without an id link others, but name no component: it is named by the smallest
id in it, and null if there is none.
An empty table gives an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corvane.llm.common import components, durable, id_and_text, rows_of, small_batches

SHINGLE, SEED, BITS = 4, 42, 4
#: Most members of a bucket that are compared at once.
BUCKET = 2048
#: Rows of a fingerprint beyond which its rows are not shuffled to one task, and rows that may be broadcast.
HOT, BROADCAST_ROWS = 10_000, 200_000
SEGMENTS = ((0, 22), (22, 21), (43, 21))

#: Generator polynomial of the (23, 12) Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
_PIECE = 1 << 16
#: Bits of each octet, the lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


# ---- fingerprints ------------------------------------------------------------------


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text."""
    import xxhash

    # on bytes, lower() means A-Z only and split() cuts at \x20 and \x09-\x0D only
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, seed=SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - SHINGLE + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    a, b = starts[:n].tolist(), ends[SHINGLE - 1 :].tolist()
    for at in range(0, n, _PIECE):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(a[at : at + _PIECE], b[at : at + _PIECE], strict=True)], "<u8")
        octets = h.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[8 * k : 8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ _BITS
    set_bits = (counts * 2 > n).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch):
                fps = np.fromiter((fingerprint(t) for t in part.column(1).to_pylist()), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, fp long")


# ---- the code ----------------------------------------------------------------------


def remainders(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word, as a polynomial, by the generator: its syndrome."""
    left = words.astype(np.uint32).copy()
    for i in range(22, 10, -1):
        left ^= np.where(left >> i & 1, np.uint32(GENERATOR << i - 11), np.uint32(0))
    return left


_tables: list = []


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, error patterns by syndrome, and which are lone.

    Column 0 of the patterns has the one of at most 3 bits; if that has 3 bits, the next
    five have the patterns of 4 bits, else the syndrome is lone: no codeword is 4 bits away.
    A codeword's index is its high 12 bits.
    """
    if not _tables:
        from itertools import combinations

        low, high = remainders(np.arange(1 << 12)), remainders(np.arange(1 << 11) << 12)
        errors, filled = np.zeros((1 << 11, 6), np.uint32), np.zeros(1 << 11, int)
        for weight in range(5):
            for bits in combinations(range(23), weight):
                e = sum(1 << i for i in bits)
                s = low[e & 0xFFF] ^ high[e >> 12]
                errors[s, filled[s]] = e
                filled[s] += 1
        if set(filled) != {1, 6}:
            raise RuntimeError("not the perfect code")
        _tables.append((low, high, errors, filled == 1))
    return _tables[0]


def decoded(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Six indices of near codewords for each 23-bit word, base first, and whether it has base alone."""
    low, high, errors, lone = tables()
    words = words.astype(np.uint32)
    s = low[words & 0xFFF] ^ high[words >> 12]
    return ((words[:, None] ^ errors[s]) >> 11).astype(np.int64), lone[s]


_KEYS = "key long, fp long, side byte"


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, row of each key's fingerprint, side) of distinct fingerprints.

    side 0: the key is compared with all of its bucket; 1 and 2: with the other number.
    A key starts with the kind of key, so different kinds never meet.
    """
    n = len(fps)
    exact = [(fps >> np.uint64(at) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
    six, lone = zip(*[decoded(e) for e in exact], strict=True)
    one = [x[:, 0] for x in six]
    rows = np.arange(n)
    out_keys, out_rows, out_side = [], [], []

    def add(kind: int, keys: np.ndarray, at: np.ndarray, side: int) -> None:
        out_keys.append(np.int64(kind) << 36 | keys)
        out_rows.append(at)
        out_side.append(np.full(len(keys), side, np.int8))

    kind = 0
    for y in range(3):
        held = np.ones((n, 6), bool)
        held[:, 1:] = ~lone[y][:, None]
        at = np.repeat(rows, 6).reshape(n, 6)[held]
        index = six[y][held]
        for x in range(3):
            if x != y:
                add(kind, exact[x][at] << 12 | index, at, 0)
                kind += 1
    for x, y in ((0, 1), (0, 2), (1, 2)):
        for side, (p, q) in ((1, (x, y)), (2, (y, x))):
            # side 1: near of x, base of y; side 2: base of x, near of y
            held = np.ones((n, 6), bool)
            held[:, 1:] = ~lone[p][:, None]
            at = np.repeat(rows, 6).reshape(n, 6)[held]
            index = six[p][held]
            other = one[q][at]
            add(kind, (index << 12 | other) if side == 1 else (other << 12 | index), at, side)
        kind += 1
    return np.concatenate(out_keys), np.concatenate(out_rows), np.concatenate(out_side)


# ---- buckets -----------------------------------------------------------------------


def spanning_links(fps: np.ndarray, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what the pairs at most BITS apart connect; with `left`, only pairs across.

    Grows each component from a member: compares it with those not yet reached.
    """
    n = len(fps)
    if left is None:
        waiting = np.arange(n)
        found = []
        while len(waiting):
            front, waiting = [waiting[0]], waiting[1:]
            while front and len(waiting):
                at = front.pop()
                close = np.bitwise_count(fps[waiting] ^ fps[at]) <= BITS
                if close.any():
                    reached = waiting[close]
                    found += [(int(at), int(r)) for r in reached]
                    front += reached.tolist()
                    waiting = waiting[~close]
        return found
    sides = [np.flatnonzero(left), np.flatnonzero(~left)]
    found = []
    while len(sides[0]) and len(sides[1]):
        front, sides[0] = [(0, sides[0][0])], sides[0][1:]
        while front:
            side, at = front.pop()
            waiting = sides[1 - side]
            close = np.bitwise_count(fps[waiting] ^ fps[at]) <= BITS
            if close.any():
                reached = waiting[close]
                found += [(int(at), int(r)) for r in reached]
                front += [(1 - side, r) for r in reached.tolist()]
                sides[1 - side] = waiting[~close]
    return found


_LINKS = "a long, b long, key long, hot long"


def _links_of(fps: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links of a bucket: all pairs if its keys have no side, else pairs of either side."""
    if not side.any():
        return spanning_links(fps)
    if side.min() == side.max():
        return []
    # a fingerprint can be on both sides; its two rows count as linked
    members, place = np.unique(fps, return_inverse=True)
    if len(members) < 2:
        return []
    links = spanning_links(fps, side == 1)
    return [(i, j) for i, j in links if place[i] != place[j]]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: links of buckets, and the members of those that are too large.

    Holds no more than BUCKET members of a bucket: behind these, members pass through.
    """
    held_k = held_f = held_s = None
    hot_key = None

    def out(links: list, hot: list) -> Iterator[pa.RecordBatch]:
        a = np.array([x[0] for x in links], np.uint64).view(np.int64)
        b = np.array([x[1] for x in links], np.uint64).view(np.int64)
        if len(a):
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none], ["a", "b", "key", "hot"])
        for k, f, s in hot:
            yield pa.RecordBatch.from_arrays(
                [pa.array(f.view(np.int64)), pa.nulls(len(f), pa.int64()), pa.array(np.full(len(f), k)), pa.array(s.astype(np.int64))],
                ["a", "b", "key", "hot"],
            )

    def work(k: np.ndarray, f: np.ndarray, s: np.ndarray, whole: bool):
        """Rows of whole buckets, or with the last one open: that comes back as the rest."""
        nonlocal hot_key
        links, hot = [], []
        cuts = np.flatnonzero(np.diff(k)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(k)]])
        if hot_key is not None and len(k) and k[0] == hot_key:
            hot.append((hot_key, f[: ends[0]], s[: ends[0]]))
            if len(starts) == 1 and not whole:
                return links, hot, None
            starts, ends = starts[1:], ends[1:]
        hot_key = None
        rest = None
        if len(starts) and not whole:
            at = starts[-1]
            if ends[-1] - at > BUCKET:
                hot_key = int(k[at])
                hot.append((hot_key, f[at:], s[at:]))
            else:
                rest = (k[at:], f[at:], s[at:])
            starts, ends = starts[:-1], ends[:-1]
        sizes = ends - starts
        # buckets of two at once, as most are
        two = starts[sizes == 2]
        if len(two):
            good = (np.bitwise_count(f[two] ^ f[two + 1]) <= BITS) & (f[two] != f[two + 1])
            good &= (s[two] == 0) | (s[two] != s[two + 1])
            links += zip(f[two[good]].tolist(), f[two[good] + 1].tolist(), strict=True)
        for i, j in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist(), strict=True):
            if j - i > BUCKET:
                hot.append((int(k[i]), f[i:j], s[i:j]))
            else:
                own = f[i:j]
                links += [(int(own[x]), int(own[y])) for x, y in _links_of(own, s[i:j])]
        return links, hot, rest

    for batch in batches:
        k = batch.column(0).to_numpy(zero_copy_only=False)
        f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        s = batch.column(2).to_numpy(zero_copy_only=False)
        if held_k is not None:
            k, f, s = np.concatenate([held_k, k]), np.concatenate([held_f, f]), np.concatenate([held_s, s])
        if not len(k):
            continue
        links, hot, rest = work(k, f, s, False)
        held_k, held_f, held_s = rest if rest is not None else (None, None, None)
        yield from out(links, hot)
    if held_k is not None:
        links, hot, _ = work(held_k, held_f, held_s, True)
        yield from out(links, hot)


def _block_pairs(hot: DataFrame) -> DataFrame:
    """Links of large buckets, by pairs of blocks of BUCKET / 2 members."""
    sized = hot.groupBy("key").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / (BUCKET // 2))
    own = F.pmod(F.xxhash64("fp"), F.col("m"))
    dealt = (
        hot.join(sized.select("key", blocks.cast("long").alias("m")), "key")
        .select("key", "fp", "side", own.alias("g"), "m")
        .select("key", "fp", "side", "g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("o"))
        .select("key", "fp", "side", "g", F.least("g", "o").alias("p"), F.greatest("g", "o").alias("q"))
    )

    def compare(part: pa.Table) -> pa.Table:
        f = part["fp"].to_numpy().view(np.uint64)
        s, g = part["side"].to_numpy(), part["g"].to_numpy()
        if s.any():
            links = _links_of(f, s)
        elif g.min() == g.max():
            links = spanning_links(f)
        else:
            links = spanning_links(f, g == g.min())
        a = np.array([f[i] for i, _ in links], np.uint64).view(np.int64)
        b = np.array([f[j] for _, j in links], np.uint64).view(np.int64)
        return pa.table({"a": a, "b": b})

    return dealt.groupBy("key", "p", "q").applyInArrow(compare, "a long, b long")


#: The first number of the kinds of keys (near index, base index), and their third segments.
_MIXED, _THIRD = 6, np.array([2, 1, 0])


def refined(keys: np.ndarray, fps: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members of large mixed buckets with longer keys: a row for each near index of the third segment."""
    kind = (keys >> 36) - _MIXED
    third = _THIRD[kind]
    words = np.zeros(len(keys), np.int64)
    for z, (at, size) in enumerate(SEGMENTS):
        words = np.where(third == z, (fps >> np.uint64(at) & np.uint64((1 << size) - 1)).astype(np.int64), words)
    six, lone = decoded(words)
    held = np.ones((len(keys), 6), bool)
    held[:, 1:] = ~lone[:, None]
    at = np.repeat(np.arange(len(keys)), 6).reshape(-1, 6)[held]
    longer = (kind[at] + _MIXED + 3) << 36 | (keys[at] & ((1 << 24) - 1)) << 12 | six[held]
    return longer, fps[at], sides[at]


def _refined_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in rows_of(batch, 4096):
            keys, fps, sides = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            keys, fps, sides = refined(keys, fps.view(np.uint64), sides)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps.view(np.int64)), pa.array(sides)], ["key", "fp", "side"])


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all within BITS bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, 2048):
                values = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                keys, rows, side = keys_of(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(values[rows].view(np.int64)), pa.array(side)], ["key", "fp", "side"]
                )

    def compared(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The links of buckets, and the members of those that are too large."""
        found = durable(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_buckets, _LINKS))
        hot = found.where("key IS NOT NULL").select("key", F.col("a").alias("fp"), F.col("hot").cast("byte").alias("side"))
        return found.where("key IS NULL").select("a", "b"), hot

    plain, hot = compared(fps.select("fp").mapInArrow(run, _KEYS))
    mixed = hot.where(F.shiftright("key", 36) >= _MIXED)
    if mixed.limit(1).count():
        more, still = compared(mixed.mapInArrow(_refined_rows, _KEYS))
        plain, hot = plain.union(more), hot.where(F.shiftright("key", 36) < _MIXED).union(still)
    if hot.limit(1).count():
        plain = plain.union(_block_pairs(hot))
    return plain


# ---- the operator ------------------------------------------------------------------


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _joined(rows: DataFrame, named: DataFrame) -> DataFrame:
    """rows with the columns of named, by fp; fingerprints that very many rows have are not shuffled, if they are few."""
    hot = named.where(F.col("n") > HOT).drop("n")
    if not 0 < hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(named.drop("n"), "fp")
    rest = rows.join(F.broadcast(hot.select("fp")), "fp", "left_anti")
    return rows.join(F.broadcast(hot), "fp").union(rest.join(named.where(F.col("n") <= HOT).drop("n"), "fp"))


def grouped(each: DataFrame) -> DataFrame:
    """(fp, component, component_id, n) of the distinct fingerprints of rows (doc_id, fp)."""
    named = durable(each.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    reached = components(fingerprint_links(named))
    linked = durable(named.join(reached.toDF("fp", "component"), "fp", "left"))
    # only fingerprints with links need a name from elsewhere
    least = linked.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("least"))
    return linked.join(_few(least), "component", "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"), "n"
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each document."""
    each = durable(fingerprints(docs))
    whole = _joined(each, durable(grouped(each).drop("component")))
    return whole.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component, with its columns: that of the smallest id (a null id is the largest).

    Of several rows with this id, the one with the least fingerprint, then the least text
    (null as empty); if their texts are equal as well, any one of them.
    """
    each = durable(fingerprints(docs))
    named = durable(grouped(each))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
    kept = durable(_joined(each, named).groupBy("component").agg(F.min(key).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.fp").alias("__fp")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    again = durable(each.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__again")))
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    if not again.limit(1).count():
        return docs.join(kept, same, "left_semi").select(*columns)
    again = _few(again)
    repeated = F.col("doc_id").eqNullSafe(F.col("__again"))
    plain = docs.join(again, repeated, "left_anti").join(kept, same, "left_semi").select(*columns)
    # rows of one id are told apart by their fingerprints, which are computed again for these
    place = docs.columns.index("text")

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch):
                fps = np.fromiter((fingerprint(t) for t in part.column(place).to_pylist()), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fps.view(np.int64))], [*part.schema.names, "__own"])

    small_batches(docs.sparkSession)
    rows = docs.join(again, repeated, "left_semi").select(*columns)
    rows = rows.mapInArrow(printed, StructType([*docs.schema.fields, StructField("__own", LongType())]))
    rows = rows.join(kept, same & (F.col("__own") == F.col("__fp")), "left_semi")
    one = rows.groupBy(F.col("doc_id").alias("__id"), "__own").agg(
        F.min_by(F.struct(*columns), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row")
    )
    return plain.union(one.select(*[F.col(f"row.`{c}`") for c in docs.columns]))
