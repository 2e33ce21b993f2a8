"""Phrases of two to five words counted over the whole text, with little on disk.

A word's place is sent once for the pairs and once for the longer phrases, as the window of
the five words from it on: by the window's first three words, so that all phrases of three
to five words with the same beginning meet in one bucket, and a pair that is frequent does
not fill one. Pairs are dealt out by both words. Windows of a batch are counted by source before they
are sent, sorted, and coded as numbers of words: those of a list of COMMON words that all tasks have, and
further ones that are sent along; so nothing depends on hashes being unequal. Which words are in
the list changes the size of what is sent and no result, so the most frequent ones of some documents do.

A bucket has about WINDOWS windows, whatever the size of the table, and is counted in memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import english_words

LONGEST = 5
#: Windows of a bucket, about; a word and the space behind it have about CHARS characters.
WINDOWS, CHARS = 1_000_000, 6
#: Bytes and rows of the batches that are counted before they are sent.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4096
#: Words that need not be sent along, found in about so many documents.
COMMON, COMMON_FROM = 60_000, 8000
#: The lengths that are counted from windows of so many words that agree in the bucket's key.
_KINDS = {2: (2,), 3: (3, 4, 5)}
_CODED = "kind int, bucket int, rows int, words binary, sources array<string>, codes binary"


def _sorted(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """The order of rows by their columns; numbers of at most so many bits are sorted packed."""
    per = max(1, 63 // max(bits, 1))
    keys = []
    for i in range(0, len(columns), per):
        key = columns[i].astype(np.int64)
        for c in columns[i + 1 : i + per]:
            key = (key << bits) | c
        keys.append(key)
    return np.lexsort(keys[::-1])


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """True at each row of the sorted columns that is unlike the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _dense(column: np.ndarray, room: np.ndarray, fixed: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers above `fixed` that a column has, in order, and the column with these as fixed + 1 and so on."""
    room[column] = 1
    own = np.flatnonzero(room[fixed + 1 :]) + fixed + 1
    room[: fixed + 1] = np.arange(fixed + 1)
    room[own] = np.arange(fixed + 1, fixed + 1 + len(own))
    places = room[column]
    room[: fixed + 1] = room[own] = 0
    return own, places


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers below 2^31, byte by byte, as bytes of one weight are alike."""
    planes = [np.ascontiguousarray(c.astype("<i4")).view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns]
    data = b"".join(planes)
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpacked(data: bytes, rows: int) -> np.ndarray:
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    held = np.frombuffer(planes, np.uint8).reshape(-1, 4, rows)
    return held.transpose(0, 2, 1).copy().view("<i4")[:, :, 0]


def _windows(batch: pa.RecordBatch, buckets: dict[int, int], common: pa.Array) -> Iterator[tuple]:
    """(kind, bucket, rows, words, sources, codes) of a batch of documents (words joined by a space, source)."""
    lists = pc.split_pattern(batch.column(0), " ")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    # words have numbers from 1 on, common ones that of their place in the list; 0: no word
    known = pc.index_in(coded.dictionary, common).cast(pa.int32())
    new = coded.dictionary.filter(known.is_null()).to_pylist()
    rank = pc.fill_null(known, -1).to_numpy(zero_copy_only=False) + np.int32(1)
    rank[rank == 0] = np.arange(len(common) + 1, len(common) + 1 + len(new))
    n_words = len(common) + len(new)
    crc = np.zeros(n_words + 1, np.uint64)
    crc[rank] = [zlib.crc32(x.encode()) for x in coded.dictionary.to_pylist()]
    w = np.concatenate([rank[index], np.zeros(LONGEST, np.int32)])
    n = len(index)
    left = (np.repeat(np.cumsum(sizes), sizes) - np.arange(n)).astype(np.int32)
    named = batch.column(1).dictionary_encode()
    names = named.dictionary.to_pylist()
    source = np.repeat(pc.fill_null(pc.add(named.indices, pa.scalar(1, pa.int32())), 0).to_numpy(zero_copy_only=False), sizes)
    bits = max(n_words, len(names), 1).bit_length()
    room, some_names = np.zeros(n_words + 1, np.int32), np.zeros(len(names) + 1, np.int32)
    for kind, lengths in _KINDS.items():
        at = np.flatnonzero(left >= kind)
        if not len(at):
            continue
        columns = [w[at + k] if k < kind else np.where(left[at] > k, w[at + k], np.int32(0)) for k in range(lengths[-1])]
        key = np.zeros(len(at), np.uint64)
        for c in columns[:kind]:
            key = (key ^ crc[c]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        bucket = (key % np.uint64(buckets[kind])).astype(np.int32)
        del key
        columns.append(source[at])
        order = _sorted(columns, bits)
        order = order[np.argsort(bucket[order].astype(np.uint16 if buckets[kind] < 1 << 16 else np.int32), kind="stable")]
        bucket, columns = bucket[order], [c[order] for c in columns]
        first = np.flatnonzero(_changes([bucket, *columns]))
        times = np.diff(np.append(first, len(order)))
        bucket, columns = bucket[first], [c[first] for c in columns]
        starts = np.flatnonzero(_changes([bucket]))
        for a, b in zip(starts, [*starts[1:], len(bucket)]):
            own, places = _dense(np.concatenate([c[a:b] for c in columns[:-1]]), room, len(common))
            its, where = _dense(columns[-1][a:b], some_names, 0)
            parts = list(places.reshape(-1, b - a))
            parts[0] = np.diff(parts[0], prepend=0)
            said = "\n".join([new[i - len(common) - 1] for i in own]).encode()
            said = len(said).to_bytes(8, "little") + pa.compress(said, "zstd", asbytes=True)
            yield kind, int(bucket[a]), int(b - a), said, [names[i - 1] for i in its], _packed([*parts, where, times[a:b]])


def _met(kind: int, blobs: list[tuple], common: pa.Array) -> Iterator[tuple]:
    """For each length: (n, groups, their counts, their first rows, group of each row, columns of words, sources, the words)."""
    said = [pa.decompress(x[3][8:], int.from_bytes(x[3][:8], "little"), "zstd", asbytes=True).decode() for x in blobs]
    said = [x.split("\n") if x else [] for x in said]
    every = pa.concat_arrays([common, pa.array([w for ws in said for w in ws], pa.string())]).dictionary_encode()
    number = np.concatenate([[0], every.indices.to_numpy(zero_copy_only=False) + 1]).astype(np.int32)
    sources: dict[str, int] = {}
    parts, before = [], 0
    c = len(common)
    for (_, _, rows, _, names, codes), ws in zip(blobs, said):
        held = _unpacked(codes, rows)
        held[0] = np.cumsum(held[0])
        held[:-2] = number[np.where(held[:-2] > c, held[:-2] + before, held[:-2])]
        held[-2] = np.array([0, *(sources.setdefault(s, len(sources) + 1) for s in names)], np.int32)[held[-2]]
        parts.append(held)
        before += len(ws)
    held = np.concatenate(parts, axis=1)
    del parts
    order = _sorted(list(held[:-2]), max(len(every.dictionary), 1).bit_length())
    for row in held:
        row[:] = row[order]
    for n in _KINDS[kind]:
        # a row without an n-th word sorts before those that have one, so the rest of a group is together
        own = held[:, held[n - 1] > 0] if n > kind else held
        if not own.shape[1]:
            continue
        new = _changes(list(own[:n]))
        first = np.flatnonzero(new)
        yield n, np.add.reduceat(own[-1], first, dtype=np.int64), first, np.cumsum(new) - 1, own, len(sources), every.dictionary


def _recurring(kind: int, blobs: list[tuple], common: pa.Array, least: int) -> Iterator[pa.RecordBatch]:
    for n, counts, first, group, own, n_sources, words in _met(kind, blobs, common):
        often = np.flatnonzero(counts >= least)
        place = np.full(len(counts), -1)
        place[often] = np.arange(len(often))
        rows = np.flatnonzero((place[group] >= 0) & (own[-2] > 0))
        pairs = np.unique(place[group[rows]] * (n_sources + 1) + own[-2, rows])
        spread = np.bincount(pairs // (n_sources + 1), minlength=len(often))
        for a in range(0, len(often), 65536):
            some = often[a : a + 65536]
            grams = pc.binary_join_element_wise(*[words.take(pa.array(own[k, first[some]] - 1)) for k in range(n)], " ")
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), n, np.int32)), grams, pa.array(counts[some]), pa.array(spread[a : a + 65536].astype(np.int64))],
                ["n", "gram", "count", "sources"],
            )


def _summed(kind: int, blobs: list[tuple], common: pa.Array, least: int) -> Iterator[pa.RecordBatch]:
    for n, counts, *_ in _met(kind, blobs, common):
        often = counts[counts >= least]
        row = {"n": n, "distinct_phrases": len(counts), "kept": len(often), "occurrences": int(often.sum())}
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if c == "n" else pa.int64()) for c, v in row.items()], list(row))


def _counted(docs: DataFrame, count, schema: str, least: int) -> DataFrame:
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    chars, n_docs = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(max(1, n_docs // COMMON_FROM))) == 0).select(F.col("text")).distinct()
    counts = some.select(F.explode(english_words(F.col("text"))).alias("word")).groupBy("word").count().where("count > 1")
    common = pa.array([r["word"] for r in counts.orderBy(F.desc("count"), "word").limit(COMMON).collect()], pa.string())
    # windows of pairs are fewer and shorter than the others
    many = max(2 * spark.sparkContext.defaultParallelism, -(-chars // (CHARS * WINDOWS)))
    buckets = {2: -(-many // 3), 3: many}

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.binary()]
        for batch in batches:
            for row in _windows(batch, buckets, common):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], [x.split()[0] for x in _CODED.split(", ")])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*columns):
                if now is not None and row[:2] != now:
                    yield from count(now[0], blobs, common, least)
                    blobs = []
                now = row[:2]
                blobs.append(row)
        if blobs:
            yield from count(now[0], blobs, common, least)

    worded = docs.select(english_words(F.col("text")).alias("w"), F.col("source").cast("string").alias("source"))
    worded = worded.where(F.size("w") > 1).select(F.array_join("w", " ").alias("words"), "source")
    dealt = worded.mapInArrow(coded, _CODED).repartition(many, "kind", "bucket").sortWithinPartitions("kind", "bucket")
    return dealt.mapInArrow(met, schema)


def recurring_phrases(docs: DataFrame, least: int = 2) -> DataFrame:
    """(n, gram, count, sources) of the phrases of two to five words found at least so often; null is no source."""
    return _counted(docs, _recurring, "n int, gram string, count long, sources long", least)


def phrase_totals(docs: DataFrame, least: int = 2) -> DataFrame:
    """Parts of (n, distinct_phrases, kept, occurrences), to be summed: distinct phrases, those found so often, and how often those are."""
    return _counted(docs, _summed, "n int, distinct_phrases long, kept long, occurrences long", least)
