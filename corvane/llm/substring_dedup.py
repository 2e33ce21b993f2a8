r"""Suffix-array dedup: removes bytes that repeat an earlier 100-byte string, exactly.

A byte goes if it lies in a window (WINDOW bytes of one document's UTF-8 text) whose
string also starts earlier: in a document with a smaller id, or in the same one before.

No suffix array of a whole corpus fits a task, so equal windows are brought together
first, and only what may repeat is sorted:

1. Anchors. Each window picks the GRAM-byte string in it with the least hash (the
   leftmost of equals); equal windows pick the same place. The windows of a place are
   neighbours, so a document becomes records (anchor hash a, first byte, end): about one
   for each 35 bytes, whose span holds all windows of the anchor. x is a hash of the span.
2. Classes. Records meet by a. Of records with the same span (a, x) only the first can
   have a window that is no repeat; the others are covered whole. Each task reduces its
   own records to the first of a class before the shuffle, so a passage that a third of
   all documents share comes from each task once. An anchor with one class is done.
3. Hot anchors. An anchor that more than SPANS such first records share (a very common
   line in ever different surroundings) is refined: each of its windows holds either so
   many bytes to the left of the anchor or so many to the right, so a record becomes two,
   one for either half of its windows, with the longer common part as its new anchor; these
   meet again by step 2. As a part grows to a whole window in at most seven rounds, this
   ends, and no anchor that is left has more than SPANS spans.
4. Suffix arrays. The first records of the other classes (spans that share the anchor,
   but not all around it) get their bytes again and meet by a. A half of a span (as in step
   3) that shares its longer part with no other is left out; the rest is concatenated, with
   separators, to texts of bounded size. The two-stage construction sorts their suffixes:
   only suffixes smaller than their successor are sorted directly, to a depth of WINDOW
   bytes; all others are induced by scanning the buckets of first bytes in order. Common
   prefixes of neighbours then show windows that are equal; all but the earliest are
   covered.
5. Covered intervals return to their documents, which are cut and hashed.

Equal spans are recognised by 128 bits of hash; windows in the suffix arrays by their
bytes. Strings are judged on the input. Null texts are empty; rows with the same id are
told apart by their text's order, equal rows by position; null ids come first. An empty
table gives an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import durable, id_and_text, rows_of, small_batches, written

WINDOW, GRAM = 100, 32
#: Bytes of a block of documents that anchors are found in at once, and of a suffix array.
BLOCK, SORTED = 1 << 21, 1 << 20
#: Spans of an anchor that are sorted in one task; an anchor with more is refined.
SPANS = 1024
#: Ids that may be broadcast to leave out documents without repeats.
BROADCAST_IDS = 1_000_000

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * _M1
    h = (h ^ h >> np.uint64(33)) * _M2
    return h ^ h >> np.uint64(33)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each GRAM-byte string, by doubling."""
    h, width, base = data.astype(np.uint64) + np.uint64(1), 1, np.uint64(0x9E3779B97F4A7C15)
    while width < GRAM:
        h = h[: len(h) - width] * base + h[width:]
        base, width = base * base, 2 * width
    return _mixed(h)


def records(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(document, first byte, end, a, x) of the records of documents that stand in `data`.

    Places are in `data`; documents shorter than a window have no record.
    """
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = gram_hashes(data)
        n_windows = len(data) - WINDOW + 1
        # the least (hash, place) of the places in a window
        key = h & np.uint64(0xFFFFFFFF00000000) | np.arange(len(h), dtype=np.uint64)
        places, width = WINDOW - GRAM + 1, 1
        while 2 * width <= places:
            key = np.minimum(key[: len(key) - width], key[width:])
            width *= 2
        rest = places - width
        if rest:
            key = np.minimum(key[: len(key) - rest], key[rest:])
        place = (key[:n_windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        owner = np.repeat(np.arange(len(starts)), ends - starts)
        whole = owner[:n_windows] == owner[WINDOW - 1 :]
        new = np.ones(n_windows, bool)
        new[1:] = (place[1:] != place[:-1]) | ~whole[:-1]
        first = np.flatnonzero(new & whole)
        # a record goes on to the window before the next record, or the last of its document
        last = np.minimum(np.append(first[1:], n_windows) - 1, ends[owner[first]] - WINDOW)
        low, end = first, last + WINDOW
        a = h[place[first]]
        x = _mixed(end.astype(np.uint64) - low.astype(np.uint64))
        for at in (low, low + 32, low + 64, np.minimum(low + 96, end - GRAM), end - 64, end - 32):
            x = _mixed(x * np.uint64(0x9E3779B97F4A7C15) + h[at])
    return owner[first], low, end, a, x


_ROWS = "a long, x long, doc_id long, span long"


def _firsts(a: np.ndarray, x: np.ndarray, doc: np.ndarray, span: np.ndarray):
    """Sorted by class and place, and which rows are the first of their class."""
    order = np.lexsort((span, doc, x, a))
    a, x, doc, span = a[order], x[order], doc[order], span[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (x[1:] != x[:-1])
    return a, x, doc, span, first


def _merged(doc: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of each document, those that touch or overlap made one; span: start << 32 | end."""
    if not len(doc):
        return doc, span
    order = np.lexsort((span, doc))
    doc, low, end = doc[order], span[order] >> 32, span[order] & 0xFFFFFFFF
    # ends so far, in their document: documents are set apart by an offset
    place = np.cumsum(np.append(False, doc[1:] != doc[:-1])).astype(np.int64) << 33
    far = np.maximum.accumulate(place + end)
    new = np.append(True, place[1:] + low[1:] > far[:-1])
    at = np.flatnonzero(new)
    return doc[at], low[at] << 32 | (far[np.append(at[1:], len(doc)) - 1] - place[at])


COVERED = -1


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(a, x, doc_id, span) of all records, those of a task reduced to the first of a class.

    Rows with x = COVERED are intervals that are known to repeat; their a is arbitrary.
    """

    def block(ids: list[int], bases: list[int], texts: list[bytes]) -> pa.RecordBatch:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        owner, low, end, a, x = records(np.frombuffer(b"".join(texts), np.uint8), starts, ends)
        doc = np.array(ids, np.int64)[owner]
        shift = np.array(bases, np.int64)[owner] - starts[owner]
        span = low + shift << 32 | end + shift
        x = np.where(x == np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0), x)
        a, x, doc, span, first = _firsts(a.view(np.int64), x.view(np.int64), doc, span)
        more, spans = _merged(doc[~first], span[~first])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([a[first], spans * 0x9E3779B1 ^ more])),
                pa.array(np.concatenate([x[first], np.full(len(more), COVERED)])),
                pa.array(np.concatenate([doc[first], more])),
                pa.array(np.concatenate([span[first], spans])),
            ],
            ["a", "x", "doc_id", "span"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bases, texts, held = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                # a long text comes in pieces, each with the windows that start in it
                for at in range(0, len(data) - WINDOW + 1, BLOCK):
                    ids.append(doc_id)
                    bases.append(at)
                    texts.append(data[at : at + BLOCK + WINDOW - 1])
                    held += len(texts[-1])
                    if held >= BLOCK:
                        yield block(ids, bases, texts)
                        ids, bases, texts, held = [], [], [], 0
        if ids:
            yield block(ids, bases, texts)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, _ROWS)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, x, doc_id, span): intervals covered whole, and first records of anchors with several classes.

    Holds one row between batches.
    """
    last_a = last_x = pending = None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, x, doc, span = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        known = x == COVERED
        out_doc, out_span, out_a, out_kind = [doc[known]], [span[known]], [a[known]], [np.zeros(known.sum(), np.int8)]
        a, x, doc, span = a[~known], x[~known], doc[~known], span[~known]
        if len(a):
            new_a, new_x = np.ones(len(a), bool), np.ones(len(a), bool)
            new_a[1:] = a[1:] != a[:-1]
            new_a[0] = a[0] != last_a
            new_x[1:] = new_a[1:] | (x[1:] != x[:-1])
            new_x[0] = new_a[0] or x[0] != last_x
            again = ~new_x
            out_doc.append(doc[again]), out_span.append(span[again]), out_a.append(a[again]), out_kind.append(np.zeros(again.sum(), np.int8))
            # classes of each anchor in this batch
            at = np.flatnonzero(new_x)
            if len(at):
                own = a[at]
                run_start = np.ones(len(at), bool)
                run_start[1:] = own[1:] != own[:-1]
                group = np.cumsum(run_start) - 1
                many = np.bincount(group)[group] > 1
                goes_on = (own == last_a) & (group == 0) if last_a is not None else np.zeros(len(at), bool)
                many |= goes_on
                if pending is not None and goes_on.any():
                    for column, value in zip((out_a, out_doc, out_span), pending, strict=True):
                        column.append(np.array([value], np.int64))
                    out_kind.append(np.ones(1, np.int8))
                    pending = None
                chosen = at[many]
                out_doc.append(doc[chosen]), out_span.append(span[chosen]), out_a.append(a[chosen]), out_kind.append(np.ones(len(chosen), np.int8))
                # the last anchor may go on in the next batch
                pending = None if many[-1] else (int(a[at[-1]]), int(doc[at[-1]]), int(span[at[-1]]))
            last_a, last_x = a[-1], x[-1]
        kind = np.concatenate(out_kind)
        if len(kind):
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind), *[pa.array(np.concatenate(c).astype(np.int64)) for c in (out_a, out_doc, out_span)]],
                ["kind", "a", "doc_id", "span"],
            )


# ---- two-stage suffix sorting ------------------------------------------------------


def two_stage_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of `text` (numbers from 0; the last one is 0 and the only 0) in order of their first `depth` numbers.

    Suffixes that share these stand together. Type S: smaller than the next suffix.
    """
    n = len(text)
    # a suffix is of type S if its first number is less than the next that differs
    up = np.zeros(n, bool)
    differs = np.flatnonzero(text[1:] != text[:-1])
    rises = text[differs + 1] > text[differs]
    ends = np.append(differs, n - 1)
    up = np.repeat(np.append(rises, False), np.diff(np.append(-1, ends)))
    small = np.flatnonzero(up)
    # stage one: sort these alone, by eight numbers at a time
    padded = np.zeros(n + depth + 64, np.uint64)
    padded[:n] = text
    words = np.zeros(n + depth, np.uint64)
    bits = max(1, int(text.max()).bit_length())
    per = max(1, 64 // bits)
    for j in range(per):
        words |= padded[j : j + n + depth] << np.uint64(bits * (per - 1 - j))
    rank = np.zeros(len(small), np.int64)
    order = np.arange(len(small))
    for at in range(0, depth, per):
        own = words[small[order] + at]
        step = np.lexsort((own, rank))
        order, own, held = order[step], own[step], rank[step]
        new = np.ones(len(order), bool)
        new[1:] = (own[1:] != own[:-1]) | (held[1:] != held[:-1])
        rank = np.cumsum(new)
        if new.all():
            break
    small = small[order]
    # stage two: scan the buckets of first numbers; what stands there induces the suffix before it
    buckets = int(text.max()) + 1
    counts = np.bincount(text, minlength=buckets)
    start = np.concatenate([[0], np.cumsum(counts)])
    filled = start[:-1].copy()
    out = np.full(n, -1, np.int64)
    small_cuts = np.searchsorted(text[small], np.arange(buckets + 1))
    for c in range(buckets):
        own = small[small_cuts[c] : small_cuts[c + 1]]
        if c == int(text[n - 1]):  # the last suffix is of neither type: it begins its bucket
            out[filled[c]] = n - 1
            filled[c] += 1
        if len(own):
            out[start[c + 1] - len(own) : start[c + 1]] = own
        at, small_at = start[c], start[c + 1] - len(own)
        while True:
            end = filled[c] if at < filled[c] else start[c + 1] if at >= small_at else at
            if end <= at:
                break
            before = out[at:end] - 1
            at = end
            before = before[before >= 0]
            before = before[~up[before]]
            first = text[before]
            # in the order of the scan, each to the next free place of its bucket
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            held = np.bincount(first, minlength=buckets)
            inside = np.arange(len(first)) - np.repeat(np.cumsum(held)[held > 0] - held[held > 0], held[held > 0])
            out[filled[first] + inside] = before
            filled += held
            if at == filled[c] and at < small_at:
                at = small_at
    return out


def repeated_windows(spans: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of the windows of these spans (document, first byte, bytes) that an earlier one equals."""
    data = np.frombuffer(b"".join(b for _, _, b in spans), np.uint8)
    lengths = np.array([len(b) for _, _, b in spans])
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(spans)), lengths)
    # bytes become 2..257; 1 ends each span, 0 the text
    text = np.ones(len(data) + len(spans) + 1, np.int64)
    text[np.arange(len(data)) + owner] = data.astype(np.int64) + 2
    text[-1] = 0
    order = two_stage_order(text, WINDOW)
    inside = np.full(len(text), -1, np.int64)
    left = ends[owner] - np.arange(len(data))
    inside[(np.arange(len(data)) + owner)[left >= WINDOW]] = np.flatnonzero(left >= WINDOW)
    place = inside[order]
    place = place[place >= 0]  # windows, in the order of their strings
    if not len(place):
        return place, place
    view = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
    same = np.zeros(len(place), bool)
    for at in range(1, len(place), 65536):
        to = min(len(place), at + 65536)
        same[at:to] = (view[place[at:to]] == view[place[at - 1 : to - 1]]).all(axis=1)
    group = np.cumsum(~same) - 1
    docs = np.array([d for d, _, _ in spans], np.int64)[owner[place]]
    starts = (np.array([s for _, s, _ in spans], np.int64) - (ends - lengths))[owner[place]] + place
    by = np.lexsort((starts, docs, group))
    group, docs, starts = group[by], docs[by], starts[by]
    first = np.append(True, group[1:] != group[:-1])
    return docs[~first], starts[~first]


def may_repeat(anchors: list[int], spans: list[tuple[int, int, bytes]]) -> list[tuple[int, int, bytes]]:
    """The halves of these spans whose windows may have equals among the others.

    A half is told by the hash of the anchor and the 34 bytes to its left, or the 35 to its right,
    that all its windows hold. Spans without a GRAM-byte anchor (refined ones) stay whole.
    """
    left = (WINDOW - GRAM) // 2
    lengths = np.fromiter((len(b) for _, _, b in spans), np.int64, len(spans))
    data = np.frombuffer(b"".join(b for _, _, b in spans), np.uint8)
    starts = np.cumsum(lengths) - lengths
    with np.errstate(over="ignore"):
        h = gram_hashes(data)
        owner = np.repeat(np.arange(len(spans)), lengths)[: len(h)]
        at = np.flatnonzero(h.view(np.int64) == np.array(anchors, np.int64)[owner])
        place = at - starts[owner[at]]
        at = at[(place >= lengths[owner[at]] - WINDOW) & (place <= WINDOW - GRAM)]
        found, first = np.unique(owner[at], return_index=True)
        at = at[first]
        place, last = at - starts[found], lengths[found] - WINDOW
        out = [spans[i] for i in np.setdiff1d(np.arange(len(spans)), found)]
        # windows that start `left` or more before the anchor, and the others; each part by the grams that cover it
        begin = np.maximum(0, place - left + 1)
        halves_of = (
            (place >= left, (-left, GRAM - left, 0), np.zeros_like(place), np.minimum(place - left, last) + WINDOW),
            (begin <= last, (0, GRAM, WINDOW - GRAM - left + 1), begin, lengths[found]),
        )
        for there, steps, low, end in halves_of:
            i = np.flatnonzero(there)
            key = _mixed(h[at[i] + steps[0]] * np.uint64(0x9E3779B97F4A7C15) + h[at[i] + steps[1]])
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + h[at[i] + steps[2]])
            _, number, times = np.unique(key, return_inverse=True, return_counts=True)
            for k in i[times[number] > 1].tolist():
                doc, at_doc, own = spans[found[k]]
                out.append((doc, at_doc + int(low[k]), own[low[k] : end[k]]))
    return out


_FOUND = "doc_id long, span long"


def _sorted_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The covered intervals of spans that come sorted by a; whole anchors share a suffix array."""
    held: list[tuple[int, int, bytes]] = []
    anchors: list[int] = []
    size, last = 0, None

    def found() -> Iterator[pa.RecordBatch]:
        if held and (tried := may_repeat(anchors, held)):
            docs, starts = repeated_windows(tried)
            docs, span = _merged(docs, starts << 32 | starts + WINDOW)
            if len(docs):
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(span)], ["doc_id", "span"])

    for batch in batches:
        for a, doc, low, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if a != last and size >= SORTED:
                yield from found()
                held, anchors, size = [], [], 0
            last = a
            held.append((doc, low, data))
            anchors.append(a)
            size += len(data)
    yield from found()


# ---- hot anchors -------------------------------------------------------------------


def _packed(low: int, end: int, core: int, size: int) -> int:
    """A refined span: its first byte, its length, the place of the common part in it and that part's length."""
    return low << 24 | end - low << 16 | core - low << 8 | size


def halves(a: int, low: int, end: int, data: bytes, core: int, size: int) -> Iterator[tuple[int, int, int]]:
    """(a, x, packed span) of the two records that a record of a hot anchor becomes.

    The record's windows start from low to end - WINDOW of the document `data`, and all
    hold its bytes from `core` on, `size` of them (less than WINDOW).
    """
    import xxhash

    slack = WINDOW - size
    half = (slack + 1) // 2
    # a window that starts `half` or more before the part holds so many bytes to its left, any other the rest to its right
    last = min(core - half, end - WINDOW)
    parts = [(0, low, last + WINDOW, core - half, size + half)] if low <= last else []
    first = max(low, core - half + 1)
    if first <= end - WINDOW:
        parts.append((1, first, end, core, size + slack - half + 1))
    for side, s, e, c, n in parts:
        key = xxhash.xxh3_64_intdigest(data[c : c + n], seed=side)
        x = xxhash.xxh3_64_intdigest(data[s:e], seed=c - s)
        x = 0 if x == 0xFFFFFFFFFFFFFFFF else x
        yield key - (1 << 64) if key >> 63 else key, x - (1 << 64) if x >> 63 else x, _packed(s, e, c, n)


def anchor_place(a: int, low: int, end: int, data: bytes) -> int:
    """Where a record's anchor stands: the first place in all of its windows with the anchor's hash."""
    at = end - WINDOW
    with np.errstate(over="ignore"):
        h = gram_hashes(np.frombuffer(data, np.uint8, low + WINDOW - at, at)).view(np.int64)
    return at + int(np.flatnonzero(h == a)[0])


def refined_rows(own: DataFrame, first: bool) -> DataFrame:
    """(a, x, doc_id, packed span) of the halves of hot anchors' records; own: doc_id, text, spans (a, span).

    first: the spans are those of anchors (start << 32 | end), else packed ones. Of a
    task's records of a class only the first keeps x, as in anchor_rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, 64):
                rows: list[tuple[int, int, int, int]] = []
                for doc_id, text, spans in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    data = text.encode("utf-8", "surrogatepass")
                    for r in spans:
                        a, s = r["a"], r["span"]
                        if first:
                            low, end = s >> 32, s & 0xFFFFFFFF
                            core, size = anchor_place(a, low, end, data), GRAM
                        else:
                            low = s >> 24
                            end, core, size = low + (s >> 16 & 0xFF), low + (s >> 8 & 0xFF), s & 0xFF
                        rows += [(key, x, doc_id, span) for key, x, span in halves(a, low, end, data, core, size)]
                a, x, doc, span, one = _firsts(*np.array(rows, np.int64).reshape(-1, 4).T)
                x = np.where(one, x, COVERED)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a, x, doc, span)], ["a", "x", "doc_id", "span"])

    return own.mapInArrow(run, _ROWS)


# ---- the operator ------------------------------------------------------------------


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with one of these ids; the ids are broadcast only if they are few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text, spans) of the documents that have some of these spans (a, doc_id, span)."""
    listed = spans.groupBy("doc_id").agg(F.collect_list(F.struct("a", "span")).alias("spans"))
    own = _among(docs.select("doc_id", "text"), spans.select("doc_id").distinct())
    return own.join(listed, "doc_id").select("doc_id", "text", "spans")


def covered_intervals(docs: DataFrame) -> DataFrame:
    """(doc_id, span) of all repeated bytes, as start << 32 | end; docs: doc_id and text, ids unique."""
    small_batches(docs.sparkSession)
    rows, whole, covered, few = anchor_rows(docs), True, [], []
    while True:
        sorted_rows = rows.repartition("a").sortWithinPartitions("a", "x", "doc_id", "span")
        met = written(sorted_rows.mapInArrow(_classes, "kind byte, a long, doc_id long, span long"), "repeats")
        low = F.shiftright("span", 24)
        plain = F.col("span") if whole else F.shiftleft(low, 32) + low + F.shiftright("span", 16).bitwiseAND(0xFF)
        covered.append(met.where("kind = 0").select("doc_id", plain.alias("span")))
        firsts = met.where("kind = 1").select("a", "doc_id", "span")
        hot = durable(firsts.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > SPANS).select("a"))
        n_hot = hot.limit(BROADCAST_IDS + 1).count()
        if not n_hot:
            few.append(firsts.select("a", "doc_id", plain.alias("span")))
            break
        hot = F.broadcast(hot) if n_hot <= BROADCAST_IDS else hot
        few.append(firsts.join(hot, "a", "left_anti").select("a", "doc_id", plain.alias("span")))
        rows, whole = refined_rows(_with_spans(docs, firsts.join(hot, "a", "left_semi")), whole), False

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, 64):
                out: tuple[list, ...] = ([], [], [], [])
                for doc_id, text, spans in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    data = text.encode("utf-8", "surrogatepass")
                    for s in spans:
                        low, end = s["span"] >> 32, s["span"] & 0xFFFFFFFF
                        for column, value in zip(out, (s["a"], doc_id, low, data[low:end]), strict=True):
                            column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["a", "doc_id", "low", "data"])

    spans = _with_spans(docs, reduce(DataFrame.union, few)).mapInArrow(cut, "a long, doc_id long, low long, data binary")
    found = written(spans.repartition("a").sortWithinPartitions("a").mapInArrow(_sorted_spans, _FOUND), "windows")
    return reduce(DataFrame.union, [*covered, found])


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _keyed(own: DataFrame) -> DataFrame:
    """The rows with their id as `id`, and in doc_id a key of each row in the order of (id, text, position).

    Unique ids are their own keys, and their texts are not moved.
    """
    again = own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if not again.limit(1).count():
        return own.withColumn("id", F.col("doc_id"))
    order = ("id", "text", "at")
    placed = own.select(F.col("doc_id").alias("id"), "text", F.monotonically_increasing_id().alias("at"))
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranged.select(F.monotonically_increasing_id().alias("doc_id"), "text", "id"), "keyed")


def deduplicate(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    own = _keyed(id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long")))
    covered = covered_intervals(own)
    listed = durable(covered.groupBy("doc_id").agg(F.collect_list("span").alias("spans")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                merged = _merged(np.zeros(len(spans), np.int64), np.array(spans.values, np.int64))[1]
                kept, at, removed = hashlib.sha256(), 0, 0
                for s in merged.tolist():
                    low, end = s >> 32, s & 0xFFFFFFFF
                    kept.update(data[at:low])
                    at, removed = end, removed + end - low
                kept.update(data[at:])
                out.append((doc_id, len(data), removed, len(merged), kept.hexdigest()))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), r, strict=True)) for r in out],
                schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]),
            )

    ids = listed.select("doc_id")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    ids = F.broadcast(ids) if few else ids
    hit = own.join(ids, "doc_id", "left_semi").join(listed, "doc_id").select("id", "text", "spans").mapInArrow(cut, _RESULT)
    whole = own.join(ids, "doc_id", "left_anti").select(
        F.col("id").alias("doc_id"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )
    return hit.union(whole)
