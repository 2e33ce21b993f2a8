from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from corvane.llm import packing as K
from corvane.llm import token_frames as T
from corvane.llm.registry import tokenizer_path
from corvane.llm.tokens import encoder
from tests.llm import odd

HARD = [
    "", "  a  b\n\n c", "don't DON'T ÉCOLE Straße İstanbul ΣΑΣ áb ﬁne x y", "tab\tsep \r\n x", "a,b;c!! d?? (e) [f] 12ab ab12 é.è",
    "\n", "a\n", " a", "日本語 text, 漢字!", "<|endoftext|> <|startoftext|>x", "a <|endoftext|> b", "x<|startoftext|>y.\n<|ENDOFTEXT|>", "ǅ ÀÉ ſ ŉ", "x" * 100 + " y", "İ.", "it's I'll 'tis rock'n'roll,", "a\x1cb a\x85b",
]


@pytest.mark.parametrize(("kind", "file"), [("byte_bpe", "byte_bpe_50k.json"), ("word_bpe", "word_bpe_49k.json")])
def test_units_give_the_library_s_ids(kind, file):
    from tokenizers import Tokenizer

    own, library = encoder(kind, tokenizer_path(file)), Tokenizer.from_file(tokenizer_path(file))
    for text in [*HARD, *[t for t in odd.texts() if t]]:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.packed(text), "<u4").tolist() == want, text


def test_frames_round_trip(spark, tmp_path):
    df = odd.frame(spark)
    folder = f"file://{tmp_path}/frames"
    path = tokenizer_path("word_bpe_49k.json")
    files = T.write_token_files(df, folder, path)
    found = sorted(T.read_token_files(files, folder).collect(), key=lambda r: r.doc_id)
    encode, start = encoder("word_bpe", path).packed, 0
    for r, (doc_id, text, *_) in zip(found, odd.rows(), strict=True):
        packed = encode(text or "") + struct.pack("<I", 1)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(packed) // 4, zlib.crc32(packed))
        start += len(packed) // 4
    some = T.read_documents(folder, [0, 7, 50])
    assert {d: [ids.tolist() for ids in v] for d, v in some.items()} == {
        d: [[*np.frombuffer(encode(odd.texts()[d] or ""), "<u4").tolist(), 1]] for d in (0, 7, 50)
    }
    # plain zstandard tools read the frames and skip the rest
    import zstandard

    first = sorted(p for p in (tmp_path / "frames").iterdir() if p.suffix == ".zst")[0]
    with first.open("rb") as f:
        plain = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert len(plain) == 4 * files.orderBy("shard").first()["n_tokens"]


def test_repeated_and_null_ids_in_frames(spark, tmp_path):
    path = tokenizer_path("word_bpe_49k.json")
    rows = [(4, "a b")] * 40 + [(4, "c")] * 3 + [(None, "x y z"), (None, None), (9, None), (-3, "minus")]
    folder = f"file://{tmp_path}/again"
    files = T.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), folder, path)
    found = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in T.read_token_files(files, folder).collect())
    encode = encoder("word_bpe", path).packed
    want = sorted((d is not None, d or 0, zlib.crc32(encode(t or "") + struct.pack("<I", 1))) for d, t in rows)
    assert sorted((known, d, crc) for known, d, _, _, crc in found) == want
    by_start, at = sorted((s, n, known, d) for known, d, s, n, _ in found), 0
    for s, n, _, _ in by_start:
        assert s == at
        at += n
    assert [(known, d) for _, _, known, d in by_start] == sorted((known, d) for _, _, known, d in by_start)
    some = T.read_documents(folder, [4, 9])
    assert len(some[4]) == 43 and [ids.tolist() for ids in some[9]] == [[1]]
    # an id with many rows fills several files
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    dealt = T.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), f"{folder}-2", path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert dealt.where("n_docs > 30").count() == 0


def test_damage_is_found(tmp_path):
    path = tmp_path / "x.zst"
    with path.open("wb") as f:
        w = T.FrameWriter(f)
        for i in range(50):
            w.add(i, np.arange(i * 100, dtype="<u4").tobytes())
        w.close()
    good = path.read_bytes()
    with path.open("rb") as f:
        assert [len(b) // 4 for _, b in T.FrameReader(f).documents()] == [i * 100 for i in range(50)]
    path.write_bytes(good[:40] + bytes([good[40] ^ 1]) + good[41:])
    with path.open("rb") as f, pytest.raises(Exception):  # noqa: B017
        list(T.FrameReader(f).documents())


def test_token_files_of_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    files = T.write_token_files(odd.empty(spark), folder, tokenizer_path("word_bpe_49k.json"))
    assert files.count() == 0
    assert T.read_token_files(files, folder).count() == 0


def test_packing(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = K.pack(odd.frame(spark), path).collect()
    encode = encoder("byte_bpe", path).packed
    by_doc: dict[int, list] = {}
    by_sequence: dict[int, list] = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in enumerate(odd.texts()):
        packed = encode(text or "") + struct.pack("<I", 2)
        own = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert all(r.length == 1024 for r in own[1:])
        assert sum(r.length for r in own) == len(packed) // 4
        at = 0
        for r in own:
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(packed[4 * at : 4 * (at + r.length)]))
            at += r.length
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= 1.05 * -(-total // 1024) + 1
    assert K.pack(odd.empty(spark), path).count() == 0


def test_repeated_rows_are_packed_apart(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    rows = K.pack(df, tokenizer_path("byte_bpe_50k.json")).collect()
    assert len(rows) == 3
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3


def test_crossover_keeps_every_piece():
    import random

    rng = random.Random(0)
    sizes = {s: rng.randint(1, 9) for s in rng.sample(range(1, 100), 40)}
    a, b = K.best_fit(sizes, 100), K.best_fit(sizes, 100, sorted(sizes))
    for _ in range(20):
        for child in (K.crossover(a, b, sizes, 100, rng), K.mutated(a, sizes, 100, rng)):
            assert not any(K._left(sizes, child).values())
            assert all(sum(p) <= 100 for p in child)


def test_exact_filling_keeps_every_piece():
    import random

    rng = random.Random(1)
    sizes = {s: rng.randint(1, 9) for s in rng.sample(range(1, 101), 60)}
    for made in (K.exact_fill(sizes, 100), K.exact_fill(sizes, 100, rng), K.exact_fill({}, 100)):
        assert all(sum(p) <= 100 for p in made)
        assert not any(K._left(sizes if made else {}, made).values())


@pytest.mark.parametrize("bins", [60, 400])
def test_the_genetic_algorithm_beats_best_fit(spark, bins):
    """Threes that fill a sequence exactly: best-fit needs about a tenth more sequences than there are."""
    import random
    from collections import Counter

    rng = random.Random(bins)
    sizes: Counter[int] = Counter()
    for _ in range(bins):
        a = rng.randint(390, 500)
        b = rng.randint((1024 - a) * 42 // 100 + 1, (1024 - a) // 2)
        sizes.update((a, b, 1024 - a - b))
    plain = sum(K.best_fit(sizes, 1024).values())
    found = K.pack_sizes(spark, dict(sizes))
    assert not any(K._left(dict(sizes), found).values())
    assert sum(found.values()) <= 0.94 * plain and sum(found.values()) <= 1.03 * bins
