"""Readers and writers on files made here."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from corvane.sources import readers, writers


def test_manifests_prefer_the_public_variant(spark, tmp_path):
    (tmp_path / "EN.yaml").write_text("work: EN\nbooks: [{n: 1, start: a, end: b}]\nexpected_line_gaps: ['5']\n")
    (tmp_path / "EN.public.yaml").write_text("work: EN\nbooks: []\n")
    (tmp_path / "MA.yaml").write_text("work: MA\n")
    found = readers.manifests(spark, [str(tmp_path)]).collect()
    assert {(r.work, r.public) for r in found} == {("EN", True), ("MA", False)}


def test_spine_and_chunks(spark, tmp_path):
    (tmp_path / "W.xml").write_text(
        '<t><div type="book" n="1"><div type="page" n="4b"><head>No</head><l n="4">one  two</l><l n="5a">three</l><l n="6-7">a b c d</l></div></div></t>'
    )
    rows = readers.markup(spark, str(tmp_path / "W.xml")).orderBy("line_ord").collect()
    assert [(r.work, r.book, r.segment, r.n, r["sub"], r.text) for r in rows] == [
        ("W", 1, "4b", 4, None, "one two"),
        ("W", 1, "4b", 5, "a", "three"),
        ("W", 1, "4b", 6, None, "a b"),
        ("W", 1, "4b", 7, None, "c d"),
    ]
    (tmp_path / "P.xml").write_text('<t><p><milestone n="1"/>Some <note>x y</note>prose. <milestone n="2"/>More.</p></t>')
    rows = readers.markup(spark, str(tmp_path / "P.xml"), "chunks").orderBy("id").collect()
    assert [(r.id, r.text) for r in rows] == [("1", "Some prose."), ("2", "More.")]
    assert rows[0].notes[0].text == "x y"


def test_dictionary_keeps_needed_keys(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("lo/gos\t{12 9 lo/gos\tword\tmasc nom sg}{13 9 lo/gos2\tlogue\tneut}\nkai/\t{1 9 kai/\tand\tconj}\n".replace("\t{", "\x00", 2).replace("\x00", "\t{"))
    needed = spark.createDataFrame([("lo/gos",)], "key string")
    assert [r.key for r in readers.dictionary(spark, str(tmp_path / "d.tsv"), needed).collect()] == ["lo/gos"]
    rows = spark.createDataFrame([("k", "{12 9 lo/gos\tword\tmasc nom sg}{13 9 lo/gos2\tlogue\tneut}")], "key string, entry string")
    assert [(r.ord, r.lemma_id, r.form, r.gloss, r.parse) for r in readers.analyses(rows).orderBy("ord").collect()] == [
        (0, 12, "lo/gos", "word", "masc nom sg"),
        (1, 13, "lo/gos2", "logue", "neut"),
    ]


def test_binary_and_text_files(spark, tmp_path):
    (tmp_path / "c.bin").write_bytes(struct.pack("<3H", 7, 0, 65535))
    assert [r.value for r in readers.packed_column(spark, str(tmp_path / "c.bin"), 2).orderBy("off").collect()] == [7, 0, 65535]
    (tmp_path / "p.txt").write_text("one\ftwo\f")
    assert [(r.page, r.text) for r in readers.text_pages(spark, str(tmp_path / "p.txt")).orderBy("page").collect()] == [(0, "one"), (1, "two")]
    (tmp_path / "l.xml").write_text('<entryFree id="1" key="a">A</entryFree>\n<entryFree key="b">B</entryFree>\nrest\n')
    assert [r.key for r in readers.fragment_entries(spark, str(tmp_path / "l.xml")).orderBy("key").collect()] == ["a", "b"]
    assert readers.tagged_records(b"wrk Alpha  \x00dat 4 B.C.\x00wrk Other\x00") == [{"wrk": "Alpha", "dat": "4 B.C."}, {"wrk": "Other"}]


def test_anchors_fall_back_to_shorter_phrases(spark):
    chunks = spark.createDataFrame([("c", "It was  the best of times it was the worst")], "id string, text string")
    anchors = spark.createDataFrame([("c", "the best of"), ("c", "the best of times but then not"), ("c", "nowhere at all to be")], "id string, phrase string")
    found = {r.phrase: (r.offset, r.tier) for r in readers.located_anchors(anchors, chunks).collect()}
    assert found == {"the best of": (8, "phrase"), "the best of times but then not": (8, "first 4"), "nowhere at all to be": (42, "end")}


def test_marked_prose(spark, tmp_path):
    (tmp_path / "m.md").write_text("# One\nText[^1] here.\n\n# Two\nMore.\n[^1]: A note.\n")
    rows = readers.marked_prose(spark, str(tmp_path / "m.md")).orderBy("section").collect()
    assert [(r.title, r.text) for r in rows] == [("One", "Text here."), ("Two", "More.")]
    assert rows[0].notes == ["A note."]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("alpha", 1), ("Beta", 2), ("7", 3)], "key string, n int")
    writers.by_letter(df, str(tmp_path / "shards"), "key")
    assert {p.name for p in (tmp_path / "shards").iterdir() if p.is_dir()} == {"shard=a", "shard=b", "shard=_"}
    new = writers.merged(df, spark.createDataFrame([("alpha", 9)], "key string, n int"), "key")
    assert {(r.key, r.n) for r in new.collect()} == {("alpha", 9), ("Beta", 2), ("7", 3)}
    writers.spreadsheet_csv(df.coalesce(1), str(tmp_path / "csv"))
    (part,) = [p for p in (tmp_path / "csv").iterdir() if p.name.startswith("part")]
    assert part.read_bytes().startswith("﻿key,n\r\n".encode())
    assert writers.markdown_report(df.orderBy("n"), "T").splitlines()[4] == "| alpha | 1 |"
    path = writers.cache_path(str(tmp_path), "counts", 1, {"a": 1})
    assert path != writers.cache_path(str(tmp_path), "counts", 1, {"a": 2})
    assert writers.cached(df, path).count() == writers.cached(df.where(F.lit(False)), path).count() == 3


def test_tagged_files_and_author_tables(spark, tmp_path):
    (tmp_path / "canon.bin").write_bytes(b"wrk Alpha  \x00dat 4 B.C.\x00wrk Other\x00")
    found = [(r.record, r.fields) for r in readers.tagged_files(spark, f"{tmp_path}/canon.bin").orderBy("record").collect()]
    assert found == [(0, {"wrk": "Alpha", "dat": "4 B.C."}), (1, {"wrk": "Other"})]
    table = b"ABC0086 Name&1 Phil. et Corpus&\x80Other Name\x83g\xffodd record\xff\xffLAT0001 \x83lCicero\xffLAT0002 &\xff"
    (tmp_path / "authors.dir").write_bytes(table)
    rows = [(r.id, r.name, r.language) for r in readers.disc_authors(spark, f"{tmp_path}/authors.dir").orderBy("id").collect()]
    assert rows == [("ABC0086", "Name Phil. et Corpus", "greek"), ("LAT0001", "Cicero", "latin")]


def test_chapters_and_export_lines(spark, tmp_path):
    (tmp_path / "t.xml").write_text(
        "<TEI xmlns='x'><body><div subtype='book' n='2'><div subtype='chapter' n='1'><p>One <note>n</note> two\n three</p></div><div subtype='chapter' n='x'/></div>"
        "<div subtype='chapter' n='7'><p>Alone</p></div></body></TEI>"
    )
    assert sorted((r.book, r.chapter, r.prose) for r in readers.chapter_prose(spark, f"{tmp_path}/t.xml").collect()) == [(1, 7, "Alone"), (2, 1, "One two three")]
    (tmp_path / "e.xml").write_text(
        "<d><div type='Book' n='3'><l n='4'>a|b <hi rend='small'>not</hi> c</l><l n='x'>no</l></div><div type='Fragment' n='9b'><l n='1'>f <bibl>x</bibl></l></div>"
        "<div type='Stephanus-page' n='17'><div type='section' n='a'><l n='2'>p</l></div></div><l n='5'>q</l></d>"
    )
    rows = [(r.n, r.place, r.text) for r in readers.export_lines(spark, f"{tmp_path}/e.xml").orderBy("n").collect()]
    assert rows == [(1, "9b", "f"), (2, "17a", "p"), (4, "3.4", "ab c"), (5, "5", "q")]


def test_the_entry_tolerates_a_missing_package_only(tmp_path):
    """Without the optional folder the entry file loads; a fault inside the folder is an error."""
    import os
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{top}/corvane", tmp_path / "corvane", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(f"{top}/__spark_entry__.py", tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len([n for n in e.queries() if n.startswith('op')]))"], cwd=tmp_path, capture_output=True, text=True)
    assert run().stdout.strip() == "0"
    (tmp_path / "corvane" / "llm").mkdir()
    (tmp_path / "corvane" / "llm" / "__init__.py").write_text("")
    assert run().stdout.strip() == "0"
    (tmp_path / "corvane" / "llm" / "registry.py").write_text("from corvane.llm import misspelt\n")
    assert run().returncode != 0


def test_archive_pages(spark, tmp_path):
    page = """<html><head><title>1</title></head><body><script>var x = 1;</script>
<h1>On Things</h1>Translated by A. B.<br>1<br><a name="1"></a>All men<a name="2"></a>
say so, e.g. in

1984
<br><br>and more. <br><br>He said: &quot;Yes.&quot;<br><br>THE END<br>Home<br>&nbsp;<br>Search<br>Help<br>
Translated by A. B.<br>Search<br>2<br>Second<br>3 things<br>7<br>end.<br>Part I<br>Commentary: none<br>3<br>lost</body></html>""".replace("Second", "Second " + "word " * 40)
    (tmp_path / "book.html").write_text(page)
    rows = readers.archive_chapters(spark, str(tmp_path / "book.html")).orderBy("chapter").collect()
    assert [(r.chapter, r.prose) for r in rows] == [
        (1, 'All men say so, e.g. in 1984 and more.\nHe said: "Yes."\nSearch'),
        (2, "Second " + "word " * 40 + "3 things 7 end. Part I"),
    ]
    parts = b"Part I<br>a.<br><br><br>Part III<br>b<br>Part II<br>c<br>Part III<br>d<br>Part IV<br>e"
    assert readers.archive_rows(parts, "part_roman") == [(1, "a.\nPart III b"), (2, "c"), (3, "d"), (4, "e")]
    assert [readers._number(n) for n in ("XLIV", "XIX", "9")] == [44, 19, 9]
    assert readers.archive_rows(b"") == readers.archive_rows(b"no chapters") == []


def test_index_files_are_opened_once_and_tried_again(spark, tmp_path):
    files = readers.index_files(spark, str(tmp_path), ["id"])
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files("a")
    spark.range(3).withColumn("x", F.lit(1)).write.parquet(str(tmp_path / "a.parquet"))
    assert files("a").columns == ["id"] and files("a") is files("a")
    held = files("a")
    files.forget(lambda key: key == "a")
    assert files("a") is not held
