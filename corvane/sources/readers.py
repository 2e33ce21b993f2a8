"""Sources beyond tables: manifests, markup, dictionaries, binary columns, pages of text."""

from __future__ import annotations

import html
import io
import re
import struct
import xml.etree.ElementTree as ET
from collections.abc import Callable, Hashable, Iterator
from concurrent.futures import Future
from threading import Lock

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "work string, book int, segment string, line_ord int, n int, sub string, text string"
CHUNKS = "work string, id string, text string, notes array<struct<offset:int,text:string>>"


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def manifests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Manifests (one small YAML file a work) as rows; a public variant beside a file replaces it. Files are read by tasks."""
    kinds = "path string, work string, public boolean, books array<struct<n:int,start:string,end:string>>, expected_gaps array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                m = yaml.safe_load(bytes(data).decode("utf-8")) or {}
                books = [(int(b["n"]), str(b.get("start", "")), str(b.get("end", ""))) for b in m.get("books", [])]
                rows.append((path, str(m.get("work", "")), ".public." in path, books, [str(g) for g in m.get("expected_line_gaps", [])]))
            yield pd.DataFrame(rows, columns=["path", "work", "public", "books", "expected_gaps"])

    found = _files(spark, paths).mapInPandas(run, kinds)
    best = found.groupBy("work").agg(F.max(F.struct("public", "path")).alias("b")).select("work", "b.path")
    return found.join(best, ["work", "path"])


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def spine_rows(work: str, data: bytes) -> list[tuple]:
    """Lines of a text with page divisions: (work, book, segment, line_ord, n, sub, text).

    A line number such as 5a has the suffix apart; a range such as 3-4 is one row for each number,
    its words dealt out evenly; headings are left out.
    """
    rows, book, segment, order = [], 1, "", 0

    def walk(node) -> None:
        nonlocal book, segment, order
        tag = _local(node.tag)
        if tag == "div" and node.get("type") == "book":
            book = int(node.get("n", book))
        if tag == "div" and node.get("type") == "page" or tag == "pb":
            segment, order = node.get("n", ""), 0
        if tag == "head":
            return
        if tag == "l":
            text = " ".join("".join(node.itertext()).split())
            label = node.get("n", "")
            if m := re.fullmatch(r"(\d+)-(\d+)", label):
                numbers = list(range(int(m[1]), int(m[2]) + 1))
                words = text.split(" ")
                for k, n in enumerate(numbers):
                    cut = [len(words) * (k + d) // len(numbers) for d in (0, 1)]
                    rows.append((work, book, segment, order, n, None, " ".join(words[cut[0] : cut[1]])))
                    order += 1
            else:
                m = re.fullmatch(r"(\d+)([a-z]?)", label)
                rows.append((work, book, segment, order, int(m[1]) if m else None, (m[2] or None) if m else None, text))
                order += 1
            return
        for child in node:
            walk(child)

    walk(ET.fromstring(data))
    return rows


def chunk_rows(work: str, data: bytes) -> list[tuple]:
    """Prose cut at milestones: (work, id, text, notes), notes with their offset in the text."""
    found: list[tuple] = []
    text, notes, name = [], [], ""

    def size() -> int:
        return len(" ".join("".join(text).split()))

    def end() -> None:
        plain = " ".join("".join(text).split())
        if plain or notes:
            found.append((work, name, plain, list(notes)))
        text.clear()
        notes.clear()

    def walk(node) -> None:
        nonlocal name
        tag = _local(node.tag)
        if tag == "milestone":
            end()
            name = node.get("n", "")
        elif tag == "note":
            notes.append((size(), " ".join("".join(node.itertext()).split())))
        else:
            text.append(node.text or "")
            for child in node:
                walk(child)
                text.append(child.tail or "")
            if tag in ("p", "head", "div"):
                text.append(" ")

    walk(ET.fromstring(data))
    end()
    return found


def markup(spark: SparkSession, path: str, kind: str = "lines") -> DataFrame:
    """Rows of XML files, one task a file: `lines` of a spine or `chunks` of prose; the work is the file's name."""
    schema, parse = {"lines": (LINES, spine_rows), "chunks": (CHUNKS, chunk_rows)}[kind]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, data in zip(pdf["path"], pdf["content"], strict=True) for r in parse(re.sub(r"\.[^.]*$", "", p.rsplit("/", 1)[-1]), bytes(data))]
            yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def dictionary(spark: SparkSession, path: str, needed: DataFrame | None = None) -> DataFrame:
    """A tab-separated dictionary (key, entry); with `needed` (key), only those keys' rows, by a semi join."""
    rows = spark.read.csv(path, sep="\t", schema="key string, entry string", quote="")
    return rows if needed is None else rows.join(needed.select("key").distinct(), "key", "left_semi")


_ANALYSIS = r"\{(\d+) \d+ ([^\t{}]*)\t([^\t{}]*)\t([^\t{}]*)\}"


def analyses(rows: DataFrame) -> DataFrame:
    """(key, ord, lemma_id, form, gloss, parse) of entries of the form {id n form<tab>gloss<tab>parse}..."""
    group = lambda k: F.regexp_extract_all("entry", F.lit(_ANALYSIS), F.lit(k))
    zipped = F.arrays_zip(group(1).alias("id"), group(2).alias("form"), group(3).alias("gloss"), group(4).alias("parse"))
    each = rows.select("key", F.posexplode(zipped).alias("ord", "a"))
    return each.select("key", "ord", F.col("a.id").cast("int").alias("lemma_id"), "a.form", "a.gloss", "a.parse")


def fragment_entries(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """Lexicon entries (key, body) of a file of fragments, one entry a line; with keys, those only."""
    lines = spark.read.text(path).select(F.regexp_extract("value", r'<entryFree[^>]*\bkey="([^"]*)"', 1).alias("key"), F.col("value").alias("body"))
    lines = lines.where("key <> ''")
    return lines if keys is None else lines.join(keys.select("key").distinct(), "key", "left_semi")


def packed_column(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(path, off, value) of files of little-endian unsigned integers of 2 or 4 bytes."""
    code = {2: "H", 4: "I"}[width]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                values = [v for (v,) in struct.iter_unpack(f"<{code}", bytes(data))]
                yield pd.DataFrame({"path": p, "off": range(len(values)), "value": values})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, off long, value long")


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text) of text files whose pages end with a form feed."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.select("path", F.posexplode(F.split("value", "\f")).alias("page", "text")).where(F.trim("text") != "")


def json_artefacts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Many small JSON files of a known schema, with the file of each row."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("file", F.input_file_name())


def located_anchors(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Anchor phrases (id, phrase) found in their chunk's text (id, text): the offset and how it was found.

    The whole phrase is tried, then its first 8, 6, 5 and 4 words, with any white space between
    words; without a match the anchor is at the end of the chunk.
    """
    joined = anchors.join(chunks, "id")
    tried = []
    for n in (10_000, 8, 6, 5, 4):
        words = F.slice(F.split("phrase", r"\s+"), 1, n)
        pattern = F.array_join(F.transform(words, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), r"\s+")
        at = F.regexp_instr("text", pattern) - 1
        tried.append(F.when(at >= 0, F.struct(at.alias("offset"), F.lit("phrase" if n > 8 else f"first {n}").alias("tier"))))
    end = F.struct(F.length("text").alias("offset"), F.lit("end").alias("tier"))
    return joined.withColumn("f", F.coalesce(*tried, end)).select("id", "phrase", "f.offset", "f.tier")


def marked_prose(spark: SparkSession, path: str) -> DataFrame:
    """Sections of Markdown files: (path, section, title, text, notes), [^n] marks taken out of the text."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    body = F.regexp_replace("value", r"(?m)^\[\^[^\]]+\]:.*$", "")
    notes = F.regexp_extract_all("value", F.lit(r"(?m)^\[\^[^\]]+\]:\s*(.*)$"), F.lit(1))
    parts = files.select("path", notes.alias("notes"), F.posexplode(F.split(body, r"(?m)^#+\s+")).alias("section", "part"))
    title = F.when(F.col("section") > 0, F.trim(F.substring_index("part", "\n", 1)))
    text = F.when(F.col("section") > 0, F.regexp_replace("part", r"^[^\n]*\n?", "")).otherwise(F.col("part"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, r"\[\^[^\]]+\]", ""), r"\s+", " "))
    return parts.select("path", "section", title.alias("title"), plain.alias("text"), "notes").where("title IS NOT NULL OR text <> ''")


def tagged_records(data: bytes, tags: tuple[bytes, ...] = (b"wrk", b"dat", b"typ"), reach: int = 400) -> list[dict[str, str]]:
    """Records of a binary file of fields `tag value`, each record from its first tag on within `reach` bytes."""
    rows, stream = [], io.BytesIO(data).getvalue()
    starts = [m.start() for m in re.finditer(tags[0] + rb"\s+", stream)]
    for i, at in enumerate(starts):
        end = min(starts[i + 1] if i + 1 < len(starts) else len(stream), at + reach)
        part = stream[at:end]
        row = {}
        for tag in tags:
            if m := re.search(tag + rb"\s+([\x20-\x7e]+)", part):
                row[tag.decode()] = m[1].decode("ascii").strip()
        rows.append(row)
    return rows


def tagged_files(spark: SparkSession, path: str, tags: tuple[str, ...] = ("wrk", "dat", "typ")) -> DataFrame:
    """(path, record, fields) of binary files of tagged fields; fields: a map of tags to texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (p, k, record)
                for p, data in zip(pdf["path"], pdf["content"], strict=True)
                for k, record in enumerate(tagged_records(bytes(data), tuple(t.encode() for t in tags)))
            ]
            yield pd.DataFrame(rows, columns=["path", "record", "fields"])

    return _files(spark, [path]).mapInPandas(run, "path string, record long, fields map<string,string>")


# Bytes of a disc's author table, and the languages that it names by a letter.
_ENDS_AUTHOR, _ALIAS, _LANGUAGE = b"\xff", 0x80, 0x83
_LANGUAGES = {"g": "greek", "l": "latin", "h": "hebrew", "c": "coptic"}


def author_rows(data: bytes) -> list[tuple[str, str, str | None]]:
    """(id, name, language) of an author table, in its order; records of another shape are left out.

    The name ends where an alias begins; a language may be named behind it. Typographic marks
    (an ampersand with digits) are spaces.
    """
    rows = []
    for record in data.split(_ENDS_AUTHOR):
        own = re.search(rb"\x83(.)", record, re.S)
        language = _LANGUAGES.get(chr(own[1][0])) if own else None
        bare = re.sub(rb"\x83.?", b"", record, flags=re.S).split(bytes([_ALIAS]))[0]
        text = "".join(chr(b) for b in bare if 0x20 <= b < 0x7F).strip()
        m = re.fullmatch(r"([A-Z]{3}\d{4})\s+(.*)", text)
        name = " ".join(re.sub(r"&\d*", " ", m[2]).split()) if m else ""
        if name:
            rows.append((m[1], name, language))
    return rows


def disc_authors(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, name, language) of the author tables of discs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *r) for p, data in zip(pdf["path"], pdf["content"], strict=True) for r in author_rows(bytes(data))]
            yield pd.DataFrame(rows, columns=["path", "id", "name", "language"])

    return _files(spark, [path]).mapInPandas(run, "path string, id string, name string, language string")


def _flat(node, skipped) -> str:
    """The text of a node without elements that are skipped, in single spaces."""

    def parts(own) -> Iterator[str]:
        yield own.text or ""
        for child in own:
            if not skipped(child):
                yield from parts(child)
            yield child.tail or ""

    return " ".join("".join(parts(node)).split())


def chapter_rows(data: bytes) -> list[tuple[int, int, str]]:
    """(book, chapter, prose) of the chapter divisions of a text; without a book around them they are in book 1."""
    rows = []

    def walk(node, book: int) -> None:
        if _local(node.tag) == "div":
            kind, n = node.get("subtype"), node.get("n") or ""
            if kind == "book" and n.isdigit():
                book = int(n)
            elif kind == "chapter" and n.lstrip("-").isdigit():
                if prose := _flat(node, lambda c: _local(c.tag) in ("note", "bibl", "head")):
                    rows.append((book, int(n), prose))
        for child in node:
            walk(child, book)

    body = next((e for e in ET.fromstring(data).iter() if _local(e.tag) == "body"), None)
    if body is None:
        raise ValueError("no body in the text")
    walk(body, 1)
    return rows


def export_rows(data: bytes) -> list[tuple[int, str, str]]:
    """(n, place, text) of the lines of a verse export. Notes, references and small print, which cite others, are no text.

    A place is page and section, else book and line, else the fragment, else the line alone.
    """
    rows: list[tuple[int, str, str]] = []
    levels = {"Book": "book", "Stephanus-page": "page", "section": "section", "Fragment": "fragment"}
    skipped = lambda c: _local(c.tag) in ("note", "bibl") or _local(c.tag) == "hi" and (c.get("rend") or "").lower() == "small"

    def walk(node, at: dict[str, str]) -> None:
        n = node.get("n") or ""
        if _local(node.tag) == "div" and node.get("type") in levels:
            at = at | {levels[node.get("type")]: n}
        if _local(node.tag) == "l" and re.fullmatch(r"[0-9]+", n):
            place = at["page"] + at["section"] if at["page"] and at["section"] else f"{at['book']}.{n}" if at["book"] else at["fragment"] or n
            rows.append((int(n), place, " ".join(_flat(node, skipped).replace("|", "").split())))
        for child in node:
            walk(child, at)

    walk(ET.fromstring(data), dict.fromkeys(levels.values(), ""))
    return rows


def _parsed(spark: SparkSession, path: str, rows_of, kinds: str, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *r) for p, data in zip(pdf["path"], pdf["content"], strict=True) for r in rows_of(bytes(data))]
            yield pd.DataFrame(rows, columns=["path", *names])

    return _files(spark, [path]).mapInPandas(run, f"path string, {kinds}")


def chapter_prose(spark: SparkSession, path: str) -> DataFrame:
    """(path, book, chapter, prose) of texts with chapter divisions."""
    return _parsed(spark, path, chapter_rows, "book int, chapter int, prose string", ["book", "chapter", "prose"])


def export_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, place, text) of verse exports."""
    return _parsed(spark, path, export_rows, "n int, place string, text string", ["n", "place", "text"])


# fixed values: how an archive's pages mark chapters, their furniture, and where their text ends
CHAPTER_MARKERS = {"number": r"([0-9]{1,2})", "part": r"Part\s+([0-9]{1,3})", "part_roman": r"Part\s+([IVXLC]+)"}
INLINE_TAGS = "a span i b em strong sup sub font".split()
FURNITURE = [r"-?\bTHE\s+END\b-?", r"Table\s+of\s+Contents", r"Browse\s+and\s+Comment", r"Buy\s+Books(?:\s+and\s+CD-ROMs)?", r"©\s*[0-9]{4}(?:\s*-\s*[0-9]{4})?"]
MENU_WORDS = ("Home", "Search", "Help")
TEXT_ENDS = (r"Commentary:", r"How\s+to\s+cite")
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}

#: A blank line ends a paragraph only behind the end of a sentence: some pages have one behind every wrapped line.
_PARAGRAPH_END = re.compile(r"""([.?!:]["'’”)\]]?)\n{2,}""")


def _number(numeral: str) -> int:
    if numeral.isdigit():
        return int(numeral)
    values = [ROMAN[c] for c in numeral]
    return sum(-v if v < max(values[k:]) else v for k, v in enumerate(values))


def _archive_lines(data: bytes) -> list[str]:
    """The text lines of an archive's page from its translator's line on, without menus and repeated page heads."""
    page = re.sub(r"(?is)<(script|style)\b.*?</\1>", "", data.decode("utf-8", errors="replace"))
    body = re.search(r"(?is)<body.*?</body>", page)
    # wrapped lines begin with an anchor, so inline tags are no line breaks; all others are
    text = re.sub(rf"(?i)</?(?:{'|'.join(INLINE_TAGS)})\b[^>]*>", "", body[0] if body else page)
    text = html.unescape(re.sub(r"<[^>]+>", "\n", text))
    # what is left of page-number templates whose attributes hold a closing bracket
    text = re.sub(r'(?s)[\s",\[\]]*\{"template":.*?>\s*', " ", text)
    text = text[max(text.find("Translated by"), 0) :]
    for end in TEXT_ENDS:
        if found := re.compile(end).search(text, 200):
            text = text[: found.start()]
    text = re.sub("|".join(FURNITURE), "", text)
    lines: list[str] = []
    menu: list[str] = []
    for k, line in enumerate(x.strip() for x in text.split("\n")):
        if line in MENU_WORDS or menu and not line:
            menu.append(line)
            continue
        if sum(map(bool, menu)) < 2:  # such a word alone is text
            lines += menu
        menu = []
        if not (k and re.match(r"Translated\s+by", line)):
            lines.append(line)
    return lines if sum(map(bool, menu)) > 1 else lines + menu


def archive_rows(data: bytes, marker: str = "number") -> list[tuple[int, str]]:
    """(chapter, prose) of an archive's page. A chapter begins at a line that is its marker, if it is the next one due.

    Lines are joined by spaces and a line break ends a paragraph. Quotation marks that verse repeats are kept.
    """
    pattern = re.compile(CHAPTER_MARKERS[marker])
    chapters: list[list[str]] = []
    for line in _archive_lines(data):
        found = pattern.fullmatch(line)
        if found and _number(found[1]) == len(chapters) + 1:
            chapters.append([])
        elif chapters:
            chapters[-1].append(line)
    prose = []
    for lines in chapters:
        text = "\n".join([*lines, ""]).lstrip("\n")
        prose.append("\n".join(" ".join(p.split()) for p in _PARAGRAPH_END.sub("\\1\0", text).split("\0")))
    return list(enumerate(prose, 1))


def archive_chapters(spark: SparkSession, path: str, marker: str = "number") -> DataFrame:
    """(path, chapter, prose) of an archive's pages, one a book."""
    return _parsed(spark, path, lambda data: archive_rows(data, marker), "chapter int, prose string", ["chapter", "prose"])


class Once:
    """Calls `load` once for each key; others who ask meanwhile wait for the same call. One that fails is forgotten, so the next asks again."""

    def __init__(self, load: Callable):
        self._load, self._held, self._lock = load, {}, Lock()

    def __call__(self, key: Hashable):
        with self._lock:
            held = self._held.get(key)
            first = held is None
            if first:
                held = self._held[key] = Future()
        if first:
            try:
                held.set_result(self._load(key))
            except BaseException as e:
                with self._lock:
                    if self._held.get(key) is held:
                        del self._held[key]
                held.set_exception(e)
        return held.result()

    def forget(self, wanted: Callable = lambda key: True) -> None:
        with self._lock:
            self._held = {k: v for k, v in self._held.items() if not wanted(k)}


def index_files(spark: SparkSession, folder: str, columns: list[str] | None = None) -> Once:
    """The Parquet files of a folder by name, each opened when first asked for; of a file only `columns` are read."""

    def load(name: str) -> DataFrame:
        found = spark.read.parquet(f"{folder}/{name}.parquet")
        return found.select(*columns) if columns else found

    return Once(load)
