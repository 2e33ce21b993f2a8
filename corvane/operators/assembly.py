"""Chapters put together from chunks of a marked text, notes numbered by book, keys to look words up by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import ENCLITICS, NO_ENCLITIC, latin_variants, lookup_variants
from corvane.plans.registry import query
from corvane.sources.tables import table


def assembled_chapters(chunks: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book, chapter, citation, text, anchors): each chapter's text with the places in it that a line is known for.

    chunks: book, col, text, ticks array<struct<n, off, real>>, sections map<chapter, off>. chapters: book, chapter, col, line.
    A chapter begins at its section in the chunk of its column; where the text lacks that column, in the last chunk
    before it, and a chapter with none before it is left out. It ends where the book's next chapter begins, or with the book.
    Anchors are the chapter's first line and the real ticks after it. Columns are numbers here and ticks' lines are cited
    as col.n. Windows over a book hold small rows only; texts are joined by (book, number of the chunk).
    """
    numbered = chunks.select("book", "col", "sections", F.row_number().over(Window.partitionBy("book").orderBy("col")).alias("i"))
    last = numbered.groupBy("book").agg(F.max("i").alias("last"))
    nothing = F.lit(None)
    both = numbered.select("book", "col", F.lit(0).alias("line"), nothing.cast("string").alias("chapter"), F.struct("i", "sections").alias("at")).unionByName(
        chapters.select("book", "col", "line", F.col("chapter").cast("string").alias("chapter"), nothing.cast(numbered.select(F.struct("i", "sections")).schema[0].dataType).alias("at"))
    )
    # a chunk stands before the chapters of its own column
    order = Window.partitionBy("book").orderBy("col", F.col("chapter").isNotNull(), "line")
    placed = both.withColumn("at", F.last("at", ignorenulls=True).over(order)).where("chapter IS NOT NULL AND at IS NOT NULL")
    start = placed.select("book", "chapter", "col", "line", F.col("at.i").alias("i"), F.coalesce(F.try_element_at("at.sections", F.col("chapter")), F.lit(0)).alias("off"))
    following = Window.partitionBy("book").orderBy("col", "line")
    spans = start.withColumn("to", F.lead(F.struct("i", "off")).over(following)).join(last, "book")
    pieces = spans.select(
        "book", "chapter", F.concat_ws(".", "col", "line").alias("citation"), F.col("i").alias("first"), "off", "to",
        F.explode(F.sequence("i", F.coalesce("to.i", "last"))).alias("i"),
    )
    texts = chunks.select("book", "col", "text", "ticks").join(numbered.select("book", "col", "i"), ["book", "col"])
    cut = pieces.join(texts, ["book", "i"]).select(
        "book", "chapter", "citation", "i", "col", "text", "ticks",
        F.when(F.col("i") == F.col("first"), F.col("off")).otherwise(0).alias("a"),
        F.when(F.col("i") == F.col("to.i"), F.col("to.off")).otherwise(F.length("text")).alias("z"),
    )
    sized = cut.withColumn("size", F.greatest(F.coalesce(F.col("z") - F.col("a"), F.lit(0)), F.lit(0)))
    own = Window.partitionBy("book", "chapter").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    based = sized.withColumn("base", F.coalesce(F.sum("size").over(own), F.lit(0)))
    met = F.filter("ticks", lambda t: t["real"] & (t["off"] >= F.col("a")) & (t["off"] < F.col("z")) & (F.col("base") + t["off"] > F.col("a")))
    cited = F.transform(
        met,
        lambda t: F.struct(
            (F.col("base") + t["off"] - F.col("a")).cast("long").alias("off"),
            F.concat_ws(".", F.col("col"), t["n"]).alias("citation"),
            F.when(t["n"] == 1, "column").otherwise("half_column").alias("tier"),
        ),
    )
    part = F.when(F.col("size") > 0, F.expr("substr(text, a + 1, size)")).otherwise("")
    whole = based.groupBy("book", "chapter", "citation").agg(
        F.array_sort(F.collect_list(F.struct("i", part.alias("part")))).alias("parts"), F.array_sort(F.flatten(F.collect_list(F.coalesce(cited, F.expr("array()"))))).alias("ticks")
    )
    opening = F.array(F.struct("citation", F.lit(0).cast("long").alias("off"), F.lit("chapter").alias("tier")))
    rest = F.transform("ticks", lambda t: F.struct(t["citation"].alias("citation"), t["off"].alias("off"), t["tier"].alias("tier")))
    return whole.select("book", "chapter", "citation", F.array_join("parts.part", "").alias("text"), F.concat(opening, rest).alias("anchors"))


@query(
    "aln06_assembled_chapters",
    """WITH c AS (SELECT conv_id book, turn col, text, length(text) // 3 o FROM conversations WHERE role = 'assistant'),
    s AS (SELECT h.conv_id book, h.turn t, max(c.col) s FROM conversations h JOIN c ON c.book = h.conv_id AND c.col <= h.turn WHERE h.role = 'user' GROUP BY 1, 2),
    n AS (SELECT *, lead(s) OVER w e, lead(t) OVER w et FROM s WINDOW w AS (PARTITION BY book ORDER BY t)),
    p AS (SELECT n.book, n.t, c.col, c.text, CASE WHEN c.col = s AND s + 1 = t THEN o ELSE 0 END a,
        CASE WHEN c.col = e THEN CASE WHEN e + 1 = et THEN o ELSE 0 END ELSE length(c.text) END z
        FROM n JOIN c ON c.book = n.book AND c.col >= s AND c.col <= coalesce(e, c.col)),
    r AS (SELECT *, sum(greatest(z - a, 0)) OVER (PARTITION BY book, t ORDER BY col) - greatest(z - a, 0) base FROM p),
    k AS (SELECT book, t, col, u.n, base + u.off - a off FROM r, (VALUES (1, 0), (5, 100)) u(n, off) WHERE u.off >= a AND u.off < z AND base + u.off > a),
    g AS (SELECT book, t, string_agg(col || '.' || n || '@' || off::BIGINT, ' ' ORDER BY off) ticks FROM k GROUP BY 1, 2),
    x AS (SELECT book, t, string_agg(substr(text, (a + 1)::BIGINT, greatest(z - a, 0)::BIGINT), '' ORDER BY col) text FROM r GROUP BY 1, 2)
    SELECT x.book, x.t::VARCHAR chapter, x.text, x.t || '.0@0' || coalesce(' ' || ticks, '') anchors FROM x LEFT JOIN g ON g.book = x.book AND g.t = x.t""",
)
def aln06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers are chunks and questions chapters: a question's column is missing, so it begins a third into the answer before it."""
    said = table(spark, sf_dir, "conversations")
    ticks = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(off).alias("off"), F.lit(real).alias("real")) for n, off, real in ((1, 0, True), (5, 100, True), (10, 200, False))))
    third = F.floor(F.length("text") / 3).cast("int")
    chunks = said.where("role = 'assistant'").select(
        F.col("conv_id").alias("book"), F.col("turn").alias("col"), "text", ticks.alias("ticks"), F.create_map((F.col("turn") + 1).cast("string"), third).alias("sections")
    )
    chapters = said.where("role = 'user'").select(F.col("conv_id").alias("book"), F.col("turn").cast("string").alias("chapter"), F.col("turn").alias("col"), F.lit(0).alias("line"))
    shown = F.array_join(F.transform("anchors", lambda a: F.concat(a["citation"], F.lit("@"), a["off"])), " ")
    return assembled_chapters(chunks, chapters).select("book", "chapter", "text", shown.alias("anchors"))


def notes_by_book(cited: DataFrame) -> DataFrame:
    """(note, label): notes that are numbered straight through, numbered anew in each book in the order of their first citation.

    cited: book, chapter, pos, note. A note belongs to the book that cites it first.
    """
    first = cited.groupBy("note").agg(F.min(F.struct("book", "chapter", "pos")).alias("f"))
    rank = F.row_number().over(Window.partitionBy("f.book").orderBy("f.chapter", "f.pos"))
    return first.select("note", F.concat_ws(".", "f.book", rank).alias("label"))


def uncited(defined: DataFrame, labels: DataFrame) -> DataFrame:
    """Notes that are defined but cited nowhere, so that they have no place in a book: to be reported, not lost."""
    return defined.join(labels, "note", "left_anti")


@query(
    "fn19_notes_by_book",
    """WITH l AS (SELECT conv_id book, turn chapter, regexp_extract_all(text, '[A-Z][a-z]{7,}') ks FROM conversations),
    c AS (SELECT book, chapter, unnest(ks) note, unnest(range(len(ks))) pos FROM l),
    f AS (SELECT note, min({'book': book, 'chapter': chapter, 'pos': pos}) f FROM c GROUP BY note)
    SELECT note, f.book || '.' || row_number() OVER (PARTITION BY f.book ORDER BY f.chapter, f.pos) label FROM f""",
)
def fn19_by_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long capitalised words stand for notes, conversations for books."""
    marks = F.posexplode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{7,}"), F.lit(0))).alias("pos", "note")
    return notes_by_book(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("chapter"), marks))


_WORDS = "WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) word FROM documents))"


def _distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")).distinct()


@query(
    "fn02_latin_variants",
    f"""{_WORDS}, k AS (SELECT word, lower(word) k, word <> lower(word) AND substr(word, 1, 1) <> lower(substr(word, 1, 1)) c FROM w),
    h AS (SELECT *, CASE WHEN k IN ({", ".join(f"'{w}'" for w in NO_ENCLITIC)}) THEN NULL
        {" ".join(f"WHEN k LIKE '__%{e}' THEN substr(k, 1, length(k) - {len(e)})" for e in ENCLITICS)} END h FROM k)
    SELECT word, k || coalesce(',' || h, '') || CASE WHEN c THEN ',' || upper(k[1]) || substr(k, 2) || coalesce(',' || upper(h[1]) || substr(h, 2), '') ELSE '' END tried FROM h""",
)
def fn02_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys by which each distinct word would be looked up as a Latin one."""
    return _distinct_words(spark, sf_dir).select("word", F.array_join(latin_variants(F.col("word")), ",").alias("tried"))


@query(
    "fn02_lookup_variants",
    f"""{_WORDS}, k AS (SELECT DISTINCT regexp_replace(regexp_replace(lower(word), '^h([aeiou])', '\\1('), '([aeou])i', '\\1i+') k, word <> lower(word) c FROM w),
    p AS (SELECT *, CASE WHEN contains(k, '+') THEN [k, replace(k, '+', ''), replace(k, '+', '('), replace(k, '+', ')')] ELSE [k] END v FROM k)
    SELECT k AS key, c AS capital, array_to_string(CASE WHEN c THEN list_concat(v, list_transform(v, lambda x: regexp_replace(x, '^([a-z])([()/\\\\=|+]*)', '*\\2\\1'))) ELSE v END, ',') tried FROM p""",
)
def fn02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys for words written as if in Greek: an h before a vowel as its breathing, an i after one with a diaeresis."""
    word = F.col("word")
    key = F.regexp_replace(F.regexp_replace(F.lower(word), "^h([aeiou])", "$1("), "^(.*?)([aeou])i", "$1$2i+")
    keys = _distinct_words(spark, sf_dir).select(key.alias("key"), (word != F.lower(word)).alias("capital")).distinct()
    return keys.select("key", "capital", F.array_join(lookup_variants(F.col("key"), F.col("capital")), ",").alias("tried"))
