"""Data-quality checks: each returns the rows that violate it; none means the check is passed."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import english_words
from corvane.operators.tokens import OFF, TOK, offset_tokens, running_before, segment_bases, tokens
from corvane.plans.registry import query
from corvane.sources.tables import table


def missing_numbers(df: DataFrame, by: str, number: str) -> DataFrame:
    """Numbers that a group lacks between 1 and its largest."""
    every = df.groupBy(by).agg(F.sequence(F.lit(1), F.max(number).cast("int")).alias("__all"))
    every = every.select(by, F.explode("__all").alias(number))
    return every.join(df.select(by, F.col(number).cast("int").alias(number)), [by, number], "left_anti")


def without_exceptions(found: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Violations that no allow-list names."""
    return found.join(allowed, keys, "left_anti")


def dangling(df: DataFrame, key: str, reference: DataFrame, reference_key: str) -> DataFrame:
    """Keys that the reference table lacks."""
    known = reference.select(F.col(reference_key).alias(key)).distinct()
    return df.where(F.col(key).isNotNull()).join(known, key, "left_anti")


# The breathings, and beginnings of words in which crasis puts a breathing further in.
BREATHINGS = ("\u0313", "\u0314")
VOWELS = "αειηουω"
CRASIS = ("ἐγᾠ", "ἐγᾦ", "μεντἀ", "καλοκἀ")


def late_breathings(word: str) -> list[str]:
    """The letters that carry a breathing behind the opening of a word.

    The opening is its first two vowels at most, whatever consonants come before them, and
    ends at the first consonant behind a vowel.
    """
    found, vowels, closed, letter = [], 0, False, ""
    for c in unicodedata.normalize("NFD", word):
        if unicodedata.combining(c):
            if c in BREATHINGS and (closed or vowels > 2):
                found.append(letter)
            continue
        letter = c.lower()
        if letter in VOWELS:
            vowels += 1
        elif c.isalpha() and vowels:
            closed = True
    return found


def illegal_breathing(word: str) -> bool:
    """Whether a breathing stands behind the opening of a word."""
    return bool(late_breathings(word))


def breathing_state(word: str) -> str:
    """ok, crasis or rho (late breathings that are in order), or unexpected."""
    late = late_breathings(word)
    if not late:
        return "ok"
    if unicodedata.normalize("NFD", word).startswith(tuple(unicodedata.normalize("NFD", p) for p in CRASIS)):
        return "crasis"
    return "rho" if all(letter == "ρ" for letter in late) else "unexpected"


def breathing_states(words: Column) -> Column:
    """breathing_state of each word; null for null."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda w: None if w is None else breathing_state(w))

    return run(words)


@query(
    "dq01_missing_lines",
    """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R'),
    e AS (SELECT l_orderkey, unnest(range(1, max(l_linenumber) + 1)) l_linenumber FROM l GROUP BY 1)
    SELECT l_orderkey, l_linenumber::INT l_linenumber FROM e EXCEPT SELECT l_orderkey, l_linenumber FROM l""",
)
def dq01(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber").distinct()
    return missing_numbers(lines, "l_orderkey", "l_linenumber")


@query(
    "dq02_undeclared_gaps",
    """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R'),
    g AS (SELECT l_orderkey, l_linenumber, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) nxt FROM l)
    SELECT l_orderkey, l_linenumber, nxt FROM g WHERE nxt > l_linenumber + 1 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def dq02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps in numbering, except in groups that an allow-list names."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber").distinct()
    nxt = F.lead("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    found = lines.withColumn("nxt", nxt).where("nxt > l_linenumber + 1")
    allowed = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return without_exceptions(found, allowed, ["l_orderkey"])


@query(
    "dq03_alignment_coverage",
    """SELECT conv_id, count(*) turns, sum((role = 'user')::INT)::BIGINT asked, sum((role = 'assistant')::INT)::BIGINT answered FROM conversations
    GROUP BY 1 HAVING sum((role = 'user')::INT) <> sum((role = 'assistant')::INT)""",
)
def dq03(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = lambda r: F.sum((F.col("role") == r).cast("int"))
    counted = table(spark, sf_dir, "conversations").groupBy("conv_id")
    counted = counted.agg(F.count("*").alias("turns"), role("user").alias("asked"), role("assistant").alias("answered"))
    return counted.where("asked <> answered")


@query(
    "dq04_length_ratio_outliers",
    """WITH p AS (SELECT u.conv_id, u.turn, length(a.text)::DOUBLE / greatest(length(u.text), 1) ratio FROM conversations u JOIN conversations a
      ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
    s AS (SELECT avg(ratio) m, stddev_samp(ratio) d FROM p) SELECT conv_id, turn FROM p, s WHERE abs(ratio - m) > 1.5 * d""",
)
def dq04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of segments whose lengths stand in an unusual ratio: two figures of all pairs, then a filter."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    answers = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("n").alias("m"))
    pairs = turns.where("role = 'user'").join(answers, ["conv_id", "turn"])
    pairs = pairs.select("conv_id", "turn", (F.col("m") / F.greatest("n", F.lit(1))).alias("ratio"))
    figures = pairs.agg(F.avg("ratio").alias("mean"), F.stddev_samp("ratio").alias("sd"))
    return pairs.crossJoin(F.broadcast(figures)).where("abs(ratio - mean) > 1.5 * sd").select("conv_id", "turn")


@query(
    "dq06_chapter_collapse",
    "SELECT conv_id, turn FROM (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) nxt FROM conversations) WHERE role = 'user' AND nxt IS DISTINCT FROM 'assistant'",
)
def dq06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters without any text of their own: a start that the next start follows at once, or nothing."""
    nxt = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", nxt.alias("nxt"))
    return found.where((F.col("role") == "user") & ~F.col("nxt").eqNullSafe(F.lit("assistant"))).select("conv_id", "turn")


@query(
    "dq08_offset_geometry",
    f"""WITH {OFF} SELECT source, count(*) n, min(off) lo, max(off) hi, count(*) - 1 - max(off) defect FROM off GROUP BY source""",
)
def dq08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of a source run from 0 without holes: the defect is 0."""
    toks = offset_tokens(table(spark, sf_dir, "documents"))
    return toks.groupBy("source").agg(
        F.count("*").alias("n"), F.min("off").alias("lo"), F.max("off").alias("hi"), (F.count("*") - 1 - F.max("off")).alias("defect")
    )


@query(
    "dq09_index_parity",
    f"""WITH {TOK}, i AS (SELECT word, doc_id, pos FROM tok WHERE lang <> 'es')
    SELECT doc_id, count(*) stream, 0::BIGINT indexed FROM tok WHERE lang = 'es' GROUP BY doc_id""",
)
def dq09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments whose word stream and postings differ: the index here is one made before the Spanish documents came."""
    docs = table(spark, sf_dir, "documents")
    old = docs.where("lang <> 'es'").select("doc_id", F.posexplode(english_words(F.col("text"))).alias("pos", "word"))
    return index_parity(tokens(docs).select("doc_id", "pos", "word"), old)


def index_parity(stream: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, stream, indexed): how many rows of a segment only the stream has, and only the index.

    Both are (doc_id, pos, word). Equal rows cancel out in one aggregate, without a join.
    """
    both = stream.withColumn("side", F.lit(1)).unionByName(index.withColumn("side", F.lit(-1)))
    left = both.groupBy("doc_id", "pos", "word").agg(F.sum("side").alias("d")).where("d <> 0")
    return left.groupBy("doc_id").agg(
        F.sum(F.greatest("d", F.lit(0))).alias("stream"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("indexed")
    )


@query(
    "dq10_category_column",
    f"""WITH {TOK} SELECT doc_id, pos, length(word) % 7 sig_id FROM tok WHERE length(word) % 7 NOT BETWEEN 2 AND 5""",
)
def dq10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category ids outside the table (here: above 5), or on the two reserved ids."""
    sig = (F.length("word") % 7).cast("long")
    found = tokens(table(spark, sf_dir, "documents")).select("doc_id", F.col("pos").cast("long").alias("pos"), sig.alias("sig_id"))
    return found.where(~F.col("sig_id").between(2, 5))


#: Latin letters, the Greek ones they are written with here, and the place of the breathing that is put into a word.
_LATIN, _GREEK = "abgdezhqiklmncoprstufxyw", "αβγδεζηθικλμνξοπρστυφχψω"
_BREATHED = f"""(SELECT source, substr(g, 1, k) || '\u0313' || substr(g, k + 1) word FROM
  (SELECT source, translate(word, '{_LATIN}', '{_GREEK}') g, length(word) % 4 + 1 k FROM tok WHERE length(word) >= 4 AND NOT regexp_matches(word, '[jv'']')))"""


@query(
    "dq11_breathing_gate",
    f"""WITH {TOK}, b AS {_BREATHED},
    f AS (SELECT source, word, regexp_matches(word, '[αειηουω].*[βγδζθκλμνξπρστφχψ].*\u0313') OR regexp_matches(word, '([αειηουω].*){{3}}\u0313') late FROM b),
    s AS (SELECT source, CASE WHEN NOT late THEN 'ok' WHEN regexp_matches(word, '^(ἐγᾠ|μεντἀ|καλοκἀ)') THEN 'crasis'
      WHEN regexp_matches(word, 'ρ\u0313') THEN 'rho' ELSE 'unexpected' END state FROM f)
    SELECT source, state, count(*) n FROM s GROUP BY source, state""".replace("\u0313", "̓"),
)
def dq11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by the state of their breathings, per source; words with j or v have no Greek letter.

    The documents have no Greek, so their words are written in Greek letters, with a breathing
    behind the first to fourth. Equal words are judged once.
    """
    toks = tokens(table(spark, sf_dir, "documents")).where((F.length("word") >= 4) & ~F.col("word").rlike("[jv']"))
    counted = toks.groupBy("source", "word").agg(F.count("*").alias("c"))
    greek, k = F.translate("word", _LATIN, _GREEK), F.length("word") % 4 + 1
    breathed = F.concat(F.substr(greek, F.lit(1), k), F.lit("\u0313"), F.substr(greek, k + 1))
    judged = counted.select("source", "c", breathing_states(breathed).alias("state"))
    return judged.groupBy("source", "state").agg(F.sum("c").alias("n"))


@query(
    "dq12_preflight",
    """SELECT 'order without customer' problem, count(*) n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'line without order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'line without part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
    UNION ALL SELECT 'repeated line', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    UNION ALL SELECT 'label without document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT 'document length', count(*) FROM documents WHERE n_chars <> length(text)""",
)
def dq12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of the emitted tables: references, repeats, stated sizes."""
    orders, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    docs = table(spark, sf_dir, "documents")
    counts = [
        ("order without customer", dangling(orders, "o_custkey", table(spark, sf_dir, "customer"), "c_custkey")),
        ("line without order", dangling(line, "l_orderkey", orders, "o_orderkey")),
        ("line without part", dangling(line, "l_partkey", table(spark, sf_dir, "part"), "p_partkey")),
        ("repeated line", line.groupBy("l_orderkey", "l_linenumber").count().where("count > 1")),
        ("label without document", dangling(table(spark, sf_dir, "labels"), "doc_id", docs, "doc_id")),
        ("document length", docs.where(F.col("n_chars") != F.length("text"))),
    ]
    from corvane.operators.relations import union_all

    return union_all([found.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n") for name, found in counts])


@query(
    "dq13_dictionary_coverage",
    f"""WITH {TOK} SELECT word, count(*) n FROM tok WHERE word NOT IN (SELECT word FROM tok WHERE lang = 'en') AND length(word) >= 10 GROUP BY word HAVING count(*) >= 2""",
)
def dq13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a dictionary (here: the words of one language) lacks."""
    toks = tokens(table(spark, sf_dir, "documents"))
    counted = toks.where("length(word) >= 10").groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")
    return dangling(counted, "word", toks.where("lang = 'en'"), "word")


@query(
    "dq14_tiling",
    """WITH l AS (SELECT DISTINCT l_orderkey k, l_linenumber n FROM lineitem WHERE l_returnflag <> 'R')
    SELECT k, n, nxt FROM (SELECT k, n, lead(n) OVER (PARTITION BY k ORDER BY n) nxt FROM l) WHERE nxt <> n + 1
    UNION ALL SELECT k, min(n), NULL FROM l GROUP BY k HAVING min(n) <> 1""",
)
def dq14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divisions that do not tile their parent: a hole behind one, or a first one that does not start at its beginning."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).distinct()
    nxt = F.lead("n").over(Window.partitionBy("k").orderBy("n"))
    holes = lines.withColumn("nxt", nxt).where("nxt <> n + 1")
    late = lines.groupBy("k").agg(F.min("n").alias("n")).where("n <> 1").withColumn("nxt", F.lit(None).cast("int"))
    return holes.unionByName(late)


_LINKS = """l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) href FROM pages)"""


@query(
    "agg25_links",
    f"WITH {_LINKS} SELECT page_id, count(*) links, count(DISTINCT href) targets FROM l GROUP BY 1",
)
def agg25(spark: SparkSession, sf_dir: str) -> DataFrame:
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(hrefs).alias("href"))
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("href").alias("targets"))


@query(
    "dq15_dangling_links",
    f"""WITH {_LINKS}, t AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) path FROM pages)
    SELECT page_id, href FROM l WHERE href LIKE '/%' AND href NOT IN (SELECT path FROM t)""",
)
def dq15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links within a site that lead to no page, and text that must not leave it (none here)."""
    pages = table(spark, sf_dir, "pages")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    paths = pages.select(F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path"))
    return dangling(links.where(F.col("href").startswith("/")), "href", paths, "path").select("page_id", "href")


@query(
    "dq17_key_audit",
    """SELECT coalesce(a.k, b.k) k, a.k IS NOT NULL in_nation, b.k IS NOT NULL in_customer FROM (SELECT n_nationkey k FROM nation) a
    FULL JOIN (SELECT DISTINCT c_nationkey + 3 k FROM customer) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""",
)
def dq17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that only one of two tables has."""
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.lit(True).alias("in_nation"))
    b = table(spark, sf_dir, "customer").select((F.col("c_nationkey") + 3).alias("k")).distinct().withColumn("in_customer", F.lit(True))
    both = a.join(b, "k", "full")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return both.select("k", flag("in_nation"), flag("in_customer")).where("NOT (in_nation AND in_customer)")


@query(
    "prj03_private_columns",
    "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def prj03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public projection: private columns left out, private rows too."""
    private = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").drop("text", "n_chars").join(private, "doc_id", "left_anti")


def assert_complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, unless a row lacks one of the columns: refuse to write an incomplete table."""
    for c in columns:
        df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is missing"))).otherwise(F.col(c)))
    return df


@query("dq16_complete_manifest", "SELECT p_partkey, p_name FROM part")
def dq16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assert_complete(table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_name"])


@query(
    "dq05_names_nearby",
    """WITH n AS (SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{9,}'))) name FROM documents),
    x AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) ix FROM documents), m AS (SELECT n.*, ix FROM n JOIN x USING (doc_id))
    SELECT a.doc_id, a.name FROM m a WHERE EXISTS (SELECT 1 FROM m b WHERE b.source = a.source AND b.name = a.name AND b.ix <> a.ix AND abs(b.ix - a.ix) <= 1)""",
)
def dq05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised names that a neighbouring segment has as well."""
    docs = table(spark, sf_dir, "documents")
    names = docs.select("doc_id", "source", F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{9,}"), F.lit(0))).alias("names"))
    numbered = running_before(docs.select("doc_id", "source"), ["source"], "doc_id", F.lit(1), "ix").select("doc_id", "ix")
    flat = names.join(numbered, "doc_id").select("doc_id", "source", "ix", F.explode("names").alias("name"))
    w = Window.partitionBy("source", "name").orderBy("ix")
    near = (F.col("ix") - F.lag("ix").over(w) == 1) | (F.lead("ix").over(w) - F.col("ix") == 1)
    return flat.withColumn("near", F.coalesce(near, F.lit(False))).where("near").select("doc_id", "name")


@query(
    "dq07_character_classes",
    """SELECT lang, sum(len(regexp_extract_all(text, '[a-z]')))::BIGINT lower_case, sum(len(regexp_extract_all(text, '[A-Z]')))::BIGINT upper_case,
    sum(len(regexp_extract_all(text, '[0-9]')))::BIGINT digits FROM documents GROUP BY lang""",
)
def dq07(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.sum(F.regexp_count("text", F.lit(p)))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        count("[a-z]").alias("lower_case"), count("[A-Z]").alias("upper_case"), count("[0-9]").alias("digits")
    )


@query(
    "aln05_round_trip",
    f"""WITH {TOK} SELECT doc_id, sum(length(word))::BIGINT letters, count(*) n FROM tok GROUP BY doc_id""",
)
def aln05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream put together again has the letters of the segment: summed up from offsets, in order."""
    docs = table(spark, sf_dir, "documents")
    bases = segment_bases(docs).where("n_tokens > 0").select("doc_id")
    return tokens(docs).join(bases, "doc_id").groupBy("doc_id").agg(F.sum(F.length("word")).alias("letters"), F.count("*").alias("n"))
