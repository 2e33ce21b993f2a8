"""Text repair, glosses, titles and citations: rules on texts that leave a trace of what they did."""

from __future__ import annotations

import re
import unicodedata
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.greek import clean_token, has_sigla, signature
from corvane.operators.tokens import TOK, tokens
from corvane.plans.registry import query
from corvane.sources.tables import table

# ---- lines and hyphens -------------------------------------------------------------

#: Lines that stay apart: empty ones, list items, and lines that open with a chapter tag.
_APART = r"^\s*$|^\s*(?:[-*•]|[0-9]+\.)\s|^\s*\{[0-9]+\.[0-9]+\}"


def joined_lines(text: Column) -> Column:
    """A hard-wrapped text with its lines joined by a space, but for lines that stay apart."""

    def joined(line: Column, before: Column) -> Column:
        apart = line.rlike(_APART) | before.rlike(_APART)
        bare = F.regexp_replace(line, r"^[ \t]+", "")
        gap = F.when((bare == "") | (F.regexp_replace(before, r"[ \t\r]+$", "") == ""), "").otherwise(" ")
        return F.when(apart, F.concat(F.lit("\n"), line)).otherwise(F.concat(gap, bare))

    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    ended = F.transform(lines, lambda line, i: F.when(
        (i + 1 < F.size(lines)) & ~line.rlike(_APART) & ~F.coalesce(F.get(lines, i + 1), F.lit("")).rlike(_APART), F.regexp_replace(line, r"[ \t\r]+$", "")
    ).otherwise(line))
    return F.array_join(F.transform(ended, lambda line, i: F.when(i == 0, line).otherwise(joined(line, F.get(lines, i - 1)))), "")


_LINES = """l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) ls FROM documents),
x AS (SELECT doc_id, ls, list_transform(ls, lambda t: regexp_matches(t, '^\\s*$|^\\s*([-*•]|[0-9]+\\.)\\s|^\\s*\\{[0-9]+\\.[0-9]+\\}')) apart FROM l)"""


@query(
    "fn18_joined_lines",
    f"""WITH {_LINES} SELECT doc_id, array_to_string(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN i = 1 THEN '' WHEN apart[i] OR apart[i - 1] THEN chr(10) ELSE ' ' END
      || CASE WHEN i > 1 AND NOT apart[i] AND NOT apart[i - 1] THEN regexp_replace(CASE WHEN i < len(ls) AND NOT apart[i] AND NOT apart[i + 1] THEN regexp_replace(ls[i], '[ \\t\\r]+$', '') ELSE ls[i] END, '^[ \\t]+', '')
        WHEN i < len(ls) AND NOT apart[i] AND NOT apart[i + 1] THEN regexp_replace(ls[i], '[ \\t\\r]+$', '') ELSE ls[i] END), '') joined FROM x""",
)
def fn18_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", joined_lines(F.col("text")).alias("joined"))


@query(
    "fn18_page_joins",
    """WITH l AS (SELECT doc_id, unnest(range(len(ls))) line, unnest(ls) t FROM (SELECT doc_id, string_split(text, chr(10)) ls FROM documents)),
    n AS (SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY line) nxt FROM l)
    SELECT doc_id, line FROM n WHERE regexp_matches(rtrim(t), '[\\p{Ll},—–]$') AND regexp_matches(ltrim(nxt), '^\\p{Ll}') AND NOT regexp_matches(trim(t), '^([-*•]|[0-9]+\\.)\\s')""",
)
def fn18_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ends where a sentence seems to go on: proposals, nothing is changed. Neighbours are looked up inside the row."""
    lines = F.split("text", "\n", -1)
    ends = lambda t, nxt: (
        F.rtrim(t).rlike(r"[\p{Ll},—–]$") & F.ltrim(nxt).rlike(r"^\p{Ll}") & ~F.trim(t).rlike(r"^([-*•]|[0-9]+\.)\s")
    )
    marked = F.transform(lines, lambda t, i: F.when(F.coalesce(ends(t, F.get(lines, i + 1)), F.lit(False)), i))
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(marked, lambda i: i.isNotNull())).alias("line"))
    return found.withColumn("line", F.col("line").cast("long"))


_HYPHEN = r"([A-Za-z]+)-\n\s*([a-z]+)"


def hyphen_decisions(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(doc_id, i, first, second, action) of each word that a line end breaks.

    joined if the dictionary (column word) has the closed word and not both parts; hyphen if it has
    both parts and not the closed word; review otherwise, and for capitals.
    """
    sites = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(_HYPHEN), F.lit(0))).alias("i", "site"))
    sites = sites.select("doc_id", "i", F.regexp_extract("site", _HYPHEN, 1).alias("first"), F.regexp_extract("site", _HYPHEN, 2).alias("second"))
    asked = sites.withColumn("part", F.explode(F.array(F.lit("c"), F.lit("f"), F.lit("s"))))
    word = F.when(F.col("part") == "c", F.concat("first", "second")).when(F.col("part") == "f", F.col("first")).otherwise(F.col("second"))
    known = asked.withColumn("word", F.lower(word)).join(dictionary.select("word").distinct().withColumn("hit", F.lit(1)), "word", "left")
    has = lambda p: F.max(F.when(F.col("part") == p, F.coalesce("hit", F.lit(0)))) == 1
    told = known.groupBy("doc_id", "i", "first", "second").agg(has("c").alias("c"), has("f").alias("f"), has("s").alias("s"))
    parts = F.col("f") & F.col("s")
    action = (
        F.when(F.col("first").rlike("^[A-Z]"), "review").when(F.col("c") & ~parts, "joined").when(~F.col("c") & parts, "hyphen").otherwise("review")
    )
    return told.select("doc_id", "i", "first", "second", action.alias("action"))


def dehyphenated(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """(doc_id, text) with each broken word as decided; words to be reviewed are marked."""
    closed = F.concat("first", "second")
    hyphened = F.concat_ws("-", "first", "second")
    put = (
        F.when(F.col("action") == "joined", closed).when(F.col("action") == "hyphen", hyphened)
        .otherwise(F.concat(F.lit('[REVIEW: "'), closed, F.lit('" or "'), hyphened, F.lit('"?]')))
    )
    listed = decisions.select("doc_id", F.struct("i", put.alias("put")).alias("x")).groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    gaps = F.split("text", _HYPHEN, -1)
    whole = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col("xs"), i)["put"], F.lit("")))), "")
    joined = docs.select("doc_id", "text").join(listed, "doc_id", "left")
    return joined.select("doc_id", F.when(F.col("xs").isNull(), F.col("text")).otherwise(whole).alias("text"))


# ---- glosses -----------------------------------------------------------------------


def normalized_gloss(text: Column) -> Column:
    """Lower case, single spaces, no punctuation at the end."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), r"[\p{P}\s]+$", "")


def extended_glosses(glosses: DataFrame, keys: DataFrame, definitions: DataFrame) -> DataFrame:
    """(lemma, gloss, extended): a cut-off gloss is replaced by the definition that goes on from it, if there is only one.

    glosses: lemma, gloss; keys: lemma, key (the entries that the lemma may be); definitions: key,
    definition. If the lemma is a key itself, only that entry counts.
    """
    own = keys.groupBy("lemma").agg(F.max((F.col("lemma") == F.col("key")).cast("int")).alias("self"))
    tried = keys.join(own, "lemma").where("self = 0 OR key = lemma").join(definitions, "key")
    plain, longer = normalized_gloss(F.col("gloss")), normalized_gloss(F.col("definition"))
    behind = F.substr(longer, F.length(plain) + 1, F.lit(1))
    extends = (plain != "") & F.startswith(longer, plain) & (F.length(longer) > F.length(plain)) & ~behind.rlike(r"[\p{L}\p{N}_]")
    found = glosses.join(tried, "lemma").where(extends).groupBy("lemma", "gloss")
    one = found.agg(F.min("definition").alias("a"), F.max("definition").alias("b")).where("a = b").select("lemma", "gloss", F.col("a").alias("d"))
    joined = glosses.distinct().join(one, ["lemma", "gloss"], "left")
    return joined.select("lemma", "gloss", F.coalesce("d", "gloss").alias("extended"))


@query(
    "fn12_extended_glosses",
    """WITH d AS (SELECT DISTINCT p_brand key, p_type definition FROM part WHERE p_size <= 10),
    g AS (SELECT DISTINCT p_brand lemma, split_part(p_type, ' ', 1) gloss FROM part),
    f AS (SELECT lemma, gloss, min(definition) a, max(definition) b FROM g JOIN d ON key = lemma WHERE starts_with(lower(definition), lower(gloss) || ' ') GROUP BY 1, 2)
    SELECT lemma, gloss, CASE WHEN a = b THEN a ELSE gloss END extended FROM g LEFT JOIN f USING (lemma, gloss)""",
)
def fn12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of a brand's types, extended where its small parts have only one type that goes on from them."""
    part = table(spark, sf_dir, "part")
    glosses = part.select(F.col("p_brand").alias("lemma"), F.element_at(F.split("p_type", " "), 1).alias("gloss")).distinct()
    definitions = part.where("p_size <= 10").select(F.col("p_brand").alias("key"), F.col("p_type").alias("definition")).distinct()
    keys = definitions.select(F.col("key").alias("lemma"), "key").distinct()
    return extended_glosses(glosses, keys, definitions)


# What may stand between two italic runs of one definition, and what may not end it.
_CONNECTIVE = re.compile(r"\s*(?:[,;]|or|and)?\s*(?:or|and)?\s*")
_ENDS_ON = re.compile(r"\s+(?:or|and)$")
_ARTICLE = re.compile(r"\b(?:an?|the)$", re.I)


def short_definition(entry: str | None) -> str:
    """The first italic run of an entry's first sense, with those that only a connective parts from it.

    Empty if there is none, if it ends on an article, or if it is longer than a hundred characters.
    """
    if not entry:
        return ""
    root = ET.fromstring(entry)
    children = list(next(root.iter("sense"), root))
    first = next((k for k, c in enumerate(children) if c.tag == "i"), None)
    if first is None:
        return ""
    run = [children[first]]
    for child in children[first + 1 :]:
        if child.tag != "i" or not _CONNECTIVE.fullmatch(run[-1].tail or ""):
            break
        run.append(child)
    pieces = ["".join(c.itertext()) + (c.tail or "" if c is not run[-1] else "") for c in run]
    edge = lambda c: c.isspace() or unicodedata.category(c).startswith("P")
    bare = lambda t: "".join(pd.Series(list(t)).loc[lambda s: ~(s.map(edge).cummin() | s[::-1].map(edge).cummin()[::-1])]) if t else ""
    text = bare(_ENDS_ON.sub("", bare(" ".join("".join(pieces).split()))))
    return "" if _ARTICLE.search(text) or len(text) > 100 else text


# ---- titles, citations, anchors ----------------------------------------------------


def is_testimonia(title: Column) -> Column:
    return F.contains(F.lower(title), F.lit("testimonia"))


def is_unreliable(title: Column, transmission: Column, direct: list[str]) -> Column:
    """Works that can't date their own words: not directly transmitted, fragments, testimonia, spurious or doubtful ones."""
    low = F.lower(title)
    return ~F.coalesce(transmission.isin(*direct), F.lit(False)) | low.startswith("fragment") | low.rlike(r"\b(?:testimoni|spuri|dubi)|\[sp\.\]|\[dub\.\]")


_TITLES = ["Testimonia ", "Fragmenta ", "[Sp.] ", "Spuria ", "De ", "Papyrus fragmenta ", "Subdubia "]


@query(
    "flt14_unreliable_works",
    f"""WITH t AS (SELECT p_partkey, {_TITLES}[p_size % {len(_TITLES)} + 1] || p_name title, left(p_type, 1) x FROM part)
    SELECT p_partkey, contains(lower(title), 'testimonia') testimonia, NOT x IN ('S', 'P', 'E') OR starts_with(lower(title), 'fragment')
      OR regexp_matches(lower(title), '\\b(testimoni|spuri|dubi)|\\[sp\\.\\]|\\[dub\\.\\]') unreliable FROM t""",
)
def flt14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of works (made of the parts' names) that are no source of quotations, or can't date their words."""
    kind = F.get(F.array(*[F.lit(t) for t in _TITLES]), F.col("p_size") % len(_TITLES))
    title, x = F.concat(kind, "p_name"), F.substring("p_type", 1, 1)
    return table(spark, sf_dir, "part").select("p_partkey", is_testimonia(title).alias("testimonia"), is_unreliable(title, x, ["S", "P", "E"]).alias("unreliable"))


def reader_links(citations: DataFrame, books: DataFrame) -> DataFrame:
    """citations (work, place) with `link`: the address of the book whose range holds the place; null if none does.

    books: work, book, lo, hi. Ranges of a work do not overlap.
    """
    ranged = books.select(F.col("work").alias("w"), "book", "lo", "hi")
    met = citations.join(ranged, (F.col("work") == F.col("w")) & F.col("place").between(F.col("lo"), F.col("hi")), "left")
    link = F.when(F.col("book").isNotNull(), F.format_string("/%s/book/%d?loc=%d", "work", "book", "place"))
    return met.select(*citations.columns, link.alias("link"))


@query(
    "fn14_reader_links",
    """WITH c AS (SELECT page_id, regexp_extract(url, '/(en|de|fr|es)/', 1) work, TRY_CAST(nullif(regexp_extract(url, '/(?:en|de|fr|es)/([0-9]+)', 1), '') AS BIGINT) place FROM pages),
    r AS (SELECT work, book, book * 300 lo, book * 300 + 199 hi FROM (SELECT unnest(['en', 'de', 'fr']) work), (SELECT unnest([0, 1, 2, 3]) book))
    SELECT page_id, c.work, place, CASE WHEN book IS NOT NULL THEN '/' || c.work || '/book/' || book || '?loc=' || place END link FROM c LEFT JOIN r ON r.work = c.work AND place BETWEEN lo AND hi""",
)
def fn14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations in addresses as links to the book that holds the place."""
    number = F.expr("try_cast(nullif(regexp_extract(url, '/(?:en|de|fr|es)/([0-9]+)', 1), '') AS BIGINT)")
    cited = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "/(en|de|fr|es)/", 1).alias("work"), number.alias("place"))
    books = spark.createDataFrame([(w, k, 300 * k, 300 * k + 199) for w in ("en", "de", "fr") for k in range(4)], "work string, book int, lo long, hi long")
    return reader_links(cited, F.broadcast(books))  # twelve rows


def anchor_phrase(text: Column, offset: Column, size: int = 80) -> Column:
    """What stands at an offset, with single spaces and without a word that the window cuts off."""
    window = F.array_join(F.regexp_extract_all(F.substr(text, offset + 1, F.lit(size)), F.lit(r"\S+"), F.lit(0)), " ")
    return F.when(F.length(window) == size, F.regexp_replace(window, r" [^ ]*$", "")).otherwise(window)


def drifted(text: Column, stated: Column, tolerance: int = 4) -> Column:
    """Whether a text's length is too far from the one its anchors were made for."""
    return F.abs(F.length(text) - stated) > tolerance


@query(
    "aln16_anchor_phrases",
    """WITH w AS (SELECT item_id, array_to_string(regexp_extract_all(substr(text, length(text) // 3 + 1, 80), '\\S+'), ' ') p FROM benchmark)
    SELECT item_id, CASE WHEN length(p) = 80 THEN regexp_replace(p, ' [^ ]*$', '') ELSE p END phrase FROM w""",
)
def aln16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrase at a third of each benchmark text."""
    return table(spark, sf_dir, "benchmark").select("item_id", anchor_phrase(F.col("text"), F.floor(F.length("text") / 3).cast("int")).alias("phrase"))


# ---- tokens and readings -----------------------------------------------------------


@query(
    "fn03_clean_tokens",
    """WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\s—]+')) raw FROM documents),
    c AS (SELECT doc_id, raw, translate(trim(raw, '.,·;—()|"‘«»·;†*<>[]⎪⟦⟧⌜⌞⌝⌟'), '†*<>[]⎪⟦⟧⌜⌞⌝⌟', '') t FROM r)
    SELECT doc_id, count(*) n, sum(length(t))::BIGINT letters, sum((translate(raw, '†*<>[]⎪⟦⟧⌜⌞⌝⌟', '') <> raw)::INT)::BIGINT sigla FROM c WHERE t <> '' GROUP BY doc_id""",
)
def fn03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by the rules for Greek texts: how many, their letters, and how many had editorial signs."""
    raw = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^\s—]+"), F.lit(0))).alias("raw"))
    kept = raw.select("doc_id", clean_token(F.col("raw")).alias("t"), has_sigla(F.col("raw")).cast("int").alias("s")).where("t <> ''")
    return kept.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("letters"), F.sum("s").alias("sigla"))


#: Parses of a token by its length, and their signatures, for a query over words that have none of their own.
_PARSES = [
    (["pres ind act 2nd sg (doric aeolic)"], "mood=ind;number=sg;person=2nd;tense=pres;voice=act"),
    (["masc nom/voc pl", "masc nom/voc pl (attic)"], "case=nom,voc;gender=masc;number=pl"),
    (["fem nom sg", "fem acc pl"], "case=acc;gender=fem;number=pl|case=nom;gender=fem;number=sg"),
    (["indeclform (particle)", "doric"], "marker=particle"),
    ([], ""),
]


@query(
    "fn05_readings",
    f"""WITH {TOK}, s(k, signature) AS (VALUES {", ".join(f"({k}, '{s}')" for k, (_, s) in enumerate(_PARSES))})
    SELECT signature, count(*) n FROM tok JOIN s ON length(word) % {len(_PARSES)} = k GROUP BY 1""",
)
def fn05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by the signature of their parses, which are read once for each distinct list of them."""
    lists = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(_PARSES)], "k int, parses array<string>")
    read = lists.select("k", F.array_join(signature(F.col("parses")), "|").alias("signature"))
    counted = tokens(table(spark, sf_dir, "documents")).groupBy((F.length("word") % len(_PARSES)).alias("k")).agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(read), "k").groupBy("signature").agg(F.sum("n").alias("n"))  # a row for each list
