"""Searches over token tables: terms, Boolean modes, phrases, readings, proximity."""

from __future__ import annotations

from functools import reduce
from itertools import islice, product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import english_words, matches_term, phrase_regex
from corvane.operators.tokens import OFF, TOK, offset_tokens, tokens
from corvane.plans.registry import query
from corvane.sources.tables import table

#: Most readings of a phrase that are tried one by one.
READINGS_CAP = 64


def any_of(toks: DataFrame, terms: list[str], segment: str = "doc_id") -> DataFrame:
    """Segments with at least one of the terms."""
    hit = reduce(Column.__or__, [matches_term(F.col("word"), t) for t in terms], F.lit(False))
    return toks.where(hit).select(segment).distinct()


def all_of(toks: DataFrame, terms: list[str], segment: str = "doc_id") -> DataFrame:
    """Segments with each of the terms: one pass, one aggregate, no join for a term."""
    if not terms:
        return toks.select(segment).limit(0)
    flags = [F.max(matches_term(F.col("word"), t).cast("int")).alias(f"t{i}") for i, t in enumerate(terms)]
    any_hit = reduce(Column.__or__, [matches_term(F.col("word"), t) for t in terms])
    counted = toks.where(any_hit).groupBy(segment).agg(*flags)
    return counted.where(reduce(Column.__and__, [F.col(f"t{i}") == 1 for i in range(len(terms))])).select(segment)


def phrase_starts(docs: DataFrame, slots: list[list[str]], segment: str = "doc_id") -> DataFrame:
    """(segment, pos) where the slots match words in a row; each slot has alternative terms.

    Found inside the array of words of a row, so phrases need no self-join.
    """
    worded = docs.select(segment, english_words(F.col("text")).alias("w"))
    k = len(slots)

    def here(i: Column) -> Column:
        tests = []
        for j, terms in enumerate(slots):
            word = F.element_at("w", i + j + 1)
            tests.append(reduce(Column.__or__, [matches_term(word, t) for t in terms]))
        return reduce(Column.__and__, tests)

    places = F.sequence(F.lit(0), F.size("w") - k)
    found = F.filter(places, here)
    return worded.where(F.size("w") >= k).select(segment, F.explode(found).alias("pos"))


def highlights(starts: DataFrame, k: int, segment: str = "doc_id") -> DataFrame:
    """Each word of each found phrase, once."""
    return starts.select(segment, F.explode(F.sequence(F.col("pos"), F.col("pos") + (k - 1))).alias("pos")).distinct()


def combined(left: DataFrame, right: DataFrame, mode: str, key: str = "doc_id") -> DataFrame:
    """Two result sets by and / or, with a flag for each side."""
    both = left.withColumn("left_match", F.lit(True)).join(right.withColumn("right_match", F.lit(True)), key, "full")
    both = both.select(key, F.coalesce("left_match", F.lit(False)).alias("left_match"), F.coalesce("right_match", F.lit(False)).alias("right_match"))
    return both if mode == "or" else both.where("left_match AND right_match")


def readings(options: list[list[str]], cap: int = READINGS_CAP) -> tuple[list[tuple[str, ...]], int]:
    """The product of the options, at most `cap` of them in the order of a counter, and how many there are."""
    total = 1
    for o in options:
        total *= len(o)
    return list(islice(product(*options), cap)), total


def near_pairs(toks: DataFrame, a: str, b: str, window: int, group: str = "doc_id", off: str = "pos") -> DataFrame:
    """(group, a_off, b_off) of two words at most `window` apart, by a bucketed range join.

    Only one side is copied to its bucket and the two beside it, so each pair is found once
    and a frequent word is spread over buckets.
    """
    left = toks.where(F.col("word") == a).select(group, F.col(off).alias("a_off"))
    right = toks.where(F.col("word") == b).select(group, F.col(off).alias("b_off"))
    left = left.withColumn("bucket", F.floor(F.col("a_off") / window))
    here = F.floor(F.col("b_off") / window)
    right = right.withColumn("bucket", F.explode(F.array(here - 1, here, here + 1)))
    close = F.abs(F.col("a_off") - F.col("b_off")) <= window
    return left.join(right, [group, "bucket"]).where(close).select(group, "a_off", "b_off")


# ---- queries -----------------------------------------------------------------------


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _term(name: str, term: str, sql: str) -> None:
    @query(name, f"WITH {TOK} SELECT doc_id, pos, word FROM tok WHERE {sql}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = tokens(_docs(spark, sf_dir)).where(matches_term(F.col("word"), term))
        return found.select("doc_id", F.col("pos").cast("long").alias("pos"), "word")


_term("flt01_exact_term", "then", "word = 'then'")
_term("flt02_prefix_term", "thor*", "word LIKE 'thor%'")
_term("flt02_wildcard_term", "t?e*n", "regexp_matches(word, '^t[a-z'']e[a-z'']*n$')")
_term("flt02_leading_star", "*then", "word = 'then'")


@query("flt03_every_segment", f"WITH {TOK} SELECT DISTINCT doc_id FROM tok")
def flt03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bare asterisk in the second language: every segment with a word."""
    return _docs(spark, sf_dir).where(F.size(english_words(F.col("text"))) > 0).select("doc_id")


@query(
    "flt04_phrase_regex",
    r"""SELECT doc_id FROM documents WHERE regexp_matches(' ' || substr(lower(text), 1, 500) || ' ', '[^a-z'']of[^a-z'']+the[^a-z'']')""",
)
def flt04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase as a pattern with look-around over the first 500 characters, which is what the feature searches."""
    head = F.substring(F.lower("text"), 1, 500)
    return _docs(spark, sf_dir).where(head.rlike(phrase_regex(["of", "the"]))).select("doc_id")


@query("flt08_scope", "SELECT source, count(*) n FROM documents WHERE source IN ('src1', 'src2', 'src5') GROUP BY 1")
def flt08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where(F.col("source").isin("src1", "src2", "src5")).groupBy("source").agg(F.count("*").alias("n"))


@query("flt16_contains", "SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '00001')")
def flt16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where(F.contains(F.lower("s_name"), F.lit("00001"))).select("s_suppkey", "s_name")


@query("q01_search_any", f"WITH {TOK} SELECT DISTINCT doc_id FROM tok WHERE word = 'thor' OR word LIKE 'eau%'")
def q01_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return any_of(tokens(_docs(spark, sf_dir)), ["thor", "eau*"])


@query(
    "q01_search_all",
    f"""WITH {TOK} SELECT doc_id FROM tok GROUP BY doc_id
    HAVING bool_or(word = 'with') AND bool_or(word LIKE 'thor%') AND bool_or(word = 'was')""",
)
def q01_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_of(tokens(_docs(spark, sf_dir)), ["with", "thor*", "was"])


@query(
    "q01_search_phrase",
    f"""WITH {TOK} SELECT a.doc_id, a.pos FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1
    WHERE a.word IN ('of', 'to') AND b.word LIKE 'the%'""",
)
def q01_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_starts(_docs(spark, sf_dir), [["of", "to"], ["the*"]])
    return found.withColumn("pos", F.col("pos").cast("long"))


@query(
    "q02_highlights",
    f"""WITH {TOK}, s AS (SELECT a.doc_id, a.pos FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1
    JOIN tok c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2 WHERE a.word = 'of' AND b.word = 'the')
    SELECT DISTINCT doc_id, pos + i pos FROM s, (SELECT unnest([0, 1, 2]) i)""",
)
def q02(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_starts(_docs(spark, sf_dir), [["of"], ["the"], ["a*", "b*", "c*", "d*", "e*", "f*", "g*", "h*", "i*", "j*", "k*", "l*", "m*", "n*", "o*", "p*", "q*", "r*", "s*", "t*", "u*", "v*", "w*", "x*", "y*", "z*", "'*"]])
    return highlights(found, 3).withColumn("pos", F.col("pos").cast("long"))


_TURNS = """c AS (SELECT conv_id, turn, role, list_filter(list_transform(regexp_extract_all(lower(replace(replace(coalesce(text, ''), '’', ''''), 'ʼ', '''')), '[a-z'']+'),
  lambda x: regexp_replace(x, '^''+|''+$', '', 'g')), lambda x: x <> '') ws FROM conversations)"""


def _role_hits(spark: SparkSession, sf_dir: str, role: str, term: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == role)
    return turns.where(F.exists(english_words(F.col("text")), lambda w: matches_term(w, term))).select("conv_id").distinct()


def _two_sides(name: str, mode: str, condition: str) -> None:
    @query(
        name,
        f"""WITH {_TURNS}, f AS (SELECT conv_id,
        bool_or(role = 'user' AND len(list_filter(ws, lambda x: x LIKE 'th%')) > 0) left_match,
        bool_or(role = 'assistant' AND list_contains(ws, 'and')) right_match FROM c GROUP BY conv_id)
        SELECT * FROM f WHERE {condition}""",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Two languages (here: roles) searched apart and combined, with a flag for each."""
        return combined(_role_hits(spark, sf_dir, "user", "th*"), _role_hits(spark, sf_dir, "assistant", "and"), mode, "conv_id")


_two_sides("set03_two_sides_and", "and", "left_match AND right_match")
_two_sides("set03_two_sides_or", "or", "left_match OR right_match")


@query(
    "q03_second_side_phrase",
    f"""WITH {_TURNS}, t AS (SELECT conv_id, turn, unnest(ws) word, unnest(range(len(ws))) pos FROM c WHERE role = 'user')
    SELECT a.conv_id, a.turn, count(*) n FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.pos = a.pos + 1
    WHERE a.word = 'of' AND b.word = 'the' GROUP BY 1, 2""",
)
def q03(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.struct("conv_id", "turn").alias("seg"), "text")
    found = phrase_starts(turns, [["of"], ["the"]], "seg")
    return found.groupBy("seg").agg(F.count("*").alias("n")).select("seg.conv_id", "seg.turn", "n")


#: A seeded map of surface words to headwords: a word's first three and four letters.
_LEMMAS = "list_distinct([substr(word, 1, 4), substr(word, 1, 3)])"


@query(
    "q05_headwords",
    f"""WITH {TOK}, m AS (SELECT DISTINCT word FROM tok WHERE length(word) >= 4)
    SELECT word, list_sort(list_distinct(list_concat([word], {_LEMMAS}))) headwords FROM m""",
)
def q05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed word stands for itself and its headwords; one that the map lacks for itself."""
    words = tokens(_docs(spark, sf_dir)).where("length(word) >= 4").select("word").distinct()
    lemma_map = words.select("word", F.array_distinct(F.array(F.substring("word", 1, 4), F.substring("word", 1, 3))).alias("lemmas"))
    joined = words.join(lemma_map, "word", "left")
    return joined.select(
        "word", F.array_sort(F.array_union(F.array("word"), F.coalesce("lemmas", F.array().cast("array<string>")))).alias("headwords")
    )


@query(
    "q08_phrase_variants",
    f"""WITH {TOK} SELECT a.doc_id, count(DISTINCT p)::BIGINT marked FROM
    (SELECT a.doc_id, unnest([a.pos, b.pos]) p FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1
     WHERE substr(a.word, 1, 3) IN ('the', 'and') AND substr(b.word, 1, 3) IN ('the', 'of', 'ing')) a GROUP BY a.doc_id""",
)
def q08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readings of a phrase at once: marked words are united, never added up."""
    starts = phrase_starts(_docs(spark, sf_dir), [["the*", "and*"], ["the*", "of", "ing*"]])
    return highlights(starts, 2).groupBy("doc_id").agg(F.count("*").alias("marked"))


@query(
    "q18_word_picker",
    f"""WITH {TOK}, c AS (SELECT word, count(*) n FROM tok WHERE word LIKE 'tho%' GROUP BY word)
    SELECT word, n, (SELECT count(*) FROM c) > 30 capped FROM c ORDER BY n DESC, word LIMIT 30""",
)
def q18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 most frequent words with a prefix, and whether there are more."""
    counted = tokens(_docs(spark, sf_dir)).where(F.col("word").startswith("tho")).groupBy("word").agg(F.count("*").alias("n"))
    best = counted.orderBy(F.desc("n"), "word").limit(31)
    ranked = best.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "word")))
    return ranked.withColumn("capped", F.max("r").over(Window.partitionBy()) > 30).where("r <= 30").drop("r")


@query(
    "q09_near_words",
    f"""WITH {TOK} SELECT a.doc_id, a.pos a_off, b.pos b_off FROM tok a JOIN tok b ON a.doc_id = b.doc_id
    AND abs(b.pos - a.pos) <= 5 WHERE a.word = 'the' AND b.word = 'of'""",
)
def q09_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_pairs(tokens(_docs(spark, sf_dir)), "the", "of", 5)
    return found.select("doc_id", F.col("a_off").cast("long").alias("a_off"), F.col("b_off").cast("long").alias("b_off"))


@query(
    "q09_near_in_source",
    f"""WITH {OFF} SELECT a.source, count(*) pairs, min(a.off) first FROM off a JOIN off b ON a.source = b.source
    AND b.off - a.off BETWEEN 1 AND 3 WHERE a.word = 'was' AND b.word = 'the' GROUP BY 1""",
)
def q09_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered proximity over the offsets of a source: the second word follows within three."""
    found = near_pairs(offset_tokens(_docs(spark, sf_dir)), "was", "the", 3, "source", "off")
    return found.where("b_off > a_off").groupBy("source").agg(F.count("*").alias("pairs"), F.min("a_off").alias("first"))


@query(
    "q16_keyword_in_context",
    f"""WITH {TOK} SELECT t.doc_id, t.pos, array_to_string(ws[greatest(t.pos - 7, 1):t.pos], ' ') before, word,
    array_to_string(ws[t.pos + 2:t.pos + 9], ' ') after FROM tok t JOIN w USING (doc_id) WHERE word = 'thor'""",
)
def q16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight words on either side of each hit, cut from the row's own words."""
    worded = _docs(spark, sf_dir).select("doc_id", english_words(F.col("text")).alias("w"))
    hits = worded.where(F.array_contains("w", "thor")).select("doc_id", "w", F.posexplode("w").alias("pos", "word")).where("word = 'thor'")
    begin = F.greatest(F.col("pos") - 8, F.lit(0))
    return hits.select(
        "doc_id",
        F.col("pos").cast("long").alias("pos"),
        F.concat_ws(" ", F.slice("w", begin + 1, F.col("pos") - begin)).alias("before"),
        "word",
        F.concat_ws(" ", F.slice("w", F.col("pos") + 2, F.lit(8))).alias("after"),
    )


@query(
    "q17_grouped_hits",
    f"""WITH {TOK} SELECT source, doc_id, pos // 100 chapter, count(*) hits, min(pos) first_pos FROM tok
    WHERE word = 'then' GROUP BY 1, 2, 3""",
)
def q17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by work, book and chapter."""
    hits = tokens(_docs(spark, sf_dir)).where("word = 'then'")
    chapter = F.floor(F.col("pos") / 100).alias("chapter")
    return hits.groupBy("source", "doc_id", chapter).agg(F.count("*").alias("hits"), F.min("pos").cast("long").alias("first_pos"))


@query(
    "agg20_instance_counts",
    f"""WITH {TOK}, h AS (SELECT doc_id, list(pos) ps FROM tok WHERE word = 'then' GROUP BY 1)
    SELECT count(*) results, sum(len(ps))::BIGINT instances FROM h""",
)
def agg20(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = tokens(_docs(spark, sf_dir)).where("word = 'then'").groupBy("doc_id").agg(F.count("*").alias("n"))
    return hits.agg(F.count("*").alias("results"), F.sum("n").alias("instances"))


@query(
    "q19_bridge_rank",
    f"""WITH {TOK}, seg AS (SELECT DISTINCT doc_id FROM tok WHERE word = 'then'),
    p AS (SELECT doc_id, word || ' ' || lead(word) OVER (PARTITION BY doc_id ORDER BY pos) gram FROM tok),
    c AS (SELECT gram, count(*) total, count(DISTINCT doc_id) FILTER (doc_id IN (SELECT doc_id FROM seg)) shared
      FROM p WHERE gram IS NOT NULL GROUP BY gram)
    SELECT gram, shared, total, round(shared / sqrt(total), 6) score FROM c WHERE shared >= 3
    ORDER BY score DESC, gram LIMIT 40""",
)
def q19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases ranked by shared segments over the root of their count (a top-k report)."""
    from corvane.operators.ngrams import grams

    docs = _docs(spark, sf_dir)
    marked = docs.withColumn("hit", F.array_contains(english_words(F.col("text")), "then"))
    rows = grams(docs, 2).groupBy("gram", "doc_id").agg(F.count("*").alias("n"))
    joined = rows.join(marked.select("doc_id", "hit"), "doc_id")
    counted = joined.groupBy("gram").agg(F.sum("n").alias("total"), F.sum(F.col("hit").cast("int")).alias("shared"))
    scored = counted.where("shared >= 3").withColumn("score", F.round(F.col("shared") / F.sqrt("total"), 6))
    return scored.orderBy(F.desc("score"), "gram").limit(40).select("gram", "shared", "total", "score")
