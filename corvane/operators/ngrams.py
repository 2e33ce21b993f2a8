"""Recurring phrases of two to five words, with their score, spread and boundaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import english_words, shard_letter
from corvane.operators.phrases import phrase_totals, recurring_phrases
from corvane.operators.tokens import OFF, OFFSET_RANGE, TOK, neighbour, offset_tokens, running_before, tokens
from corvane.plans.registry import query
from corvane.sources.tables import table


def _runs(docs: DataFrame, longest: int) -> DataFrame:
    """(doc_id, source, lang, pos, w0, w1, ..): each word with those behind it in its document, null behind the end.

    Zipped and spread inside the row, so phrases need no window and no shuffle.
    """
    worded = docs.select("doc_id", "source", "lang", english_words(F.col("text")).alias("w"))
    shifted = [F.slice("w", k + 1, F.size("w")).alias(f"w{k}") for k in range(longest)]
    runs = worded.select("doc_id", "source", "lang", F.posexplode(F.arrays_zip(*shifted)).alias("pos", "r"))
    return runs.select("doc_id", "source", "lang", "pos", *[F.col(f"r.w{k}").alias(f"w{k}") for k in range(longest)])


def _joined(n: int) -> Column:
    """The phrase of the first n words; null where there are fewer."""
    return F.concat(*[c for k in range(n) for c in ([F.lit(" ")] if k else []) + [F.col(f"w{k}")]])


def grams(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, source, lang, pos, gram): each run of n words of a document, which is a hard border."""
    found = _runs(docs, n).where(F.col(f"w{n - 1}").isNotNull())
    return found.select("doc_id", "source", "lang", "pos", _joined(n).alias("gram"))


def all_grams(docs: DataFrame, shortest: int = 2, longest: int = 5) -> DataFrame:
    """grams of each length, with the length as n; the words are found once and the lengths fan out inside the row."""
    lengths = F.array(*[F.struct(F.lit(n).alias("n"), _joined(n).alias("gram")) for n in range(shortest, longest + 1)])
    each = _runs(docs, longest).select("doc_id", "source", "lang", "pos", F.inline(lengths))
    return each.where(F.col("gram").isNotNull())


def recurring(gram_rows: DataFrame, least: int = 2) -> DataFrame:
    """(n, gram, count, sources) of the phrases found at least so often; counts are combined before the shuffle.

    Sources are counted over (phrase, source) pairs, which the first step already has.
    """
    by_source = gram_rows.groupBy("n", "gram", "source").agg(F.count("*").alias("c"))
    return (
        by_source.groupBy("n", "gram")
        .agg(F.sum("c").alias("count"), F.count("*").alias("sources"))
        .where(F.col("count") >= least)
    )


def weighted_pmi(phrases: DataFrame, toks: DataFrame, n: int) -> DataFrame:
    """phrases with score = count * log2(count / expected), expected = total * product of (n_i / total).

    0 where nothing is expected. Unigram counts are joined once for each place of the phrase; the
    total is the sum of these counts.
    """
    unigrams = toks.groupBy("word").agg(F.count("*").alias("n_word"))
    total = unigrams.agg(F.sum("n_word").cast("double").alias("total"))
    out = phrases.withColumn("__w", F.split("gram", " "))
    expected = F.col("total")
    for i in range(n):
        own = unigrams.select(F.col("word").alias(f"__w{i}"), F.col("n_word").alias(f"__n{i}"))
        out = out.withColumn(f"__w{i}", F.element_at("__w", i + 1)).join(own, f"__w{i}")
        expected = expected * (F.col(f"__n{i}") / F.col("total"))
    out = out.crossJoin(F.broadcast(total))  # one row
    score = F.when(expected > 0, F.col("count") * F.log2(F.col("count") / expected)).otherwise(0.0)
    return out.withColumn("score", score).select(*phrases.columns, "score")


_BIGRAMS = f"""WITH {TOK},
u AS (SELECT word, count(*) n FROM tok GROUP BY word), t AS (SELECT sum(n)::DOUBLE total FROM u),
p AS (SELECT source, ws[i] a, ws[i + 1] b FROM (SELECT source, ws, unnest(range(1, len(ws))) i FROM w)),
s AS (SELECT a, b, source, count(*) c FROM p GROUP BY a, b, source),
g AS (SELECT a, b, sum(c)::BIGINT c, count(*) sources FROM s GROUP BY a, b HAVING sum(c) >= 2)
SELECT a || ' ' || b gram, c count, sources, round(c * log2(c / (total * (x.n / total) * (y.n / total))), 6) score
FROM g JOIN u x ON x.word = a JOIN u y ON y.word = b, t"""


@query("agg07_bigram_pmi", _BIGRAMS)
def bigram_pmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = recurring(grams(docs, 2).withColumn("n", F.lit(2)))
    return weighted_pmi(found, tokens(docs), 2).select("gram", "count", "sources", F.round("score", 6).alias("score"))


@query(
    "agg03_ngram_counts",
    f"""WITH {TOK}, g AS (SELECT n, doc_id, source, array_to_string(ws[i:i + n - 1], ' ') gram FROM
    (SELECT w.*, n, unnest(range(1, len(ws) - n + 2)) i FROM w, (SELECT unnest([2, 3, 4, 5]) n) WHERE len(ws) >= n))
    SELECT n, gram, count(*) count, count(DISTINCT source) sources FROM g GROUP BY n, gram HAVING count(*) >= 2""",
)
def agg03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurring_phrases(table(spark, sf_dir, "documents"))


@query(
    "agg22_phrases_by_length",
    f"""WITH {TOK}, g AS (SELECT n, array_to_string(ws[i:i + n - 1], ' ') gram FROM
    (SELECT w.*, n, unnest(range(1, len(ws) - n + 2)) i FROM w, (SELECT unnest([2, 3, 4, 5]) n) WHERE len(ws) >= n)),
    c AS (SELECT n, gram, count(*) c FROM g GROUP BY n, gram)
    SELECT n, count(*) distinct_phrases, sum((c >= 2)::INT)::BIGINT kept,
    sum(CASE WHEN c >= 2 THEN c ELSE 0 END)::BIGINT occurrences FROM c GROUP BY ROLLUP (n)""",
)
def phrases_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = phrase_totals(table(spark, sf_dir, "documents"))
    return parts.rollup("n").agg(*[F.sum(c).alias(c) for c in ("distinct_phrases", "kept", "occurrences")])


@query(
    "agg05_chapter_straddles",
    f"""WITH {TOK}, p AS (SELECT doc_id, pos, word a, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) b FROM tok)
    SELECT a || ' ' || b gram, count(*) count, sum((pos // 100 <> (pos + 1) // 100)::INT)::BIGINT straddles
    FROM p WHERE b IS NOT NULL GROUP BY 1 HAVING count(*) >= 5""",
)
def straddles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences whose words lie in two chapters (of 100 words, as the documents have no others)."""
    found = grams(table(spark, sf_dir, "documents"), 2)
    crossing = F.floor(F.col("pos") / 100) != F.floor((F.col("pos") + 1) / 100)
    return (
        found.groupBy("gram")
        .agg(F.count("*").alias("count"), F.sum(crossing.cast("int")).alias("straddles"))
        .where("count >= 5")
    )


@query(
    "win05_delta_offsets",
    f"""WITH {OFF}, o AS (SELECT source, off FROM off WHERE word = 'the')
    SELECT source, off, off - coalesce(lag(off) OVER (PARTITION BY source ORDER BY off), 0) delta FROM o""",
)
def delta_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of a word in each source, as differences between neighbours."""
    found = offset_tokens(table(spark, sf_dir, "documents")).where("word = 'the'").select("source", "off")
    coded = neighbour(found, ["source"], "off", "before", width=OFFSET_RANGE)
    return coded.select("source", "off", (F.col("off") - F.coalesce("before", F.lit(0))).alias("delta"))


@query(
    "win05_delta_decoded",
    f"""WITH {OFF} SELECT source, off FROM off WHERE word = 'the'""",
)
def decoded_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The differences summed up again."""
    coded = delta_offsets(spark, sf_dir)
    summed = running_before(coded, ["source"], "off", F.col("delta"), "before", OFFSET_RANGE)
    return summed.select("source", (F.col("before") + F.col("delta")).alias("off"))


@query(
    "snk02_phrase_shards",
    f"""WITH {TOK}, p AS (SELECT word a, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) b FROM tok),
    g AS (SELECT a || ' ' || b gram, count(*) c FROM p WHERE b IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)
    SELECT CASE WHEN regexp_matches(substr(gram, 1, 1), '^[a-z]$') THEN substr(gram, 1, 1) ELSE '_' END shard,
    count(*) phrases, sum(c)::BIGINT occurrences FROM g GROUP BY 1""",
)
def phrase_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recurring(grams(table(spark, sf_dir, "documents"), 2).withColumn("n", F.lit(2)))
    return found.groupBy(shard_letter(F.col("gram")).alias("shard")).agg(
        F.count("*").alias("phrases"), F.sum("count").alias("occurrences")
    )


_READINGS = "list_distinct([substr(word, 1, 4), substr(word, 1, 3)])"


@query(
    "win04_reading_bigrams",
    f"""WITH {TOK}, r AS (SELECT doc_id, pos, unnest({_READINGS}) lemma FROM tok WHERE length(word) >= 3)
    SELECT a.lemma || ' ' || b.lemma gram, count(*) count FROM r a JOIN r b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1
    GROUP BY 1 HAVING count(*) >= 20""",
)
def reading_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases over all readings of ambiguous words: every combination counts, at one offset.

    A word's readings stand in its row; the combinations are made where the words are neighbours
    in their array, so nothing is joined.
    """
    worded = table(spark, sf_dir, "documents").select("doc_id", english_words(F.col("text")).alias("w"))
    pairs = worded.select(F.explode(F.arrays_zip(F.expr("slice(w, 1, greatest(size(w) - 1, 0))").alias("a"), F.expr("slice(w, 2, greatest(size(w) - 1, 0))").alias("b"))).alias("p"))
    readings = lambda w: F.array_distinct(F.array(F.substring(w, 1, 4), F.substring(w, 1, 3)))
    both = pairs.select(F.col("p.a").alias("a"), F.col("p.b").alias("b")).where((F.length("a") >= 3) & (F.length("b") >= 3))
    # equal pairs are counted before their readings are combined
    both = both.groupBy("a", "b").agg(F.count("*").alias("c"))
    crossed = both.select("c", "b", F.explode(readings(F.col("a"))).alias("x")).select(
        "c", "x", F.explode(readings(F.col("b"))).alias("y")
    )
    return crossed.groupBy(F.concat_ws(" ", "x", "y").alias("gram")).agg(F.sum("c").alias("count")).where("count >= 20")


# Words that make a phrase grammatical only; two others at least must stand in one that is shown.
FUNCTION_WORDS = """a an the this that these those which who whom whose what
and or but nor if then than as so because although though while whereas
of in on at to for from by with without within into upon about against
among between through during over under above below across along
is are was were be been being am do does did done have has had having
will would shall should may might can could must let
it its he she they them their his her our your my we you i one
not no nor never ever also too very much more most less least
there here now when where how why some any all both each every other another same""".split()


def content_words(gram: Column) -> Column:
    """How many words of a phrase are no function words."""
    stop = F.array(*[F.lit(w) for w in FUNCTION_WORDS])
    return F.size(F.filter(F.split(gram, " "), lambda w: ~F.array_contains(stop, w)))


def browsed(phrases: DataFrame, lengths: list[int], least: int, prefixes: list[str], common: bool = False) -> DataFrame:
    """phrases of some lengths, found so often, that start with one of the prefixes; grammatical ones only if `common`."""
    starts = reduce(Column.__or__, [F.col("gram").startswith(p) for p in prefixes]) if prefixes else F.lit(True)
    kept = phrases.where(F.col("n").isin(lengths) & (F.col("count") >= least) & starts)
    return kept if common else kept.where(content_words(F.col("gram")) >= 2)


_STOP_SQL = ", ".join(f"'{w}'" for w in dict.fromkeys(FUNCTION_WORDS))
#: Phrases of some lengths found at least so often, in SQL: (n, gram, count, sources).
_PHRASES = f"""WITH {TOK}, p AS (SELECT n, source, array_to_string(ws[i:i + n - 1], ' ') gram FROM
  (SELECT w.*, n, unnest(range(1, len(ws) - n + 2)) i FROM w, (SELECT unnest([2, 3]) n) WHERE len(ws) >= n)),
s AS (SELECT n, gram, source, count(*) c FROM p GROUP BY n, gram, source),
g AS (SELECT n, gram, sum(c)::BIGINT count, count(*) sources FROM s GROUP BY n, gram HAVING sum(c) >= 2)"""


@query(
    "flt09_phrase_browser",
    f"""{_PHRASES} SELECT n, gram, count, sources FROM g WHERE count >= 3 AND gram LIKE 'th%'
    AND len(list_filter(string_split(gram, ' '), lambda x: x NOT IN ({_STOP_SQL}))) >= 2""",
)
def phrase_browser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of two and three words with a typed prefix, a least count and two content words at least."""
    found = recurring(all_grams(table(spark, sf_dir, "documents"), 2, 3))
    return browsed(found, [2, 3], 3, ["th"])


@query(
    "ord03_phrases_by_score",
    "SELECT *, row_number() OVER (ORDER BY score DESC, gram) rank FROM (" + _BIGRAMS + ") ORDER BY score DESC, gram LIMIT 50",
)
def phrases_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 phrases with the highest score (a top-k report)."""
    best = bigram_pmi(spark, sf_dir).orderBy(F.desc("score"), "gram").limit(50)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "gram")))
