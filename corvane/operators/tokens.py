"""Token tables: documents as ordered word streams with offsets, and what is counted on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import english_words
from corvane.plans.registry import query
from corvane.sources.tables import table

#: The token table in DuckDB SQL: (doc_id, source, lang, pos, word).
TOK = """w AS (SELECT doc_id, source, lang, list_filter(list_transform(
  regexp_extract_all(lower(replace(replace(coalesce(text, ''), '’', ''''), 'ʼ', '''')), '[a-z'']+'),
  lambda x: regexp_replace(x, '^''+|''+$', '', 'g')), lambda x: x <> '') ws FROM documents),
tok AS (SELECT doc_id, source, lang, unnest(range(len(ws))) pos, unnest(ws) word FROM w)"""
#: With the running offset of each source: (doc_id, source, lang, pos, word, off).
OFF = (
    TOK
    + """,
base AS (SELECT doc_id, coalesce(sum(len(ws)) OVER (PARTITION BY source ORDER BY doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT base FROM w),
off AS (SELECT tok.*, base + pos off FROM tok JOIN base USING (doc_id))"""
)


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, pos, word) of each word of each document."""
    return docs.select("doc_id", "source", "lang", F.posexplode(english_words(F.col("text"))).alias("pos", "word"))


#: Ids, or offsets, in a range that one task works on.
ID_RANGE, OFFSET_RANGE = 1 << 14, 1 << 20


def _ranged(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("__range", F.floor(F.col(order) / width))


def _by_range(ranged: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
    """ranged with the columns of a table of one row for each range of a group; groups may be null."""
    other = small.toDF(*[f"__k_{c}" if c in [*by, "__range"] else c for c in small.columns])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in [*by, "__range"]])
    return ranged.join(other, same, "left").drop(*[f"__k_{c}" for c in [*by, "__range"]])


def running_before(df: DataFrame, by: list[str], order: str, value: Column, name: str, width: int = ID_RANGE) -> DataFrame:
    """df with `name`: the sum of `value` over the rows of the group that come before in `order`, a long.

    A group is cut into ranges of its order, so that no task holds a group whole; what the
    ranges before hold is summed over one small row for each range.
    """
    ranged = _ranged(df.withColumn("__v", value), order, width)
    totals = ranged.groupBy(*by, "__range").agg(F.sum("__v").alias("__t"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*by, "__range", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("__in", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    return _by_range(summed, bases, by).withColumn(name, F.col("__base") + F.col("__in")).drop("__v", "__range", "__in", "__base")


def neighbour(df: DataFrame, by: list[str], order: str, name: str, behind: bool = False, width: int = ID_RANGE) -> DataFrame:
    """df with `name`: the `order` of the row of its group before it, or behind it; null at the end. Cut as in running_before."""
    ranged = _ranged(df, order, width)
    edge = ranged.groupBy(*by, "__range").agg((F.min if behind else F.max)(order).alias("__edge"))
    over = Window.partitionBy(*by).orderBy("__range")
    beside = edge.select(*by, "__range", (F.lead if behind else F.lag)("__edge").over(over).alias("__beside"))
    inside = (F.lead if behind else F.lag)(order).over(Window.partitionBy(*by, "__range").orderBy(order))
    found = _by_range(ranged.withColumn("__in", inside), beside, by)
    return found.withColumn(name, F.coalesce("__in", "__beside")).drop("__range", "__in", "__beside")


def segment_bases(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, base): words of the source before each document, in document order.

    One small row a document is summed up, not its words.
    """
    sized = docs.select("doc_id", "source", F.size(english_words(F.col("text"))).alias("n_tokens"))
    return running_before(sized, ["source"], "doc_id", F.col("n_tokens"), "base")


def offset_tokens(docs: DataFrame) -> DataFrame:
    """tokens with `off`, the word's offset in its source. The base joins the document's row, before its words fan out."""
    bases = segment_bases(docs).select("doc_id", "base")
    worded = docs.select("doc_id", "source", "lang", english_words(F.col("text")).alias("w")).join(bases, "doc_id")
    toks = worded.select("doc_id", "source", "lang", "base", F.posexplode("w").alias("pos", "word"))
    return toks.withColumn("off", F.col("base") + F.col("pos")).drop("base")


def token_frequency(toks: DataFrame) -> DataFrame:
    """Count, first place and whether any occurrence is longer than ten letters, of each word."""
    return toks.groupBy("word").agg(
        F.count("*").alias("n"),
        F.min(F.struct("doc_id", "pos")).alias("first"),
        F.bool_or(F.length("word") > 10).alias("long_form"),
    )


def postings(toks: DataFrame) -> DataFrame:
    """The inverted index: distinct (word, doc_id, pos), clustered by word in document order.

    By ranges of the whole key, so that the postings of a frequent word fill several partitions.
    """
    distinct = toks.select("word", "doc_id", "pos").dropDuplicates()
    return distinct.repartitionByRange("word", "doc_id", "pos").sortWithinPartitions("word", "doc_id", "pos")


@query(
    "win02_token_positions",
    f"WITH {TOK} SELECT doc_id, count(*) n_tokens, max(pos) last_pos, sum(pos)::BIGINT pos_sum FROM tok GROUP BY 1",
)
def win02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        tokens(table(spark, sf_dir, "documents"))
        .groupBy("doc_id")
        .agg(F.count("*").alias("n_tokens"), F.max("pos").cast("long").alias("last_pos"), F.sum("pos").alias("pos_sum"))
    )


@query(
    "win01_segment_offsets",
    f"WITH {OFF} SELECT w.doc_id, w.source, len(ws)::BIGINT n_tokens, base FROM w JOIN base USING (doc_id)",
)
def win01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_bases(table(spark, sf_dir, "documents")).withColumn("n_tokens", F.col("n_tokens").cast("long"))


@query(
    "agg01_token_frequency",
    f"""WITH {TOK} SELECT word, count(*) n, min(doc_id) first_doc, arg_min(pos, doc_id * 1000000 + pos) first_pos,
    bool_or(length(word) > 10) long_form FROM tok GROUP BY word""",
)
def agg01(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_frequency(tokens(table(spark, sf_dir, "documents")))
    return counted.select(
        "word", "n", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").cast("long").alias("first_pos"), "long_form"
    )


@query("agg02_postings", f"WITH {TOK} SELECT DISTINCT word, doc_id, pos FROM tok")
def agg02(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = postings(tokens(table(spark, sf_dir, "documents")))
    return found.withColumn("pos", F.col("pos").cast("long"))


@query("agg04_unigram_totals", f"WITH {TOK} SELECT count(*) total, count(DISTINCT word) distinct_words FROM tok")
def agg04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(table(spark, sf_dir, "documents")).agg(
        F.count("*").alias("total"), F.countDistinct("word").alias("distinct_words")
    )


@query(
    "agg15_character_inventory",
    """SELECT c, count(*) n, count(DISTINCT doc_id) docs FROM
    (SELECT doc_id, unnest(string_split(text, '')) c FROM documents) WHERE c <> '' GROUP BY c""",
)
def agg15(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "")).alias("c"))
    # counted in each document first, so that the second step has a row for each character and document
    each = chars.where("c <> ''").groupBy("c", "doc_id").agg(F.count("*").alias("n"))
    return each.groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query(
    "agg09_length_classes",
    f"""WITH {TOK} SELECT lang, count(*) n, sum((length(word) >= 8)::INT)::BIGINT long_words,
    sum((length(word) <= 2)::INT)::BIGINT short_words FROM tok GROUP BY lang""",
)
def agg09(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("word")
    return (
        tokens(table(spark, sf_dir, "documents"))
        .groupBy("lang")
        .agg(
            F.count("*").alias("n"),
            F.sum((size >= 8).cast("int")).alias("long_words"),
            F.sum((size <= 2).cast("int")).alias("short_words"),
        )
    )


@query(
    "agg10_weighted_histogram",
    f"""WITH {TOK}, c AS (SELECT word, count(*) n FROM tok GROUP BY word)
    SELECT length(word) size, sum(n)::BIGINT tokens, count(*) words FROM c GROUP BY 1""",
)
def agg10(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens(table(spark, sf_dir, "documents")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.groupBy(F.length("word").cast("long").alias("size")).agg(F.sum("n").alias("tokens"), F.count("*").alias("words"))


@query(
    "agg22_corpus_summary",
    f"""WITH {TOK} SELECT source, lang, count(*) tokens, count(DISTINCT word) words FROM tok
    GROUP BY ROLLUP (source, lang)""",
)
def agg22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        tokens(table(spark, sf_dir, "documents"))
        .rollup("source", "lang")
        .agg(F.count("*").alias("tokens"), F.countDistinct("word").alias("words"))
    )


@query(
    "agg24_defect_rate",
    f"""WITH {TOK} SELECT source, count(*) tokens, sum((length(word) > 20)::INT)::BIGINT defects,
    10000.0 * sum((length(word) > 20)::INT) / count(*) per_10k FROM tok GROUP BY source""",
)
def agg24(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = (F.length("word") > 20).cast("int")
    return (
        tokens(table(spark, sf_dir, "documents"))
        .groupBy("source")
        .agg(
            F.count("*").alias("tokens"),
            F.sum(bad).alias("defects"),
            (F.lit(10000.0).cast("double") * F.sum(bad) / F.count("*")).alias("per_10k"),
        )
    )


@query(
    "set08_dense_ids",
    f"""WITH {OFF}, f AS (SELECT word, min(doc_id * 1000000 + pos) spot FROM tok GROUP BY word)
    SELECT word, row_number() OVER (ORDER BY spot) + 1 id FROM f""",
)
def set08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words interned to ids in the order they are first seen; 0 and 1 are reserved.

    The rank is summed over ranges of first places, so no task sorts all words.
    """
    seen = tokens(table(spark, sf_dir, "documents")).groupBy("word").agg(
        F.min(F.col("doc_id") * 1000000 + F.col("pos")).alias("at")
    )
    return dense_rank_by(seen, "at", 1 << 26).select("word", (F.col("rank") + 1).alias("id"))


def dense_rank_by(df: DataFrame, order: str, width: int) -> DataFrame:
    """df with `rank`, from 1, in the order of a distinct long column, by ranges of `width`."""
    ranged = df.withColumn("__range", F.floor(F.col(order) / width))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    return ranged.withColumn("__r", inside).join(bases, "__range").withColumn("rank", F.col("__base") + F.col("__r")).drop(
        "__range", "__base", "__r"
    )
