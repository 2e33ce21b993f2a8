"""Concordances, distinctiveness, categories of ambiguous words, evaluation figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators.tokens import OFF, TOK, offset_tokens, tokens
from corvane.plans.registry import query
from corvane.sources.tables import table

#: Instances kept of a word in the report of instances.
INSTANCES = 20


# The authors, as a lexicon abbreviates them, whose words are not later than the corpus.
EARLIER_AUTHORS = """Hom. Il. Od. Hes. h.Hom. Thgn. Sol. Tyrt. Mimn. Archil. Alc. Sapph. Alcm. Stesich. Ibyc. Anacr. Simon. Pi. B.
A. S. E. Ar. Cratin. Eup. Pherecr. Alex. Antiph. Anaxandr. Eub. Philem.
Hdt. Th. X. Pl. Hp. Isoc. D. Lys. Aeschin. And. Antipho Is. Lycurg. Hyp. Din. Gorg.
Emp. Parm. Heraclit. Democr. Anaxag. Xenoph. Pythag. Hecat. Hellanic. Pherecyd.""".split()
#: Beginning of the abbreviations of the corpus' own author.
OWN_AUTHOR = "Arist"


def distinctiveness_label(before: Column, contemporary: Column, here: Column, key: Column) -> Column:
    """coined / rare / none, from counts before, beside and in the corpus; none for names (keys with a capital's asterisk)."""
    return (
        F.when(key.startswith("*"), "none")
        .when((before == 0) & (contemporary == 0) & (here >= 3), "coined")
        .when((before > 0) & (before < 5), "rare")
        .otherwise("none")
    )


def lexicon_verdict(authors: Column) -> Column:
    """What a lexicon entry's authors say of a coinage: earlier-attested, corroborated by later ones, or only the corpus' own."""
    others = F.filter(authors, lambda a: ~a.startswith(OWN_AUTHOR))
    earlier = F.array(*[F.lit(a) for a in EARLIER_AUTHORS])
    return (
        F.when(F.size(others) == 0, "own-only")
        .when(F.exists(others, lambda a: F.array_contains(earlier, a)), "earlier-attested")
        .otherwise("corroborated")
    )


@query(
    "agg08_surface_to_lemmas",
    f"""WITH {TOK}, p AS (SELECT DISTINCT word, substr(word, 1, 4) lemma FROM tok WHERE length(word) >= 6
      UNION SELECT DISTINCT word, substr(word, 1, 3) FROM tok WHERE length(word) >= 6)
    SELECT word, array_to_string(list_sort(list(lemma)), ' ') lemmas FROM p GROUP BY word""",
)
def agg08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each surface form with the sorted set of its lemmas."""
    toks = tokens(table(spark, sf_dir, "documents")).where(F.length("word") >= 6)
    pairs = toks.select("word").distinct().select("word", F.explode(F.array(F.substring("word", 1, 4), F.substring("word", 1, 3))).alias("lemma"))
    return pairs.groupBy("word").agg(F.array_join(F.array_sort(F.collect_set("lemma")), " ").alias("lemmas"))


@query(
    "agg11_concordance",
    f"""WITH {TOK}, l AS (SELECT substr(word, 1, 4) lemma, word, source FROM tok WHERE length(word) >= 4)
    SELECT lemma, count(*) n, count(DISTINCT source) works, count(DISTINCT word) forms FROM l GROUP BY lemma HAVING count(*) >= 3""",
)
def agg11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each lemma, over works and forms."""
    toks = tokens(table(spark, sf_dir, "documents")).where("length(word) >= 4")
    lemmas = toks.select(F.substring("word", 1, 4).alias("lemma"), "word", "source")
    return (
        lemmas.groupBy("lemma")
        .agg(F.count("*").alias("n"), F.countDistinct("source").alias("works"), F.countDistinct("word").alias("forms"))
        .where("n >= 3")
    )


@query(
    "agg11_concordance_by_work",
    f"""WITH {TOK}, c AS (SELECT substr(word, 1, 4) lemma, source, count(*) n FROM tok WHERE length(word) >= 4 GROUP BY 1, 2)
    SELECT lemma, source, n, sum(n) OVER (PARTITION BY lemma)::BIGINT total FROM c QUALIFY total >= 50""",
)
def agg11_by_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = tokens(table(spark, sf_dir, "documents")).where("length(word) >= 4")
    counted = toks.groupBy(F.substring("word", 1, 4).alias("lemma"), "source").agg(F.count("*").alias("n"))
    return counted.withColumn("total", F.sum("n").over(Window.partitionBy("lemma"))).where("total >= 50")


@query(
    "prj02_first_instances",
    f"""WITH {OFF} SELECT word, source, doc_id, pos, n > {INSTANCES} truncated FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY doc_id, pos) r,
    count(*) OVER (PARTITION BY word) n FROM off) WHERE r <= {INSTANCES}""",
)
def prj02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first instances of each word (a report with a limit), and whether there are more."""
    toks = tokens(table(spark, sf_dir, "documents"))
    # the first of a word in each bucket of documents, with their number, before a word's rows meet
    share = Window.partitionBy("word", F.pmod("doc_id", F.lit(64)))
    found = toks.withColumn("r", F.row_number().over(share.orderBy("doc_id", "pos"))).withColumn("c", F.count("*").over(share))
    some = found.where(F.col("r") <= INSTANCES)
    w = Window.partitionBy("word")
    total = F.sum(F.when(F.col("r") == 1, F.col("c")).otherwise(0)).over(w)
    kept = some.withColumn("n", total).withColumn("r", F.row_number().over(w.orderBy("doc_id", "pos"))).where(F.col("r") <= INSTANCES)
    return kept.select("word", "source", "doc_id", F.col("pos").cast("long").alias("pos"), (F.col("n") > INSTANCES).alias("truncated"))


@query(
    "agg12_picker_counts",
    f"""WITH {OFF}, p AS (SELECT source, off, unnest(list_distinct([substr(word, 1, 3), substr(word, 1, 4)])) fold, word FROM off WHERE length(word) >= 4)
    SELECT fold, count(DISTINCT (source, off)) n, count(DISTINCT word) heads FROM p GROUP BY fold""",
)
def agg12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each token once for a fold, however many of its readings have it."""
    words = tokens(table(spark, sf_dir, "documents")).where("length(word) >= 4").groupBy("word").agg(F.count("*").alias("c"))
    folds = F.array_distinct(F.array(F.substring("word", 1, 3), F.substring("word", 1, 4)))
    return words.select("word", "c", F.explode(folds).alias("fold")).groupBy("fold").agg(F.sum("c").alias("n"), F.count("*").alias("heads"))


@query(
    "agg13_bucketed_counts",
    f"""WITH {TOK} SELECT substr(word, 1, 4) lemma, sum((source IN ('src0', 'src1'))::INT)::BIGINT before,
    sum((source IN ('src2', 'src3', 'src4'))::INT)::BIGINT contemporary, sum((source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4'))::INT)::BIGINT here
    FROM tok WHERE length(word) >= 4 GROUP BY 1""",
)
def bucketed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a lemma in each period (here: sets of sources), by conditional sums."""
    toks = tokens(table(spark, sf_dir, "documents")).where("length(word) >= 4")
    bucket = F.when(F.col("source").isin("src0", "src1"), "before").when(F.col("source").isin("src2", "src3", "src4"), "contemporary").otherwise("here")
    counted = toks.groupBy(F.substring("word", 1, 4).alias("lemma"), bucket.alias("bucket")).agg(F.count("*").alias("n"))
    sums = [F.sum(F.when(F.col("bucket") == b, F.col("n")).otherwise(0)).alias(b) for b in ("before", "contemporary", "here")]
    return counted.groupBy("lemma").agg(*sums)


_CASED = """regexp_extract_all(replace(replace(coalesce(text, ''), '’', ''''), 'ʼ', ''''), '[A-Za-z'']+')"""


@query(
    "fn11_distinctiveness",
    f"""WITH t AS (SELECT source, trim(unnest({_CASED}), '''') word FROM documents),
    c AS (SELECT lower(substr(word, 1, 4)) lemma, bool_and(regexp_matches(word, '^[A-Z]')) name, sum((source IN ('src0', 'src1'))::INT)::BIGINT b,
    sum((source IN ('src2', 'src3', 'src4'))::INT)::BIGINT k, sum((source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4'))::INT)::BIGINT h
    FROM t WHERE length(word) >= 4 GROUP BY 1)
    SELECT lemma, CASE WHEN name THEN 'none' WHEN b = 0 AND k = 0 AND h >= 3 THEN 'coined' WHEN 0 < b AND b < 5 THEN 'rare' ELSE 'none' END label FROM c""",
)
def fn11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of each lemma; one that is only found capitalised is a name and gets none."""
    plain = F.translate(F.coalesce("text", F.lit("")), "’ʼ", "''")
    cased = table(spark, sf_dir, "documents").select("source", F.explode(F.regexp_extract_all(plain, F.lit("[A-Za-z']+"), F.lit(0))).alias("w"))
    words = cased.select("source", F.btrim("w", F.lit("'")).alias("w")).where(F.length("w") >= 4)
    # equal words of a source are counted before they are told apart by period
    counted = words.groupBy("source", "w").agg(F.count("*").alias("n"))
    within = lambda *names: F.sum(F.when(F.col("source").isin(*names), F.col("n")).otherwise(0))
    before, beside = within("src0", "src1"), within("src2", "src3", "src4")
    sums = counted.groupBy(F.lower(F.substring("w", 1, 4)).alias("lemma")).agg(
        before.alias("before"), beside.alias("contemporary"), (F.sum("n") - before - beside).alias("here"), F.bool_and(F.col("w").rlike("^[A-Z]")).alias("name")
    )
    key = F.concat(F.when(F.col("name"), "*").otherwise(""), F.col("lemma"))
    return sums.select("lemma", distinctiveness_label(F.col("before"), F.col("contemporary"), F.col("here"), key).alias("label"))


# ---- ambiguous categories ----------------------------------------------------------

#: Seeded signatures: id, and the readings of a token as sets of values of each category.
SIGNATURES = [
    (0, []),
    (1, []),
    (2, [{"case": ["nom"], "gender": ["fem"], "number": ["sg"]}]),
    (3, [{"case": ["nom", "voc"], "gender": ["fem"], "number": ["sg"]}]),
    (4, [{"case": ["nom"], "gender": ["fem"], "number": ["sg"]}, {"case": ["acc"], "gender": ["fem"], "number": ["pl"]}]),
    (5, [{"case": ["gen"], "number": ["pl"]}]),
    (6, [{"tense": ["pres"], "number": ["sg"]}]),
]


def signatures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SIGNATURES, "sig_id int, readings array<map<string, array<string>>>")


def reading_satisfies(reading: Column, wanted: dict[str, str]) -> Column:
    """One reading has all wanted values; a category it lacks is not satisfied."""
    out = F.lit(True)
    for category, value in wanted.items():
        out = out & F.coalesce(F.array_contains(F.try_element_at(reading, F.lit(category)), value), F.lit(False))
    return out


def possible(readings: Column, wanted: dict[str, str]) -> Column:
    return F.exists(readings, lambda r: reading_satisfies(r, wanted))


def certain(readings: Column, wanted: dict[str, str]) -> Column:
    """Every reading satisfies, and no wanted category has a second value anywhere."""
    out = (F.size(readings) > 0) & F.forall(readings, lambda r: reading_satisfies(r, wanted))
    for category in wanted:
        out = out & (F.size(F.array_distinct(_values(readings, category))) == 1)
    return out


def _values(readings: Column, category: str) -> Column:
    """All values of a category in any reading."""
    none = F.array().cast("array<string>")
    return F.flatten(F.transform(readings, lambda r: F.coalesce(F.try_element_at(r, F.lit(category)), none)))


def grammar_hits(toks: DataFrame, sigs: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """toks (with sig_id) that may satisfy the query, and whether they certainly do.

    The query is decided on the small table of signatures; the tokens only join its result.
    """
    decided = sigs.select("sig_id", possible(F.col("readings"), wanted).alias("may"), certain(F.col("readings"), wanted).alias("certain"))
    return toks.join(F.broadcast(decided.where("may").drop("may")), "sig_id")


def _sig(word: Column) -> Column:
    """The seeded category column: signature ids by the length of a word."""
    return (F.length(word) % 5 + 2).cast("int")


@query(
    "q04_grammar_search",
    f"""WITH {TOK}, s AS (SELECT *, length(word) % 5 + 2 sig FROM tok) SELECT doc_id, count(*) hits,
    sum((sig = 2)::INT)::BIGINT certain_hits FROM s WHERE sig IN (2, 3, 4) GROUP BY doc_id""",
)
def q04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that may be nominative and feminine, and those that certainly are."""
    toks = tokens(table(spark, sf_dir, "documents")).withColumn("sig_id", _sig(F.col("word")))
    found = grammar_hits(toks, signatures(spark), {"case": "nom", "gender": "fem"})
    return found.groupBy("doc_id").agg(F.count("*").alias("hits"), F.sum(F.col("certain").cast("int")).alias("certain_hits"))


@query(
    "flt06_no_mixed_readings",
    f"WITH {TOK} SELECT count(*) n FROM tok WHERE length(word) % 5 + 2 IN (99)",
)
def flt06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nominative plural: signature 4 has both values, but in different readings."""
    toks = tokens(table(spark, sf_dir, "documents")).withColumn("sig_id", _sig(F.col("word")))
    return grammar_hits(toks, signatures(spark), {"case": "nom", "number": "pl"}).agg(F.count("*").alias("n"))


@query(
    "agg09_ambiguity_rate",
    f"""WITH {TOK}, s AS (SELECT length(word) % 5 + 2 sig, count(*) n FROM tok GROUP BY 1),
    c AS (SELECT 'case' category, sum(CASE WHEN sig IN (2, 3, 4, 5) THEN n ELSE 0 END) licensed, sum(CASE WHEN sig IN (3, 4) THEN n ELSE 0 END) ambiguous FROM s
    UNION ALL SELECT 'gender', sum(CASE WHEN sig IN (2, 3, 4) THEN n ELSE 0 END), 0 FROM s
    UNION ALL SELECT 'number', sum(CASE WHEN sig IN (2, 3, 4, 5, 6) THEN n ELSE 0 END), sum(CASE WHEN sig = 4 THEN n ELSE 0 END) FROM s
    UNION ALL SELECT 'tense', sum(CASE WHEN sig = 6 THEN n ELSE 0 END), 0 FROM s)
    SELECT category, licensed::BIGINT licensed, ambiguous::BIGINT ambiguous FROM c""",
)
def ambiguity_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with a value of a category, and with more than one; counted by signature first."""
    counted = tokens(table(spark, sf_dir, "documents")).groupBy(_sig(F.col("word")).alias("sig_id")).agg(F.count("*").alias("n"))
    joined = counted.join(F.broadcast(signatures(spark)), "sig_id")
    cells = joined.select("sig_id", "n", F.explode("readings").alias("r")).select("sig_id", "n", F.explode("r").alias("category", "values"))
    values = cells.select("sig_id", "n", "category", F.explode("values").alias("v")).groupBy("sig_id", "n", "category").agg(F.countDistinct("v").alias("k"))
    many = F.sum(F.when(F.col("k") > 1, F.col("n")).otherwise(0))
    return values.groupBy("category").agg(F.sum("n").alias("licensed"), many.alias("ambiguous"))


# ---- filters on analyses -----------------------------------------------------------


def redundant_filter(analyses: DataFrame, key: str) -> DataFrame:
    """Unresolved analyses go if a resolved one of the key has the same gloss, or they have none; never all.

    analyses: key, gloss, resolved. Decided by sets over the key's window.
    """
    w = Window.partitionBy(key)
    some = F.max(F.col("resolved").cast("int")).over(w) == 1
    glosses = F.collect_set(F.when(F.col("resolved"), F.col("gloss"))).over(w)
    idle = (F.coalesce("gloss", F.lit("")) == "") | F.array_contains(glosses, F.col("gloss"))
    drop = some & ~F.col("resolved") & F.coalesce(idle, F.lit(True))
    return analyses.withColumn("__drop", drop).where("NOT __drop").drop("__drop")


@query(
    "flt13_redundant_analyses",
    """WITH a AS (SELECT l_orderkey k, l_linenumber n, l_shipflag gloss, l_discount > 0.05 resolved FROM (SELECT *, CASE WHEN l_tax < 0.02 THEN '' ELSE l_returnflag END l_shipflag FROM lineitem)),
    r AS (SELECT DISTINCT k, gloss FROM a WHERE resolved)
    SELECT k, n, gloss, resolved FROM a WHERE resolved OR NOT EXISTS (SELECT 1 FROM r WHERE r.k = a.k)
    OR (gloss <> '' AND NOT EXISTS (SELECT 1 FROM r WHERE r.k = a.k AND r.gloss = a.gloss))""",
)
def flt13(spark: SparkSession, sf_dir: str) -> DataFrame:
    gloss = F.when(F.col("l_tax") < 0.02, "").otherwise(F.col("l_returnflag"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), gloss.alias("gloss"), (F.col("l_discount") > 0.05).alias("resolved")
    )
    return redundant_filter(rows, "k")


@query(
    "flt12_function_words",
    f"""WITH {TOK}, c AS (SELECT word, count(*) n FROM tok GROUP BY word)
    SELECT word, n, n >= 200 OR word IN ('the', 'and', 'of') is_function FROM c WHERE n >= 50""",
)
def flt12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed list, or frequent in the corpus."""
    counted = tokens(table(spark, sf_dir, "documents")).groupBy("word").agg(F.count("*").alias("n")).where("n >= 50")
    return counted.withColumn("is_function", (F.col("n") >= 200) | F.col("word").isin("the", "and", "of"))


# ---- evaluation --------------------------------------------------------------------


@query(
    "agg14_outliers",
    """SELECT doc_id, source FROM documents QUALIFY abs(n_chars - avg(n_chars) OVER (PARTITION BY source))
    > 1.5 * stddev_samp(n_chars) OVER (PARTITION BY source)""",
)
def agg14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose length is more than 1.5 deviations from their source's mean: two figures a source, joined."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    figures = docs.groupBy("source").agg(F.avg("n_chars").alias("mean"), F.stddev_samp("n_chars").alias("sd"))
    return docs.join(figures, "source").where(F.abs(F.col("n_chars") - F.col("mean")) > 1.5 * F.col("sd")).select("doc_id", "source")


@query("agg16_min_max_span", "SELECT l_orderkey, min(l_linenumber) lo, max(l_linenumber) hi FROM lineitem GROUP BY 1")
def agg16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))


@query(
    "agg18_evaluation",
    """SELECT quality, count(*) n, round(avg(n_chars), 4) mean, median(n_chars)::DOUBLE median, max(n_chars) longest,
    round(100.0 * sum(toxic) / count(*), 4) toxic_pct FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (quality)""",
)
def agg18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures by tier and overall."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return joined.rollup("quality").agg(
        F.count("*").alias("n"),
        F.round(F.avg("n_chars"), 4).alias("mean"),
        F.median("n_chars").alias("median"),
        F.max("n_chars").alias("longest"),
        F.round(F.lit(100.0).cast("double") * F.sum("toxic") / F.count("*"), 4).alias("toxic_pct"),
    )


@query(
    "agg19_percentiles",
    """SELECT event_type, round(quantile_cont("value", 0.9), 6) p90, round(avg("value"), 6) mean,
    round(avg(("value" <= 10)::INT), 6) within_10 FROM events GROUP BY 1""",
)
def agg19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.round(F.expr("percentile(value, 0.9)"), 6).alias("p90"),
        F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.avg((F.col("value") <= 10).cast("int")), 6).alias("within_10"),
    )


@query(
    "agg21_union_of_positions",
    f"""WITH {TOK} SELECT doc_id, count(DISTINCT pos) n FROM (SELECT doc_id, pos FROM tok WHERE word LIKE 'th%'
    UNION ALL SELECT doc_id, pos FROM tok WHERE word LIKE '%tion') GROUP BY doc_id""",
)
def agg21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of overlapping readings are united: a word that both have counts once."""
    toks = tokens(table(spark, sf_dir, "documents"))
    return toks.where(F.col("word").startswith("th") | F.col("word").endswith("tion")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(
    "agg23_match_rate",
    f"""WITH {TOK}, d AS (SELECT DISTINCT word FROM tok WHERE source = 'src0')
    SELECT source, count(*) n, count(d.word) matched, round(100.0 * count(d.word) / count(*), 6) rate FROM tok LEFT JOIN d USING (word) GROUP BY source""",
)
def agg23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of tokens that a dictionary (the words of one source) knows; words are counted before the join."""
    toks = tokens(table(spark, sf_dir, "documents"))
    known = toks.where("source = 'src0'").select("word").distinct().withColumn("hit", F.lit(1))
    counted = toks.groupBy("source", "word").agg(F.count("*").alias("c")).join(known, "word", "left")
    matched = F.sum(F.when(F.col("hit") == 1, F.col("c")).otherwise(0))
    return counted.groupBy("source").agg(
        F.sum("c").alias("n"), matched.alias("matched"), F.round(F.lit(100.0).cast("double") * matched / F.sum("c"), 6).alias("rate")
    )


@query(
    "agg26_gap_report",
    """WITH l AS (SELECT DISTINCT l_orderkey k, l_linenumber * 2 - l_linenumber % 2 n FROM lineitem),
    r AS (SELECT k, unnest(range(min(n), max(n) + 1)) n FROM l GROUP BY k) SELECT k, n FROM r EXCEPT SELECT k, n FROM l""",
)
def agg26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that lack between the least and the largest of a group."""
    n = (F.col("l_linenumber") * 2 - F.col("l_linenumber") % 2).alias("n")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), n).distinct()
    every = lines.groupBy("k").agg(F.sequence(F.min("n"), F.max("n")).alias("r")).select("k", F.explode("r").alias("n"))
    return every.join(lines, ["k", "n"], "left_anti").withColumn("n", F.col("n").cast("long"))


@query(
    "agg27_before_after",
    """WITH a AS (SELECT event_type, count(*) n FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1),
    b AS (SELECT event_type, count(*) n FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1)
    SELECT coalesce(a.event_type, b.event_type) flag, coalesce(a.n, 0) before, coalesce(b.n, 0) after FROM a FULL JOIN b ON a.event_type = b.event_type""",
)
def agg27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each flag before and after a change."""
    events = table(spark, sf_dir, "events")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    side = lambda c: events.where(c).groupBy(F.col("event_type").alias("flag"))
    a = side(F.col("ts").cast("timestamp_ntz") < cut).agg(F.count("*").alias("before"))
    b = side(F.col("ts").cast("timestamp_ntz") >= cut).agg(F.count("*").alias("after"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return a.join(b, "flag", "full").select("flag", zero("before"), zero("after"))
