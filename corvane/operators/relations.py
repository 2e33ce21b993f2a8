"""Joins by what they compute: equality, presence, order, containment, distance, fallback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators.tokens import OFF, TOK, offset_tokens, running_before, segment_bases, tokens
from corvane.plans.registry import query
from corvane.sources.tables import table


def first_found(df: DataFrame, variants: Column, lookup: DataFrame, key: str, by: list[str]) -> DataFrame:
    """For each row of df, the lookup row of its first variant that there is (ordered coalesce); none without one."""
    tried = df.select(*by, F.posexplode(variants).alias("__ord", key))
    found = tried.join(lookup, key)
    best = Window.partitionBy(*by).orderBy("__ord")
    return found.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")


def first_tier(df: DataFrame, tiers: list[Column], lookup: DataFrame, key: str, by: str) -> DataFrame:
    """All lookup rows of the first tier of keys that finds any, with the tier's number.

    The lookup meets the keys of all tiers in one join.
    """
    keys = F.array(*[F.struct(F.lit(i).alias("tier"), k.alias(key)) for i, k in enumerate(tiers)])
    tried = df.select(by, F.explode(keys).alias("__k")).select(by, "__k.tier", f"__k.{key}").where(F.col(key).isNotNull())
    found = tried.join(lookup, key)
    lowest = F.min("tier").over(Window.partitionBy(by))
    return found.withColumn("__least", lowest).where("tier = __least").drop("__least")


def as_of(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str]) -> DataFrame:
    """left with the values of the last right row of its group whose `on` is not greater; null without one.

    Union and a running last value: one shuffle by the group, whatever the number of matches. Both
    sides need distinct rows only in that equal `on` values of the right are resolved by `values`.
    """
    marked = left.withColumn("__side", F.lit(1))
    for v in values:
        marked = marked.withColumn(f"__{v}", F.lit(None).cast(right.schema[v].dataType))
    other = right.select(*by, on, F.lit(0).alias("__side"), *[F.col(v).alias(f"__{v}") for v in values])
    for c in left.columns:
        if c not in [*by, on]:
            other = other.withColumn(c, F.lit(None).cast(left.schema[c].dataType))
    upto = Window.partitionBy(*by).orderBy(on, "__side", *[f"__{v}" for v in values]).rowsBetween(Window.unboundedPreceding, 0)
    both = marked.unionByName(other)
    # a struct keeps the values of one row together, also where one of them is null
    row = F.when(F.col("__side") == 0, F.struct(*[F.col(f"__{v}").alias(v) for v in values]))
    last = both.withColumn("__last", F.last(row, ignorenulls=True).over(upto))
    return last.where("__side = 1").select(*left.columns, *[F.col(f"__last.{v}").alias(v) for v in values])


#: Rows of a dimension that may be broadcast.
BROADCAST_ROWS = 10_000


def nearest_interval(points: DataFrame, intervals: DataFrame, point: str, by: str) -> DataFrame:
    """(by, point, name, distance): the interval (lo, hi, name) nearest to each point; 0 if one holds it, ties by name.

    Intervals are broadcast if they are few. Otherwise the axis is cut into buckets: a point is
    compared with the intervals that reach into its bucket, and with the nearest end to the left
    and start to the right of the bucket, which are found over one row for each bucket.
    """
    distance = F.greatest(F.col("lo") - F.col(point), F.col(point) - F.col("hi"), F.lit(0))
    least = F.min(F.struct(distance.alias("distance"), "name")).alias("b")
    if intervals.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        best = points.join(F.broadcast(intervals)).groupBy(by, point).agg(least)
        return best.select(by, point, "b.name", "b.distance")
    ends = intervals.agg(F.min("lo"), F.max("hi")).first()
    width = max(1, (ends[1] - ends[0]) // BROADCAST_ROWS)
    bucket = lambda c: F.least(F.greatest(F.floor((c - ends[0]) / width), F.lit(-1)), F.lit(BROADCAST_ROWS + 2))
    own = points.select(by, point, bucket(F.col(point)).alias("k"))
    reaching = intervals.withColumn("k", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))))
    inside = own.join(reaching, "k").select(by, point, "lo", "hi", "name")
    # the last end before a bucket, and the first start behind it, over a row for each bucket
    every = points.sparkSession.range(-1, BROADCAST_ROWS + 3).toDF("k")
    left = intervals.groupBy((bucket(F.col("hi")) + 1).alias("k")).agg(F.max(F.col("hi")).alias("far")).join(every, "k", "right")
    left = left.select("k", F.max("far").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)).alias("at"))
    right = intervals.groupBy((bucket(F.col("lo")) - 1).alias("k")).agg(F.min(F.col("lo")).alias("far")).join(every, "k", "right")
    right = right.select("k", F.min("far").over(Window.orderBy("k").rowsBetween(0, Window.unboundedFollowing)).alias("at"))
    first = intervals.groupBy("hi").agg(F.min("name").alias("name")), intervals.groupBy("lo").agg(F.min("name").alias("name"))
    none = F.lit(None).cast("long")
    before = own.join(left, "k").join(first[0], F.col("at") == F.col("hi")).select(by, point, none.alias("lo"), "hi", "name")
    after = own.join(right, "k").join(first[1], F.col("at") == F.col("lo")).select(by, point, "lo", none.alias("hi"), "name")
    gap = F.greatest(F.coalesce(F.col("lo") - F.col(point), F.lit(0)), F.coalesce(F.col(point) - F.col("hi"), F.lit(0)), F.lit(0))
    tried = union_all([inside, before, after])
    best = tried.groupBy(by, point).agg(F.min(F.struct(gap.alias("distance"), "name")).alias("b"))
    return best.select(by, point, "b.name", "b.distance")


# ---- equality and presence ---------------------------------------------------------


@query(
    "jn01_inner_lookup",
    "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)",
)
def jn01(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")


@query(
    "jn02_left_partner",
    """SELECT u.conv_id, u.turn, a.turn partner FROM conversations u
    LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
    WHERE u.role = 'user'""",
)
def jn02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment with its counterpart in the other language (the answer to a question), or null."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    right = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("partner"))
    return turns.where("role = 'user'").drop("role").join(right, ["conv_id", "turn"], "left")


@query(
    "jn02_right_only",
    """SELECT u.conv_id, u.turn FROM conversations u WHERE u.role = 'user' AND NOT EXISTS
    (SELECT 1 FROM conversations a WHERE a.conv_id = u.conv_id AND a.turn = u.turn - 1 AND a.role = 'assistant')""",
)
def jn02_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of one side that no segment of the other stands before (questions that follow no answer)."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    answered = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") + 1).alias("turn"))
    return turns.where("role = 'user'").join(answered, ["conv_id", "turn"], "left_anti").select("conv_id", "turn")


#: A seeded dictionary over the corpus: keys are words' first five letters, analyses their first three and two.
_KEYMAP = f"""{TOK}, keys AS (SELECT word, substr(word, 1, 5) stored FROM (SELECT DISTINCT word FROM tok) WHERE length(word) >= 5),
analyses AS (SELECT stored, unnest([0, 1]) ord, unnest([substr(stored, 1, 3), substr(stored, 2, 3)]) lemma FROM (SELECT DISTINCT stored FROM keys))"""


def key_map(toks: DataFrame) -> DataFrame:
    return toks.where(F.length("word") >= 5).select("word").distinct().select("word", F.substring("word", 1, 5).alias("stored"))


def analyses(keys: DataFrame) -> DataFrame:
    pair = F.array(F.substring("stored", 1, 3), F.substring("stored", 2, 3))
    return keys.select("stored").distinct().select("stored", F.posexplode(pair).alias("ord", "lemma"))


@query(
    "jn03_two_hop_lookup",
    f"""WITH {_KEYMAP} SELECT lemma, count(*) n, count(DISTINCT t.word) forms FROM tok t JOIN keys k USING (word)
    JOIN analyses a USING (stored) GROUP BY lemma""",
)
def jn03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token to stored key to analyses: a token counts for each of its lemmata.

    Equal words are counted before they fan out.
    """
    toks = tokens(table(spark, sf_dir, "documents"))
    keys = key_map(toks)
    counted = toks.groupBy("word").agg(F.count("*").alias("c"))
    return (
        counted.join(keys, "word")
        .join(analyses(keys), "stored")
        .groupBy("lemma")
        .agg(F.sum("c").alias("n"), F.countDistinct("word").alias("forms"))
    )


@query(
    "jn04_first_variant",
    f"""WITH {TOK}, d AS (SELECT word, count(*) n FROM tok GROUP BY word), k AS (SELECT DISTINCT substr(word, 1, 6) k FROM tok WHERE length(word) >= 6),
    v AS (SELECT k, unnest([0, 1, 2]) ord, unnest([k, substr(k, 1, 4), substr(k, 1, 2)]) variant FROM k)
    SELECT k, variant, n, ord FROM v JOIN d ON d.word = variant QUALIFY row_number() OVER (PARTITION BY k ORDER BY ord) = 1""",
)
def jn04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys resolved by the first of their variants that the dictionary has."""
    toks = tokens(table(spark, sf_dir, "documents"))
    dictionary = toks.groupBy("word").agg(F.count("*").alias("n")).withColumnRenamed("word", "variant")
    keys = toks.where(F.length("word") >= 6).select(F.substring("word", 1, 6).alias("k")).distinct()
    tried = F.array(F.col("k"), F.substring("k", 1, 4), F.substring("k", 1, 2))
    return first_found(keys, tried, dictionary, "variant", ["k"]).select("k", "variant", "n", F.col("__ord").alias("ord"))


@query(
    "jn05_tiered_fallback",
    f"""WITH {TOK}, d AS (SELECT DISTINCT substr(word, 1, 3) base, word entry FROM tok WHERE length(word) BETWEEN 3 AND 4),
    v AS (SELECT DISTINCT word FROM tok WHERE length(word) >= 5),
    m AS (SELECT word, 0 tier, entry FROM v JOIN d ON entry = word UNION ALL
      SELECT word, 1, entry FROM v JOIN d ON entry = substr(word, 1, 4) UNION ALL
      SELECT word, 2, entry FROM v JOIN d ON entry = substr(word, 1, 3))
    SELECT word, tier, entry FROM m QUALIFY tier = min(tier) OVER (PARTITION BY word)""",
)
def jn05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries of the first tier that has any: the word, its first four letters, its first three."""
    toks = tokens(table(spark, sf_dir, "documents"))
    entries = toks.where(F.length("word").between(3, 4)).select(F.col("word").alias("entry")).distinct()
    words = toks.where(F.length("word") >= 5).select("word").distinct()
    tiers = [F.col("word"), F.substring("word", 1, 4), F.substring("word", 1, 3)]
    return first_tier(words, tiers, entries, "entry", "word").select("word", "tier", "entry")


@query("jn06_semi", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def jn06(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(wanted, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("jn07_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def jn07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order."""
    ordered = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(ordered, "c_custkey", "left_anti")


@query(
    "jn08_posting_intersection",
    f"""WITH {TOK} SELECT doc_id FROM tok WHERE word = 'the' INTERSECT SELECT doc_id FROM tok WHERE word = 'was'
    INTERSECT SELECT doc_id FROM tok WHERE word = 'with'""",
)
def jn08(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = tokens(table(spark, sf_dir, "documents")).where(F.col("word").isin("the", "was", "with"))
    return toks.groupBy("doc_id").agg(F.countDistinct("word").alias("k")).where("k = 3").select("doc_id")


@query(
    "jn09_adjacent_words",
    f"""WITH {TOK} SELECT a.word left_word, b.word right_word, count(*) n FROM tok a JOIN tok b
    ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.word IN ('the', 'of') GROUP BY 1, 2""",
)
def jn09(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = tokens(table(spark, sf_dir, "documents"))
    after = F.lead("word").over(Window.partitionBy("doc_id").orderBy("pos"))
    pairs = toks.select(F.col("word").alias("left_word"), after.alias("right_word"))
    return pairs.where(F.col("left_word").isin("the", "of") & F.col("right_word").isNotNull()).groupBy("left_word", "right_word").agg(F.count("*").alias("n"))


# ---- order and distance ------------------------------------------------------------


@query(
    "jn11_positional_zip",
    f"""WITH {OFF} SELECT doc_id, source, off, word, 1 + length(word) % 5 sig_id FROM off WHERE pos < 3""",
)
def jn11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of category ids joined to tokens by offset; the offsets are unique in a source."""
    toks = offset_tokens(table(spark, sf_dir, "documents")).where("pos < 3")
    column = toks.select("source", "off", (1 + F.length("word") % 5).cast("long").alias("sig_id"))
    return toks.select("doc_id", "source", "off", "word").join(column, ["source", "off"]).select("doc_id", "source", "off", "word", "sig_id")


@query(
    "jn12_as_of_order",
    """SELECT e.event_id, e.user_id, o.o_orderkey, o.o_totalprice FROM
    (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN
    (SELECT o_custkey, o_orderdate + INTERVAL 10000 DAY ts0, o_orderkey, o_totalprice,
      to_timestamp(epoch(o_orderdate)::BIGINT % 2592000 + 1704067200)::TIMESTAMP ts FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey, epoch(o_orderdate)::BIGINT % 2592000 ORDER BY o_orderkey DESC) = 1) o
    ON e.user_id = o.o_custkey AND e.ts >= o.ts""",
)
def jn12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the last order of that customer before it (order dates moved into the month of the events)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    events = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) % 2592000 + 1704067200
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"), (seconds * 1000000).alias("at"), "o_orderkey", "o_totalprice"
    )
    return as_of(events, orders, ["user_id"], "at", ["o_orderkey", "o_totalprice"]).drop("at")


@query(
    "jn12_offset_to_segment",
    f"""WITH {OFF}, seg AS (SELECT w.doc_id, w.source, base, base + len(ws) stop FROM w JOIN base USING (doc_id)),
    q AS (SELECT DISTINCT source, (off // 1000) * 1000 off FROM off)
    SELECT q.source, q.off, seg.doc_id FROM q JOIN seg ON q.source = seg.source AND q.off >= base AND q.off < stop""",
)
def jn12_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every thousandth offset of a source to the segment that holds it: half-open bounds, last start not greater."""
    segments = segment_bases(table(spark, sf_dir, "documents")).where("n_tokens > 0")
    last = segments.groupBy("source").agg(F.max(F.col("base") + F.col("n_tokens")).alias("stop"))
    asked = last.select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("stop") - 1, F.lit(1000).cast("long"))).alias("base"))
    found = as_of(asked, segments.select("source", "base", "doc_id"), ["source"], "base", ["doc_id"])
    return found.select("source", F.col("base").alias("off"), "doc_id")


@query(
    "jn13_position_to_line",
    f"""WITH l AS (SELECT doc_id, unnest(range(len(ls))) line, unnest(ls) t FROM (SELECT doc_id, string_split(text, chr(10)) ls FROM documents)),
    n AS (SELECT doc_id, line, len(list_filter(list_transform(regexp_extract_all(lower(replace(replace(t, '’', ''''), 'ʼ', '''')), '[a-z'']+'),
      lambda x: regexp_replace(x, '^''+|''+$', '', 'g')), lambda x: x <> '')) n FROM l),
    s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT start FROM n),
    {TOK} SELECT tok.doc_id, tok.pos, s.line FROM tok JOIN s ON s.doc_id = tok.doc_id AND tok.pos >= s.start AND tok.pos < s.start + s.n
    WHERE tok.word = 'then'""",
)
def jn13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of each hit, by running counts of words; words never cross a line end."""
    from corvane.functions.text import english_words

    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    sized = lines.select("doc_id", "line", F.size(english_words(F.col("t"))).alias("n"))
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    starts = sized.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int")).where("n > 0")
    hits = tokens(docs).where("word = 'then'").select("doc_id", F.col("pos").alias("start"))
    found = as_of(hits, starts.select("doc_id", "start", "line"), ["doc_id"], "start", ["line"])
    return found.select("doc_id", F.col("start").cast("long").alias("pos"), F.col("line").cast("long").alias("line"))


_BANDS = [(0, 100, "a"), (200, 400, "b"), (500, 900, "c"), (1500, 3000, "d"), (5000, 20000, "e")]
_BANDS_SQL = "(VALUES " + ", ".join(str(b) for b in _BANDS) + ") b(lo, hi, name)"


@query("jn14_containment", f"SELECT doc_id, n_chars, name FROM documents JOIN {_BANDS_SQL} ON n_chars BETWEEN lo AND hi")
def jn14(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = F.broadcast(spark.createDataFrame(_BANDS, "lo int, hi int, name string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return docs.join(bands, F.col("n_chars").between(F.col("lo"), F.col("hi"))).select("doc_id", "n_chars", "name")


@query(
    "jn15_nearest_interval",
    f"""SELECT doc_id, n_chars, name, d::BIGINT distance FROM (SELECT doc_id, n_chars, name, greatest(lo - n_chars, n_chars - hi, 0) d
    FROM documents, {_BANDS_SQL}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d, name) = 1""",
)
def jn15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest interval of each length; the one that holds it is at distance 0."""
    bands = spark.createDataFrame(_BANDS, "lo long, hi long, name string")
    return nearest_interval(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), bands, "n_chars", "doc_id")


def maximal(intervals: DataFrame, by: str) -> DataFrame:
    """Intervals (lo, hi) of a group that lie in no other one; of equal ones each stays once.

    An interval is inside another if an earlier or equal start has an end as far: a running maximum.
    """
    distinct = intervals.select(by, "lo", "hi").distinct()
    w = Window.partitionBy(by).orderBy("lo", F.desc("hi")).rowsBetween(Window.unboundedPreceding, -1)
    return distinct.withColumn("__far", F.max("hi").over(w)).where("__far IS NULL OR hi > __far").drop("__far")


_INTERVALS = "(SELECT l_orderkey k, min(l_linenumber) * 10 + l_suppkey % 20 lo, min(l_linenumber) * 10 + l_suppkey % 20 + (l_quantity::BIGINT) hi FROM lineitem GROUP BY l_orderkey, l_linenumber, l_suppkey, l_quantity)"


@query(
    "jn16_maximal_intervals",
    f"""WITH i AS (SELECT DISTINCT k, lo, hi FROM {_INTERVALS}) SELECT k, lo, hi FROM i a WHERE NOT EXISTS
    (SELECT 1 FROM i b WHERE b.k = a.k AND b.lo <= a.lo AND b.hi >= a.hi AND (b.lo < a.lo OR b.hi > a.hi))""",
)
def jn16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal(_intervals(spark, sf_dir), "k")


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo = F.col("l_linenumber") * 10 + F.col("l_suppkey") % 20
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), lo.alias("lo"), (lo + F.round("l_quantity").cast("long")).alias("hi")
    )


@query(
    "win11_interval_clusters",
    f"""WITH i AS (SELECT DISTINCT k, lo, hi FROM {_INTERVALS}),
    m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END new FROM i),
    c AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING)::BIGINT cluster FROM m)
    SELECT k, cluster, min(lo) lo, max(hi) hi, count(*) n, max(hi - lo) widest FROM c GROUP BY k, cluster""",
)
def win11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping or touching intervals of a group as one cluster, with its widest member."""
    i = _intervals(spark, sf_dir).distinct()
    before = Window.partitionBy("k").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("k").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    new = F.when(F.col("lo") <= F.max("hi").over(before), 0).otherwise(1)
    marked = i.withColumn("new", new).withColumn("cluster", F.sum("new").over(upto))
    return marked.groupBy("k", "cluster").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"), F.max(F.col("hi") - F.col("lo")).alias("widest")
    )


@query(
    "jn18_similarity_in_group",
    """SELECT a.vec_id a_id, b.vec_id b_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) cos
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0""",
)
def jn18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity matrix within each label: the query set (ids divisible by 50) against all rows of its label."""
    from corvane.operators.similarity import cosine

    vecs = table(spark, sf_dir, "embeddings")
    a = vecs.where("vec_id % 50 = 0").select("label", F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"))
    b = vecs.select("label", F.col("vec_id").alias("b_id"), F.col("embedding").alias("b"))
    pairs = a.join(b, "label").where("a_id <> b_id")
    return pairs.select("a_id", "b_id", F.round(cosine(F.col("a"), F.col("b")), 4).alias("cos"))


@query(
    "jn19_composite_key",
    """SELECT l.l_orderkey, l.l_linenumber, p.p_name, s.s_name FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
    JOIN supplier s ON s.s_suppkey = l.l_suppkey AND s.s_nationkey = p.p_size % 25""",
)
def jn19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of several keys must agree."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", (F.col("p_size") % 25).alias("s_nationkey"))
    supp = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return line.join(part, "l_partkey").join(supp, ["l_suppkey", "s_nationkey"]).select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query(
    "jn20_card_fan_out",
    """SELECT n.n_nationkey, n.n_name, array_to_string(list(c.c_name ORDER BY c.c_acctbal DESC, c.c_custkey)[1:3], '; ') top_names, count(*) n
    FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2""",
)
def jn20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row with its best three partners in order; only these are gathered."""
    cust = table(spark, sf_dir, "customer")
    r = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    best = cust.withColumn("r", r).where("r <= 3").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.array_sort(F.collect_list(F.struct("r", "c_name"))).alias("top")
    )
    counts = cust.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    names = F.array_join(F.transform("top", lambda x: x["c_name"]), "; ")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return nation.join(best, "n_nationkey").join(counts, "n_nationkey").select("n_nationkey", "n_name", names.alias("top_names"), "n")


@query(
    "jn21_neighbour_cooccurrence",
    f"""WITH {TOK}, a AS (SELECT DISTINCT source, doc_id, word FROM tok WHERE length(word) >= 12),
    x AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) ix FROM documents)
    SELECT p.source, p.doc_id, p.word FROM (SELECT a.*, ix FROM a JOIN x USING (source, doc_id)) p WHERE NOT EXISTS
    (SELECT 1 FROM a JOIN x USING (source, doc_id) WHERE a.source = p.source AND a.word = p.word AND ix BETWEEN p.ix - 1 AND p.ix + 1 AND ix <> p.ix)""",
)
def jn21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that stand in no neighbouring segment: one step before or after, by segment number."""
    docs = table(spark, sf_dir, "documents")
    numbered = running_before(docs.select("source", "doc_id"), ["source"], "doc_id", F.lit(1), "ix")
    long_words = tokens(docs).where(F.length("word") >= 12).select("doc_id", "word").distinct()
    there = long_words.join(numbered, "doc_id").select("source", "doc_id", "word", "ix")
    w = Window.partitionBy("source", "word").orderBy("ix")
    near = (F.coalesce(F.col("ix") - F.lag("ix").over(w), F.lit(9)) == 1) | (F.coalesce(F.lead("ix").over(w) - F.col("ix"), F.lit(9)) == 1)
    return there.withColumn("near", near).where("NOT near").select("source", "doc_id", "word")


@query(
    "jn22_span_pairing",
    """WITH a AS (SELECT l_orderkey k, l_linenumber n, l_linenumber * 10 lo, l_linenumber * 10 + l_quantity::BIGINT % 15 hi FROM lineitem),
    b AS (SELECT l_orderkey k, l_linenumber * 12 lo, l_linenumber * 12 + l_suppkey % 9 hi FROM lineitem),
    c AS (SELECT a.k, a.n, count(b.k) m FROM a LEFT JOIN b ON a.k = b.k AND b.lo <= a.hi AND a.lo <= b.hi GROUP BY 1, 2)
    SELECT CASE m WHEN 0 THEN 'no-span' WHEN 1 THEN '1:1' WHEN 2 THEN '1:2' ELSE '1:n' END kind, count(*) n FROM c GROUP BY 1""",
)
def jn22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans paired by overlap within a group, classified by the number of partners."""
    line = table(spark, sf_dir, "lineitem")
    lo = F.col("l_linenumber") * 10
    a = line.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), lo.alias("a_lo"), (lo + F.round("l_quantity").cast("long") % 15).alias("a_hi"))
    start = F.col("l_linenumber") * 12
    b = line.select(F.col("l_orderkey").alias("k"), start.alias("b_lo"), (start + F.col("l_suppkey") % 9).alias("b_hi"), F.lit(1).alias("hit"))
    met = a.join(b, (a["k"] == b["k"]) & (F.col("b_lo") <= F.col("a_hi")) & (F.col("a_lo") <= F.col("b_hi")), "left")
    counted = met.groupBy(a["k"], "n").agg(F.count("hit").alias("m"))
    kind = F.when(F.col("m") == 0, "no-span").when(F.col("m") == 1, "1:1").when(F.col("m") == 2, "1:2").otherwise("1:n")
    return counted.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


# ---- sets --------------------------------------------------------------------------


def _words_of(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("source") == source)
    return tokens(docs).select("word").distinct()


for _name, _op, _sql in (("set01_union", DataFrame.union, "UNION"), ("set02_intersection", DataFrame.intersect, "INTERSECT"), ("set04_difference", DataFrame.subtract, "EXCEPT")):

    @query(_name, f"WITH {TOK} SELECT word FROM tok WHERE source = 'src1' {_sql} SELECT word FROM tok WHERE source = 'src2'")
    def _set(spark: SparkSession, sf_dir: str, op=_op) -> DataFrame:
        return op(_words_of(spark, sf_dir, "src1"), _words_of(spark, sf_dir, "src2")).distinct()


@query(
    "set06_first_of_kind",
    "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
)
def set06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without repeats of (user, type), the first one staying: a minimum, not a sort."""
    best = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id", "value")).alias("b"))
    return best.select("user_id", "event_type", "b.event_id", "b.value")


@query(
    "snk03_merge_last_writer",
    """SELECT k, v FROM (SELECT p_partkey % 500 k, p_name v, p_partkey ord FROM part UNION ALL SELECT s_suppkey, s_name, 1000000 + s_suppkey FROM supplier)
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY ord DESC) = 1""",
)
def snk03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionaries merged by key; the last writer wins."""
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") % 500).alias("k"), F.col("p_name").alias("v"), F.col("p_partkey").alias("ord"))
    supp = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"), (F.col("s_suppkey") + 1000000).alias("ord"))
    return parts.union(supp).groupBy("k").agg(F.max_by("v", "ord").alias("v"))


@query(
    "set09_unique_slugs",
    """WITH r AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') s FROM part),
    n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p_partkey) k FROM r)
    SELECT p_partkey, CASE WHEN k = 1 THEN s ELSE s || '-' || k END slug FROM n""",
)
def set09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs made unique by a number behind the later ones of the same slug."""
    from corvane.functions.text import slug

    named = table(spark, sf_dir, "part").select("p_partkey", slug(F.col("p_type")).alias("s"))
    k = F.row_number().over(Window.partitionBy("s").orderBy("p_partkey"))
    numbered = named.withColumn("k", k)
    return numbered.select("p_partkey", F.when(F.col("k") == 1, F.col("s")).otherwise(F.concat_ws("-", "s", F.col("k").cast("string"))).alias("slug"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
