"""The relational substrate: plain queries over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.plans.registry import query
from corvane.sources.tables import table


@query(
    "rel01_pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) sum_qty, round(sum(l_extendedprice), 2) sum_base,
    round(sum(l_extendedprice * (1 - l_discount)), 2) sum_disc, round(avg(l_quantity), 6) avg_qty, count(*) n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def rel01(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return line.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(disc), 2).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.count("*").alias("n"),
    )


@query(
    "rel02_regional_revenue",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue FROM customer JOIN orders ON c_custkey = o_custkey
    JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
    GROUP BY n_name""",
)
def rel02(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    joined = (
        t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
        .join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    )
    # summed by key before the names join
    by_nation = joined.groupBy("c_nationkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    named = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    return by_nation.join(named, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.round("revenue", 2).alias("revenue"))


@query(
    "rel03_cube",
    """SELECT o_orderstatus, o_orderpriority, count(*) n, grouping(o_orderstatus) g1, grouping(o_orderpriority) g2
    FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
)
def rel03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(
        F.count("*").alias("n"),
        F.grouping("o_orderstatus").cast("long").alias("g1"),
        F.grouping("o_orderpriority").cast("long").alias("g2"),
    )


@query(
    "rel04_pivot",
    """SELECT event_type, count(*) FILTER (user_id % 3 = 0) r0, count(*) FILTER (user_id % 3 = 1) r1, count(*) FILTER (user_id % 3 = 2) r2
    FROM events GROUP BY event_type""",
)
def rel04(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string"))
    pivoted = table(spark, sf_dir, "events").withColumn("kind", kind).groupBy("event_type").pivot("kind", ["r0", "r1", "r2"]).count()
    return pivoted.na.fill(0)


@query(
    "rel05_sessions",
    """WITH e AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT session FROM e)
    SELECT user_id, session, count(*) events FROM s GROUP BY 1, 2""",
)
def rel05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions: an event more than 30 minutes after the one before starts a new one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    new = F.when(F.col("ts") - F.lag("ts").over(w) <= 30 * 60 * 1_000_000, 0).otherwise(1)
    marked = events.withColumn("new", new)
    numbered = marked.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("events"))


@query(
    "rel06_json_fields",
    "SELECT event_type, count(*) n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT k_sum FROM events GROUP BY 1",
)
def rel06(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"))


@query(
    "rel07_daily_windows",
    """SELECT date_trunc('day', ts)::DATE "day", event_type, count(*) n FROM events GROUP BY 1, 2""",
)
def rel07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query(
    "rel08_large_orders",
    """SELECT o_orderkey, o_custkey, sum(l_quantity) qty FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    GROUP BY 1, 2 HAVING sum(l_quantity) > 200""",
)
def rel08(spark: SparkSession, sf_dir: str) -> DataFrame:
    qty = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty")).where("qty > 200")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.join(qty, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", "qty")


@query(
    "rel09_unpivot",
    """SELECT c_custkey, 'balance' field, round(c_acctbal, 2)::VARCHAR filler FROM customer WHERE FALSE UNION ALL
    SELECT c_custkey, 'segment', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'name', c_name FROM customer""",
)
def rel09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "stack(2, 'segment', c_mktsegment, 'name', c_name) as (field, filler)"
    )


@query(
    "src08_pushdown_semi",
    "SELECT word, n FROM (SELECT p_name word, p_size n FROM part) WHERE word IN (SELECT p_name FROM part WHERE p_size = 7)",
)
def src08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary scan that keeps needed keys only."""
    part = table(spark, sf_dir, "part")
    needed = part.where("p_size = 7").select(F.col("p_name").alias("word"))
    return part.select(F.col("p_name").alias("word"), F.col("p_size").alias("n")).join(needed, "word", "left_semi")


@query("src14_prefix_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#00000001%'")
def src14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key range by its prefix, which the scan gets as a pushed filter."""
    return table(spark, sf_dir, "customer").where(F.col("c_name").startswith("Customer#00000001")).select("c_custkey", "c_name")


@query("prj01_previews", "SELECT doc_id, substr(text, 1, 100) head, array_to_string(string_split(text, chr(10))[1:2], ' ') two_lines FROM documents")
def prj01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a result list shows of a text: its head, and its first two lines."""
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.substring("text", 1, 100).alias("head"), F.concat_ws(" ", F.slice(lines, 1, 2)).alias("two_lines")
    )


@query(
    "fn08_reference_keys",
    """SELECT url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) host, coalesce(TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT), -1) number FROM pages""",
)
def fn08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference taken apart into sortable fields."""
    number = F.expr("try_cast(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT)")
    return table(spark, sf_dir, "pages").select(
        "url", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.coalesce(number, F.lit(-1).cast("long")).alias("number")
    )


@query("fn15_slugs", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') slug FROM part")
def fn15(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.functions.text import slug

    return table(spark, sf_dir, "part").select("p_partkey", slug(F.concat_ws(" ", "p_type", "p_brand")).alias("slug"))


@query("fn23_content_hash", "SELECT doc_id, md5(text) hash, sha256(text) digest FROM documents")
def fn23(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text).alias("hash"), F.sha2(text, 256).alias("digest"))


@query(
    "fn23_changed_rows",
    """WITH a AS (SELECT doc_id, md5(text) h FROM documents), b AS (SELECT doc_id, md5(replace(text, '  ', ' ') || CASE WHEN lang = 'fr' THEN '.' ELSE '' END) h FROM documents WHERE lang <> 'es')
    SELECT a.doc_id, CASE WHEN b.h IS NULL THEN 'removed' ELSE 'changed' END state FROM a LEFT JOIN b USING (doc_id) WHERE b.h IS NULL OR a.h <> b.h""",
)
def fn23_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between two versions of a table (the second is derived here), by content hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    a = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    after = F.concat(F.replace("text", F.lit("  "), F.lit(" ")), F.when(F.col("lang") == "fr", ".").otherwise(""))
    b = docs.where("lang <> 'es'").select("doc_id", F.md5(after.cast("binary")).alias("h2"))
    state = F.when(F.col("h2").isNull(), "removed").otherwise("changed")
    return a.join(b, "doc_id", "left").where("h2 IS NULL OR h <> h2").select("doc_id", state.alias("state"))


@query(
    "fn07_sentences",
    """SELECT doc_id, len(list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda s: trim(s)), lambda s: s <> ''))::BIGINT n FROM documents""",
)
def fn07(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.functions.text import sentences

    return table(spark, sf_dir, "documents").select("doc_id", F.size(sentences(F.col("text"))).cast("long").alias("n"))


@query(
    "fn19_note_cross_check",
    """WITH m AS (SELECT conv_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{7,}'))) k FROM conversations WHERE role = 'user'),
    n AS (SELECT conv_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{7,}'))) k FROM conversations WHERE role = 'assistant')
    SELECT DISTINCT coalesce(m.conv_id, n.conv_id) conv_id, coalesce(m.k, n.k) k, m.k IS NOT NULL marked, n.k IS NOT NULL noted
    FROM m FULL JOIN n ON m.conv_id = n.conv_id AND m.k = n.k WHERE m.k IS NULL OR n.k IS NULL""",
)
def fn19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers without a note and notes without a marker (long capitalised words of the questions and the answers stand for them)."""
    found = table(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{7,}"), F.lit(0))).alias("k"))
    sides = found.groupBy("conv_id", "k").agg(
        F.max((F.col("role") == "user").cast("int")).alias("a"), F.max((F.col("role") == "assistant").cast("int")).alias("b")
    )
    return sides.where("a + b = 1").select("conv_id", "k", (F.col("a") == 1).alias("marked"), (F.col("b") == 1).alias("noted"))


@query(
    "fn10_date_buckets",
    """SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1994 THEN 'before' WHEN year(o_orderdate) <= 1996 THEN 'contemporary' ELSE 'ignored' END bucket FROM orders""",
)
def fn10(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate")
    bucket = F.when(year < 1994, "before").when(year <= 1996, "contemporary").otherwise("ignored")
    return table(spark, sf_dir, "orders").select("o_orderkey", bucket.alias("bucket"))


@query(
    "q24_groups_by_first_seen",
    """SELECT source, min(doc_id) first_doc, count(*) n, row_number() OVER (ORDER BY source IS NULL, min(doc_id)) place FROM documents GROUP BY source""",
)
def q24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works by author in the order they are first seen, those without one last; one row a group is ranked."""
    grouped = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))
    return grouped.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").isNull(), "first_doc")))


@query(
    "q23_totals_by_book",
    "SELECT source, lang, count(*) n, sum(n_chars)::BIGINT chars FROM documents GROUP BY 1, 2",
)
def q23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "q22_rows_by_start",
    "SELECT c.conv_id, c.turn, d.doc_id FROM conversations c JOIN documents d ON d.doc_id = c.conv_id AND c.turn = 0",
)
def q22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations looked up by where they start."""
    starts = table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", "turn", F.col("conv_id").alias("doc_id"))
    return starts.join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("conv_id", "turn", "doc_id")


@query(
    "q15_citation_jump",
    """SELECT page_id, regexp_extract(url, '/(en|de|fr|es)/', 1) lang, TRY_CAST(nullif(regexp_extract(url, '/(?:en|de|fr|es)/([0-9]+)', 1), '') AS BIGINT) doc_id,
    d.doc_id IS NOT NULL resolved FROM pages LEFT JOIN documents d ON d.doc_id = TRY_CAST(nullif(regexp_extract(url, '/(?:en|de|fr|es)/([0-9]+)', 1), '') AS BIGINT)""",
)
def q15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A citation parsed from its text and resolved to the segment it names."""
    number = F.expr("try_cast(nullif(regexp_extract(url, '/(?:en|de|fr|es)/([0-9]+)', 1), '') AS BIGINT)")
    cited = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "/(en|de|fr|es)/", 1).alias("lang"), number.alias("doc_id"))
    known = table(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("hit"))
    return cited.join(known, "doc_id", "left").select("page_id", "lang", "doc_id", F.coalesce("hit", F.lit(False)).alias("resolved"))
