"""Windows, ranks, top-k and running state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators.tokens import TOK, running_before, tokens
from corvane.plans.registry import query
from corvane.sources.tables import table


def monotone(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """value raised to the largest so far (clamped), and a flag where that changed it."""
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    far = F.max(value).over(upto)
    return df.withColumn("clamped", far).withColumn("flagged", far > F.col(value))


def interpolated(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Null values of an ordered group, on the line between the known ones beside them; null outside of these."""
    back = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(by).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("x"), F.col(value).alias("y")))
    a, b = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(ahead)
    filled = df.withColumn("__a", a).withColumn("__b", b)
    share = (F.col(order) - F.col("__a.x")) / (F.col("__b.x") - F.col("__a.x"))
    line = F.col("__a.y") + (F.col("__b.y") - F.col("__a.y")) * share
    return filled.withColumn("value", F.when(F.col(value).isNotNull(), F.col(value)).otherwise(line)).drop("__a", "__b")


def greedy_pages(df: DataFrame, by: str, order: str, weight: str, target: int) -> DataFrame:
    """Rows of a group packed in order into pages that end once they hold `target`: a running state."""
    schema = f"{by} {df.schema[by].dataType.simpleString()}, {order} {df.schema[order].dataType.simpleString()}, {weight} {df.schema[weight].dataType.simpleString()}, page long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        page, held, pages = 0, 0, []
        for w in pdf[weight]:
            if held and held + w > target:
                page, held = page + 1, 0
            held += w
            pages.append(page)
        return pdf.assign(page=pages)[[by, order, weight, "page"]]

    return df.select(by, order, weight).groupBy(by).applyInPandas(run, schema)


def strictly_increasing(values: list[int], low: int, high: int) -> list[int]:
    """Values made strictly increasing: a run that collides is spread evenly between its neighbours."""
    out = list(values)
    i = 0
    while i < len(out):
        before = out[i - 1] if i else low - 1
        if out[i] > before:
            i += 1
            continue
        j = i
        while j < len(out) and out[j] <= before:
            j += 1
        after = out[j] if j < len(out) else high
        gap = after - before
        for k in range(i, j):
            out[k] = before + max(k - i + 1, gap * (k - i + 1) // (j - i + 1))
        i = j
    return out


@query(
    "win03_sliding_windows",
    f"""WITH {TOK} SELECT doc_id, pos, word || ' ' || lead(word) OVER w || ' ' || lead(word, 2) OVER w three FROM tok
    WINDOW w AS (PARTITION BY doc_id ORDER BY pos) QUALIFY lead(word, 2) OVER w IS NOT NULL""",
)
def win03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word windows inside a document, at every word."""
    from corvane.operators.ngrams import grams

    found = grams(table(spark, sf_dir, "documents"), 3)
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("gram").alias("three"))


@query(
    "win06_gaps",
    """SELECT l_orderkey, l_linenumber, nxt FROM (SELECT l_orderkey, l_linenumber, lead(l_linenumber) OVER
    (PARTITION BY l_orderkey ORDER BY l_linenumber) nxt FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
    WHERE nxt <> l_linenumber + 1""",
)
def win06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks in numbering between neighbours of a group."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    nxt = F.lead("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return lines.withColumn("nxt", nxt).where("nxt <> l_linenumber + 1")


@query(
    "win07_order_violations",
    "SELECT user_id, event_id, value FROM events QUALIFY lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) > value",
)
def win07(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("b", before).where("b > value").select("user_id", "event_id", "value")


@query(
    "win08_running_words",
    """SELECT conv_id, turn, coalesce(sum(len(regexp_extract_all(coalesce(text, ''), '\\S+'))) OVER (PARTITION BY conv_id ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT words_before FROM conversations""",
)
def win08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a conversation before each turn."""
    from corvane.functions.text import spaced_words

    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    sized = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(spaced_words(F.col("text"))).alias("n"))
    return sized.select("conv_id", "turn", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("words_before"))


@query(
    "win09_monotone_clamp",
    """SELECT o_custkey, o_orderkey, max(o_totalprice) OVER w clamped, max(o_totalprice) OVER w > o_totalprice flagged FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)""",
)
def win09(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return monotone(orders, "o_custkey", "o_orderkey", "o_totalprice").drop("o_totalprice")


def repaired_groups(df: DataFrame, by: str, order: str, value: str, low: int, high: int) -> DataFrame:
    """df (by, order, value) with `repaired`: the values of each group, in order, made strictly increasing.

    Sequential, so plain Python, but over sorted partitions: a call for each group costs far more than its few
    rows. A group may go on from batch to batch. Rows without a value have none repaired and take no part.
    """
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (by, order, value)) + ", repaired long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            keys = held.column(0).to_pylist()
            last = keys[-1]
            end = len(keys)
            while end and keys[end - 1] == last:
                end -= 1
            if end:
                yield from done(held.slice(0, end), keys[:end])
                held = held.slice(end).combine_chunks()
        if held is not None and held.num_rows:
            yield from done(held, held.column(0).to_pylist())

    def done(rows: pa.Table, keys: list) -> Iterator[pa.RecordBatch]:
        values, out = rows.column(2).to_pylist(), []
        i = 0
        while i < len(keys):
            j = i + 1
            while j < len(keys) and keys[j] == keys[i]:
                j += 1
            own = values[i:j]
            if None in own:
                fixed = iter(strictly_increasing([v for v in own if v is not None], low, high))
                out += [None if v is None else next(fixed) for v in own]
            else:
                out += strictly_increasing(own, low, high)
            i = j
        yield from rows.append_column("repaired", pa.array(out, pa.int64())).combine_chunks().to_batches()

    dealt = df.select(by, order, value).repartition(by).sortWithinPartitions(by, F.asc_nulls_last(order), value)
    return dealt.mapInArrow(run, schema)


@query("win10_increasing_repair")
def win10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line positions of an order made strictly increasing."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("at"))
    return repaired_groups(line, "l_orderkey", "l_linenumber", "at", 0, 60)


@query(
    "win12_chapter_ends",
    """SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, max(turn) OVER (PARTITION BY conv_id)) last_turn
    FROM (SELECT c.conv_id, c.turn, c.role FROM conversations c) WHERE role = 'user'""",
)
def win12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of each chapter (a question and what follows) is one before the next start."""
    starts = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn")
    nxt = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return starts.withColumn("last_turn", F.coalesce(nxt, F.max("turn").over(Window.partitionBy("conv_id"))))


@query(
    "win13_running_chapter",
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
    ROWS UNBOUNDED PRECEDING) chapter FROM conversations""",
)
def win13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn belongs to the last question not behind it."""
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    start = F.when(F.col("role") == "user", F.col("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(start, ignorenulls=True).over(upto).alias("chapter"))


@query(
    "win14_interpolation",
    """WITH p AS (SELECT l_orderkey k, l_linenumber x, max(CASE WHEN l_linenumber % 3 = 1 THEN l_linenumber * 100 + l_quantity END) y
      FROM lineitem GROUP BY 1, 2),
    n AS (SELECT k, x, y, last_value(CASE WHEN y IS NOT NULL THEN x END IGNORE NULLS) OVER b xa, last_value(y IGNORE NULLS) OVER b ya,
      first_value(CASE WHEN y IS NOT NULL THEN x END IGNORE NULLS) OVER a xb, first_value(y IGNORE NULLS) OVER a yb FROM p
      WINDOW b AS (PARTITION BY k ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      a AS (PARTITION BY k ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT k, x, round(CASE WHEN y IS NOT NULL THEN y ELSE ya + (yb - ya) * ((x - xa)::DOUBLE / (xb - xa)) END, 6) "value" FROM n""",
)
def win14(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.when(F.col("l_linenumber") % 3 == 1, F.col("l_linenumber") * 100 + F.col("l_quantity"))
    known = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("x")).agg(F.max(y).alias("y"))
    return interpolated(known, "k", "x", "y").select("k", "x", F.round("value", 6).alias("value"))


@query(
    "win15_hyphen_rejoin",
    """WITH l AS (SELECT doc_id, unnest(range(len(ls))) line, unnest(ls) t FROM (SELECT doc_id, string_split(text, chr(10)) ls FROM documents))
    SELECT doc_id, line, regexp_replace(t, '[,.]$', '') || coalesce(regexp_extract(nxt, '^\\S+'), '') joined FROM
    (SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY line) nxt FROM l) WHERE regexp_matches(t, '[,.]$') AND length(t) < 30""",
)
def win15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines that end with a mark (the documents have no hyphens there), joined with the next line's first word."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    nxt = F.lead("t").over(Window.partitionBy("doc_id").orderBy("line"))
    found = lines.withColumn("nxt", nxt).where(F.col("t").rlike("[,.]$") & (F.length("t") < 30))
    joined = F.concat(F.regexp_replace("t", "[,.]$", ""), F.coalesce(F.regexp_extract("nxt", r"^\S+", 0), F.lit("")))
    return found.select("doc_id", F.col("line").cast("long").alias("line"), joined.alias("joined"))


@query(
    "win16_merge_adjacent",
    """WITH c AS (SELECT conv_id, turn, role, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END new FROM conversations),
    g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT run FROM c)
    SELECT conv_id, run, role, min(turn) first_turn, max(turn) last_turn, count(*) n FROM g GROUP BY 1, 2, 3""",
)
def win16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours with the same key become one row (islands)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    new = F.when(F.col("role") == F.lag("role").over(w), 0).otherwise(1)
    marked = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", new.alias("new"))
    runs = marked.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("conv_id", "run", "role").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n"))


def sentence_snap(text: Column, target: Column, slack: int = 12) -> Column:
    """The first sentence start not more than `slack` before a target, else the last one; offsets from 0."""
    parts = F.regexp_extract_all(text, F.lit(r"[^.!?]*[.!?]*\s*"), F.lit(0))
    lengths = F.transform(parts, F.length)
    starts = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda s, x: s + x)
    )
    return F.coalesce(F.get(F.filter(starts, lambda s: s >= target - slack), F.lit(0)), F.element_at(starts, -1))


@query("win17_sentence_snap")
def win17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle of each benchmark text moved to a sentence start."""
    own = table(spark, sf_dir, "benchmark").withColumn("target", F.floor(F.length("text") / 2).cast("int"))
    return own.select("item_id", "target", sentence_snap(F.col("text"), F.col("target")).alias("snapped"))


@query(
    "win18_proportional_ticks",
    """SELECT doc_id, line, (line - 1) * n_chars // 25 off FROM documents, (SELECT unnest([1, 5, 10, 15, 20, 25]) line)""",
)
def win18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks for line 1 and every fifth line, placed in proportion over a text."""
    lines = F.array(*[F.lit(x).cast("long") for x in (1, 5, 10, 15, 20, 25)])
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.explode(lines).alias("line"))
    return docs.select("doc_id", F.col("line").cast("int").alias("line"), F.expr("(line - 1) * n_chars div 25").alias("off"))


@query("win19_proportional_split")
def win19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's words split over its turns in proportion to their length: strictly increasing cuts."""
    from corvane.functions.text import spaced_words

    sized = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(spaced_words(F.col("text"))).alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        total = int(pdf["n"].sum())
        share = pdf["n"].cumsum().shift(fill_value=0) / max(total, 1)
        cuts = strictly_increasing([round(float(s) * 100) for s in share], 0, 100 + len(pdf))
        return pdf.assign(cut=cuts)

    return sized.groupBy("conv_id").applyInPandas(run, "conv_id long, turn long, n int, cut long")


@query(
    "win20_counts_before",
    """SELECT conv_id, turn, coalesce(sum(len(regexp_extract_all(coalesce(text, ''), '[0-9]+'))) OVER (PARTITION BY conv_id ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT notes_before FROM conversations""",
)
def win20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbering offset: notes (here: numbers) in all chapters before this one; none counts as zero."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    n = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9]+"), F.lit(0)))
    sized = table(spark, sf_dir, "conversations").select("conv_id", "turn", n.alias("n"))
    return sized.select("conv_id", "turn", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("notes_before"))


@query(
    "ord01_corpus_order",
    """SELECT d.doc_id, row_number() OVER (PARTITION BY lang ORDER BY regexp_extract(source, '[0-9]+')::INT, doc_id) rank
    FROM documents d""",
)
def ord01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus order: by a work's rank, then document order."""
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", number.alias("number"))
    # documents of the works before, over one row a work; then those of the work itself
    sized = docs.groupBy("lang", "number").agg(F.count("*").alias("n"))
    before = Window.partitionBy("lang").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    base = sized.select(F.col("lang").alias("l"), F.col("number").alias("k"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = running_before(docs, ["lang", "number"], "doc_id", F.lit(1), "inside")
    met = own.join(base, F.col("lang").eqNullSafe(F.col("l")) & F.col("number").eqNullSafe(F.col("k")))
    return met.select("doc_id", (F.col("base") + F.col("inside") + 1).alias("rank"))


@query(
    "ord02_struct_order",
    "SELECT l_orderkey, min((l_suppkey, l_linenumber, l_shipmodee)).l_suppkey m FROM (SELECT l_orderkey, l_suppkey, l_linenumber, l_returnflag l_shipmodee FROM lineitem) GROUP BY 1".replace(
        "min((l_suppkey, l_linenumber, l_shipmodee)).l_suppkey m", "min(l_suppkey * 10 + l_linenumber) // 10 m, min(l_suppkey * 10 + l_linenumber) % 10 line"
    ),
)
def ord02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References compare field by field: the least (page, line) of a group as a struct."""
    least = F.min(F.struct("l_suppkey", "l_linenumber"))
    found = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(least.alias("b"))
    return found.select("l_orderkey", F.col("b.l_suppkey").alias("m"), F.col("b.l_linenumber").cast("long").alias("line"))


@query(
    "top01_ranked_words",
    f"""WITH {TOK}, c AS (SELECT word, count(*) n FROM tok WHERE word NOT IN ('the', 'of', 'and') GROUP BY word HAVING count(*) >= 3)
    SELECT word, n, row_number() OVER (ORDER BY n DESC, word) rank FROM c ORDER BY n DESC, word LIMIT 100""",
)
def top01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 most frequent words that are no stop words (a top-k report)."""
    counted = tokens(table(spark, sf_dir, "documents")).groupBy("word").agg(F.count("*").alias("n"))
    best = counted.where((F.col("n") >= 3) & ~F.col("word").isin("the", "of", "and")).orderBy(F.desc("n"), "word").limit(100)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "word")))


@query(
    "top02_top_of_group",
    """SELECT o_custkey, o_orderkey, o_totalprice, n > 3 capped FROM (SELECT o_custkey, o_orderkey, o_totalprice,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) r, count(*) OVER (PARTITION BY o_custkey) n FROM orders) WHERE r <= 3""",
)
def top02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three of each group, and whether it has more."""
    w = Window.partitionBy("o_custkey")
    r = F.row_number().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey"))
    found = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", r.alias("r"), F.count("*").over(w).alias("n"))
    return found.where("r <= 3").select("o_custkey", "o_orderkey", "o_totalprice", (F.col("n") > 3).alias("capped"))


@query(
    "pag01_fixed_pages",
    "SELECT c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 50 page FROM customer",
)
def pag01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of fifty rows in each group."""
    r = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.floor((r - 1) / 50).alias("page"))


@query("pag02_greedy_pages")
def pag02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole orders of a customer packed into pages of about forty items."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    items = orders.join(line, orders["o_orderkey"] == line["l_orderkey"]).select("o_custkey", "o_orderkey", "n")
    return greedy_pages(items, "o_custkey", "o_orderkey", "n", 40)


@query(
    "rnk01_tiered_relevance",
    """SELECT p_partkey, CASE WHEN lower(p_brand) = 'brand#13' THEN 0 WHEN starts_with(lower(p_name), 'part#1') THEN 1
    WHEN contains(lower(p_type), 'steel') THEN 2 WHEN contains(lower(p_name), '13') THEN 3 ELSE 9 END tier FROM part""",
)
def rnk01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance by the first rule that holds: exact code, title prefix, word, substring."""
    name = F.lower("p_name")
    tier = (
        F.when(F.lower("p_brand") == "brand#13", 0)
        .when(name.startswith("part#1"), 1)
        .when(F.contains(F.lower("p_type"), F.lit("steel")), 2)
        .when(F.contains(name, F.lit("13")), 3)
        .otherwise(9)
    )
    return table(spark, sf_dir, "part").select("p_partkey", tier.alias("tier"))
