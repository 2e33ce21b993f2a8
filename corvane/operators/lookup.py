"""Lookups around a search: headwords, word cards, phrase plans and citations, page blocks, curation."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import spaced_words
from corvane.operators.ngrams import grams, reading_bigrams
from corvane.operators.relations import as_of
from corvane.operators.search import READINGS_CAP, readings
from corvane.operators.tokens import OFF, OFFSET_RANGE, TOK, running_before, segment_bases, tokens
from corvane.plans.registry import query
from corvane.sources.tables import table

# ---- headwords and word cards ------------------------------------------------------


def headword_options(words: DataFrame, lemma_map: DataFrame | None) -> DataFrame:
    """(word, options): a word's headwords; an empty list for a word that the map lacks, null if there is no map."""
    if lemma_map is None:
        return words.select("word", F.lit(None).cast("array<string>").alias("options"))
    joined = words.join(lemma_map, "word", "left")
    return joined.select("word", F.coalesce("options", F.array().cast("array<string>")).alias("options"))


def lemma_map_of(toks: DataFrame) -> DataFrame:
    """A seeded map: the words of at least four letters, each with its first four and first three as headwords."""
    words = toks.where(F.length("word") >= 4).select("word").distinct()
    return words.select("word", F.array_distinct(F.array(F.substring("word", 1, 4), F.substring("word", 1, 3))).alias("options"))


_TYPED = ["then", "that", "of", "thor", "zzzz", "the"]


@query(
    "q06_headword_options",
    f"""WITH {TOK}, m AS (SELECT DISTINCT word FROM tok WHERE length(word) >= 4), t AS (SELECT unnest({_TYPED}) word)
    SELECT t.word, CASE WHEN m.word IS NULL THEN '' ELSE array_to_string(list_distinct([substr(t.word, 1, 4), substr(t.word, 1, 3)]).list_sort(), ' ') END options
    FROM t LEFT JOIN m USING (word)""",
)
def q06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headwords of typed words (the query's own list)."""
    typed = spark.createDataFrame([(w,) for w in _TYPED], "word string")
    found = headword_options(typed, lemma_map_of(tokens(table(spark, sf_dir, "documents"))))
    return found.select("word", F.array_join(F.array_sort("options"), " ").alias("options"))


def word_cards(analyses: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, n_analyses, entries): the lexicon entries of a word's analyses, each once, in the order they are first named.

    analyses: word, ord, keys (array); lexicon: key, entry. Keys without an entry are left out.
    """
    counted = analyses.groupBy("word").agg(F.count("*").alias("n_analyses"))
    named = analyses.select("word", "ord", F.posexplode("keys").alias("at", "key"))
    first = named.groupBy("word", "key").agg(F.min(F.struct("ord", "at")).alias("place")).join(lexicon, "key")
    listed = first.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("place", "entry"))).alias("e"))
    entries = F.coalesce(F.transform("e", lambda x: x["entry"]), F.array().cast("array<string>"))
    return counted.join(listed, "word", "left").select("word", "n_analyses", entries.alias("entries"))


@query(
    "q14_word_cards",
    f"""WITH {TOK}, k AS (SELECT DISTINCT word FROM tok WHERE length(word) >= 5),
    a AS (SELECT word, 0 ord, [substr(word, 1, 3), substr(word, 1, 4)] keys FROM k UNION ALL SELECT word, 1, [substr(word, 1, 4), substr(word, 2, 3)] FROM k),
    n AS (SELECT word, ord * 10 + unnest(range(len(keys))) place, unnest(keys) key FROM a),
    f AS (SELECT word, key, min(place) place FROM n GROUP BY word, key),
    l AS (SELECT DISTINCT word key FROM tok WHERE length(word) IN (3, 4)),
    e AS (SELECT word, string_agg(upper(key), ' ' ORDER BY place) entries FROM f JOIN l USING (key) GROUP BY word)
    SELECT k.word, 2::BIGINT n_analyses, coalesce(entries, '') entries FROM k LEFT JOIN e USING (word)""",
)
def q14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards of all words over a seeded dictionary: two analyses a word, entries for the short words of the corpus."""
    toks = tokens(table(spark, sf_dir, "documents"))
    words = toks.where(F.length("word") >= 5).select("word").distinct()
    part = lambda at, n: F.substring("word", at, n)
    cards = F.array(
        F.struct(F.lit(0).alias("ord"), F.array(part(1, 3), part(1, 4)).alias("keys")), F.struct(F.lit(1).alias("ord"), F.array(part(1, 4), part(2, 3)).alias("keys"))
    )
    analyses = words.select("word", F.inline(cards))
    lexicon = toks.where(F.length("word").isin(3, 4)).select(F.col("word").alias("key")).distinct().withColumn("entry", F.upper("key"))
    return word_cards(analyses, lexicon).withColumn("entries", F.array_join("entries", " "))


# ---- phrases -----------------------------------------------------------------------


def browse_plan(typed: str, options: dict[str, list[str]] | None, cap: int = READINGS_CAP) -> tuple[dict[str, list[str]], int]:
    """The prefixes to look for by shard letter, and how many readings there were if not all are tried (else 0).

    Each typed word stands for its headwords, or for itself if it has none (it may still be being
    typed). Without a map, without any headword, or for one letter, the prefix is looked for as typed.
    """
    words = typed.split(" ")
    shard = lambda t: t[0] if "a" <= t[:1] <= "z" else "_"
    if not typed:
        return {}, 0
    if len(typed) < 2 or options is None or not any(options.get(w) for w in words):
        return {shard(typed): [typed]}, 0
    tried, total = readings([options.get(w) or [w] for w in words], cap)
    plan: dict[str, list[str]] = {}
    for reading in tried:
        plan.setdefault(shard(reading[0]), []).append(" ".join(reading))
    return plan, total if total > len(tried) else 0


@query(
    "q12_phrase_plan",
    f"""WITH {TOK}, r AS (SELECT doc_id, pos, unnest(list_distinct([substr(word, 1, 4), substr(word, 1, 3)])) lemma FROM tok WHERE length(word) >= 3),
    g AS (SELECT a.lemma || ' ' || b.lemma gram, count(*) count FROM r a JOIN r b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 GROUP BY 1 HAVING count(*) >= 20)
    SELECT gram, count FROM g WHERE gram LIKE 'then that%' OR gram LIKE 'the that%' OR gram LIKE 'then tha%' OR gram LIKE 'the tha%'""",
)
def q12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of headwords for the typed words "then that", by all readings of these."""
    typed = "then that"
    known = headword_options(
        spark.createDataFrame([(w,) for w in typed.split()], "word string"), lemma_map_of(tokens(table(spark, sf_dir, "documents")))
    )
    options = {r["word"]: list(r["options"]) for r in known.collect()}  # a row for each typed word
    plan, _ = browse_plan(typed, options or None)
    prefixes = [p for own in plan.values() for p in own]
    hit = F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(F.col("gram"), p))
    return reading_bigrams(spark, sf_dir).where(hit)


#: Citations shown of a phrase in a work.
CITATIONS = 40


@query(
    "q13_phrase_citations",
    f"""WITH {OFF}, h AS (SELECT a.source, a.doc_id, a.off FROM off a JOIN off b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.word = 'of' AND b.word = 'the')
    SELECT source, doc_id, off, total FROM (SELECT *, count(*) OVER (PARTITION BY source) total, row_number() OVER (PARTITION BY source ORDER BY off) r FROM h) WHERE r <= {CITATIONS}""",
)
def q13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first citations of a phrase in each work (a report with a limit), with the work's total.

    The phrase index has offsets only; each is located in the last segment that does not start behind it.
    """
    docs = table(spark, sf_dir, "documents")
    segments = segment_bases(docs).where("n_tokens > 0")
    starts = grams(docs, 2).where("gram = 'of the'").select("doc_id", "pos")
    offsets = starts.join(segments.select("doc_id", "source", "base"), "doc_id").select("source", (F.col("base") + F.col("pos")).alias("base"))
    numbered = running_before(offsets, ["source"], "base", F.lit(1), "before", OFFSET_RANGE)
    total = offsets.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("total"))
    first = numbered.where(F.col("before") < CITATIONS).join(total, F.col("source").eqNullSafe(F.col("s"))).select("source", "base", "total")
    located = as_of(first, segments.select("source", "base", "doc_id"), ["source"], "base", ["doc_id"])
    return located.select("source", "doc_id", F.col("base").alias("off"), "total")


def approximate_works(hits: DataFrame, bounds: DataFrame, unit: str, crosses: bool) -> DataFrame:
    """Works among the hits whose chapters start at places that are not exact; none if chapters play no part.

    hits: work; bounds: work, start, accuracy. A chapter that starts a work is exact in any case.
    """
    doubtful = bounds.where("accuracy <> 'exact' AND start <> 0").select("work").distinct()
    found = hits.select("work").distinct().join(doubtful, "work", "left_semi")
    return found if unit == "chapter" or not crosses else found.limit(0)


@query(
    "q11_approximate_chapters",
    """SELECT DISTINCT conv_id work FROM conversations h WHERE contains(lower(text), 'the') AND conv_id IN
    (SELECT conv_id FROM conversations WHERE role = 'user' AND turn <> 0 AND NOT ends_with(trim(text), '?'))""",
)
def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with a hit whose later questions (chapters) are not marked exactly, by a question mark."""
    turns = table(spark, sf_dir, "conversations")
    hits = turns.where(F.contains(F.lower("text"), F.lit("the"))).select(F.col("conv_id").alias("work"))
    exact = F.when(F.endswith(F.trim("text"), F.lit("?")), "exact").otherwise("approximate")
    bounds = turns.where("role = 'user'").select(F.col("conv_id").alias("work"), F.col("turn").alias("start"), exact.alias("accuracy"))
    return approximate_works(hits, bounds, "chapter", True)


# ---- tolerant runs -----------------------------------------------------------------


def tolerant(items: Iterable, run: Callable, limit: int = 4) -> tuple[dict, dict]:
    """(results, failures) of run(item) for each item, at most `limit` at a time; an item that fails stops no other.

    For jobs of few works; within a job, Spark's own tasks are the pool.
    """
    done, failed = {}, {}

    def one(item):
        try:
            done[item] = run(item)
        except Exception as e:  # noqa: BLE001 - whatever it is, it is this item's
            failed[item] = str(e).splitlines()[0] if str(e) else type(e).__name__

    with ThreadPoolExecutor(limit) as pool:
        list(pool.map(one, items))
    return done, failed


@query(
    "q20_tolerant_runs",
    "SELECT l lang, (SELECT count(*) FROM documents WHERE lang = l AND l <> 'xx') n, l = 'xx' failed FROM (SELECT unnest(['en', 'de', 'fr', 'es', 'xx']) l)",
)
def q20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by language, each a job of its own; the job of a language that does not exist fails."""
    docs = table(spark, sf_dir, "documents")

    def count(lang: str) -> int:
        if lang == "xx":
            raise LookupError("no such language")
        return docs.where(F.col("lang") == lang).count()

    done, failed = tolerant(["en", "de", "fr", "es", "xx"], count)
    rows = [(x, n, False) for x, n in done.items()] + [(x, 0, True) for x in failed]
    return spark.createDataFrame(rows, "lang string, n long, failed boolean")


# ---- page blocks -------------------------------------------------------------------


def page_blocks(lines: DataFrame, starts: DataFrame, by: str = "seg") -> DataFrame:
    """(by, block, chapter, n, first_word, words, cont): a segment's lines cut where chapters start, maybe within a line.

    lines: by, n, words (array); starts: by, chapter, line, word. A block holds what stands from its
    start to the next one; block 0 goes on with the chapter before. A start on a line that is not
    there falls to the next line. `cont`: the part does not begin its line. Empty lines are kept whole.
    """
    real = lines.select(by, F.col("n").alias("line"), F.col("n").alias("real"))
    # a start moves to the first line not before it
    moved = starts.withColumn("neg", -F.col("line"))
    on = real.select(by, (-F.col("line")).alias("neg"), "real")
    placed = as_of(moved, on, [by], "neg", ["real"]).where("real IS NOT NULL")
    placed = placed.withColumn("word", F.when(F.col("real") == F.col("line"), F.col("word")).otherwise(0))
    numbered = placed.withColumn("block", F.row_number().over(Window.partitionBy(by).orderBy("real", "word", "chapter")))
    each = lines.select(by, "n", F.explode_outer(F.when(F.size("words") > 0, F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("w"))))).alias("x"))
    each = each.select(by, "n", F.coalesce("x.at", F.lit(0)).alias("at"), "x.w")
    key = lambda n, at: n.cast("long") * (1 << 32) + at
    words = each.withColumn("key", key(F.col("n"), F.col("at")))
    cuts = numbered.select(by, key(F.col("real"), F.col("word")).alias("key"), "block", "chapter")
    cuts = cuts.groupBy(by, "key").agg(F.max(F.struct("block", "chapter")).alias("b")).select(by, "key", "b.block", "b.chapter")
    owned = as_of(words, cuts, [by], "key", ["block", "chapter"]).withColumn("block", F.coalesce("block", F.lit(0)))
    parts = owned.groupBy(by, "block", "n").agg(
        F.first("chapter").alias("chapter"), F.min("at").alias("first_word"), F.array_sort(F.collect_list(F.when(F.col("w").isNotNull(), F.struct("at", "w")))).alias("ws")
    )
    return parts.select(by, "block", "chapter", "n", "first_word", F.transform("ws", lambda x: x["w"]).alias("words"), (F.col("first_word") > 0).alias("cont"))


def translation_slices(starts: DataFrame, length: DataFrame, by: str = "seg") -> DataFrame:
    """(by, block, start, stop): the translation's part of each block; block 0 before the first start, if there is any."""
    w = Window.partitionBy(by).orderBy("offset", "chapter")
    found = starts.withColumn("block", F.row_number().over(w)).withColumn("next", F.lead("offset").over(w)).join(length, by)
    own = found.select(by, "block", F.col("offset").alias("start"), F.coalesce("next", "length").alias("stop"))
    first = found.where("block = 1 AND offset > 0").select(by, F.lit(0).alias("block"), F.lit(0).cast("long").alias("start"), F.col("offset").alias("stop"))
    return own.union(first)


_PAGE = """l AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '\\S+') ws FROM conversations),
s AS (SELECT conv_id, turn, turn line, len(ws) // 2 word FROM l JOIN conversations USING (conv_id, turn) WHERE role = 'assistant')"""


def _page(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("seg"), F.col("turn").alias("n"), "role", "text")
    lines = turns.select("seg", "n", spaced_words(F.col("text")).alias("words"))
    half = F.floor(F.size(spaced_words(F.col("text"))) / 2).cast("int")
    return lines, turns.where("role = 'assistant'").select("seg", F.col("n").alias("chapter"), F.col("n").alias("line"), half.alias("word"))


@query(
    "q21_page_blocks",
    f"""WITH {_PAGE}, w AS (SELECT conv_id, turn, unnest(range(greatest(len(ws), 1))) "at", len(ws) n FROM l),
    b AS (SELECT w.*, (SELECT count(*) FROM s WHERE s.conv_id = w.conv_id AND (s.line < w.turn OR s.line = w.turn AND s.word <= w."at")) block FROM w)
    SELECT conv_id seg, block, turn n, min("at") first_word, CASE WHEN max(n) = 0 THEN 0 ELSE count(*) END words FROM b GROUP BY 1, 2, 3""",
)
def q21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pages whose chapters start in the middle of each answer."""
    found = page_blocks(*_page(spark, sf_dir))
    return found.select("seg", "block", "n", "first_word", F.size("words").cast("long").alias("words"))


@query(
    "q21_translation_slices",
    """WITH o AS (SELECT conv_id seg, turn, role, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT "offset" FROM conversations),
    n AS (SELECT conv_id seg, sum(length(text))::BIGINT length FROM conversations GROUP BY 1),
    s AS (SELECT seg, "offset", row_number() OVER w block, lead("offset") OVER w nxt FROM o WHERE role = 'assistant' WINDOW w AS (PARTITION BY seg ORDER BY "offset", turn))
    SELECT seg, block, "offset" "start", coalesce(nxt, length) stop FROM s JOIN n USING (seg) UNION ALL SELECT seg, 0, 0, "offset" FROM s WHERE block = 1 AND "offset" > 0""",
)
def q21_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("seg"), F.col("turn").alias("chapter"), "role", F.length("text").alias("n"))
    before = Window.partitionBy("seg").orderBy("chapter").rowsBetween(Window.unboundedPreceding, -1)
    starts = turns.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).where("role = 'assistant'")
    length = turns.groupBy("seg").agg(F.sum("n").alias("length"))
    return translation_slices(starts.select("seg", "chapter", "offset"), length)


# ---- word indexes and curation -----------------------------------------------------


def remapped_index(words: Column, toks: Column, index: Column) -> Column:
    """The place in `toks` of the word number `index`; null unless both have the same words, empty ones left out."""
    kept = F.filter(F.transform(toks, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda x: x["t"] != "")
    same = F.transform(kept, lambda x: x["t"]) == F.filter(words, lambda w: w != "")
    return F.when(same & (index >= 0), F.get(kept, index)["i"])


@query(
    "aln18_word_index",
    """WITH l AS (SELECT doc_id, string_split(text, chr(10))[1] line FROM documents),
    x AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(line), '[^a-z ]', '', 'g'), ' '), lambda w: w <> '') ws,
      list_transform(regexp_extract_all(line, '\\S+'), lambda t: regexp_replace(lower(t), '[^a-z]', '', 'g')) ts FROM l)
    SELECT doc_id, CASE WHEN ws = list_filter(ts, lambda t: t <> '') THEN list_filter(range(len(ts)), lambda i: ts[i + 1] <> '')[4] END place FROM x""",
)
def aln18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth word of each document's first line, as a place among its tokens."""
    line = F.element_at(F.split("text", "\n"), 1)
    words = F.split(F.regexp_replace(F.lower(line), "[^a-z ]", ""), " ")
    toks = F.transform(spaced_words(line), lambda t: F.regexp_replace(F.lower(t), "[^a-z]", ""))
    return table(spark, sf_dir, "documents").select("doc_id", remapped_index(words, toks, F.lit(3)).cast("long").alias("place"))


def curated(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """(index, lo, hi, url, blocked) of the decisions that keep a candidate, in the order of neither.

    candidates: index, lo, hi, url; decisions: index, action, lo, hi, url. Rejected ones are dropped. A
    span is moved inside its candidate's; a corrected address must be an absolute https one, else the row is blocked.
    """
    d = decisions.where("action <> 'reject'").select("index", "action", F.col("lo").alias("d_lo"), F.col("hi").alias("d_hi"), F.col("url").alias("d_url"))
    inside = lambda c, own: F.least(F.greatest(F.coalesce(c, own), F.col("lo")), F.col("hi"))
    both = candidates.join(d, "index").withColumn("a", inside(F.col("d_lo"), F.col("lo"))).withColumn("b", inside(F.col("d_hi"), F.col("hi")))
    corrected = F.col("action") == "accept_corrected"
    bad = corrected & ~F.coalesce(F.trim("d_url").rlike("^https://[^/?#]+"), F.lit(False))
    return both.select(
        "index", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.when(corrected, F.col("d_url")).otherwise(F.col("url")).alias("url"), bad.alias("blocked")
    )


@query(
    "aln20_curation",
    """WITH c AS (SELECT o_orderkey "index", o_custkey % 100 lo, o_custkey % 100 + 20 hi, 'https://a.example/' || o_orderkey url, o_orderpriority p, o_orderstatus s FROM orders),
    k AS (SELECT *, CASE WHEN s = 'P' THEN 'reject' WHEN s = 'F' THEN 'accept' ELSE 'accept_corrected' END action, lo + 30 - "index" % 40 a, lo + "index" % 50 - 10 b FROM c),
    x AS (SELECT *, least(greatest(a, lo), hi) x, least(greatest(b, lo), hi) y FROM k WHERE action <> 'reject')
    SELECT "index", least(x, y) lo, greatest(x, y) hi, CASE action WHEN 'accept' THEN url ELSE CASE WHEN p LIKE '1%' THEN 'http://b' ELSE 'https://b/' || p END END url,
    action = 'accept_corrected' AND p LIKE '1%' blocked FROM x""",
)
def aln20(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    lo, key = F.col("o_custkey") % 100, F.col("o_orderkey")
    candidates = orders.select(key.alias("index"), lo.alias("lo"), (lo + 20).alias("hi"), F.concat(F.lit("https://a.example/"), key.cast("string")).alias("url"))
    action = F.when(F.col("o_orderstatus") == "P", "reject").when(F.col("o_orderstatus") == "F", "accept").otherwise("accept_corrected")
    address = F.when(F.col("o_orderpriority").startswith("1"), "http://b").otherwise(F.concat(F.lit("https://b/"), "o_orderpriority"))
    decisions = orders.select(key.alias("index"), action.alias("action"), (lo + 30 - key % 40).alias("lo"), (lo + key % 50 - 10).alias("hi"), address.alias("url"))
    return curated(candidates, decisions)
