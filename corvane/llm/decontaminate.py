r"""Benchmark decontamination: size-partitioned MinHash containment search, then exact check.

An item (a short benchmark text) is inside a document (maybe a very long one) when at
least `containment` of the item's distinct word shingles are among the document's. Words
are runs of letters and digits of the lower-cased text; a shingle is five words in a row;
a text of one to four words has one shingle, all its words.

Banded MinHash signatures of whole documents would need thousands of hashes to find an
item of 40 shingles in a text of 20,000: their Jaccard similarity is 0.002. So sketches
follow the short side's size:

* Items are partitioned by their number of shingles, in powers of two. All items of a
  partition use the sketch size of its upper bound u: k = floor((1 - containment) * u) + 1
  smallest hashes (a bottom-k MinHash, of all shingles where the item has fewer).
* A partition has a lower bound on documents, `least`: a document that contains one of its
  items has that many shingles; and a hash bound, `tau`: the largest hash in its sketches.
* A document's sketch are its shingles' hashes up to the largest `tau` of those partitions
  whose `least` it reaches: partitions of longer items neither see it nor lengthen its
  sketch. One pass over the documents probes all partitions they are sent to.

Why nothing is missed: of an item's n shingles a document that contains it lacks at most
floor((1 - containment) * n), which is less than k. So it has one of the k smallest, whose
hash is at most `tau`, and which is therefore in the document's sketch. Recall is 1 for each
partition; a candidate is verified on the shingles themselves, not on hashes.

Items with equal sets of shingles (by count and two 64-bit sums of hashes) are searched for
once. What may be broadcast is counted: at most BROADCAST_ROWS rows of hashes or ids, beyond
that joins are shuffled. Only documents with a candidate go through the exact check, and
only with shingles that some item has. A passage that many documents share gives one row
for each document and item.

Null or empty texts and items contain nothing and are in nothing. Repeated rows of an id,
documents without an id too, count once, as their shingles together; items without an id
are not searched for. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import durable

SHINGLE = 5
CONTAINMENT = 0.8
#: Rows of hashes or ids (16 bytes each) that may be broadcast.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _starts(w: Column) -> Column:
    """Start of each shingle in an array of words, from 0; none for no words."""
    return F.when(
        F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0)))
    ).otherwise(F.array().cast("array<int>"))


def _hash_at(hashes: Column, i: Column) -> Column:
    """The hash of the shingle at i, of its words' hashes; words behind the end are null and don't count."""
    return F.xxhash64(*[F.get(hashes, i + k) for k in range(SHINGLE)])


def _worded(df: DataFrame, key: str) -> DataFrame:
    """key, the words w of each text and their hashes wh."""
    own = df.select(key, words(F.col("text")).alias("w"))
    return own.select(key, "w", F.transform("w", lambda x: F.xxhash64(x)).alias("wh"))


def _few(df: DataFrame) -> tuple[DataFrame, bool]:
    """A table, to be broadcast if it has at most BROADCAST_ROWS rows, and whether it has."""
    few = df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return (F.broadcast(df) if few else df), few


def item_sketches(items: DataFrame, containment: float = CONTAINMENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Searched items' shingles (item, shingle, h, n), their sketches (h, item, least, part), and all items' (item, item_id, n).

    `item` is the smallest item_id of those with equal shingles.
    """
    each = _worded(items.where("item_id IS NOT NULL"), "item_id").select("item_id", "w", "wh", F.explode(_starts(F.col("w"))).alias("i"))
    text = F.concat_ws(" ", F.slice("w", F.col("i") + 1, F.lit(SHINGLE)))
    shingles = each.select("item_id", text.alias("shingle"), _hash_at(F.col("wh"), F.col("i")).alias("h")).distinct()
    other = F.xxhash64(F.lit(3), "shingle")
    sized = shingles.groupBy("item_id").agg(
        F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s1"), F.sum(other.cast("decimal(38,0)")).alias("s2")
    )
    least = sized.groupBy("n", "s1", "s2").agg(F.min("item_id").alias("item"))
    named = durable(sized.join(least, ["n", "s1", "s2"]).select("item_id", "n", "item"))
    searched = named.where("item = item_id").select("item", "item_id", "n")
    shingles = durable(shingles.join(searched, "item_id").select("item", "shingle", "h", "n"))
    # partition by the number of binary digits: sizes from 2^(digits - 1) to 2^digits - 1
    part = F.length(F.bin("n"))
    lower = F.pow(F.lit(2), part - 1).cast("long")
    k = F.floor((1 - F.lit(containment)) * (2 * lower - 1) + 1e-9) + 1
    least = F.ceil(F.lit(containment) * lower - 1e-9)
    ranked = shingles.select("item", "h", k.alias("k"), least.alias("least"), part.alias("part"))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy("h")))
    return shingles, durable(ranked.where("r <= k").select("h", "item", "least", "part")), named


def candidates(docs: DataFrame, sketch: DataFrame) -> DataFrame:
    """Distinct (doc_id, item) of documents whose sketch meets the item's, and that are large enough for it."""
    # a row for each partition: as many as an item's size has binary digits
    parts = sketch.groupBy("part", "least").agg(F.max("h").alias("tau")).collect()
    if not parts:
        return docs.select("doc_id", F.lit(None).cast(sketch.schema["item"].dataType).alias("item")).limit(0)
    size = F.greatest(F.size("w") - (SHINGLE - 1), F.lit(1))
    bounds = [F.when(size >= r["least"], F.lit(r["tau"])) for r in parts]
    tau = F.greatest(*bounds) if len(bounds) > 1 else bounds[0]
    sent = _worded(docs, "doc_id").select("doc_id", "w", "wh", size.alias("size"), tau.alias("tau")).where("tau IS NOT NULL AND size(w) > 0")
    own = F.filter(F.transform(_starts(F.col("w")), lambda i: _hash_at(F.col("wh"), i)), lambda h: h <= F.col("tau"))
    probes = sent.select("doc_id", "size", F.explode(own).alias("h"))
    keys, _ = _few(sketch.select("h", "item", "least"))
    return probes.join(keys, "h").where("size >= least").select("doc_id", "item").distinct()


def contained_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of each item inside a document."""
    shingles, sketch, named = item_sketches(items, containment)
    pairs = durable(candidates(docs.select("doc_id", "text"), sketch))
    found = _verified(docs, shingles, pairs, containment)
    all_items, _ = _few(named.select("item", "item_id"))
    return found.join(all_items, "item").select(
        "doc_id", "item_id", "n_shared", F.col("n").alias("n_shingles"), (F.col("n_shared") / F.col("n")).alias("containment")
    )


def _verified(docs: DataFrame, shingles: DataFrame, pairs: DataFrame, containment: float) -> DataFrame:
    """(doc_id, item, n_shared, n) of the candidate pairs whose exact containment is high enough."""
    chosen, _ = _few(pairs.select(F.col("doc_id").alias("d")).distinct())
    own = docs.select("doc_id", "text").join(chosen, F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    each = _worded(own, "doc_id").select("doc_id", "w", "wh", F.explode(_starts(F.col("w"))).alias("i"))
    # a document needs only those of its shingles that some item has
    known, _ = _few(shingles.select("h").distinct())
    each = each.withColumn("h", _hash_at(F.col("wh"), F.col("i"))).join(known, "h", "left_semi")
    text = F.concat_ws(" ", F.slice("w", F.col("i") + 1, F.lit(SHINGLE)))
    of_docs = each.select(F.col("doc_id").alias("d"), text.alias("s")).distinct()
    asked = pairs.join(shingles, "item")
    shared = (
        asked.join(of_docs, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("shingle") == F.col("s")))
        .groupBy("doc_id", "item", "n")
        .agg(F.count("*").alias("n_shared"))
    )
    return shared.where(F.col("n_shared") >= F.lit(containment) * F.col("n") - 1e-9)


def decontaminate(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The documents that contain no item, with their columns."""
    shingles, sketch, _ = item_sketches(items, containment)
    pairs = durable(candidates(docs.select("doc_id", "text"), sketch))
    found, _ = _few(durable(_verified(docs, shingles, pairs, containment).select(F.col("doc_id").alias("__found")).distinct()))
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("__found")), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same rows in DuckDB SQL, by comparing all shingles.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) i FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) n FROM bs GROUP BY 1)
SELECT doc_id, item_id, count(*) n_shared, n n_shingles, count(*)::DOUBLE / n containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n - 1e-9
"""
