"""What the operators share: reading tables, cutting lineage, Arrow batches, components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches to and from Python hold at most this many bytes and rows.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the one in spark.checkpoint.dir.

    Only where a local session names none (as in tests) a new temporary folder is set;
    on a cluster, executors would not see such a folder, so there this raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return str(set_before.get()).rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="corvane-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives lost executors."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint()


#: Folders made in the shared one and not deleted yet.
_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; `tidy` deletes it."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def made_so_far() -> int:
    """A mark for `tidy`."""
    return len(_made)


def tidy(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Delete the folders made since a mark, but for `keep`; to be called when no result reads them any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in [p for p in _made[since:] if p != keep]:
        place = hadoop.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        _made.remove(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches, so that long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), and the named columns; all else is left out."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def hashed_sample(df: DataFrame, n: int) -> DataFrame:
    """About n distinct rows at most (all, if there are no more), chosen by a hash of all their columns.

    A filter, so that no task sends more than its share to the driver, as a limit would.
    Equal rows count once: however often one is repeated, the sample keeps its bound.
    """
    total = df.count()
    span = 1 << 40
    share = span if total <= n else n * span // total
    return df.where(F.pmod(F.xxhash64(F.lit(17), *df.columns), F.lit(span)) < share).distinct()


def rows_of(batch: pa.RecordBatch, limit: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, of at most so many rows."""
    for at in range(0, batch.num_rows, limit):
        yield batch.slice(at, limit)


def ascii_words(text: Column) -> Column:
    r"""The words `[^\x20\x09-\x0D]+` of a text, as an array."""
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph: (node, component).

    edges: columns a and b, of a type that can be ordered. A component is named by
    its smallest node. Alternates large-star and small-star steps, whose rows never
    exceed the edges, until nothing changes; each round is checkpointed. Nodes without an
    edge have no row; an empty table gives an empty table.
    """
    now = durable(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31)), F.bit_xor(F.xxhash64("v", "u"))).first())

    seen = state(now)
    if not seen[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        # large star: each neighbour above a node goes to the least node around it
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each neighbour below a node, and the node, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = durable(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        was, seen = seen, state(now)
        if was == seen:
            break
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)


def filesystem(uri: str):
    """A pyarrow file system and the path in it, for a URI that all executors see."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))
