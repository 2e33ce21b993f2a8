"""Typed readers of the input tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Schemas of the tables; reading never infers one.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "conversations": "conv_id long, turn long, role string, text string",
}


#: Tables whose rows hold texts, so that a few rows are much work.
_TEXTS = ("documents", "pages", "conversations")
#: Bytes that a scan reads in one piece at least, as row groups are written.
_ROW_GROUP = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder.

    A table of texts in too few row groups to keep all cores busy is dealt out to them; it is
    at most a row group for each core, so this shuffle is bounded. Larger tables are read as they lie.
    """
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    if name not in _TEXTS:
        return df
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    held = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if held.getLength() // _ROW_GROUP + held.getFileCount() < cores else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a local session may go without: there it is a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="corvane-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
