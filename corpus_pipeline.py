"""Documents to packed training sequences: five stages, each written and read again.

    language_id     documents whose language can't be told go
    near_dedup      one document of each group of near-duplicates stays
    decontaminate   documents that contain a benchmark item go
    pii             personal data in the texts is replaced by its kind
    pack            the texts become pieces in sequences of at most 1024 tokens

All stages but the last return the columns of documents; decisions are those of the
operators in corvane.llm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import decontaminate as _decontaminate
from corvane.llm import langid as _langid
from corvane.llm import packing as _packing
from corvane.llm import pii as _pii
from corvane.llm import simhash as _simhash
from corvane.llm.common import made_so_far, new_folder, table, tidy
from corvane.llm.registry import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pii", pii),
    ("pack", pack),
]

#: SQL has neither the trained model of the first stage nor the tokenizer of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what only earlier stages needed is deleted."""
    docs, before = table(spark, sf_dir, "documents"), made_so_far()
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        folder = new_folder(spark, f"corpus-pipeline-{name}")
        out.write.parquet(folder)
        docs = spark.read.parquet(folder)
        # this stage's own tables and the stage before it are not read any more
        tidy(spark, before, keep=folder)
    return docs
