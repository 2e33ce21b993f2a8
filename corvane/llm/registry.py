"""The thin queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import decontaminate, html_text, langid, packing, pii, quality, simhash, substring_dedup, token_frames, toxicity
from corvane.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = token_frames.new_folder(docs)
    files = token_frames.write_token_files(docs, folder, tokenizer_path("word_bpe_49k.json"))
    return token_frames.read_token_files(files, folder).drop("shard")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = toxicity.toxicity_labels(table(spark, sf_dir, "labels"))
    return toxicity.toxicity(table(spark, sf_dir, "documents"), labels, toxicity.CATEGORIES)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_langid": op1_langid,
        "op2_pii": op2_pii,
        "op3_simhash": op3_simhash,
        "op4_decontaminate": op4_decontaminate,
        "op5_packing": op5_packing,
        "op6_quality": op6_quality,
        "op7_token_frames": op7_token_frames,
        "op8_toxicity": op8_toxicity,
        "op9_html_text": op9_html_text,
        "op10_substring_dedup": op10_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_decontaminate": decontaminate.ORACLE}
