"""Sinks: partitioned JSON, shards by letter, CSV for spreadsheets, reports, keyed caches."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import initials_shard, shard_letter


def by_work_and_book(df: DataFrame, path: str) -> None:
    """Nested rows as JSON, a folder for each work and book."""
    df.write.mode("overwrite").partitionBy("work", "book").json(path)


def by_letter(df: DataFrame, path: str, key: str, any_script: bool = False) -> None:
    """JSON shards by the first letter of a key; earlier shards are replaced."""
    shard = initials_shard(F.col(key)) if any_script else shard_letter(F.col(key))
    df.withColumn("shard", shard).write.mode("overwrite").partitionBy("shard").json(path)


def merged(shared: DataFrame, update: DataFrame, key: str) -> DataFrame:
    """A shared dictionary with the rows of an update, which win."""
    kept = shared.join(update.select(key).distinct(), key, "left_anti")
    return kept.unionByName(update)


def packed(df: DataFrame, path: str, order: str, value: str) -> None:
    """A column of small integers in offset order: Parquet keeps it dictionary- or run-length-encoded."""
    df.select(F.col(order), F.col(value).cast("int").alias(value)).repartitionByRange(order).sortWithinPartitions(order).write.mode(
        "overwrite"
    ).parquet(path)


def spreadsheet_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, quoted where needed, CRLF line ends, and a byte order mark before the first name."""
    first, *rest = df.columns
    df.withColumnRenamed(first, "﻿" + first).select(F.col(f"`﻿{first}`"), *rest).write.mode("overwrite").option(
        "header", True
    ).option("lineSep", "\r\n").option("escape", '"').option("emptyValue", "").csv(path)


def markdown_report(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small result as a Markdown table; says so if there are more rows than it shows."""
    rows = df.limit(most + 1).collect()
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v).replace("|", r"\|") for v in r) + " |" for r in rows[:most]]
    if len(rows) > most:
        lines += ["", f"The first {most} rows."]
    return "\n".join(lines) + "\n"


def json_report(df: DataFrame, most: int = 1000) -> str:
    rows = df.limit(most + 1).collect()
    return json.dumps({"rows": [r.asDict(recursive=True) for r in rows[:most]], "capped": len(rows) > most}, default=str, ensure_ascii=False)


def cache_path(folder: str, name: str, version: int, rules: dict) -> str:
    """The place of a cached table: its version and a hash of the rules it was made by are part of the name."""
    key = hashlib.md5(json.dumps(rules, sort_keys=True).encode()).hexdigest()[:12]
    return f"{folder}/{name}-v{version}-{key}"


def cached(df: DataFrame, path: str) -> DataFrame:
    """The table at a path, written first if it isn't there whole (a finished write leaves _SUCCESS)."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
