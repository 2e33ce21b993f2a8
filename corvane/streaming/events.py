"""Structured Streaming over the events table: windows, late data, sessions, incremental counts.

Each function takes a (streaming or batch) DataFrame of events and returns one, so the same
definition runs on both; `drain` runs a streaming query over what there is and returns its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import english_words
from corvane.plans.registry import query
from corvane.sources.tables import SCHEMAS, shared_folder, table

LATE = "10 minutes"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream, with their time as a timestamp."""
    stream = spark.readStream.schema(SCHEMAS["events"]).option("pathGlobFilter", "events*").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts and sums of each type in windows that do not overlap."""
    windowed = events.withWatermark("ts", LATE).groupBy(F.window("ts", width), "event_type")
    return windowed.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("window.start").alias("start"), "event_type", "n", "total"
    )


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour") -> DataFrame:
    windowed = events.withWatermark("ts", LATE).groupBy(F.window("ts", width, step), "event_type")
    return windowed.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    windowed = events.withWatermark("ts", LATE).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return windowed.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def without_repeats(events: DataFrame) -> DataFrame:
    """Each event once, also if it comes again within the time that late data may take."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])


def purchases_after_clicks(events: DataFrame, within: str = "1 hour") -> DataFrame:
    """A stream joined with itself: purchases and the clicks of the same user shortly before."""
    clicks = events.where("event_type = 'click'").select(F.col("user_id").alias("u"), F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    buys = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    near = (F.col("user_id") == F.col("u")) & (F.col("click_ts") <= F.col("ts")) & (F.col("click_ts") >= F.col("ts") - F.expr(f"INTERVAL {within}"))
    return buys.withWatermark("ts", LATE).join(clicks.withWatermark("click_ts", LATE), near).select("event_id", "click_id")


def word_counts(docs: DataFrame) -> DataFrame:
    """Incremental posting counts: complete totals of each word as documents arrive."""
    return docs.select(F.explode(english_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """All rows of a streaming query over the input there is.

    Each batch is written to a folder of its own in the shared one, so no row passes the driver and a
    batch that runs twice replaces itself; in complete mode the last batch is the result.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "stream")
    done: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        done.append(number)

    running = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    wanted = sorted(set(done))[-1:] if mode == "complete" else sorted(set(done))
    if not wanted:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(*[f"{folder}/out/batch={n}" for n in wanted])


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "str01_tumbling",
    """SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT "start", event_type, count(*) n, round(sum("value"), 4) total FROM events GROUP BY 1, 2""",
)
def str01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling(_batch(spark, sf_dir)).select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "str02_sliding",
    """SELECT (s - 3600 * i)::BIGINT "start", event_type, count(*) n FROM (SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT s, event_type FROM events),
    (SELECT unnest([0, 1]) i) GROUP BY 1, 2""",
)
def str02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding(_batch(spark, sf_dir)).select(F.unix_seconds("start").alias("start"), "event_type", "n")


@query(
    "str03_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM e)
    SELECT user_id, epoch_us(min(ts)) "start", count(*) n FROM s GROUP BY user_id, k""",
)
def str03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(_batch(spark, sf_dir)).select("user_id", F.unix_micros("start").alias("start"), "n")


@query(
    "str04_stream_tumbling",
    """SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT "start", event_type, count(*) n, round(sum("value"), 4) total FROM events GROUP BY 1, 2""",
)
def str04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tumbling windows run as a stream to its end: every window, with its count and sum."""
    found = drain(tumbling(event_stream(spark, sf_dir)), "complete")
    return found.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("str05_stream_repeats", "SELECT event_id, user_id, event_type FROM events")
def str05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event of the stream, once; a stream with every event twice has the same rows."""
    events = event_stream(spark, sf_dir)
    return drain(without_repeats(events.union(events))).select("event_id", "user_id", "event_type")


@query(
    "str06_stream_join",
    """SELECT b.event_id, c.event_id click_id FROM events b JOIN events c ON b.user_id = c.user_id AND c.ts <= b.ts AND c.ts >= b.ts - INTERVAL 1 HOUR
    WHERE b.event_type = 'purchase' AND c.event_type = 'click'""",
)
def str06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(purchases_after_clicks(event_stream(spark, sf_dir)))
