"""Weekly micro-batches as a stream: new event files are upserted as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.clean import clean_events
from tidemark.plans.pipeline import load
from tidemark.schema import EVENT_CSV


def event_stream(spark: SparkSession, folder: str, watermark: str = "7 days") -> DataFrame:
    """CSV files of a folder as a stream of typed events."""
    raw = spark.readStream.option("header", True).schema(EVENT_CSV).csv(folder)
    return raw.withColumn("event_time", F.to_timestamp(F.regexp_replace("event_time", " UTC$", ""))).withWatermark("event_time", watermark)


def run_available(spark: SparkSession, folder: str, root: str, checkpoint: str, anchor: str = "2024-01-01") -> None:
    """Take all files that are there, one upsert for each batch, then stop.

    A batch that is run again after a failure finds its rows by their ids, so it adds nothing.
    Imputation sees the rows of its batch, so a batch should hold whole weeks; equal events count
    as often as the batch with most of them holds them.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        load(spark, root, clean_events(batch.withColumn("event_time", F.col("event_time").cast("timestamp_ntz")), anchor))

    query = event_stream(spark, folder).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, days: int = 7) -> DataFrame:
    """Events by tumbling window and type; emits a window once the watermark passes it."""
    w = F.window("event_time", f"{days} days").alias("w")
    return events.groupBy(w, "event_type").agg(F.count("*").alias("cnt")).select("w.start", "event_type", "cnt")
