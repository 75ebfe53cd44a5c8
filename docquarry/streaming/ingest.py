"""Streams: files that land in a folder, and events by windows of their own time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquarry.sources.versioned import VersionedTable


def arrivals(spark: SparkSession, folder: str, schema: str, fmt: str = "json", files_a_batch: int = 100) -> DataFrame:
    """Rows of the files that land in a folder."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_a_batch).load(folder)


def first_arrivals(rows: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """One row of each key; state of keys older than the watermark is let go."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def upsert_sink(rows: DataFrame, target: str, checkpoint: str, key: list[str], step: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Writes each batch to a folder named by its number, so that a batch that is run again after a failure
    replaces itself: rows come once.  ``current`` reads the newest version of each key."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).dropDuplicates(key).write.mode("overwrite").parquet(f"{target}/batch={number:012d}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, key: list[str]) -> DataFrame:
    """The rows of the latest batch that has each key."""
    rows = spark.read.parquet(target)
    newest = rows.groupBy(*key).agg(F.max("batch").alias("batch"))
    return rows.join(newest, [*key, "batch"]).drop("batch")


def versioned_sink(rows: DataFrame, table: VersionedTable, checkpoint: str, name: str, key: list[str] | None = None, step: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Each batch as a version of a table: its rows take the place of those of equal key, or, without keys, are added.  The
    stream's name and the batch's number go with the commit, so a batch that is run again changes nothing; readers read one
    version, however many batches there were."""

    def write(batch: DataFrame, number: int) -> None:
        own = step(batch)
        if key:
            table.replace(own.dropDuplicates(key), key, (name, number))
        else:
            table.append(own, (name, number))

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, length: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by window; late rows are taken up to the
    watermark."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    sums = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return sums.select(F.col("window.start").alias("start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of each user: events with no longer gap between them."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")
