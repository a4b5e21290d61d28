"""Streams of submissions and reports, with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need timestamps with a zone; Parquet may hold them without."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def first_submissions(events: DataFrame, keys: list[str], *, ts: str = "ts", within: str = "1 hour") -> DataFrame:
    """The first event of each key; state goes once the watermark has passed."""
    return event_time(events, ts).withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def usage_windows(events: DataFrame, key: str, value: str, *, ts: str = "ts", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Totals of each key by window, final once the watermark has passed it."""
    own = event_time(events, ts).withWatermark(ts, late)
    return own.groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def live_reports(reports: DataFrame, *, ts: str = "ts", ttl: str = "1 hour") -> DataFrame:
    """Reports by session of activity: one is live from its first event until ``ttl`` after its last."""
    own = event_time(reports, ts).withWatermark(ts, "10 minutes")
    return own.groupBy(F.session_window(ts, ttl), "report_id").agg(F.count("*").alias("events")).select("report_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """All that the stream gives for the input there is now, written under ``folder`` and read again."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
