"""Incremental forms with Structured Streaming.

The file source remembers which files it has read, which is what a list of
processed files is for; upserts go through foreachBatch. Windowed counts with
late rows go beyond what the batch operators need.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quillgraph.operators.notes import parse_notes


def note_lines(spark: SparkSession, path: str) -> DataFrame:
    """Streaming ``(file, line_no, line)`` of note files that arrive in a folder."""
    raw = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def parsed_notes(lines: DataFrame, sink: Callable[[DataFrame, DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer that hands each batch's concepts and relations to ``sink``; the batch number makes retries idempotent."""

    def write(batch: DataFrame, number: int) -> None:
        sink(*parse_notes(batch), number)

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def event_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows; for streams and tables alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")
