"""Index tables and sessions over unbounded event streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def with_event_time(stream: DataFrame, date: str, late: str) -> DataFrame:
    """Event time as a timestamp, with a watermark; later rows are dropped."""
    return stream.withColumn(date, F.col(date).cast("timestamp")).withWatermark(date, late)


def live_index(stream: DataFrame, index: Sequence[str], date: str, code: str) -> DataFrame:
    """First and last event and entries of every entity so far; state is three values for each."""
    return stream.groupBy(*index).agg(F.min(date).alias(f"index_{code}"), F.max(date).alias(f"last_{code}"), F.count("*").alias(f"entries_{code}"))


def live_courses(stream: DataFrame, index: Sequence[str], date: str, code: str, gap: str, late: str) -> DataFrame:
    """Courses as session windows: events closer than ``gap`` belong together; a course is final once the watermark passes its end."""
    rows = with_event_time(stream, date, late)
    out = rows.groupBy(*index, F.session_window(date, gap).alias("w")).agg(F.min(date).alias(f"index_therapy_{code}"), F.max(date).alias(f"last_therapy_{code}"), F.count("*").alias(f"entries_{code}"))
    return out.drop("w")


def live_counts(stream: DataFrame, date: str, every: str, late: str, groups: Sequence[str] = ()) -> DataFrame:
    """Counts of tumbling windows."""
    return with_event_time(stream, date, late).groupBy(F.window(date, every).alias("w"), *groups).agg(F.count("*").alias("count")).select(F.col("w.start").alias("period"), *groups, "count")


def run_once(out: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; the checkpoint makes the next run go on from here."""
    return out.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
