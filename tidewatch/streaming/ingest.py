"""Ingest statistics of a stream: counts that Spark gathers while each batch passes, without a second read of it."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

LINES, EVENTS = "ingest_lines", "ingest_events"


def observed_events(lines: DataFrame, parse: Callable[[DataFrame], DataFrame], retained: Column | None = None) -> DataFrame:
    """`parse` of one log type's lines, with both sides counted. The columns and rows of the events stay as they are.

    A parser that reads its lines in several branches would count them in each, so one stream carries one log type.
    """
    kept = F.lit(False) if retained is None else retained
    counted = lines.observe(LINES, F.count(F.lit(1)).alias("lines_total"))
    return parse(counted).observe(
        EVENTS, F.count(F.lit(1)).alias("events_created"), F.count_if(~F.col("time_parsed")).alias("lines_failed"), F.count_if(kept).alias("raw_saved")
    )


def batch_stats(progress: Any) -> dict[str, int] | None:
    """The counts of one batch, as `ingest_stats` has them for files, with its number; None for a batch that read nothing.

    `progress` is what a query's `recentProgress` holds and what a listener is given.
    """
    lines, events = (progress.observedMetrics.get(name) for name in (LINES, EVENTS))
    if lines is None or events is None or not lines["lines_total"]:
        return None
    total, created, failed = lines["lines_total"], events["events_created"], events["lines_failed"]
    return {
        "batch": progress.batchId, "lines_total": total, "lines_parsed": created - failed, "lines_skipped": total - created,
        "lines_failed": failed, "events_created": created, "raw_saved": events["raw_saved"],
    }


def recent_stats(query: StreamingQuery) -> list[dict[str, int]]:
    """Counts of the batches that the query still remembers (spark.sql.streaming.numRecentProgressUpdates), oldest first."""
    return [s for s in map(batch_stats, query.recentProgress) if s]
