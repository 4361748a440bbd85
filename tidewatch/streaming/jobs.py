"""Starting the continuous jobs: alerts, activity, incidents and entities.

Every job keeps its state in Spark's state store (RocksDB, checkpointed) and writes a log of changes to the folder of the job through Spark's file
sink, so a restart neither loses nor doubles rows. `current_*` of the sibling modules read a log as it stands. `folder` must be shared.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.operators.rules import EventRule, TrustConfig
from tidewatch.plans.dashboards import activity_columns
from tidewatch.plans.incidents import IncidentRule
from tidewatch.streaming.alerts import alert_changes
from tidewatch.streaming.entities import entity_changes
from tidewatch.streaming.incidents import incident_changes, link_batch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _log(changes: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Changes to `folder`/changes, by kind."""
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    writer = changes.writeStream.format("parquet").partitionBy("kind").outputMode("append")
    writer = writer.option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _batches(stream: DataFrame, step: Callable[[DataFrame, int], None], folder: str, mode: str = "append", **trigger) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_alerts(
    events: DataFrame, rules: list[EventRule], trust: TrustConfig, folder: str, max_delay_seconds: int = 3600, **trigger
) -> StreamingQuery:
    """Raise, and take back, alerts from a stream of events. Rows later than the delay are logged as late."""
    return _log(alert_changes(events, rules, trust, max_delay_seconds), folder, **trigger)


def stream_incidents(
    alerts: DataFrame, rules: list[IncidentRule], folder: str, step_seconds: int = 300, max_delay_seconds: int = 3600, **trigger
) -> StreamingQuery:
    """Log the firings of incident rules at every tick that the stream of alerts has passed."""
    return _log(incident_changes(alerts, rules, step_seconds, max_delay_seconds), folder, **trigger)


def stream_incident_links(
    changes: DataFrame, rules: list[IncidentRule], read_alerts: Callable[[SparkSession], DataFrame], folder: str, **trigger
) -> StreamingQuery:
    """Add the links of new firings (a stream of the log of `stream_incidents`) to `folder`/links."""
    return _batches(changes, link_batch(rules, read_alerts, f"{folder}/links"), folder, **trigger)


def stream_entities(alerts: DataFrame, folder: str, now: datetime | None = None, **trigger) -> StreamingQuery:
    """Log the entities that alerts touch, and what changed their scores."""
    return _log(entity_changes(alerts, now), folder, **trigger)


def activity(alerts: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Alerts per day and class, kept up to date."""
    return (
        alerts.withWatermark("triggered_at", watermark)
        .groupBy(F.window("triggered_at", "1 day").alias("w")).agg(*activity_columns())
        .withColumn("day", F.to_date("w.start")).drop("w")
    )


def stream_activity(alerts: DataFrame, folder: str, watermark: str = "1 day", **trigger) -> StreamingQuery:
    """Write the days that a batch has changed to `folder`/days; a repeated batch writes its own rows again."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/days/batch={batch_id}")

    return _batches(activity(alerts, watermark), step, folder, "update", **trigger)


def current_activity(days: DataFrame) -> DataFrame:
    """Every day as its last batch left it."""
    cols = [c for c in days.columns if c not in ("day", "batch")]
    return days.groupBy("day").agg(F.max_by(F.struct(*cols), "batch").alias("row")).select("day", "row.*")
