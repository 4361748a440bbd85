"""Entity scores from a stream of alerts, as a log of changes.

State of an entity: its scope, score and times. A batch that brings alerts of an entity decays its score once, adds the severities, and writes one
row with the entity as it is now, a ledger row for each alert that counted and one for the decay. Entities without new alerts are not touched
or written. Net of versions, the log equals runs of `entity_score` and `upsert_entities` over the same batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.functions.times import _utc
from tidewatch.plans.entities import DECAY_STEPS, KEY, alerts_with_entity, score_severity

STATE = "scope string, score int, first_seen_us long, last_seen_us long, score_updated_us long, version long"
CHANGE = (
    "kind string, entity_type string, entity_key string, version long, scope string, score_current int, first_seen_us long, last_seen_us long, "
    "score_updated_us long, us long, delta int, reason_type string, reason_id string"
)
ENTITY, LEDGER = "entity", "ledger"


class EntityScores(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("entity", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        scope, score, first, last, updated, version = self.state.get() or (None, None, None, None, None, 0)
        version += 1
        opening, points, scored, now = None, 0, None, None
        for row in rows:
            opening = min(filter(None, (opening, (row.id, row.us, row.scope))))
            points, now = points + row.severity, row.now
            if row.severity:
                scored = row.us if scored is None else max(scored, row.us)
                yield self._row(LEDGER, key, version, us=row.us, delta=row.severity, reason_type="alert", reason_id=str(row.id))
        is_new = score is None
        changed = opening[1] if is_new else updated if updated is not None else last
        age, decay = (now - changed) // 1_000_000, 0
        for seconds, step in DECAY_STEPS:
            decay = step if age >= seconds else decay
        if decay:
            yield self._row(LEDGER, key, version, us=now, delta=decay, reason_type="decay")
        scope = scope if scope is not None else opening[2]
        first = first if first is not None else opening[1]
        last = max(x for x in (last, opening[1] if is_new else None, scored) if x is not None)
        updated = now if decay or points > 0 else changed
        score = min(100, max(0, (score or 0) + decay) + points)
        self.state.update((scope, score, first, last, updated, version))
        yield self._row(ENTITY, key, version, scope=scope, score_current=score, first_seen_us=first, last_seen_us=last, score_updated_us=updated)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(kind: str, key: Any, version: int, **values: Any) -> Row:
        names = [c.split()[0] for c in CHANGE.split(", ")]
        return Row(**{**dict.fromkeys(names), "kind": kind, "entity_type": key[0], "entity_key": key[1], "version": version, **values})


def entity_changes(alerts: DataFrame, now: datetime | None = None) -> DataFrame:
    """Changes of entities that a stream of alerts makes. `now` fixes the time of decay; else it is the time of each batch."""
    at = F.current_timestamp() if now is None else F.timestamp_micros(F.lit(int(_utc(now).timestamp() * 1_000_000)))
    rows = alerts_with_entity(alerts).select(
        *KEY, "scope", F.col("id").cast("long").alias("id"), F.coalesce(F.col("severity"), F.lit(0)).cast("int").alias("severity"), F.unix_micros("triggered_at").alias("us"), F.unix_micros(at).alias("now")
    )
    changed = rows.groupBy(*KEY).transformWithState(EntityScores(), CHANGE, "Append", "None")
    return changed.withColumn("severity", F.when(F.col("kind") == ENTITY, score_severity(F.col("score_current"))))


def current_entities(changes: DataFrame) -> DataFrame:
    """Every entity as its last change left it."""
    cols = ["scope", "score_current", "severity", "first_seen_us", "last_seen_us", "score_updated_us"]
    last = changes.filter(F.col("kind") == ENTITY).groupBy(*KEY).agg(F.max_by(F.struct(*cols), "version").alias("row"))
    return last.select(*KEY, "row.*")


def ledger_rows(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("kind") == LEDGER).select(*KEY, "us", "delta", "reason_type", "reason_id")
