"""List filters of alerts, incidents, entities and events, and paging."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.bands import ACTIVE, ALERT_RANGES, entity_bucket, status_to_stored
from tidewatch.functions.fields import optional
from tidewatch.functions.times import _utc, within
from tidewatch.operators.normalize import entity_servers
from tidewatch.plans.entities import entity_state


def _like(col: Column, needle: str) -> Column:
    return F.coalesce(F.contains(F.lower(col), F.lit(needle.lower())), F.lit(False))


def _since(now: datetime, days: int) -> datetime:
    return _utc(now) - timedelta(days=max(1, int(days or 7)))


def _status(df: DataFrame, status: str) -> DataFrame:
    s = (status or "all").strip().lower()
    if s == "all":
        return df
    stored = status_to_stored(s)
    return df.filter(F.col("status").isin(ACTIVE) if stored == "open" else F.col("status") == stored)


def _in_incident(df: DataFrame, links: DataFrame, incident_id: int, id_col: str) -> DataFrame:
    ids = links.filter(F.col("incident_id") == incident_id).select(F.col(id_col).alias("id"))
    return df.join(ids, "id", "left_semi")


def filter_alerts(
    alerts: DataFrame, now: datetime, *, days: int = 7, server: str | None = None, status: str = "all",
    severity: str = "all", ip: str | None = None, q: str | None = None,
    incident_id: int | None = None, links: DataFrame | None = None,
) -> DataFrame:
    out = alerts.filter(F.col("triggered_at") >= _since(now, days))
    if server:
        out = out.filter(F.col("server") == server)
    out = _status(out, status)
    if (severity or "").strip().lower() in ALERT_RANGES:
        out = out.filter(F.col("severity").between(*ALERT_RANGES[severity.strip().lower()]))
    documents = [F.to_json("evidence"), F.to_json("metrics")]
    if ip and ip.strip():
        out = out.filter(_any([_like(c, ip.strip()) for c in [F.col("group_key"), *documents]]))
    if q and q.strip():
        needle = q.strip()
        tests = [_like(F.col("group_key"), "|" + needle), *[_like(d, needle) for d in documents]]
        if server and server.strip():
            tests.append(F.col("group_key") == f"{server.strip()}|{needle}")
        out = out.filter(_any(tests))
    return out if incident_id is None else _in_incident(out, links, incident_id, "alert_id")


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def alerts_of_incident(alerts: DataFrame, links: DataFrame, incident_id: int) -> DataFrame:
    return _in_incident(alerts, links, incident_id, "alert_id")


def filter_incidents(
    incidents: DataFrame, now: datetime, *, days: int = 7, server: str | None = None, status: str = "all", severity: str = "all"
) -> DataFrame:
    out = incidents.filter(F.col("last_activity_at") >= _since(now, days))
    if server and server != "all":
        out = out.filter(F.col("server") == server)
    out = _status(out, status)
    tests = {"high": F.col("score") >= 61, "medium": F.col("score").between(31, 60), "low": F.col("score") <= 30}
    return out.filter(tests[severity]) if severity in tests else out


def filter_entities(
    entities: DataFrame, now: datetime, *, incident_id: int | None = None, links: DataFrame | None = None,
    entity_type: str | None = None, q: str | None = None, state: str = "all", server: str | None = None,
    days: int | None = None, severity: str = "all",
) -> DataFrame:
    out = entities if incident_id is None else _in_incident(entities, links, incident_id, "entity_id")
    if entity_type and entity_type != "all":
        out = out.filter(F.col("entity_type") == entity_type)
    if q and q.strip():
        out = out.filter(_like(F.col("entity_key"), q.strip()))
    if state != "all":
        out = out.filter(entity_state(optional(out, "attrs.state")) == state.strip().lower())
    if server and server.strip().lower() not in ("", "all"):
        out = out.filter(F.array_contains(entity_servers(out), server.strip()))
    if days is not None:
        out = out.filter(F.col("last_seen_at").isNull() | (F.col("last_seen_at") >= _utc(now) - timedelta(days=int(days))))
    sev = (severity or "all").strip().lower()
    return out if sev == "all" else out.filter(entity_bucket(F.col("severity")) == sev)


def search_events(
    events: DataFrame, *, start: datetime | None = None, end: datetime | None = None, server: str | None = None,
    source: str | None = None, service: str | None = None, q: str | None = None,
) -> DataFrame:
    out = events.filter(within(events, "timestamp_utc", start, end))
    for name, value in (("server", server), ("source", source), ("service", service)):
        if value:
            out = out.filter(F.col(name) == value)
    return out.filter(_like(F.col("message"), q.strip())) if q else out


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page in the given order; the total is `df.count()`."""
    return df.orderBy(*order).offset(offset).limit(limit)
