"""Numbers and lists shown on the dashboards."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.bands import ACTIVE, incident_level, kpi_floor, level_label, score_badge, shown_status
from tidewatch.functions.fields import optional
from tidewatch.functions.times import _utc, lag_band, lag_seconds, lag_text, newest_days, within
from tidewatch.plans.entities import entity_state

FAILED = ["failed", "error"]
# Alert code classes of the activity chart.
BOT_CODES = ["WEB-001", "WEB-002", "WEB-004", "WEB-007"]
EXPLOIT_CODES = ["WEB-003"]
WP_CODES = ["WEB-005"]
PANEL_CODES = ["AUTH-005"]
QUEUE_STATES = ["pending", "processing", "error"]
UPLOAD_QUEUE = ["queued", "parsing", "parsed", "processing_engine"]


def _on_server(df: DataFrame, server: str | None) -> DataFrame:
    return df if not server or server == "all" else df.filter(F.col("server") == server)


def one_row(*parts: DataFrame) -> DataFrame:
    """Side by side columns of frames of one row each: their union, with the only value of every column."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def incident_kpi_entities(incidents: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct entities of active incidents with a score of at least 30 and of at least 80."""
    active = incidents.filter(F.col("status").isin(ACTIVE)).select(F.col("id").alias("incident_id"))
    ids = links.join(active, "incident_id", "left_semi").select("entity_id").distinct()
    scored = entities.filter("score_current >= 30").select(F.col("id").alias("entity_id"), "score_current")
    return scored.join(ids, "entity_id", "left_semi").agg(
        F.count(F.lit(1)).alias("entities_risky"), F.count_if(F.col("score_current") >= 80).alias("entities_critical")
    )


def dashboard_kpis(
    alerts: DataFrame, incidents: DataFrame, links: DataFrame, entities: DataFrame, events: DataFrame, uploads: DataFrame,
    start: datetime, end: datetime, now: datetime, server: str | None = None, severity: str | None = "all",
) -> DataFrame:
    """One row of key figures. Every input is reduced to one row by its own aggregate before they meet.

    Counts of a range read that range only; latest times are aggregates of their own, over the newest day where a table has days.
    """
    start, end, now = _utc(start), _utc(end), _utc(now)
    alerts, incidents, events, uploads = (_on_server(d, server) for d in (alerts, incidents, events, uploads))
    in_range = F.col("triggered_at").between(start, end)
    floor = kpi_floor(severity)
    if floor is not None:
        in_range = in_range & (F.col("severity") >= floor)
    a = alerts.filter(in_range).agg(
        F.count(F.lit(1)).alias("alerts_total"),
        F.count_if(F.col("status") == "open").alias("alerts_open"),
        F.count_if(F.col("severity") >= 15).alias("alerts_high_critical"),
    )
    last_alert = alerts.agg(F.max("triggered_at").alias("last_alert_at"))
    active = F.col("status").isin(ACTIVE)
    i = incidents.agg(
        F.count_if(active).alias("incidents_active"),
        F.count_if(active & (F.col("severity_current") >= 90)).alias("incidents_critical"),
        F.max("last_activity_at").alias("last_incident_at"),
    )
    e = events.filter(within(events, "timestamp_utc", start, end)).agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("source").alias("active_sources"),
    )
    last_event = newest_days(events).agg(F.max("timestamp_utc").alias("last_event_at"))
    recent = F.col("uploaded_at") >= now - timedelta(hours=24)
    u = uploads.filter(recent).agg(
        F.count(F.lit(1)).alias("uploads_24h"), F.count_if(F.col("status").isin(FAILED)).alias("uploads_failed_24h"),
    )
    out = one_row(a, last_alert, i, incident_kpi_entities(incidents, links, entities), e, last_event, u)
    return out.withColumn("lag_seconds", lag_seconds(F.col("last_event_at"), now))


def activity_columns() -> list[Column]:
    code = F.split_part(F.col("rule_name"), F.lit(" "), F.lit(1))
    n = lambda test, name: F.sum(F.when(test, 1).otherwise(0)).alias(name)
    return [
        F.count(F.lit(1)).alias("total"),
        n(code.startswith("AUTH-"), "bruteforce"), n(code.isin(BOT_CODES), "bots"), n(code.isin(EXPLOIT_CODES), "exploits"),
        n(code.isin(WP_CODES), "wp"), n(code.startswith("FILE-"), "file"), n(code.startswith("MAIL-"), "mail"),
        n(code.isin(PANEL_CODES), "panel"),
    ]


def alert_activity(alerts: DataFrame, start: datetime, end: datetime, server: str | None = None) -> DataFrame:
    """Alerts per day and class; one class may overlap another."""
    rows = _on_server(alerts.filter(F.col("triggered_at").between(_utc(start), _utc(end))), server)
    return rows.groupBy(F.to_date("triggered_at").alias("day")).agg(*activity_columns())


def fill_missing_days(activity: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """The same with a zero row for every day of the range that has none, and a short label."""
    calendar = activity.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(_utc(start).date()), F.lit(_utc(end).date()))).alias("day")
    )
    counts = [c for c in activity.columns if c != "day"]
    return calendar.join(activity, "day", "left").select(
        "day", F.date_format("day", "MM-dd").alias("label"), *[F.coalesce(c, F.lit(0)).alias(c) for c in counts]
    )


def uploads_by_status(uploads: DataFrame) -> DataFrame:
    return uploads.groupBy(F.coalesce("status", F.lit("")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def events_by_status(events: DataFrame) -> DataFrame:
    """Queue states only, zero included."""
    states = events.sparkSession.createDataFrame([(s,) for s in QUEUE_STATES], "engine_status string")
    counted = events.filter(F.col("engine_status").isin(QUEUE_STATES)).groupBy("engine_status").agg(F.count(F.lit(1)).alias("n"))
    return states.join(counted, "engine_status", "left").select("engine_status", F.coalesce("n", F.lit(0)).alias("n"))


def pipeline_overview(alerts: DataFrame, incidents: DataFrame, uploads: DataFrame, events: DataFrame, now: datetime) -> DataFrame:
    since = _utc(now) - timedelta(hours=24)
    fresh = lambda df, name: df.filter(F.col("created_at") >= since).agg(F.count(F.lit(1)).alias(name))
    return one_row(
        fresh(alerts, "alerts_24h"), fresh(incidents, "incidents_24h"),
        uploads.filter("status = 'queued'").agg(F.min("uploaded_at").alias("oldest_queued")),
        events.filter("engine_status = 'pending'").agg(F.min("created_at").alias("oldest_pending")),
    )


def operational_tops(uploads: DataFrame, events: DataFrame, queued: int = 50, failed: int = 30, pending: int = 80) -> dict[str, DataFrame]:
    """The oldest queued uploads, the latest failed ones and the oldest pending events; the lists' lengths are parameters."""
    return {
        "pending_uploads": uploads.filter(F.col("status").isin(UPLOAD_QUEUE)).orderBy("uploaded_at", "id").limit(queued),
        "error_uploads": uploads.filter("status = 'error'").orderBy(F.desc("uploaded_at"), "id").limit(failed),
        "pending_events": events.filter(F.col("engine_status").isin(QUEUE_STATES)).orderBy("created_at", "id").limit(pending),
    }


def alert_servers(alerts: DataFrame) -> DataFrame:
    return alerts.filter("server IS NOT NULL AND server <> ''").select("server").distinct()


def system_status(events: DataFrame, alerts: DataFrame, incidents: DataFrame, uploads: DataFrame, now: datetime) -> DataFrame:
    """Band per component."""
    now = _utc(now)
    recent = F.col("uploaded_at") >= now - timedelta(hours=24)
    one = one_row(
        newest_days(events).agg(F.max("timestamp_utc").alias("e")), alerts.agg(F.max("triggered_at").alias("a")),
        incidents.agg(F.max("last_activity_at").alias("i")),
        uploads.filter(recent).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin(FAILED)).alias("bad")),
    )
    lag = lambda c: lag_seconds(F.col(c), now)
    upload_code = F.when(F.col("bad") >= 10, "error").when(F.col("bad") > 0, "warning").otherwise("ok")
    items = [
        ("Ingesta (events)", lag_band(lag("e"), 900, 3600), lag_text(lag("e"))),
        ("Correlación (alerts)", lag_band(lag("a"), 900, 3600), lag_text(lag("a"))),
        ("Incidentes", lag_band(lag("i"), 3600, 21600), lag_text(lag("i"))),
        ("Uploads (24h)", upload_code, F.concat(F.col("n").cast("string"), F.lit(" / "), F.col("bad").cast("string"))),
    ]
    row = [F.struct(F.lit(n).alias("component"), c.alias("status_code"), d.alias("detail")) for n, c, d in items]
    label = (
        F.when(F.col("status_code") == "ok", "OK").when(F.col("status_code") == "warning", "Atención")
        .when(F.col("status_code") == "error", "Crítico").otherwise("Sin datos")
    )
    return one.select(F.explode(F.array(*row)).alias("r")).select("r.*").withColumn("status", label)


def _label_of(name: Column, code: Column) -> Column:
    name, code = (F.nullif(F.trim(c), F.lit("")) for c in (name, code))
    return F.when(name.isNotNull() & code.isNotNull(), F.concat(name, F.lit(" ("), F.upper(code), F.lit(")"))).otherwise(
        F.coalesce(name, F.upper(code))
    )


def _most_frequent(rows: DataFrame, label: str, name: str) -> DataFrame:
    """Most frequent label, the earliest listed on ties; one row, null if there is none."""
    counted = rows.filter(F.col(label).isNotNull()).groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("score_current")).alias("s"), "entity_key")).alias("first")
    )
    return counted.agg(F.min(F.struct((-F.col("n")).alias("m"), "first", label)).alias("b")).select(
        F.col(f"b.{label}").alias(name), (-F.col("b.m")).alias(f"{name}_count")
    )


def entity_kpis(entities: DataFrame) -> DataFrame:
    """Totals, the highest score, open and closed counts, and the commonest operator and country of ip entities."""
    rows = entities.select(
        "entity_type", "entity_key", "score_current", entity_state(optional(entities, "attrs.state")).alias("state"),
        F.when(
            F.col("entity_type") == "ip",
            F.coalesce(
                F.when(optional(entities, "attrs.asn.number").isNotNull(), F.trim(F.concat(
                    F.lit("AS"), optional(entities, "attrs.asn.number").cast("string"),
                    F.coalesce(F.concat(F.lit(" "), optional(entities, "attrs.asn.org")), F.lit("")),
                ))),
                F.nullif(F.trim(optional(entities, "attrs.asn.org")), F.lit("")),
            ),
        ).alias("asn"),
        F.when(
            F.col("entity_type") == "ip",
            _label_of(optional(entities, "attrs.geo.country_name"), optional(entities, "attrs.geo.country_code")),
        ).alias("country"),
    )
    totals = rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.min(F.struct((-F.col("score_current")).alias("s"), "entity_key", "entity_type")).alias("top"),
        F.count_if(F.col("state") == "open").alias("open"), F.count_if(F.col("state") == "closed").alias("closed"),
    ).select(
        "total", F.concat(F.col("top.entity_key"), F.lit(" ("), F.col("top.entity_type"), F.lit(")")).alias("top"), "open", "closed",
    )
    return one_row(totals, _most_frequent(rows, "asn", "top_asn"), _most_frequent(rows, "country", "top_country"))


def top_entities(entities: DataFrame, entity_type: str = "ip", k: int = 4) -> DataFrame:
    order = [F.desc("score_current"), F.desc("updated_at"), F.asc("entity_key")]
    return entities.filter(F.col("entity_type") == entity_type).orderBy(*order).limit(k)


def recent_incidents(
    incidents: DataFrame, now: datetime, days: int = 7, status: str | None = "open", server: str | None = None,
    limit: int = 20, offset: int = 0,
) -> DataFrame:
    out = _on_server(incidents.filter(F.col("last_activity_at") >= _utc(now) - timedelta(days=days)), server)
    if status and status != "all":
        out = out.filter(F.col("status") == status)
    severity = F.coalesce(F.nullif(F.col("severity_current"), F.lit(0)), F.col("severity_base"), F.lit(0))
    level = incident_level(severity)
    out = out.orderBy(F.desc("last_activity_at"), F.asc("id")).offset(offset).limit(limit)
    return out.select(
        "id", level.alias("level"), level_label(level).alias("severity_label"),
        F.concat_ws(" · ", "code", "name").alias("type"), F.coalesce("primary_entity_key", F.lit("—")).alias("entity"),
        F.coalesce("server", F.lit("—")).alias("server"), "last_activity_at",
    )


def incident_detail(
    incidents: DataFrame, alert_links: DataFrame, alerts: DataFrame, entity_links: DataFrame, entities: DataFrame
) -> dict[str, DataFrame]:
    """Incidents with their open counts, and the alerts and entities of each as rows of their own.

    An incident may hold a large part of all alerts, so they are not packed into one row of it.
    """
    a = alert_links.select("incident_id", F.col("alert_id").alias("id")).join(
        alerts.select("id", "rule_name", "severity", "server", "group_key", "triggered_at", shown_status(F.col("status")).alias("status")), "id")
    state = entity_state(optional(entities, "attrs.state"))
    e = entity_links.select("incident_id", F.col("entity_id").alias("id"), F.coalesce("relation", F.lit("related")).alias("relation")).join(
        entities.select("id", "entity_type", "entity_key", "scope", "score_current", "severity", state.alias("state")), "id")
    open_a = a.groupBy("incident_id").agg(F.count_if(F.col("status") == "open").alias("open_alerts"))
    open_e = e.groupBy("incident_id").agg(F.count_if(F.col("state") == "open").alias("open_entities"))
    badge = score_badge(F.col("score"))
    head = (
        incidents.withColumn("incident_id", F.col("id")).join(open_a, "incident_id", "left").join(open_e, "incident_id", "left")
        .withColumn("status", shown_status(F.col("status"))).withColumn("badge", badge).withColumn("severity_label", level_label(badge))
        .withColumn("open_alerts", F.coalesce("open_alerts", F.lit(0))).withColumn("open_entities", F.coalesce("open_entities", F.lit(0)))
        .drop("incident_id")
    )
    return {"incidents": head, "alerts": a, "entities": e}


def uploads_fully_processed(uploads: DataFrame, events: DataFrame) -> DataFrame:
    """Uploads in the engine stage with no event still waiting."""
    waiting = events.filter(F.col("engine_status").isin("pending", "processing")).select(F.col("log_upload_id").alias("id")).distinct()
    return uploads.filter("status = 'processing_engine'").join(waiting, "id", "left_anti")


