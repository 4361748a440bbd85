"""State changes of alerts, incidents and entities as transforms, and who is told about them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.bands import shown_status, status_to_stored
from tidewatch.functions.fields import optional
from tidewatch.functions.times import _utc
from tidewatch.plans.entities import entity_state

CLOSED = ["closed", "false_positive"]
TWO_HOURS_US = 2 * 3600 * 1_000_000


def close_alerts(
    alerts: DataFrame, chosen: Column, status: str, now: datetime, disposition: str | None = None, note: str | None = None
) -> DataFrame:
    """Set the status of the chosen alerts; closing stamps resolved_at, reopening clears it."""
    stored, hit = status_to_stored(status), F.coalesce(chosen, F.lit(False))
    values = {"status": F.lit(stored), "resolved_at": F.lit(_utc(now) if stored in CLOSED else None).cast("timestamp")}
    if disposition is not None:
        values["disposition"] = F.lit(disposition.strip() or None).cast("string")
    if note is not None:
        values["resolution_note"] = F.lit(note.strip() or None).cast("string")
    return alerts.withColumns({
        c: F.when(hit, v).otherwise(F.col(c) if c in alerts.columns else F.lit(None)) for c, v in values.items()
    })


def open_counts(alert_links: DataFrame, alerts: DataFrame, entity_links: DataFrame, entities: DataFrame) -> DataFrame:
    """Open alerts and entities per incident."""
    a = alert_links.select("incident_id", F.col("alert_id").alias("id")).join(
        alerts.filter(shown_status(F.col("status")) == "open").select("id"), "id"
    ).groupBy("incident_id").agg(F.count(F.lit(1)).alias("open_alerts"))
    e = entity_links.select("incident_id", F.col("entity_id").alias("id")).join(
        entities.filter(entity_state(optional(entities, "attrs.state")) == "open").select("id"), "id"
    ).groupBy("incident_id").agg(F.count(F.lit(1)).alias("open_entities"))
    zero = F.lit(0)
    return a.join(e, "incident_id", "full_outer").select(
        "incident_id", F.coalesce("open_alerts", zero).alias("open_alerts"), F.coalesce("open_entities", zero).alias("open_entities")
    )


def close_incidents(
    incidents: DataFrame, chosen: Column, status: str, now: datetime, by: str,
    alert_links: DataFrame, alerts: DataFrame, entity_links: DataFrame, entities: DataFrame, cascade: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(incidents, alerts, entities) after asking for a status.

    Closing is blocked, and the incident stays open, while it has open alerts or entities, unless
    `cascade` closes those as well. `blocked` tells which.
    """
    stored, stamp = status_to_stored(status), F.lit(_utc(now))
    wants_close = stored in CLOSED
    rows = incidents.withColumn("_hit", F.coalesce(chosen, F.lit(False)))
    counts = open_counts(alert_links, alerts, entity_links, entities).withColumnRenamed("incident_id", "id")
    rows = rows.join(counts, "id", "left")
    pending = F.coalesce(F.col("open_alerts") + F.col("open_entities"), F.lit(0)) > 0
    blocked = F.col("_hit") & F.lit(wants_close and not cascade) & pending
    final = F.when(blocked, "open").otherwise(F.lit(stored))
    null_time = F.lit(None).cast("timestamp")
    closed_now = F.when(blocked, F.col("closed_at")).otherwise(stamp if wants_close else null_time)
    resolved_by = F.when(blocked, F.col("resolved_by")).otherwise(F.lit(by if wants_close else None).cast("string"))
    zero = F.lit(0)
    out = rows.withColumn("blocked", blocked).withColumns({
        "status": F.when(F.col("_hit"), final).otherwise(F.col("status")),
        "closed_at": F.when(F.col("_hit"), closed_now).otherwise(F.col("closed_at")),
        "resolved_by": F.when(F.col("_hit"), resolved_by).otherwise(F.col("resolved_by")),
        "open_alerts": F.when(F.col("_hit") & F.lit(cascade and wants_close), zero).otherwise(F.coalesce("open_alerts", zero)),
        "open_entities": F.when(F.col("_hit") & F.lit(cascade and wants_close), zero).otherwise(F.coalesce("open_entities", zero)),
    })
    if not (cascade and wants_close):
        return out.drop("_hit"), alerts, entities
    hit_ids = rows.filter("_hit").select(F.col("id").alias("incident_id"))
    alert_ids = alert_links.join(hit_ids, "incident_id", "left_semi").select(F.col("alert_id").alias("id"), F.lit(True).alias("_go")).distinct()
    entity_ids = entity_links.join(hit_ids, "incident_id", "left_semi").select(F.col("entity_id").alias("id"), F.lit(True).alias("_go")).distinct()
    new_alerts = close_alerts(alerts.join(alert_ids, "id", "left"), F.col("_go"), stored, now).drop("_go")
    new_entities = set_entity_state(entities.join(entity_ids, "id", "left"), F.col("_go"), "closed", now, by).drop("_go")
    return out.drop("_hit"), new_alerts, new_entities


def set_entity_state(entities: DataFrame, chosen: Column, state: str, now: datetime, by: str) -> DataFrame:
    """Open or close entities; closing stamps time and person, opening removes both."""
    if state not in ("open", "closed"):
        raise ValueError("state must be open or closed")
    closed = state == "closed"
    changed = (
        F.col("attrs").withField("state", F.lit(state))
        .withField("closed_at", F.lit(_utc(now).isoformat() if closed else None).cast("string"))
        .withField("closed_by", F.lit(by if closed else None).cast("string"))
    )
    return entities.withColumn("attrs", F.when(F.coalesce(chosen, F.lit(False)), changed).otherwise(
        F.col("attrs").withField("state", optional(entities, "attrs.state"))
        .withField("closed_at", optional(entities, "attrs.closed_at")).withField("closed_by", optional(entities, "attrs.closed_by"))
    ))


# ---------------------------------------------------------------- notifications


def alert_bucket(severity: Column) -> Column:
    s = F.coalesce(severity, F.lit(0))
    return F.when(s >= 18, "high").when(s >= 10, "medium").otherwise("low")


def incident_bucket(score: Column) -> Column:
    s = F.coalesce(score, F.lit(0))
    return F.when(s >= 61, "high").when(s >= 31, "medium").otherwise("low")


def route_notifications(items: DataFrame, prefs: DataFrame, bucket: Column) -> DataFrame:
    """Who is mailed about which item: the owner has an address and has not switched the bucket off.

    `items` carry the owner in user_id; prefs are (user_id, high, medium, low, to_email).
    """
    rows = items.withColumn("bucket", bucket).join(prefs, "user_id")
    on = F.when(F.col("bucket") == "high", F.col("high")).when(F.col("bucket") == "medium", F.col("medium")).otherwise(F.col("low"))
    address = F.nullif(F.trim("to_email"), F.lit(""))
    return rows.filter(address.isNotNull() & F.coalesce(on, F.lit(True))).withColumn("to_email", address).drop("high", "medium", "low")


def upload_owner(uploads: DataFrame, api_keys: DataFrame) -> DataFrame:
    """(log_upload_id, owner): the upload's user, else the creator of its API key."""
    keys = api_keys.select(F.col("id").alias("api_key_id"), "created_by_user_id")
    return uploads.join(keys, "api_key_id", "left").select(
        F.col("id").alias("log_upload_id"), F.coalesce("user_id", "created_by_user_id").alias("owner")
    )


def nearest_event(alerts: DataFrame, events: DataFrame, reach_us: int = TWO_HOURS_US) -> DataFrame:
    """Each alert with the upload of the latest event on its server within `reach` before or after it.

    As-of lookup in time slices as long as the whole reach: a slice holds its own rows and the last
    event of the slice before, so a busy server is split by time and no pairs are formed.
    """
    span = 2 * reach_us
    points = events.select("server", F.unix_micros("timestamp_utc").alias("t"), F.col("id").alias("event_id"), "log_upload_id").withColumn(
        "slice", F.expr(f"t div {span}")
    )
    last = points.groupBy("server", "slice").agg(F.max(F.struct("t", "event_id", "log_upload_id")).alias("e")).select(
        "server", (F.col("slice") + 1).alias("slice"), "e.*"
    )
    asks = alerts.select(
        "server", (F.unix_micros("triggered_at") + reach_us).alias("t"), F.col("id").alias("alert_id")
    ).withColumn("slice", F.expr(f"t div {span}"))
    both = points.unionByName(last).unionByName(asks, allowMissingColumns=True)
    event = F.when(F.col("alert_id").isNull(), F.struct("t", "event_id", "log_upload_id"))
    # at equal times the event comes first
    upto = Window.partitionBy("server", "slice").orderBy("t", F.col("alert_id").isNotNull(), "event_id")
    seen = both.withColumn("e", F.last(event, ignorenulls=True).over(upto)).filter("alert_id IS NOT NULL")
    near = F.col("e.t") >= F.col("t") - span
    return seen.select("alert_id", F.when(near, F.col("e.event_id")).alias("event_id"), F.when(near, F.col("e.log_upload_id")).alias("log_upload_id"))


def notify_owner(alerts: DataFrame, events: DataFrame, uploads: DataFrame, api_keys: DataFrame) -> DataFrame:
    """(alert_id, user_id): the user that the alert names, else the owner of the upload that it names, else of the nearest event's upload."""
    named = alerts.select(
        F.col("id").alias("alert_id"), optional(alerts, "metrics.user_id").try_cast("bigint").alias("named_user"),
        optional(alerts, "evidence.log_upload_id").try_cast("bigint").alias("named_upload"),
    )
    found = nearest_event(alerts, events).join(named, "alert_id").withColumn("log_upload_id", F.coalesce("named_upload", "log_upload_id"))
    return found.join(upload_owner(uploads, api_keys), "log_upload_id", "left").select("alert_id", F.coalesce("named_user", "owner").alias("user_id"))
