"""Alerts to risk scores per entity, with decay and a ledger of score changes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.fields import field_type, text
from tidewatch.functions.times import _utc

KEY = ["entity_type", "entity_key"]
# Seconds since the last score change -> points taken away; the longest reached counts.
DECAY_STEPS = [(24 * 3600, -5), (7 * 24 * 3600, -15), (30 * 24 * 3600, -30)]
# Upper score of each band.
SCORE_BANDS = [(9, "clean"), (29, "low"), (59, "medium"), (79, "high")]


def score_severity(score: Column) -> Column:
    out = F.lit("critical")
    for top, name in reversed(SCORE_BANDS):
        out = F.when(score <= top, name).otherwise(out)
    return out


def pick_entity(alerts: DataFrame) -> Column:
    """(type, key, scope) of an alert's entity: the first of user, ip, /24, host, operator, country, server."""
    def value(path):
        return F.nullif(F.trim(F.try_element_at(F.col("evidence.group_values"), F.lit(path))), F.lit(""))

    order = [
        ("user", F.lower(value("username")), "local"), ("ip", value("ip_client"), "local"),
        ("subnet24", value("ip_subnet24"), "local"), ("host", F.lower(value("extra.vhost")), "local"),
        ("asn", value("extra.asn.number"), "global"), ("country", F.upper(value("extra.geo.country_code")), "global"),
        ("server", value("server"), "local"),
    ]
    return F.coalesce(*[
        F.when(key.isNotNull(), F.struct(
            F.lit(kind).alias("entity_type"), key.alias("entity_key"), F.lit(scope).alias("scope")))
        for kind, key, scope in order
    ])


def alerts_with_entity(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("_e", pick_entity(alerts)).filter("_e IS NOT NULL").select("*", "_e.*").drop("_e")


def decay_points(age_seconds: Column) -> Column:
    out = F.lit(0)
    for seconds, points in DECAY_STEPS:
        out = F.when(age_seconds >= seconds, points).otherwise(out)
    return F.coalesce(out, F.lit(0))


def _empty_entities(alerts: DataFrame) -> DataFrame:
    return alerts.sparkSession.createDataFrame(
        [], "entity_type string, entity_key string, scope string, score_current int, first_seen_us long, last_seen_us long, "
        "score_updated_us long",
    )


def _touched(alerts: DataFrame, entities: DataFrame | None, now: datetime) -> DataFrame:
    """Per entity with new alerts: sums of the run and the state before it."""
    now_us = F.lit(int(_utc(now).timestamp() * 1_000_000))
    before = entities if entities is not None else _empty_entities(alerts)
    rows = alerts_with_entity(alerts).select(
        *KEY, "scope", "id", F.coalesce(F.col("severity"), F.lit(0)).cast("int").alias("severity"),
        F.unix_micros("triggered_at").alias("us"),
    )
    run = rows.groupBy(*KEY).agg(
        F.min_by("us", "id").alias("first_us"), F.min_by("scope", "id").alias("new_scope"),
        F.sum("severity").alias("points"), F.max(F.when(F.col("severity") != 0, F.col("us"))).alias("scored_us"),
    )
    old = before.select(*KEY, "scope", F.col("score_current").alias("old_score"), "first_seen_us", "last_seen_us", "score_updated_us")
    both = run.join(old, KEY, "left")
    is_new = F.col("old_score").isNull()
    changed = F.when(is_new, F.col("first_us")).otherwise(F.coalesce("score_updated_us", "last_seen_us"))
    points = decay_points(F.floor((now_us - changed) / 1_000_000))
    return both.select(
        *KEY, is_new.alias("is_new"), F.coalesce("scope", "new_scope").alias("scope"),
        F.coalesce("old_score", F.lit(0)).alias("old_score"), points.alias("decay"), "points",
        F.coalesce("first_seen_us", "first_us").alias("first_seen_us"),
        F.greatest("last_seen_us", F.when(is_new, F.col("first_us")), "scored_us").alias("last_seen_us"),
        F.when((points != 0) | (F.col("points") > 0), now_us).otherwise(changed).alias("score_updated_us"),
    )


def entity_score(alerts: DataFrame, entities: DataFrame | None, now: datetime) -> DataFrame:
    """Entities touched by the alerts: one decay, then the severities, within 0..100.

    Severities are never negative, so clamping once after the sum equals clamping at every step.
    """
    t = _touched(alerts, entities, now)
    decayed = F.greatest(F.lit(0), F.col("old_score") + F.col("decay"))
    score = F.least(F.lit(100), decayed + F.col("points")).cast("int")
    return t.select(
        *KEY, "scope", score.alias("score_current"), score_severity(score).alias("severity"),
        "first_seen_us", "last_seen_us", "score_updated_us",
    )


def upsert_entities(entities: DataFrame, touched: DataFrame) -> DataFrame:
    """All entities after a run."""
    return touched.unionByName(entities.join(touched, KEY, "left_anti").select(*touched.columns))


def entity_ledger(alerts: DataFrame, entities: DataFrame | None, now: datetime) -> DataFrame:
    """One row per alert that changed a score, and one per decay."""
    now_us = int(_utc(now).timestamp() * 1_000_000)
    rows = alerts_with_entity(alerts).filter("coalesce(severity, 0) <> 0").select(
        *KEY, F.unix_micros("triggered_at").alias("us"), F.col("severity").cast("int").alias("delta"),
        F.lit("alert").alias("reason_type"), F.col("id").cast("string").alias("reason_id"),
    )
    decays = _touched(alerts, entities, now).filter("decay <> 0").select(
        *KEY, F.lit(now_us).cast("bigint").alias("us"), F.col("decay").cast("int").alias("delta"),
        F.lit("decay").alias("reason_type"), F.lit(None).cast("string").alias("reason_id"),
    )
    return rows.unionByName(decays)


def dedupe_ledger(ledger: DataFrame) -> DataFrame:
    """At most one row per (entity, alert), the earliest; decay rows are all kept."""
    key = [*KEY, "reason_type", "reason_id"]
    alert = ledger.filter("reason_type = 'alert'").groupBy(*key).agg(F.min(F.struct("us", "delta")).alias("v"))
    first = alert.select(*KEY, F.col("v.us").alias("us"), F.col("v.delta").alias("delta"), "reason_type", "reason_id")
    return first.unionByName(ledger.filter("reason_type <> 'alert'"))


def entity_attrs(alerts: DataFrame) -> DataFrame:
    """Country and operator of each entity; every field from the newest alert that has it."""
    rows = alerts_with_entity(alerts)

    def value(*paths):
        return F.coalesce(*[F.nullif(F.trim(F.try_element_at(F.col("evidence.group_values"), F.lit(p))), F.lit("")) for p in paths])

    def nested(section, name):
        paths = [f"evidence.{section}.{name}", f"evidence.enrich.{section}.{name}"]
        return [F.col(p).cast("string") for p in reversed(paths) if field_type(rows.schema, p) is not None]

    code = F.coalesce(*nested("geo", "country_code"), F.upper(value("extra.geo.country_code", "geo.country_code", "country_code")))
    country = F.coalesce(*nested("geo", "country_name"), F.lit(None).cast("string"))
    number = F.coalesce(*nested("asn", "number"), value("extra.asn.number", "asn.number", "asn")).try_cast("bigint")
    org = F.coalesce(*nested("asn", "org"), F.lit(None).cast("string"))

    def newest(v):
        return F.max_by(v, F.when(v.isNotNull(), F.col("id")))

    return rows.groupBy(*KEY).agg(
        newest(code).alias("country_code"), newest(country).alias("country_name"),
        newest(number).alias("asn_number"), newest(org).alias("asn_org"),
    )


def entity_state(attrs_state: Column) -> Column:
    s = F.lower(F.trim(text(attrs_state)))
    return F.when(s.isin("open", "closed"), s).otherwise("open")
