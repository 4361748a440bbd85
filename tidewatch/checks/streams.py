"""Streaming jobs, run to the end of their input in several micro-batches."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.checks import base
from tidewatch.checks.casework import BAND, DAY, PICKED, READY, TICKS
from tidewatch.checks.casework import RULES as INCIDENT_RULES
from tidewatch.checks.engine import AUTH, COUNTRY, KEY, RULES, TRUST, WITH_SEC, alert_rows, alert_sql, cooldown_cte, window_cte
from tidewatch.checks.registry import check
from tidewatch.operators.rules import TrustConfig
from tidewatch.operators.staging import shared_root
from tidewatch.parsers.web import parse_http_access
from tidewatch.plans import incidents as incident_plans
from tidewatch.sources.lines import stream_log_lines
from tidewatch.streaming import jobs
from tidewatch.streaming.alerts import current_alerts, late_rows, read_changes
from tidewatch.streaming.entities import current_entities, ledger_rows
from tidewatch.streaming.incidents import current_incidents, firings_of

NOW = datetime(2024, 1, 25, tzinfo=timezone.utc)
CUTS = (1705000000000000, 1705900000000000)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def in_runs(df: DataFrame, name: str, start, part=None) -> None:
    """Add the rows to a folder in three parts (by time, or as `part` says), and run the streaming job after each: one batch of rows a run."""
    path = _folder(df.sparkSession, name)
    us = F.col("us")
    df = df.withColumn("_part", F.when(us < CUTS[0], 0).when(us < CUTS[1], 1).otherwise(2) if part is None else part)
    for n in range(3):
        df.filter(F.col("_part") == n).drop("_part").write.mode("append").parquet(path)
        start(df.sparkSession.readStream.schema(df.drop("_part").schema).parquet(path)).awaitTermination()


_CTES, _PICKS = alert_sql()
# the columns of the batch query, and the values of the group
GROUP_VALUES = f"""array_to_string(list_filter(['extra.asn.number=' || (64000 + user_id % 16), 'extra.asn.org=org', 'extra.geo.country_code=' || {COUNTRY},
  'ip_client=' || ip_client, 'server=' || server, 'username=' || username], lambda x: x IS NOT NULL), ';')"""
T1_NAMES = {r.id: (r.name, r.severity) for r in RULES}


@check("t1_stream_alerts", f"""{WITH_SEC}, {_CTES}, a AS ({_PICKS}) SELECT a.*, {GROUP_VALUES} AS group_values,
  CASE rule_id {' '.join(f"WHEN {i} THEN '{n}'" for i, (n, _) in T1_NAMES.items())} END AS rule_name, (CASE rule_id {' '.join(f'WHEN {i} THEN {s}' for i, (_, s) in T1_NAMES.items())} END)::BIGINT AS severity
  FROM a JOIN sec USING (event_id, us)""".replace("SELECT a.*", "SELECT a.* EXCLUDE (us), sec.us"))
def t1(spark, sf):
    """The whole alerts, as the batch query gives them."""
    folder = _folder(spark, "alerts")
    in_runs(base.events(spark, sf), "events", lambda stream: jobs.stream_alerts(stream, RULES, TRUST, folder))
    al = current_alerts(read_changes(spark, folder))
    pairs = F.transform(F.array_sort(F.map_entries("evidence.group_values")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    # rows of one alert are told apart by its event and rule
    extra = al.select("event_id", "rule_id", F.array_join(pairs, ";").alias("group_values"), "rule_name", F.col("severity").cast("bigint").alias("severity"))
    return alert_rows(al).join(extra.withColumn("rule_id", F.col("rule_id").cast("bigint")), ["event_id", "rule_id"])


# every fifth row comes a batch later than its time; the delay covers it or does not
_LATER_SQL = f"least(2, CASE WHEN us < {CUTS[0]} THEN 0 WHEN us < {CUTS[1]} THEN 1 ELSE 2 END + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END)"
LONG, SHORT = 30 * 86400, 6 * 3600


@check("t2_event_time_order", f"""{WITH_SEC}, {window_cte('m')}, c AS (SELECT * FROM m WHERE fail_count >= 2 AND unique_paths >= 2), {cooldown_cte('f', 'c', 172800_000_000)}
  SELECT event_id, c.gk AS group_key, n, fail_count, array_to_string(ids[-3:], ',') AS evidence FROM c JOIN f ON c.gk = f.gk AND c.us = f.us""")
def t2(spark, sf):
    """Rows that come a batch late, in reverse order, within the delay: the alerts of the batch run."""
    folder = _folder(spark, "order")
    backwards = base.events(spark, sf).orderBy(F.desc("us"))
    in_runs(backwards, "events", lambda stream: jobs.stream_alerts(stream, RULES[:1], TrustConfig(), folder, LONG), F.expr(_LATER_SQL))
    al = current_alerts(read_changes(spark, folder))
    return al.select("event_id", "group_key", F.col("metrics.count").alias("n"), "metrics.fail_count", F.array_join("evidence.event_ids", ",").alias("evidence"))


@check("t2_late_rows", f"""{WITH_SEC}, p AS (SELECT *, {_LATER_SQL} AS part FROM sec), h AS (SELECT b.part, (max(p.us) // 1000 - {SHORT} * 1000) * 1000 AS horizon
  FROM p JOIN (SELECT DISTINCT part FROM p) b ON p.part < b.part GROUP BY b.part)
  SELECT event_id, us, {KEY} AS group_key FROM p JOIN h USING (part) WHERE us < horizon AND {AUTH}""")
def t2_late(spark, sf):
    """Rows that come later than the delay are in the late table, each once."""
    folder = _folder(spark, "late")
    in_runs(base.events(spark, sf), "events", lambda stream: jobs.stream_alerts(stream, RULES[:1], TrustConfig(), folder, SHORT), F.expr(_LATER_SQL))
    late = late_rows(read_changes(spark, folder))
    return late.select("event_id", F.unix_micros("triggered_at").alias("us"), "group_key")


@check("t3_stream_activity", f"""{base.WITH_ALERTS} SELECT strftime(make_timestamp(us // {DAY} * {DAY}), '%Y-%m-%d') AS day, count(*) AS total, count_if(starts_with(rule_name, 'AUTH-')) AS bruteforce,
  count_if(rule_name = 'WEB-001 scan') AS bots, count_if(rule_name = 'WEB-003 exploit') AS exploits, count_if(starts_with(rule_name, 'MAIL-')) AS mail, count_if(starts_with(rule_name, 'AUTH-005')) AS panel
  FROM alerts GROUP BY ALL""")
def t3(spark, sf):
    folder = _folder(spark, "activity")
    in_runs(base.alerts(spark, sf), "alerts", lambda stream: jobs.stream_activity(stream, folder))
    days = jobs.current_activity(spark.read.parquet(f"{folder}/days"))
    return days.select(F.col("day").cast("string").alias("day"), "total", "bruteforce", "bots", "exploits", "mail", "panel")


# ticks that the watermark has passed: those before the newest alert, less the delay
T4_STEP = 3600
_PASSED = f"(SELECT (max(us) // 1000 - 3600 * 1000) * 1000 FROM alerts)"
T4_TICKS = TICKS.split(", ticks AS")[0] + f""", ticks AS (SELECT i * {T4_STEP * 1_000_000} AS tick FROM range((SELECT min(us) // {T4_STEP * 1_000_000} FROM alerts), (SELECT max(us) // {T4_STEP * 1_000_000} + 1 FROM alerts)) r(i)
  WHERE i * {T4_STEP * 1_000_000} < {_PASSED}), totals AS""" + TICKS.split("totals AS")[1]


@check("t4_stream_incidents", f"""{T4_TICKS}, {READY}, n AS (SELECT code, kind, pv, count(*) AS alerts, sum(alert_id)::BIGINT AS alert_sum FROM links GROUP BY ALL),
  i AS (SELECT code, kind, pv, count(*) AS firings, min_by(first_us, (tick, rule_id)) AS opened_us, max(last_us) AS last_us, sum(n)::BIGINT AS count FROM fired GROUP BY ALL)
  SELECT code, kind AS primary_entity_type, pv AS primary_entity_key, firings, opened_us, last_us, count, alerts, alert_sum FROM i JOIN n USING (code, kind, pv)""")
def t4(spark, sf):
    """Three runs, the second with a backlog of ten days: every tick of it, and the links of all firings."""
    folder, key = _folder(spark, "incidents"), ["code", "primary_entity_type", "primary_entity_key"]
    alerts, runs_left = base.alerts(spark, sf), [3, 2, 1]

    def start(stream):
        run = jobs.stream_incidents(stream, INCIDENT_RULES, folder, T4_STEP)
        run.awaitTermination()
        if runs_left.pop() % 2 == 0:  # the links of the second run wait for the third
            return run
        log = spark.read.parquet(f"{folder}/changes")
        changes = spark.readStream.schema(log.schema).parquet(f"{folder}/changes")
        return jobs.stream_incident_links(changes, INCIDENT_RULES, lambda s: base.alerts(s, sf), f"{folder}/linked")

    in_runs(alerts, "alerts", start)
    log = spark.read.parquet(f"{folder}/changes")
    incidents = current_incidents(log, INCIDENT_RULES)
    links = spark.read.parquet(f"{folder}/linked/links").groupBy(*key).agg(F.count(F.lit(1)).alias("alerts"), F.sum("alert_id").alias("alert_sum"))
    described = incident_plans.described(firings_of(log), INCIDENT_RULES).groupBy("code", "primary_entity_type", F.col("primary").alias("primary_entity_key"))
    firings = described.agg(F.count(F.lit(1)).alias("firings"))
    return incidents.join(links, key).join(firings, key).select(*key, "firings", "opened_us", "last_us", "count", "alerts", "alert_sum")


@check("t5_stream_entities", f"""{PICKED}, p AS (SELECT *, CASE WHEN us < {CUTS[0]} THEN 0 WHEN us < {CUTS[1]} THEN 1 ELSE 2 END AS part FROM e),
  r AS (SELECT entity_type, entity_key, arg_min(us, id) AS first_us, sum(severity)::BIGINT AS points, max(us) AS last_us, count(DISTINCT part) AS versions, count_if(severity <> 0) AS ledger FROM p GROUP BY ALL)
  SELECT entity_type, entity_key, least(100, points)::BIGINT AS score, {BAND.format('least(100, points)')} AS severity, last_us, versions, ledger FROM r""")
def t5(spark, sf):
    """Read from the log: each entity has a version for each batch that touched it, and no more."""
    folder, key = _folder(spark, "entities"), ["entity_type", "entity_key"]
    in_runs(base.alerts(spark, sf), "alerts", lambda stream: jobs.stream_entities(stream, folder, NOW))
    log = spark.read.parquet(f"{folder}/changes")
    versions = log.filter("kind = 'entity'").groupBy(*key).agg(F.count(F.lit(1)).alias("versions"))
    ledger = ledger_rows(log).filter("reason_type = 'alert'").groupBy(*key).agg(F.count(F.lit(1)).alias("ledger"))
    return current_entities(log).join(versions, key).join(ledger, key).select(
        *key, F.col("score_current").cast("bigint").alias("score"), "severity", F.col("last_seen_us").alias("last_us"), "versions", "ledger")


@check("s2_stream_log_lines", f"{WITH_SEC} SELECT ip_client AS ip, path, CAST(status AS BIGINT) AS status, count(*) AS n FROM sec GROUP BY ALL")
def s2(spark, sf):
    from tidewatch.checks.parsing import ACCESS_LINE

    src, out = _folder(spark, "lines"), _folder(spark, "parsed")
    base.sec_events(spark, sf).select(F.expr(ACCESS_LINE).alias("value")).repartition(3).write.text(src)
    events = parse_http_access(stream_log_lines(spark, src, "srv", "apache_access"), datetime(2024, 6, 1))
    flat = events.select(F.col("ip_client").alias("ip"), F.col("extra.http.path").alias("path"), F.col("extra.http.status").cast("bigint").alias("status"))
    flat.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("ip", "path", "status").agg(F.count(F.lit(1)).alias("n"))


