"""Incidents, entities, dashboards, filters and state changes."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tidewatch.checks import base
from tidewatch.checks.base import WITH_ALERTS, WITH_OPS, WITH_SEC, alerts
from tidewatch.checks.engine import cooldown_cte
from tidewatch.checks.registry import check
from tidewatch.functions import bands
from tidewatch.operators import filters
from tidewatch.operators.staging import staged
from tidewatch.plans import dashboards, entities, incidents, lifecycle
from tidewatch.sources import lines as src

NOW = datetime(2024, 1, 25, tzinfo=timezone.utc)
NOW_US = 1706140800000000
DAY = 86_400_000_000
START, END, STEP = datetime(2024, 1, 1, tzinfo=timezone.utc), datetime(2024, 1, 31, tzinfo=timezone.utc), 1800
START_US = 1704067200000000
RULES = incidents.seeded_rules() + [
    incidents.IncidentRule(15, "INC-X-01", "Named", "user", "username", {"alert_names_any": ["WEB-001 scan", "x"], "min_severity": "12", "server_any": ["srv1", "srv2"]},
                           [], "count >= 1 and sum_severity > 20", severity_base=40, window_seconds=43200, cooldown_seconds=5400),
]
CODE = "split_part(rule_name, ' ', 1)"
# rule id, code, alert test, group key, primary, window, cooldown, condition, base severity, score, entity type
ORACLE_RULES = [
    (1, "INC-ACC-01", f"{CODE} IN ('AUTH-003', 'AUTH-005', 'MAIL-002')", "server || '|' || coalesce(gv_username, '-')", "gv_username", 3600, 21600, "n >= 1", 85, 100, "user"),
    (3, "INC-WEB-01", f"{CODE} IN ('WEB-001', 'WEB-003')", "server || '|' || coalesce(gv_ip, '-')", "gv_ip", 900, 1800, "n >= 2 OR max_severity >= 15", 60, 70, "ip"),
    (6, "INC-MAIL-01", f"{CODE} = 'MAIL-002'", "server", "server", 7200, 21600, "n >= 1", 95, 100, "host"),
    (15, "INC-X-01", "rule_name = 'WEB-001 scan' AND severity >= 12 AND server IN ('srv1', 'srv2')", "server || '|' || coalesce(gv_username, '-')", "gv_username", 43200, 5400,
     "n >= 1 AND sum_severity > 20", 40, 40, "user"),
]
MATCHED = " UNION ALL ".join(
    f"SELECT {i}::BIGINT AS rule_id, '{code}' AS code, id, us, severity, rule_name, server, {gk} AS gk, {pv} AS pv, {w * 1_000_000}::BIGINT AS w, {cd * 1_000_000}::BIGINT AS cd, "
    f"{b}::BIGINT AS base, {score}::BIGINT AS score, '{kind}' AS kind, server || '/' || coalesce(gv_username, '-') || '/' || coalesce(gv_ip, '-') AS gvt FROM alerts WHERE {test}"
    for i, code, test, gk, pv, w, cd, _, b, score, kind in ORACLE_RULES)
TICKS = f"""{WITH_ALERTS}, hits AS ({MATCHED}), ticks AS (SELECT {START_US} + i * {STEP * 1_000_000} AS tick FROM range({30 * 86400 // STEP + 1}) r(i)),
  totals AS (SELECT rule_id, code, kind, gk, tick, w, cd, base, score, count(*) AS n, count(DISTINCT rule_name) AS unique_alerts, count(DISTINCT server) AS unique_servers,
    max(severity) AS max_severity, sum(severity)::BIGINT AS sum_severity, min(us) AS first_us, max(us) AS last_us, arg_min(pv, us) AS pv, arg_min(server, us) AS server, arg_min(gvt, us) AS gvt
    FROM hits JOIN ticks ON tick BETWEEN us AND us + w GROUP BY ALL)"""
READY = f"""ready AS (SELECT *, rule_id || ':' || gk AS rk, tick AS us FROM totals WHERE pv IS NOT NULL AND CASE rule_id
  {' '.join(f'WHEN {r[0]} THEN {r[7]}' for r in ORACLE_RULES)} END), {cooldown_cte('f', 'ready', 'cd', 'rk')},
  fired AS (SELECT ready.* FROM ready JOIN f ON ready.rk = f.rk AND ready.us = f.us),
  links AS (SELECT DISTINCT fired.code, fired.kind, fired.pv, hits.id AS alert_id FROM fired JOIN hits ON hits.rule_id = fired.rule_id AND hits.gk = fired.gk AND hits.us BETWEEN tick - fired.w AND tick)"""


def _hits(spark, sf):
    return incidents.alerts_to_rules(alerts(spark, sf), RULES)


@check("f6_incident_match", f"{WITH_ALERTS} SELECT rule_id, id, gk, pv FROM ({MATCHED})")
def f6(spark, sf):
    return _hits(spark, sf).select(F.col("rule_id").cast("bigint").alias("rule_id"), "id", F.col("group_key").alias("gk"), F.col("primary").alias("pv"))


TICK_COLS = ["unique_alerts", "unique_servers", "max_severity", "sum_severity"]


def _ticks(df):
    return df.select(F.col("rule_id").cast("bigint").alias("rule_id"), F.col("group_key").alias("gk"), F.col("tick_ts").alias("tick"), F.col("count").alias("n"),
                     *TICK_COLS, F.col("first_ts").alias("first_us"), F.col("last_ts").alias("last_us"), F.col("primary").alias("pv"))


@check("w4_incident_ticks", f"{TICKS} SELECT rule_id, gk, tick, n, {', '.join(TICK_COLS)}, first_us, last_us, pv FROM totals")
def w4(spark, sf):
    return _ticks(incidents.incident_metrics(_hits(spark, sf), RULES, START, END, STEP))


@check("a4_incident_metrics", f"{TICKS} SELECT rule_id, gk, tick, n, {', '.join(TICK_COLS)}, first_us, last_us, pv FROM totals WHERE tick = {NOW_US}")
def a4(spark, sf):
    return _ticks(incidents.incident_metrics(_hits(spark, sf), RULES, NOW, NOW, 300))


@check("w5_incident_cooldown", f"{TICKS}, {READY} SELECT rule_id, gk, tick, n, {', '.join(TICK_COLS)}, first_us, last_us, pv FROM fired")
def w5(spark, sf):
    return _ticks(incidents.incident_firings(alerts(spark, sf), RULES, START, END, STEP))


INC = f"""ids AS (SELECT code, kind, pv, count(*) AS alerts, sum(alert_id)::BIGINT AS alert_sum FROM links GROUP BY ALL),
  inc AS (SELECT fired.code, fired.kind AS primary_entity_type, fired.pv AS primary_entity_key, max(base) AS severity_current, max(score) AS score,
  arg_min(server, (tick, rule_id, first_us, gk)) AS server, arg_min(first_us, (tick, rule_id, first_us, gk)) AS opened_us, max(last_us) AS last_us, sum(n)::BIGINT AS n,
  max(max_severity) AS max_severity, arg_min(gvt, (tick, rule_id, first_us, gk)) AS gvt, arg_min(rule_id, (tick, rule_id, first_us, gk)) AS rule_id,
  arg_min(last_us, (tick, rule_id, first_us, gk)) AS window_end, any_value(alerts) AS alerts, any_value(alert_sum) AS alert_sum
  FROM fired JOIN ids ON ids.code = fired.code AND ids.kind = fired.kind AND ids.pv = fired.pv GROUP BY ALL)"""
INC_COLS = "code, primary_entity_type, primary_entity_key, severity_current, score, server, opened_us, last_us, n, max_severity"


def _built(spark, sf, existing=None):
    return incidents.build_incidents(alerts(spark, sf), RULES, START, END, STEP, existing)


def _inc_rows(df):
    return df.withColumn("n", F.col("count")).withColumn("severity_current", F.col("severity_current").cast("bigint")).withColumn("score", F.col("score").cast("bigint"))


@check("r4_build_incidents", f"{TICKS}, {READY}, {INC} SELECT {INC_COLS}, alerts, alert_sum, gvt, rule_id, window_end, last_us AS last_window_end, CASE rule_id WHEN 6 THEN 'server' WHEN 3 THEN 'server,ip_client' ELSE 'server,username' END AS group_by FROM inc")
def r4(spark, sf):
    inc, links, _ = _built(spark, sf)
    key = ["code", "primary_entity_type", "primary_entity_key"]
    ids = links.groupBy(*key).agg(F.count(F.lit(1)).alias("alerts"), F.sum("alert_id").alias("alert_sum"))
    values = F.concat_ws("/", *[F.coalesce(F.try_element_at("evidence.group_values", F.lit(n)), F.lit("-")) for n in ("server", "username", "ip_client")])
    evidence = [
        values.alias("gvt"), F.col("evidence.rule_id").cast("bigint").alias("rule_id"), F.unix_micros("evidence.window_end").alias("window_end"),
        F.unix_micros(incidents.incident_metrics_row()["last_window_end"]).alias("last_window_end"), F.array_join("evidence.group_by", ",").alias("group_by"),
    ]
    return _inc_rows(inc).join(ids, key, "left").select(*INC_COLS.split(", "), "alerts", "alert_sum", *evidence)


@check("r8_seeded_rules", f"{TICKS}, {READY} SELECT rule_id, count(*) AS firings FROM fired WHERE rule_id < 15 GROUP BY rule_id")
def r8(spark, sf):
    f = incidents.incident_firings(alerts(spark, sf), incidents.seeded_rules(), START, END, STEP)
    return f.groupBy(F.col("rule_id").cast("bigint").alias("rule_id")).agg(F.count(F.lit(1)).alias("firings"))


@check("j8_new_links_only", f"""{TICKS}, {READY} SELECT code, kind, pv, alert_id, CASE WHEN alert_id % 2 = 0 THEN 'seen' ELSE 'supporting' END AS role FROM links""")
def j8(spark, sf):
    firings = staged(incidents.incident_firings(alerts(spark, sf), RULES, START, END, STEP), "firings")
    links = incidents.incident_links(firings, alerts(spark, sf), RULES).withColumnRenamed("primary_entity_type", "kind").withColumnRenamed("primary_entity_key", "pv")
    old = links.filter("alert_id % 2 = 0").withColumn("role", F.lit("seen"))
    return incidents.new_links_only(links, old, ["code", "kind", "pv", "alert_id"]).select("code", "kind", "pv", "alert_id", "role")


EXISTING = f"""{base.WITH_ALERTS}, incidents AS ({base.INCIDENTS})"""


@check("u3_upsert_incidents", f"""{TICKS}, {READY}, {INC}, incidents AS ({base.INCIDENTS}),
  merged AS (SELECT coalesce(o.code, i.code) AS code, coalesce(o.primary_entity_type, i.primary_entity_type) AS primary_entity_type, coalesce(o.primary_entity_key, i.primary_entity_key) AS primary_entity_key,
    coalesce(o.status, 'open') AS status, greatest(o.severity_current, i.severity_current) AS severity_current, greatest(o.score, i.score) AS score,
    CASE WHEN o.id IS NULL THEN i.server ELSE o.server END AS server, coalesce(o.opened_us, i.opened_us) AS opened_us, greatest(o.last_us, i.last_us) AS last_us,
    coalesce(o.count, 0) + coalesce(i.n, 0) AS n, greatest(o.max_severity, i.max_severity) AS max_severity
    FROM (SELECT * FROM incidents WHERE status IN ('open', 'triage', 'contained')) o FULL JOIN inc i
    ON o.code = i.code AND o.primary_entity_type = i.primary_entity_type AND o.primary_entity_key = i.primary_entity_key)
  SELECT * FROM merged UNION ALL SELECT code, primary_entity_type, primary_entity_key, status, severity_current, score, server, opened_us, last_us, count, max_severity FROM incidents
  WHERE status NOT IN ('open', 'triage', 'contained')""")
def u3(spark, sf):
    inc = _built(spark, sf, base.incidents(spark, sf)).incidents
    return _inc_rows(inc).select(*INC_COLS.split(", "), "status")


@check("u1_merge_evidence_ids", f"{WITH_SEC} SELECT event_id, array_to_string(list_sort(list_distinct(list_concat([k, user_id], CASE WHEN k % 2 = 0 THEN [event_id, k] ELSE [] END))), ',') AS ids FROM sec")
def u1(spark, sf):
    old, new = F.array("k", "user_id"), F.expr("CASE WHEN k % 2 = 0 THEN array(event_id, k) END")
    ids = F.transform(incidents.merge_evidence_ids(old, new), lambda x: x.cast("string"))
    return base.sec_events(spark, sf).select("event_id", F.array_join(ids, ",").alias("ids"))


@check("j7_find_open_incident", f"""{EXISTING}, wanted AS (SELECT DISTINCT 'INC-ACC-01' AS code, 'user' AS primary_entity_type, 'user' || (user_id - user_id % 3) AS primary_entity_key FROM alerts)
  SELECT w.*, max(i.id) AS incident_id FROM wanted w LEFT JOIN incidents i ON i.code = w.code AND i.primary_entity_key = w.primary_entity_key AND i.status IN ('open', 'triage', 'contained') GROUP BY ALL""")
def j7(spark, sf):
    wanted = base.alerts_raw(spark, sf).select(F.lit("INC-ACC-01").alias("code"), F.lit("user").alias("primary_entity_type"),
                                               F.expr("concat('user', user_id - user_id % 3)").alias("primary_entity_key")).distinct()
    return incidents.find_open_incident(wanted, base.incidents(spark, sf))


@check("r7_link_incident_entities", f"{WITH_OPS} SELECT i.id AS incident_id, e.id AS entity_id, 'primary' AS relation FROM incidents i JOIN entities e ON e.entity_type = 'user' AND e.entity_key = i.primary_entity_key")
def r7(spark, sf):
    return incidents.link_incident_entities(base.incidents(spark, sf), base.entities(spark, sf))


# ---------------------------------------------------------------- entities

PICK = """CASE WHEN gv_username IS NOT NULL THEN 'user' WHEN gv_ip IS NOT NULL THEN 'ip' WHEN gv_asn IS NOT NULL THEN 'asn' WHEN gv_country IS NOT NULL THEN 'country' ELSE 'server' END AS entity_type,
  coalesce(gv_username, gv_ip, gv_asn::VARCHAR, upper(gv_country), server) AS entity_key"""
PICKED = f"{WITH_ALERTS}, e AS (SELECT *, {PICK} FROM alerts)"
# the state before the run, from the alerts of the first nine days
OLD_CUT = START_US + 9 * DAY
OLD = f"""old AS (SELECT entity_type, entity_key, 'local' AS scope, least(100, 20 + sum(severity) % 90)::BIGINT AS score_current, min(us) AS first_seen_us, max(us) AS last_seen_us,
  max(us) AS score_updated_us FROM e WHERE us < {OLD_CUT} GROUP BY ALL)"""
RUN = f"""{PICKED}, {OLD}, run AS (SELECT entity_type, entity_key, arg_min(us, id) AS first_us, sum(severity)::BIGINT AS points, max(us) AS last_us FROM e WHERE us >= {OLD_CUT} GROUP BY ALL),
  t AS (SELECT run.*, old.score_current AS old_score, old.first_seen_us AS old_first, coalesce(old.score_updated_us, run.first_us) AS changed, old.last_seen_us AS old_last,
    CASE WHEN {NOW_US} - changed >= 30 * {DAY} THEN -30 WHEN {NOW_US} - changed >= 7 * {DAY} THEN -15 WHEN {NOW_US} - changed >= {DAY} THEN -5 ELSE 0 END AS decay
    FROM run LEFT JOIN old ON old.entity_type = run.entity_type AND old.entity_key = run.entity_key)"""


def _before(spark, sf):
    e = entities.alerts_with_entity(alerts(spark, sf).filter(F.col("us") < OLD_CUT))
    return e.groupBy("entity_type", "entity_key").agg(
        F.lit("local").alias("scope"), F.least(F.lit(100), 20 + F.sum("severity") % 90).cast("int").alias("score_current"), F.min("us").alias("first_seen_us"),
        F.max("us").alias("last_seen_us"), F.max("us").alias("score_updated_us"))


def _new(spark, sf):
    return alerts(spark, sf).filter(F.col("us") >= OLD_CUT)


@check("r5_pick_entity", f"{PICKED} SELECT id, entity_type, entity_key, CASE WHEN entity_type IN ('asn', 'country') THEN 'global' ELSE 'local' END AS scope FROM e")
def r5(spark, sf):
    return entities.alerts_with_entity(alerts(spark, sf)).select("id", "entity_type", "entity_key", "scope")


BAND = "CASE WHEN {0} <= 9 THEN 'clean' WHEN {0} <= 29 THEN 'low' WHEN {0} <= 59 THEN 'medium' WHEN {0} <= 79 THEN 'high' ELSE 'critical' END"
SCORED = f"""{RUN}, s AS (SELECT entity_type, entity_key, least(100, greatest(0, coalesce(old_score, 0) + decay) + points)::BIGINT AS score, coalesce(old_first, first_us) AS first_us,
  greatest(old_last, last_us) AS last_us FROM t) SELECT *, {BAND.format('score')} AS severity FROM s"""


def _score_rows(df):
    return df.select("entity_type", "entity_key", F.col("score_current").cast("bigint").alias("score"), F.col("first_seen_us").alias("first_us"), F.col("last_seen_us").alias("last_us"), "severity")


@check("a11_entity_score", SCORED)
def a11(spark, sf):
    return _score_rows(entities.entity_score(_new(spark, sf), _before(spark, sf), NOW))


@check("u4_upsert_entities", f"""{SCORED} UNION ALL SELECT entity_type, entity_key, score_current, first_seen_us, last_seen_us, {BAND.format('score_current')} FROM old
  WHERE (entity_type, entity_key) NOT IN (SELECT (entity_type, entity_key) FROM run)""")
def u4(spark, sf):
    before = _before(spark, sf)
    full = before.withColumn("severity", entities.score_severity(F.col("score_current")))
    return _score_rows(entities.upsert_entities(full, entities.entity_score(_new(spark, sf), before, NOW)))


LEDGER = f"""{RUN}, ledger AS (SELECT entity_type, entity_key, us, severity AS delta, 'alert' AS reason_type, id::VARCHAR AS reason_id FROM e WHERE us >= {OLD_CUT}
  UNION ALL SELECT entity_type, entity_key, {NOW_US}, decay, 'decay', NULL FROM t WHERE decay <> 0) SELECT * FROM ledger"""


@check("a12_entity_ledger", LEDGER)
def a12(spark, sf):
    return entities.entity_ledger(_new(spark, sf), _before(spark, sf), NOW).withColumn("delta", F.col("delta").cast("bigint"))


@check("a12_ledger_once_per_alert", LEDGER)
def a12_once(spark, sf):
    led = staged(entities.entity_ledger(_new(spark, sf), _before(spark, sf), NOW), "ledger")
    twice = led.unionByName(led.filter("reason_type = 'alert'").withColumn("us", F.col("us") + 1))
    return entities.dedupe_ledger(twice).withColumn("delta", F.col("delta").cast("bigint"))


@check("a13_entity_attrs", f"""{PICKED} SELECT entity_type, entity_key, upper(arg_max(gv_country, id) FILTER (gv_country IS NOT NULL)) AS country_code,
  arg_max(gv_asn, id) FILTER (gv_asn IS NOT NULL) AS asn_number FROM e GROUP BY ALL""")
def a13(spark, sf):
    return entities.entity_attrs(alerts(spark, sf)).select("entity_type", "entity_key", "country_code", "asn_number")


# ---------------------------------------------------------------- filters and bands

SINCE = NOW_US - 10 * DAY


@check("f7_filter_alerts", f"""{WITH_OPS} SELECT 'a' AS f, id FROM alerts WHERE us >= {SINCE} AND server = 'srv3' AND status IN ('open', 'triage') AND severity BETWEEN 10 AND 17
  UNION ALL SELECT 'b', id FROM alerts WHERE us >= {SINCE} AND status = 'closed' AND (strpos(group_key, '44.3.2') > 0 OR strpos(coalesce(gv_ip, ''), '44.3.2') > 0)
  UNION ALL SELECT 'c', id FROM alerts WHERE us >= {SINCE} AND (strpos(lower(group_key), '|user12') > 0 OR strpos(coalesce(gv_username, ''), 'user12') > 0)
  UNION ALL SELECT 'd', id FROM alerts WHERE us >= {SINCE} AND id IN (SELECT alert_id FROM alert_links WHERE incident_id = 5)""")
def f7(spark, sf):
    a, links = alerts(spark, sf), base.alert_links(spark, sf)
    run = lambda n, **kw: filters.filter_alerts(a, NOW, days=10, **kw).select(F.lit(n).alias("f"), "id")
    return (run("a", server="srv3", status="open", severity="medium").unionByName(run("b", status="resolved", ip="44.3.2"))
            .unionByName(run("c", q="USER12")).unionByName(run("d", incident_id=5, links=links)))


@check("j5_alerts_of_incident", f"{WITH_OPS} SELECT id, server FROM alerts WHERE id IN (SELECT alert_id FROM alert_links WHERE incident_id = 9)")
def j5(spark, sf):
    return filters.alerts_of_incident(alerts(spark, sf), base.alert_links(spark, sf), 9).select("id", "server")


@check("f8_filter_incidents", f"""{WITH_OPS} SELECT 'a' AS f, id FROM incidents WHERE last_us >= {NOW_US - DAY} AND score BETWEEN 31 AND 60
  UNION ALL SELECT 'b', id FROM incidents WHERE last_us >= {NOW_US - DAY} AND status IN ('open', 'triage', 'contained') AND server = 'srv1'
  UNION ALL SELECT 'c', id FROM incidents WHERE last_us >= {NOW_US - DAY} AND status = 'closed' AND score >= 61""")
def f8(spark, sf):
    i = base.incidents(spark, sf)
    run = lambda n, **kw: filters.filter_incidents(i, NOW, days=1, **kw).select(F.lit(n).alias("f"), "id")
    return run("a", severity="medium").unionByName(run("b", status="open", server="srv1")).unionByName(run("c", status="resolved", severity="high"))


@check("f9_filter_entities", f"""{WITH_OPS} SELECT 'a' AS f, id FROM entities WHERE entity_type = 'ip' AND strpos(entity_key, '44.0.0.1') > 0 AND coalesce(state, 'x') <> 'closed'
  UNION ALL SELECT 'b', id FROM entities WHERE server = 'srv4' AND score_current >= 60
  UNION ALL SELECT 'c', id FROM entities WHERE id IN (SELECT entity_id FROM entity_links WHERE incident_id = 7) AND last_us >= {NOW_US - 400 * DAY}
  UNION ALL SELECT 'd', id FROM entities WHERE state = 'closed' AND score_current <= 9""")
def f9(spark, sf):
    e, links = base.entities(spark, sf), base.entity_links(spark, sf)
    run = lambda n, **kw: filters.filter_entities(e, NOW, **kw).select(F.lit(n).alias("f"), "id")
    return (run("a", entity_type="ip", q="44.0.0.1", state="open").unionByName(run("b", server="srv4", severity="high"))
            .unionByName(run("c", incident_id=7, links=links, days=400)).unionByName(run("d", state="closed", severity="info")))


@check("f10_search_events", f"""{WITH_SEC} SELECT event_id FROM sec WHERE us BETWEEN {SINCE} AND {NOW_US} AND server = 'srv2' AND source = 'APACHE_ACCESS' AND strpos(event_type || ' ' || path, 'click /p/1') > 0""")
def f10(spark, sf):
    out = filters.search_events(base.events(spark, sf), start=datetime(2024, 1, 15), end=NOW, server="srv2", source="APACHE_ACCESS", service="HTTP", q=" Click /P/1 ")
    return out.select(F.col("id").alias("event_id"))


@check("f11_status_names", f"""{WITH_ALERTS} SELECT s, CASE WHEN s = 'Resolved' THEN 'closed' WHEN s = 'weird' THEN 'open' ELSE s END AS stored,
  CASE WHEN s = 'closed' THEN 'resolved' WHEN s = 'false_positive' THEN s ELSE 'open' END AS shown, count(*) AS n
  FROM (SELECT CASE WHEN k % 9 = 0 THEN 'Resolved' WHEN k % 9 = 1 THEN 'weird' ELSE status END AS s FROM alerts) GROUP BY ALL""")
def f11(spark, sf):
    df = alerts(spark, sf).select(F.expr("CASE WHEN k % 9 = 0 THEN 'Resolved' WHEN k % 9 = 1 THEN 'weird' ELSE status END").alias("s"))
    return df.groupBy("s", bands.stored_status(F.col("s")).alias("stored"), bands.shown_status(F.col("s")).alias("shown")).agg(F.count(F.lit(1)).alias("n"))


@check("f12_severity_bands", f"""{WITH_ALERTS} SELECT severity, CASE WHEN severity >= 25 THEN 'Crítica' WHEN severity >= 18 THEN 'Alta' WHEN severity >= 10 THEN 'Media' WHEN severity >= 4 THEN 'Baja' ELSE 'Info' END AS label,
  CASE WHEN severity >= 18 THEN 'high' WHEN severity >= 10 THEN 'medium' WHEN severity >= 4 THEN 'low' ELSE 'info' END AS level,
  CASE WHEN severity * 3 >= 61 THEN 'high' WHEN severity * 3 >= 31 THEN 'medium' ELSE 'low' END AS badge,
  CASE WHEN severity * 4 >= 85 THEN 'high' WHEN severity * 4 >= 60 THEN 'medium' ELSE 'low' END AS inc_level,
  {BAND.format('severity * 3')} AS entity_band, count(*) AS n FROM alerts GROUP BY ALL""")
def f12(spark, sf):
    s = F.col("severity")
    df = base.alerts_raw(spark, sf)
    return df.groupBy("severity", bands.alert_label(s).alias("label"), bands.alert_level(s).alias("level"), bands.score_badge(s * 3).alias("badge"),
                      bands.incident_level(s * 4).alias("inc_level"), entities.score_severity(s * 3).alias("entity_band")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- dashboards

RANGE = (datetime(2024, 1, 18, tzinfo=timezone.utc), NOW)
IN_RANGE = f"us BETWEEN {NOW_US - 7 * DAY} AND {NOW_US}"
KPI_ENT = """(SELECT count(DISTINCT e.id) FROM incidents i JOIN entity_links l ON l.incident_id = i.id JOIN entities e ON e.id = l.entity_id
  WHERE i.status IN ('open', 'triage', 'contained') AND e.score_current >= {0} {1})"""


@check("j4_incident_kpi_entities", f"{WITH_OPS} SELECT {KPI_ENT.format(30, '')} AS entities_risky, {KPI_ENT.format(80, '')} AS entities_critical")
def j4(spark, sf):
    return dashboards.incident_kpi_entities(base.incidents(spark, sf), base.entity_links(spark, sf), base.entities(spark, sf))


def _kpi_sql(server, sev):
    on = f"server = '{server}'" if server else "true"
    return f"""{WITH_OPS} SELECT
  (SELECT count(*) FROM alerts WHERE {IN_RANGE} AND {on} AND severity >= {sev}) AS alerts_total, (SELECT count(*) FROM alerts WHERE {IN_RANGE} AND {on} AND severity >= {sev} AND status = 'open') AS alerts_open,
  (SELECT count(*) FROM alerts WHERE {IN_RANGE} AND {on} AND severity >= greatest(15, {sev})) AS alerts_high_critical,
  (SELECT count(*) FROM incidents WHERE status IN ('open', 'triage', 'contained') AND {on}) AS incidents_active,
  (SELECT count(*) FROM incidents WHERE status IN ('open', 'triage', 'contained') AND {on} AND severity_current >= 90) AS incidents_critical,
  {KPI_ENT.format(30, 'AND i.' + on if server else '')} AS entities_risky, {KPI_ENT.format(80, 'AND i.' + on if server else '')} AS entities_critical,
  (SELECT count(*) FROM sec WHERE {IN_RANGE} AND {on}) AS events, (SELECT count(DISTINCT source) FROM sec WHERE {IN_RANGE} AND {on}) AS active_sources,
  (SELECT count(*) FROM uploads WHERE uploaded_us >= {NOW_US - DAY} AND {on}) AS uploads_24h, (SELECT count(*) FROM uploads WHERE uploaded_us >= {NOW_US - DAY} AND {on} AND status = 'error') AS uploads_failed_24h,
  (SELECT max(us) FROM alerts WHERE {on}) AS last_alert, (SELECT max(last_us) FROM incidents WHERE {on}) AS last_incident, (SELECT floor(({NOW_US} - max(us)) / 1000000)::BIGINT FROM sec WHERE {on}) AS lag_seconds"""


def _kpis(spark, sf, server, severity):
    out = dashboards.dashboard_kpis(alerts(spark, sf), base.incidents(spark, sf), base.entity_links(spark, sf), base.entities(spark, sf), base.events(spark, sf),
                                    base.uploads(spark, sf), *RANGE, NOW, server, severity)
    return out.withColumn("last_alert", F.unix_micros("last_alert_at")).withColumn("last_incident", F.unix_micros("last_incident_at")).drop("last_alert_at", "last_incident_at", "last_event_at")


@check("a5_dashboard_kpis", _kpi_sql(None, 0))
def a5(spark, sf):
    return _kpis(spark, sf, None, "all")


@check("a5_dashboard_kpis_server", _kpi_sql("srv1", 10))
def a5_server(spark, sf):
    return _kpis(spark, sf, "srv1", "high")


ACTIVITY = f"""act AS (SELECT us // {DAY} AS d, count(*) AS total, count_if(starts_with({CODE}, 'AUTH-')) AS bruteforce, count_if({CODE} IN ('WEB-001', 'WEB-002')) AS bots,
  count_if({CODE} = 'WEB-003') AS exploits, count_if({CODE} = 'WEB-005') AS wp, count_if(starts_with({CODE}, 'FILE-')) AS file, count_if(starts_with({CODE}, 'MAIL-')) AS mail,
  count_if({CODE} = 'AUTH-005') AS panel FROM alerts WHERE us BETWEEN {START_US} AND {START_US + 40 * DAY} AND server = 'srv3' AND {{0}} GROUP BY ALL)"""


@check("a6_alert_activity", f"{WITH_ALERTS}, {ACTIVITY.format('true')} SELECT strftime(make_timestamp(d * {DAY}), '%Y-%m-%d') AS day, act.* EXCLUDE (d) FROM act")
def a6(spark, sf):
    out = dashboards.alert_activity(alerts(spark, sf), START, datetime(2024, 2, 10), "srv3")
    return out.withColumn("day", F.col("day").cast("string"))


@check("a7_fill_missing_days", f"""{WITH_ALERTS}, {ACTIVITY.format('true')} SELECT strftime(make_timestamp((19723 + i) * {DAY}), '%Y-%m-%d') AS day, strftime(make_timestamp((19723 + i) * {DAY}), '%m-%d') AS label,
  {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in ('total', 'bruteforce', 'bots', 'exploits', 'wp', 'file', 'mail', 'panel'))} FROM range(41) r(i) LEFT JOIN act ON d = 19723 + i""")
def a7(spark, sf):
    act = dashboards.alert_activity(alerts(spark, sf), START, datetime(2024, 2, 10), "srv3")
    return dashboards.fill_missing_days(act, START, datetime(2024, 2, 10)).withColumn("day", F.col("day").cast("string"))


@check("a8_uploads_by_status", f"{WITH_OPS} SELECT status, count(*) AS n FROM uploads GROUP BY status")
def a8(spark, sf):
    return dashboards.uploads_by_status(base.uploads(spark, sf))


@check("a8_events_by_status", f"{WITH_OPS} SELECT engine_status, count(*) AS n FROM queue WHERE engine_status <> 'done' GROUP BY ALL")
def a8_events(spark, sf):
    return dashboards.events_by_status(base.queue(spark, sf))


@check("a9_pipeline_overview", f"""{WITH_OPS} SELECT (SELECT count(*) FROM alerts WHERE us >= {NOW_US - DAY}) AS alerts_24h, (SELECT count(*) FROM incidents WHERE opened_us >= {NOW_US - DAY}) AS incidents_24h,
  (SELECT min(uploaded_us) FROM uploads WHERE status = 'queued') AS oldest_queued, (SELECT min(us) FROM queue WHERE engine_status = 'pending') AS oldest_pending""")
def a9(spark, sf):
    a = alerts(spark, sf).withColumn("created_at", F.col("triggered_at"))
    out = dashboards.pipeline_overview(a, base.incidents(spark, sf), base.uploads(spark, sf), base.queue(spark, sf), NOW)
    return out.withColumn("oldest_queued", F.unix_micros("oldest_queued")).withColumn("oldest_pending", F.unix_micros("oldest_pending"))


@check("a10_alert_servers", f"{WITH_ALERTS} SELECT DISTINCT server FROM alerts")
def a10(spark, sf):
    return dashboards.alert_servers(alerts(spark, sf))


@check("a14_system_status", f"""{WITH_OPS}, x AS (SELECT (SELECT max(us) FROM sec WHERE us <= {NOW_US}) AS e, (SELECT max(us) FROM alerts WHERE us <= {NOW_US} - 1800000000) AS a,
    (SELECT max(last_us) FROM incidents WHERE last_us <= {NOW_US} - 30000000000) AS i, (SELECT count(*) FROM uploads WHERE uploaded_us >= {NOW_US - DAY}) AS n, (SELECT count(*) FROM uploads WHERE uploaded_us >= {NOW_US - DAY} AND status = 'error') AS bad),
  l AS (SELECT 'Ingesta (events)' AS component, ({NOW_US} - e) // 1000000 AS lag, 900 AS warn, 3600 AS crit FROM x UNION ALL SELECT 'Correlación (alerts)', ({NOW_US} - a) // 1000000, 900, 3600 FROM x
    UNION ALL SELECT 'Incidentes', ({NOW_US} - i) // 1000000, 3600, 21600 FROM x)
  SELECT component, CASE WHEN lag IS NULL THEN 'unknown' WHEN lag >= crit THEN 'error' WHEN lag >= warn THEN 'warning' ELSE 'ok' END AS status_code,
    CASE WHEN lag IS NULL THEN '—' WHEN lag < 60 THEN lag || 's' WHEN lag < 3600 THEN (lag // 60) || 'm' ELSE (lag // 3600) || 'h' END AS detail FROM l
  UNION ALL SELECT 'Uploads (24h)', CASE WHEN bad >= 10 THEN 'error' WHEN bad > 0 THEN 'warning' ELSE 'ok' END, n || ' / ' || bad FROM x""")
def a14(spark, sf):
    before = lambda df, c, gap: df.filter(F.unix_micros(c) <= NOW_US - gap)
    return dashboards.system_status(before(base.events(spark, sf), "timestamp_utc", 0), before(alerts(spark, sf), "triggered_at", 1800_000_000),
                                    before(base.incidents(spark, sf), "last_activity_at", 30000_000_000), base.uploads(spark, sf), NOW).drop("status")


@check("a15_entity_kpis", f"""{WITH_OPS}, r AS (SELECT *, CASE WHEN entity_type = 'ip' THEN CASE WHEN asn IS NOT NULL THEN 'AS' || asn || CASE WHEN id % 3 > 0 THEN ' Net' ELSE '' END WHEN id % 3 > 0 THEN 'Net' END END AS al,
    CASE WHEN entity_type = 'ip' AND cc IS NOT NULL THEN CASE WHEN id % 2 = 0 THEN 'Land ' || cc || ' (' || upper(cc) || ')' ELSE upper(cc) END END AS cl FROM entities),
  ta AS (SELECT al, count(*) AS n FROM r WHERE al IS NOT NULL GROUP BY al ORDER BY n DESC, min((-score_current, entity_key)) LIMIT 1),
  tc AS (SELECT cl, count(*) AS n FROM r WHERE cl IS NOT NULL GROUP BY cl ORDER BY n DESC, min((-score_current, entity_key)) LIMIT 1)
  SELECT count(*) AS total, arg_min(entity_key || ' (' || entity_type || ')', (-score_current, entity_key)) AS top, count_if(coalesce(state, 'x') <> 'closed') AS open, count_if(state = 'closed') AS closed,
    (SELECT al FROM ta) AS top_asn, (SELECT n FROM ta) AS top_asn_count, (SELECT cl FROM tc) AS top_country, (SELECT n FROM tc) AS top_country_count FROM r""")
def a15(spark, sf):
    return dashboards.entity_kpis(base.entities(spark, sf))


@check("l1_top_entities", f"{WITH_OPS} SELECT id, entity_key, score_current FROM entities WHERE entity_type = 'ip' ORDER BY score_current DESC, updated_us DESC, entity_key LIMIT 4")
def l1(spark, sf):
    return dashboards.top_entities(base.entities(spark, sf)).select("id", "entity_key", "score_current")


@check("l2_recent_incidents", f"""{WITH_OPS} SELECT id, CASE WHEN severity_current >= 85 THEN 'high' WHEN severity_current >= 60 THEN 'medium' ELSE 'low' END AS level, code || ' · ' || name AS type, last_us
  FROM incidents WHERE status = 'open' AND last_us >= {NOW_US - 7 * DAY} ORDER BY last_us DESC, id LIMIT 10 OFFSET 3""")
def l2(spark, sf):
    out = dashboards.recent_incidents(base.incidents(spark, sf), NOW, limit=10, offset=3)
    return out.select("id", "level", "type", F.unix_micros("last_activity_at").alias("last_us"))


@check("l3_page", f"{WITH_ALERTS} SELECT id, us, (SELECT count(*) FROM alerts) AS total FROM alerts ORDER BY us DESC, id DESC LIMIT 50 OFFSET 100")
def l3(spark, sf):
    a = alerts(spark, sf)
    rows = filters.page(a, [F.desc("triggered_at"), F.desc("id")], 50, 100)
    return rows.select("id", "us", a.agg(F.count(F.lit(1))).scalar().alias("total"))


@check("l4_operational_tops", f"""{WITH_OPS} SELECT * FROM (SELECT 'pending_uploads' AS list, id FROM uploads WHERE status IN ('queued', 'parsing', 'parsed', 'processing_engine') ORDER BY uploaded_us, id LIMIT 50)
  UNION ALL SELECT * FROM (SELECT 'error_uploads', id FROM uploads WHERE status = 'error' ORDER BY uploaded_us DESC, id LIMIT 30)
  UNION ALL SELECT * FROM (SELECT 'pending_events', id FROM queue WHERE engine_status <> 'done' ORDER BY us, id LIMIT 80)""")
def l4(spark, sf):
    tops = dashboards.operational_tops(base.uploads(spark, sf), base.queue(spark, sf))
    parts = [df.select(F.lit(n).alias("list"), "id") for n, df in tops.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@check("j6_incident_detail", f"""{WITH_OPS} SELECT 'incident' AS what, i.id AS incident_id, i.id, CASE WHEN score >= 61 THEN 'high' WHEN score >= 31 THEN 'medium' ELSE 'low' END AS label,
  (SELECT count(*) FROM alert_links l JOIN alerts a ON a.id = l.alert_id WHERE l.incident_id = i.id AND a.status IN ('open', 'triage')) AS open_alerts,
  (SELECT count(*) FROM entity_links l JOIN entities e ON e.id = l.entity_id WHERE l.incident_id = i.id AND coalesce(e.state, 'x') <> 'closed') AS open_entities FROM incidents i
  UNION ALL SELECT 'alert', l.incident_id, a.id, CASE a.status WHEN 'closed' THEN 'resolved' WHEN 'false_positive' THEN a.status ELSE 'open' END, NULL, NULL FROM alert_links l JOIN alerts a ON a.id = l.alert_id
  UNION ALL SELECT 'entity', l.incident_id, e.id, CASE WHEN e.state = 'closed' THEN 'closed' ELSE 'open' END || ':' || coalesce(l.relation, 'related'), NULL, NULL FROM entity_links l JOIN entities e ON e.id = l.entity_id""")
def j6(spark, sf):
    out = dashboards.incident_detail(base.incidents(spark, sf), base.alert_links(spark, sf), alerts(spark, sf), base.entity_links(spark, sf), base.entities(spark, sf))
    head = out["incidents"].select(F.lit("incident").alias("what"), F.col("id").alias("incident_id"), "id", F.col("badge").alias("label"), "open_alerts", "open_entities")
    al = out["alerts"].select(F.lit("alert").alias("what"), "incident_id", "id", F.col("status").alias("label"))
    en = out["entities"].select(F.lit("entity").alias("what"), "incident_id", "id", F.concat_ws(":", "state", "relation").alias("label"))
    return head.unionByName(al, allowMissingColumns=True).unionByName(en, allowMissingColumns=True)


@check("j9_uploads_fully_processed", f"{WITH_OPS} SELECT id FROM uploads WHERE status = 'processing_engine' AND id NOT IN (SELECT log_upload_id FROM queue WHERE engine_status IN ('pending', 'processing'))")
def j9(spark, sf):
    return dashboards.uploads_fully_processed(base.uploads(spark, sf), base.queue(spark, sf)).select("id")


@check("j10_notify_owner", f"""{WITH_OPS}, near AS (SELECT a.id AS alert_id, arg_max(q.log_upload_id, (q.us, q.id)) AS up FROM alerts a LEFT JOIN queue q ON q.server = a.server AND q.us BETWEEN a.us - 7200000000 AND a.us + 7200000000 GROUP BY a.id)
  SELECT alert_id, coalesce(CASE WHEN alert_id % 9 = 0 THEN 777 END, u.user_id, k.created_by_user_id) AS user_id FROM near LEFT JOIN uploads u ON u.id = up LEFT JOIN api_keys k ON k.id = u.api_key_id""")
def j10(spark, sf):
    named = alerts(spark, sf).withColumn("metrics", F.expr("named_struct('user_id', CASE WHEN id % 9 = 0 THEN 777 END)"))
    return lifecycle.notify_owner(named, base.queue(spark, sf), base.uploads(spark, sf), base.api_keys(spark, sf))


# ---------------------------------------------------------------- state changes

CHOSEN = "k % 4 = 0 AND server = 'srv2'"


@check("u5_close_alerts", f"""{WITH_ALERTS} SELECT id, CASE WHEN {CHOSEN} THEN 'closed' ELSE status END AS status, CASE WHEN {CHOSEN} THEN 'benign' END AS disposition,
  CASE WHEN {CHOSEN} THEN {NOW_US} END::BIGINT AS resolved FROM alerts""")
def u5(spark, sf):
    out = lifecycle.close_alerts(alerts(spark, sf), F.expr(CHOSEN), "resolved", NOW, " benign ", "")
    return out.select("id", "status", "disposition", F.unix_micros("resolved_at").alias("resolved"))


def _close(spark, sf, cascade):
    few = alerts(spark, sf).withColumn("status", F.expr("CASE WHEN user_id % 4 > 0 THEN 'closed' ELSE status END"))
    ents = base.entities(spark, sf)
    ents = ents.withColumn("attrs", F.col("attrs").withField("state", F.expr("CASE WHEN id % 9 > 0 THEN 'closed' ELSE 'open' END")))
    return lifecycle.close_incidents(base.incidents(spark, sf), F.col("server").isin("srv1", "srv4", "srv5"), "resolved", NOW, "ana", base.alert_links(spark, sf), few, base.entity_links(spark, sf), ents, cascade)


FEW = f"""{WITH_OPS}, open_a AS (SELECT l.incident_id, count(*) AS n FROM alert_links l JOIN alerts a ON a.id = l.alert_id WHERE a.user_id % 4 = 0 AND a.status IN ('open', 'triage') GROUP BY ALL),
  open_e AS (SELECT incident_id, count(*) AS n FROM entity_links WHERE entity_id % 9 = 0 AND entity_id IN (SELECT id FROM entities) GROUP BY ALL),
  o AS (SELECT i.*, server IN ('srv1', 'srv4', 'srv5') AS hit, coalesce(a.n, 0) AS oa, coalesce(e.n, 0) AS oe FROM incidents i LEFT JOIN open_a a ON a.incident_id = i.id LEFT JOIN open_e e ON e.incident_id = i.id)"""


@check("u6_close_incident", f"""{FEW} SELECT id, (hit AND oa + oe > 0)::BIGINT AS blocked, CASE WHEN hit THEN CASE WHEN oa + oe > 0 THEN 'open' ELSE 'closed' END ELSE status END AS status,
  CASE WHEN hit AND oa + oe = 0 THEN 'ana' END AS resolved_by, oa AS open_alerts, oe AS open_entities FROM o""")
def u6(spark, sf):
    out, _, _ = _close(spark, sf, False)
    return out.select("id", F.col("blocked").cast("bigint").alias("blocked"), "status", "resolved_by", "open_alerts", "open_entities")


@check("u6_close_incident_cascade", f"""{FEW} SELECT 'incident' AS what, id, CASE WHEN hit THEN 'closed' ELSE status END AS status FROM o
  UNION ALL SELECT 'alert', id, CASE WHEN id IN (SELECT alert_id FROM alert_links JOIN o ON o.id = incident_id WHERE hit) OR user_id % 4 > 0 THEN 'closed' ELSE status END FROM alerts
  UNION ALL SELECT 'entity', id, CASE WHEN id IN (SELECT entity_id FROM entity_links JOIN o ON o.id = incident_id WHERE hit) OR id % 9 > 0 THEN 'closed' ELSE 'open' END FROM entities""")
def u6_cascade(spark, sf):
    inc, al, en = _close(spark, sf, True)
    pick = lambda w, df, c: df.select(F.lit(w).alias("what"), "id", F.col(c).alias("status"))
    return pick("incident", inc, "status").unionByName(pick("alert", al, "status")).unionByName(pick("entity", en, "attrs.state"))


@check("u7_set_entity_state", f"""{WITH_OPS} SELECT id, CASE WHEN server = 'srv1' THEN 'closed' ELSE state END AS state, CASE WHEN server = 'srv1' THEN 'ana' END AS closed_by FROM entities""")
def u7(spark, sf):
    out = lifecycle.set_entity_state(base.entities(spark, sf), F.col("attrs.server") == "srv1", "closed", NOW, "ana")
    return out.select("id", F.col("attrs.state").alias("state"), F.col("attrs.closed_by").alias("closed_by"))


PREFS = "SELECT DISTINCT user_id, user_id % 2 = 0 AS high, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 3 = 1 END AS medium, true AS low, CASE WHEN user_id % 5 > 0 THEN concat(' u', CAST(user_id AS STRING), '@example.com') END AS to_email FROM sec"


@check("r6_route_notifications", f"""{WITH_OPS}, prefs AS ({PREFS}), items AS (SELECT 'alert' AS what, id, user_id, CASE WHEN severity >= 18 THEN 'high' WHEN severity >= 10 THEN 'medium' ELSE 'low' END AS bucket FROM alerts
    UNION ALL SELECT 'incident', id, id - 1, CASE WHEN score >= 61 THEN 'high' WHEN score >= 31 THEN 'medium' ELSE 'low' END FROM incidents)
  SELECT what, id, items.user_id, bucket, trim(to_email) AS to_email FROM items JOIN prefs ON prefs.user_id = items.user_id
  WHERE to_email IS NOT NULL AND coalesce(CASE bucket WHEN 'high' THEN high WHEN 'medium' THEN medium ELSE low END, true)""")
def r6(spark, sf):
    prefs = base._derive(spark, sf, PREFS)
    a = alerts(spark, sf).select(F.lit("alert").alias("what"), "id", "user_id", "severity")
    i = base.incidents(spark, sf).select(F.lit("incident").alias("what"), "id", (F.col("id") - 1).alias("user_id"), "score")
    cols = ["what", "id", "user_id", "bucket", "to_email"]
    return lifecycle.route_notifications(a, prefs, lifecycle.alert_bucket(F.col("severity"))).select(*cols).unionByName(
        lifecycle.route_notifications(i, prefs, lifecycle.incident_bucket(F.col("score"))).select(*cols))


@check("s8_export_tables", f"""{WITH_OPS} SELECT 'events' AS name, event_id AS id FROM sec WHERE us >= {SINCE} UNION ALL SELECT 'alerts', id FROM alerts WHERE us >= {SINCE} AND status IN ('open', 'closed') AND CASE WHEN k % 2 = 0 THEN 'benign' END = 'benign'
  UNION ALL SELECT 'incidents', id FROM incidents WHERE last_us >= {SINCE} AND status IN ('open', 'closed') UNION ALL SELECT 'entities', id FROM entities WHERE updated_us >= {SINCE}""")
def s8(spark, sf):
    a = alerts(spark, sf).withColumn("disposition", F.expr("CASE WHEN k % 2 = 0 THEN 'benign' END"))
    tables = {"events": base.events(spark, sf), "alerts": a, "incidents": base.incidents(spark, sf), "entities": base.entities(spark, sf)}
    out = src.export_tables(tables, F.lit(datetime(2024, 1, 15, tzinfo=timezone.utc)), {"alerts": ["benign"]}, ["open", "closed"])
    parts = [df.select(F.lit(n).alias("name"), "id") for n, df in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@check("s9_incremental_alerts", f"""{WITH_ALERTS} SELECT 'cursor' AS mode, id FROM alerts WHERE id > 9000 UNION ALL SELECT 'time', id FROM alerts WHERE id >= (SELECT min(id) FROM alerts WHERE us >= {NOW_US})
  UNION ALL SELECT 'id', id FROM alerts WHERE id > 9900""")
def s9(spark, sf):
    a = alerts(spark, sf)
    run = lambda n, **kw: src.incremental_alerts(a, **kw).select(F.lit(n).alias("mode"), "id")
    return run("cursor", last_id=9000).unionByName(run("time", from_ts=F.lit(NOW))).unionByName(run("id", from_ts=F.lit(NOW), from_id=9900))
