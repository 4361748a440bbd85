"""Alerts to incidents: match, tick windows, condition, cooldown, one incident per (code, primary entity)."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.fields import group_key, text, truthy
from tidewatch.functions.times import _utc
from tidewatch.operators.cooldown import apply_cooldown
from tidewatch.operators.ruleindex import literal
from tidewatch.operators.rules import INCIDENT_CONDITION_NAMES, condition_error, rule_condition
from tidewatch.operators.staging import staged

OPEN_STATES = ["open", "triage", "contained"]
KEYS = ["rule_id", "group_key"]


@dataclass(frozen=True)
class IncidentRule:
    id: int
    code: str
    name: str
    primary_entity_type: str
    primary_entity_field: str
    match: dict = field(default_factory=dict)
    group_by: list[str] = field(default_factory=list)
    condition: str = ""
    scope: str = "local"
    severity_base: int = 10
    score_bonus: int = 0
    window_seconds: int = 1800
    cooldown_seconds: int = 3600
    enabled: bool = True

    @property
    def fields(self) -> list[str]:
        if self.group_by:
            return list(self.group_by)
        return ["server"] + ([self.primary_entity_field] if self.primary_entity_field else [])

    @property
    def score(self) -> int:
        return max(0, min(100, self.severity_base + self.score_bonus))


# The seeded correlation rules.
def seeded_rules() -> list[IncidentRule]:
    return [
        IncidentRule(
            id=1, code="INC-ACC-01", name="Account Compromise", scope="global", severity_base=85, score_bonus=20,
            window_seconds=3600, cooldown_seconds=21600, primary_entity_type="user", primary_entity_field="username",
            group_by=["server", "username"], condition="count >= 1",
            match={"alert_codes_any": ["AUTH-003", "AUTH-005", "MAIL-002", "MULTI-002"]},
        ),
        IncidentRule(
            id=2, code="INC-ACC-02", name="Privileged Account Compromise", scope="global", severity_base=95, score_bonus=35,
            window_seconds=21600, cooldown_seconds=86400, primary_entity_type="user", primary_entity_field="username",
            group_by=["server", "username"], condition="count >= 1",
            match={"alert_codes_any": ["AUTH-006", "SYS-001"]},
        ),
        IncidentRule(
            id=3, code="INC-WEB-01", name="Web Attack", scope="local", severity_base=60, score_bonus=10,
            window_seconds=900, cooldown_seconds=1800, primary_entity_type="ip", primary_entity_field="ip_client",
            group_by=["server", "ip_client"], condition="count >= 2 or max_severity >= 15",
            match={"alert_codes_any": ["WEB-001", "WEB-002", "WEB-003", "WEB-004", "WEB-006"]},
        ),
        IncidentRule(
            id=4, code="INC-WEB-02", name="Webshell / Malware Upload", scope="local", severity_base=95, score_bonus=35,
            window_seconds=21600, cooldown_seconds=21600, primary_entity_type="host", primary_entity_field="server",
            group_by=["server"], condition="count >= 1",
            match={"alert_codes_any": ["FILE-001", "FILE-003", "FILE-004"]},
        ),
        IncidentRule(
            id=5, code="INC-WP-01", name="WordPress Compromise", scope="local", severity_base=85, score_bonus=15,
            window_seconds=21600, cooldown_seconds=21600, primary_entity_type="host", primary_entity_field="extra.vhost",
            group_by=["server", "extra.vhost"], condition="count >= 1 and (unique_alerts >= 2 or max_severity >= 20)",
            match={"alert_codes_any": ["FILE-002", "WEB-002", "WEB-005", "FILE-001"]},
        ),
        IncidentRule(
            id=6, code="INC-MAIL-01", name="Mail Abuse / Spam", scope="global", severity_base=95, score_bonus=25,
            window_seconds=7200, cooldown_seconds=21600, primary_entity_type="host", primary_entity_field="server",
            group_by=["server"], condition="count >= 1",
            match={"alert_codes_any": ["MAIL-002", "MAIL-003", "MAIL-004"]},
        ),
        IncidentRule(
            id=7, code="INC-SYS-01", name="SSH Compromise", scope="local", severity_base=95, score_bonus=30,
            window_seconds=3600, cooldown_seconds=21600, primary_entity_type="host", primary_entity_field="server",
            group_by=["server"], condition="count >= 1 and unique_alerts >= 2",
            match={"alert_codes_any": ["SYS-001", "SYS-002"]},
        ),
        IncidentRule(
            id=8, code="INC-SYS-02", name="System Persistence Detected", scope="local", severity_base=95, score_bonus=30,
            window_seconds=28800, cooldown_seconds=28800, primary_entity_type="host", primary_entity_field="server",
            group_by=["server"], condition="count >= 1",
            match={"alert_codes_any": ["SYS-003", "FILE-003"]},
        ),
        IncidentRule(
            id=9, code="INC-GLOB-01", name="Distributed Attack", scope="global", severity_base=95, score_bonus=25,
            window_seconds=1800, cooldown_seconds=1800, primary_entity_type="ip", primary_entity_field="ip_client",
            group_by=["ip_client"], condition="count >= 1",
            match={"alert_codes_any": ["MULTI-001", "WEB-008"]},
        ),
        IncidentRule(
            id=10, code="INC-GLOB-02", name="Credential Stuffing Campaign", scope="global", severity_base=85, score_bonus=20,
            window_seconds=3600, cooldown_seconds=3600, primary_entity_type="user", primary_entity_field="username",
            group_by=["username"], condition="count >= 1",
            match={"alert_codes_any": ["AUTH-002", "MULTI-002"]},
        ),
        IncidentRule(
            id=11, code="INC-GLOB-03", name="DDoS Campaign", scope="global", severity_base=95, score_bonus=20,
            window_seconds=900, cooldown_seconds=1800, primary_entity_type="asn", primary_entity_field="extra.asn.number",
            group_by=["extra.asn.number"], condition="count >= 1 and (unique_servers >= 2 or max_severity >= 15)",
            match={"alert_codes_any": ["WEB-006", "WEB-008", "WEB-009", "WEB-012", "MULTI-003"]},
        ),
        IncidentRule(
            id=12, code="INC-GLOB-04", name="Suspected DDoS Impact", scope="global", severity_base=85, score_bonus=15,
            window_seconds=1800, cooldown_seconds=3600, primary_entity_type="host", primary_entity_field="server",
            group_by=["server"], condition="count >= 2",
            match={"alert_codes_any": ["RES-001", "RES-002", "DB-002", "WEB-006", "WEB-008", "WEB-009", "WEB-012", "MULTI-003"]},
        ),
        IncidentRule(
            id=13, code="INC-LFD-01", name="LFD Attack + Resource Impact", scope="local", severity_base=80, score_bonus=15,
            window_seconds=900, cooldown_seconds=3600, primary_entity_type="host", primary_entity_field="server",
            group_by=["server"], condition="count >= 2 and unique_alerts >= 2",
            match={"alert_codes_any": ["LFD-001", "LFD-002", "LFD-003", "LFD-004", "LFD-007", "LFD-008", "RES-001", "RES-002"]},
        ),
        IncidentRule(
            id=14, code="INC-LFD-02", name="Distributed LFD Campaign + Multi-Host Impact", scope="global", severity_base=90, score_bonus=20,
            window_seconds=1800, cooldown_seconds=7200, primary_entity_type="asn", primary_entity_field="extra.asn.number",
            group_by=["extra.asn.number"], condition="count >= 2 and unique_servers >= 2 and unique_alerts >= 2",
            match={"alert_codes_any": ["LFD-003", "LFD-005", "LFD-006", "RES-001", "RES-002"]},
        ),
    ]


def _listed(m: dict, key: str) -> list[str]:
    v = m.get(key)
    return [str(x).strip() for x in (v if isinstance(v, list) else [] if v is None else [v]) if str(x).strip()]


SEPARATORS = ["", " ", "\t", "-", ":"]


def rules_by_code(rules: list[IncidentRule]) -> Column:
    """Ids of the rules whose codes (if they ask for any) the alert's name begins with.

    A code ends where the name does or at a separator, so each length that codes have costs one look-up, however many rules and codes there are.
    """
    name, by_length = F.trim(text(F.col("rule_name"))), {}
    for r in rules:
        for code in dict.fromkeys(_listed(r.match, "alert_codes_any")):
            by_length.setdefault(len(code), {}).setdefault(code, []).append(r.id)
    found = [literal([r.id for r in rules if "alert_codes_any" not in r.match], "array<int>")]
    for length, ids in sorted(by_length.items()):
        held = F.try_element_at(literal(ids, "map<string,array<int>>"), name.substr(1, length))
        found.append(F.when(name.substr(length + 1, 1).isin(SEPARATORS), held))
    return F.array_distinct(F.flatten(F.array_compact(F.array(*found))))


def incident_match(match: dict) -> Column | None:
    """What else a rule asks of an alert: any of the names, a severity floor, any of the servers; nothing is None."""
    tests = []
    if "alert_names_any" in match:
        names = _listed(match, "alert_names_any")
        tests.append(F.trim(text(F.col("rule_name"))).isin(names) if names else F.lit(False))
    if "min_severity" in match:
        try:
            floor = int(match["min_severity"])
        except (TypeError, ValueError):
            floor = 0
        tests.append(F.coalesce(F.col("severity"), F.lit(0)) >= floor)
    if _listed(match, "server_any"):
        tests.append(F.trim(text(F.col("server"))).isin(_listed(match, "server_any")))
    return reduce(lambda a, b: a & b, tests) if tests else None


def alerts_to_rules(alerts: DataFrame, rules: list[IncidentRule]) -> DataFrame:
    """One row per (alert, matching rule) with its group key and primary entity."""
    met = alerts.select("id", "rule_name", "server", "severity", "triggered_at", "evidence.group_values", F.explode(rules_by_code(rules)).alias("rule_id"))
    asks = F.lit(True)
    for r in rules:
        test = incident_match(r.match)
        if test is not None:
            asks = F.when(F.col("rule_id") == r.id, test).otherwise(asks)
    value = lambda path: F.try_element_at("group_values", F.lit(path))

    def of_fields(field, column) -> Column:
        """The column that the row's rule asks for; rules with the same fields share it."""
        same: dict = {}
        for r in rules:
            same.setdefault(field(r), []).append(r.id)
        return F.coalesce(*[F.when(F.col("rule_id").isin(ids), column(f)) for f, ids in same.items()], F.lit(None).cast("string"))

    return met.filter(asks).select(
        "id", F.coalesce(F.nullif(F.trim("rule_name"), F.lit("")), F.lit("-")).alias("alert_name"),
        F.coalesce(F.nullif(F.trim("server"), F.lit("")), F.lit("-")).alias("alert_server"),
        F.coalesce(F.col("severity"), F.lit(0)).cast("bigint").alias("severity"),
        F.unix_micros("triggered_at").alias("ts"),
        F.trim(value("server")).alias("server"), F.to_json("group_values").alias("group_json"), "rule_id",
        of_fields(lambda r: tuple(r.fields), lambda fs: group_key([value(f) for f in fs], empty_is_missing=True)).alias("group_key"),
        of_fields(lambda r: r.primary_entity_field, lambda f: F.trim(value(f))).alias("primary"),
    )


def _by_rule(rules: list[IncidentRule], value) -> Column:
    out = F.lit(None)
    for r in rules:
        out = F.when(F.col("rule_id") == r.id, F.lit(value(r))).otherwise(out)
    return out


def incident_metrics(hits: DataFrame, rules: list[IncidentRule], start: datetime, end: datetime, step_seconds: int) -> DataFrame:
    """Window totals per (rule, group, tick); tick t covers alerts in [t - window, t].

    Alerts are first summed per stretch of ticks they belong to, name and server; only those sums are
    copied to the ticks, so a busy group costs its ticks and not its alerts.
    """
    t0, t1 = (int(_utc(d).timestamp() * 1_000_000) for d in (start, end))
    step = step_seconds * 1_000_000
    window = _by_rule(rules, lambda r: r.window_seconds * 1_000_000).cast("bigint")
    spans = (
        hits.withColumn("w", window)
        .withColumn("first_tick", F.greatest(F.lit(0), F.expr(f"CAST(ceil((ts - {t0}) / {step}) AS BIGINT)")))
        .withColumn("last_tick", F.least(F.lit((t1 - t0) // step), F.expr(f"(ts + w - {t0}) div {step}")))
        .filter(F.expr(f"ts + w >= {t0} AND first_tick <= last_tick"))
        .groupBy(*KEYS, "first_tick", "last_tick", "alert_name", "alert_server")
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum("severity").alias("sum_severity"), F.max("severity").alias("max_severity"),
            F.min(F.struct("ts", "id", "server", "primary", "group_json")).alias("first"), F.max("ts").alias("last_ts"),
        )
    )
    return (
        spans.withColumn("tick", F.explode(F.sequence("first_tick", "last_tick")))
        .groupBy(*KEYS, "tick")
        .agg(
            F.sum("n").alias("count"),
            # as sets: distinct counts of two columns would copy every row for each
            F.size(F.collect_set("alert_name")).cast("bigint").alias("unique_alerts"),
            F.size(F.collect_set("alert_server")).cast("bigint").alias("unique_servers"),
            F.max("max_severity").alias("max_severity"), F.sum("sum_severity").alias("sum_severity"),
            F.min("first").alias("first"), F.max("last_ts").alias("last_ts"),
        )
        .select(
            *KEYS, (F.col("tick") * step + t0).alias("tick_ts"), "count", "unique_alerts", "unique_servers",
            "max_severity", "sum_severity", F.col("first.ts").alias("first_ts"), "last_ts",
            F.col("first.server").alias("server"), F.col("first.primary").alias("primary"), F.col("first.group_json").alias("group_json"),
        )
    )


def incident_firings(
    alerts: DataFrame, rules: list[IncidentRule], start: datetime, end: datetime | None = None, step_seconds: int = 300,
    last: DataFrame | None = None,
) -> DataFrame:
    """Ticks at which a rule fires for a group: condition true, primary entity known, not in cooldown.

    `last` (rule_id, group_key, fired_ts) are the last firings of earlier runs.
    """
    rules = [r for r in rules if r.enabled and not condition_error(r.condition, INCIDENT_CONDITION_NAMES)]
    totals = incident_metrics(alerts_to_rules(alerts, rules), rules, start, end or start, step_seconds).withColumn(
        "window_seconds", _by_rule(rules, lambda r: r.window_seconds)
    )
    holds = F.lit(False)
    for r in rules:
        holds = F.when(F.col("rule_id") == r.id, rule_condition(r.condition)).otherwise(holds)
    ready = totals.filter(holds & truthy(F.col("primary") != "")).withColumn(
        "cooldown", _by_rule(rules, lambda r: r.cooldown_seconds * 1_000_000).cast("bigint")
    )
    if last is not None:
        free = F.col("fired_ts").isNull() | (F.col("tick_ts") >= F.col("fired_ts") + F.col("cooldown"))
        ready = ready.join(last.select(*KEYS, "fired_ts"), KEYS, "left").filter(free).drop("fired_ts")
    return apply_cooldown(staged(ready, "ready"), KEYS, "tick_ts", "tick_ts", "cooldown").drop("cooldown")


def described(firings: DataFrame, rules: list[IncidentRule]) -> DataFrame:
    return firings.select(
        "*",
        *[_by_rule(rules, lambda r, a=a: getattr(r, a)).alias(n) for a, n in (
            ("code", "code"), ("name", "name"), ("scope", "scope"), ("severity_base", "severity_base"),
            ("score", "rule_score"), ("primary_entity_type", "primary_entity_type"),
        )],
    )


def upsert_incidents(firings: DataFrame, rules: list[IncidentRule], existing: DataFrame | None = None) -> DataFrame:
    """Incidents after a run. All firings of one (code, primary entity) meet in one incident.

    The first firing opens it (or finds the latest open one of `existing`); later ones extend activity,
    severity, score and count. The alert ids are the links: an incident may hold too many for one row. `evidence` says which rule and
    window opened it, grouped by what, with which values; `incident_metrics_row` gives its numbers as one value.
    """
    key = ["code", "primary_entity_type", "primary_entity_key"]
    rows = described(firings, rules).withColumnRenamed("primary", "primary_entity_key")
    order = F.struct("tick_ts", "rule_id", "first_ts", "group_key")
    first_of = lambda c: F.min_by(c, order)
    new = rows.groupBy(*key).agg(
        first_of("name").alias("name"), first_of("scope").alias("scope"), first_of("server").alias("server"),
        first_of("first_ts").alias("opened_us"), F.max("last_ts").alias("last_us"),
        F.max("severity_base").alias("severity_current"), first_of("severity_base").alias("severity_base"),
        F.max("rule_score").alias("score"), F.sum("count").alias("count"),
        first_of("unique_alerts").alias("unique_alerts"), first_of("unique_servers").alias("unique_servers"),
        F.max("max_severity").alias("max_severity"), first_of("sum_severity").alias("sum_severity"),
        first_of("window_seconds").alias("window_seconds"), first_of("group_key").alias("group_key"),
        first_of(F.struct(
            "rule_id", F.coalesce(*[F.when(F.col("rule_id") == r.id, F.array(*map(F.lit, r.fields))) for r in rules]).alias("group_by"),
            F.from_json("group_json", "map<string,string>").alias("group_values"),
            F.timestamp_micros("first_ts").alias("window_start"), F.timestamp_micros("last_ts").alias("window_end"),
        )).alias("evidence"),
    )
    if existing is None:
        return new.select(
            *key, "name", "scope", F.lit("open").alias("status"), "severity_base", "severity_current", "score", "server",
            "opened_us", "last_us", "count", "unique_alerts", "unique_servers", "max_severity", "sum_severity",
            "window_seconds", "group_key", "evidence",
        )
    if "evidence" not in existing.columns:
        existing = existing.withColumn("evidence", F.lit(None).cast(new.schema["evidence"].dataType))
    is_open = F.col("status").isin(OPEN_STATES)
    open_rows = latest_open(existing.filter(is_open))
    untouched = existing.join(open_rows.select("id"), "id", "left_anti")
    n = new.select(*key, *[F.col(c).alias(f"n_{c}") for c in new.columns if c not in key])
    merged = open_rows.join(n, key, "full_outer")
    known = F.col("id").isNotNull()

    def keep(c):
        return F.coalesce(F.col(c), F.col(f"n_{c}")).alias(c)

    merged = merged.select(
        "id", *key, keep("name"), keep("scope"), F.coalesce("status", F.lit("open")).alias("status"),
        keep("severity_base"), F.greatest("severity_current", "n_severity_current").alias("severity_current"),
        F.greatest("score", "n_score").alias("score"),
        F.when(known, F.col("server")).otherwise(F.col("n_server")).alias("server"), keep("opened_us"),
        F.greatest("last_us", "n_last_us").alias("last_us"),
        (F.coalesce("count", F.lit(0)) + F.coalesce("n_count", F.lit(0))).alias("count"),
        keep("unique_alerts"), keep("unique_servers"), F.greatest("max_severity", "n_max_severity").alias("max_severity"),
        keep("sum_severity"), keep("window_seconds"), keep("group_key"), keep("evidence"),
    )
    return merged.unionByName(untouched.select(*merged.columns))


def incident_metrics_row() -> Column:
    """The numbers of an incident, with the end of the last window that added to it."""
    return F.struct(
        "count", "unique_alerts", "unique_servers", "max_severity", "sum_severity", "window_seconds", "group_key", F.timestamp_micros("last_us").alias("last_window_end")
    )


def latest_open(open_incidents: DataFrame) -> DataFrame:
    """The most recently opened of the open incidents of each (code, primary entity)."""
    key = ["code", "primary_entity_type", "primary_entity_key"]
    best = open_incidents.groupBy(*key).agg(F.max_by("id", F.struct("opened_us", "id")).alias("id"))
    return open_incidents.join(best.select("id"), "id", "left_semi")


def find_open_incident(wanted: DataFrame, incidents: DataFrame) -> DataFrame:
    """For each wanted (code, primary entity) the id of its latest open incident, null if there is none."""
    key = ["code", "primary_entity_type", "primary_entity_key"]
    is_open = incidents.filter(F.col("status").isin(OPEN_STATES))
    best = is_open.groupBy(*key).agg(F.max_by("id", F.struct("opened_us", "id")).alias("incident_id"))
    return wanted.join(best, key, "left")


def merge_evidence_ids(old: Column, new: Column) -> Column:
    """Sorted union of two id arrays, for evidence kept as arrays; whole incidents merge their link rows instead."""
    empty = F.array().cast("array<bigint>")
    return F.array_sort(F.array_union(F.coalesce(old, empty), F.coalesce(new, empty)))


def incident_links(firings: DataFrame, alerts: DataFrame, rules: list[IncidentRule]) -> DataFrame:
    """Alerts inside the windows of the firings, by incident key. Role is always supporting."""
    key = ["code", "primary_entity_type", "primary_entity_key"]
    width = _by_rule(rules, lambda r: r.window_seconds * 1_000_000).cast("bigint")
    fired = described(firings, rules).select(
        *KEYS, F.col("primary").alias("primary_entity_key"), "code", "primary_entity_type",
        F.col("tick_ts").alias("hi"), (F.col("tick_ts") - F.col("window_seconds").cast("bigint") * 1_000_000).alias("lo"),
    ).withColumn("w", F.col("hi") - F.col("lo")).withColumn("stretch", F.explode(F.expr("sequence(lo div w, hi div w)"))).drop("w")
    hits = alerts_to_rules(alerts, rules).select(
        *KEYS, F.col("id").alias("alert_id"), "ts", width.alias("w")
    ).withColumn("stretch", F.expr("ts div w")).drop("w")
    return (
        hits.join(fired, [*KEYS, "stretch"]).filter("ts BETWEEN lo AND hi")
        .select(*key, "alert_id", F.lit("supporting").alias("role")).dropDuplicates()
    )


def unseen_links(links: DataFrame, existing: DataFrame, on: list[str]) -> DataFrame:
    """Those of `links` that are not among the existing ones."""
    return links.join(existing, on, "left_anti")


def new_links_only(links: DataFrame, existing: DataFrame, on: list[str]) -> DataFrame:
    """Existing links and those of `links` not among them."""
    return existing.unionByName(unseen_links(links, existing, on))


class IncidentRun(NamedTuple):
    incidents: DataFrame
    links: DataFrame
    last: DataFrame


def build_incidents(
    alerts: DataFrame,
    rules: list[IncidentRule],
    start: datetime,
    end: datetime | None = None,
    step_seconds: int = 300,
    existing: DataFrame | None = None,
    last: DataFrame | None = None,
) -> IncidentRun:
    """Incidents, alert links and last firings of a run at `start`, or of a backfill with ticks from `start` to `end`.

    `existing` and `last` carry the result of earlier runs.
    """
    rules = [r for r in rules if r.enabled]
    firings = staged(incident_firings(alerts, rules, start, end, step_seconds, last), "firings")
    latest = firings.groupBy(*KEYS).agg(F.max("tick_ts").alias("fired_ts"))
    if last is not None:
        latest = latest.unionByName(last.select(*KEYS, "fired_ts")).groupBy(*KEYS).agg(F.max("fired_ts").alias("fired_ts"))
    return IncidentRun(upsert_incidents(firings, rules, existing), incident_links(firings, alerts, rules), latest)


def link_incident_entities(incidents: DataFrame, entities: DataFrame) -> DataFrame:
    """Link each incident to its primary entity where that entity exists."""
    e = entities.select(F.col("id").alias("entity_id"), F.col("entity_type").alias("primary_entity_type"), "entity_key")
    same = (F.lower("primary_entity_key") == F.lower("entity_key"))
    i = incidents.select(F.col("id").alias("incident_id"), "primary_entity_type", "primary_entity_key")
    return (
        i.withColumn("_k", F.lower("primary_entity_key"))
        .join(e.withColumn("_k", F.lower("entity_key")), ["primary_entity_type", "_k"])
        .filter(same).select("incident_id", "entity_id", F.lit("primary").alias("relation")).dropDuplicates()
    )
