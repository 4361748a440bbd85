"""Event rules to alerts: match, window, condition, cooldown, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.fields import blank_to_null, event_field
from tidewatch.functions.net import ip_subnet, ip_to_long
from tidewatch.functions.times import within
from tidewatch.operators.cooldown import apply_cooldown
from tidewatch.operators.prefix import SIX_HOURS_US, numbered
from tidewatch.operators.ruleindex import by_rule, matched_rules
from tidewatch.operators.rules import (
    EVENT_CONDITION_NAMES,
    EventRule,
    TrustConfig,
    asn_number,
    condition_error,
    event_action,
    event_path,
    geo_country,
    is_trusted,
    rule_condition,
    rule_let,
)
from tidewatch.operators.staging import staged
from tidewatch.operators.windows import sliding_metrics

KEYS = ["rule_id", "group_key"]
BLOCK = 256


def condition_errors(rules: list[EventRule]) -> dict[int, str]:
    """Rules whose condition cannot be evaluated; they raise no alert."""
    found = {r.id: condition_error(r.condition, EVENT_CONDITION_NAMES + list(r.let)) for r in rules}
    return {rid: err for rid, err in found.items() if err}


def events_to_rules(
    events: DataFrame, rules: list[EventRule], trust: TrustConfig, extended: bool = False
) -> DataFrame:
    """One row per (event, matching rule), in one pass over the events; only lists too long for a plan are joined."""
    wanted_sources = sorted({r.source.strip().upper() for r in rules})
    events = (
        events.withColumn("rule_source", F.upper(F.trim(F.col("source"))))
        .withColumn("rule_type", F.lower(F.trim(event_field(events.schema, "extra.event_type"))))
        .filter(F.col("rule_source").isin(wanted_sources))
        .withColumn("ip_long", ip_to_long(blank_to_null(F.col("ip_client"))))
    )
    events = events.withColumn("trusted_base", is_trusted(events.schema, trust))
    schema = events.schema
    lets = [
        c.alias(f"let_{r.id}_{n}") for r in rules for n, c in rule_let(schema, r.let, extended).items()
    ]
    return matched_rules(events, rules, trust, extended).select(
        "id", "server", "ip_client", "username",
        event_field(schema, "raw_id").alias("raw_id"),
        F.unix_micros("timestamp_utc").alias("ts"),
        F.col("rule_source").alias("source"),
        F.col("rule_type").alias("event_type"),
        ip_subnet(blank_to_null(F.col("ip_client"))).alias("ip_subnet24"),
        geo_country(schema).alias("geo_country"),
        asn_number(schema).alias("asn_number"),
        event_field(schema, "extra.asn.org").alias("asn_org"),
        event_field(schema, "extra.vhost").alias("vhost"),
        event_path(events).alias("path"),
        event_action(events).alias("action"),
        *lets,
        "rule_id", "group_key", "w", "trusted", "group_fields",
    )


def window_metrics(hits: DataFrame, rules: list[EventRule], slice_width: int = SIX_HOURS_US) -> DataFrame:
    """Running window metrics of every (event, rule) row.

    A dimension that is part of the group key has one value per group, so it is not counted.
    """
    source_of = {
        "paths": (F.col("path"), ["extra.http.path"]),
        "ips": (blank_to_null(F.col("ip_client")), ["ip_client"]),
        "users": (F.lower(blank_to_null(F.col("username"))), ["username"]),
        "servers": (blank_to_null(F.col("server")), ["server"]),
        "subnets24": (F.col("ip_subnet24"), ["ip_client", "ip_subnet24"]),
    }
    fixed = {
        d: [r.id for r in rules if set(fields) & set(r.fields)] if d != "paths" else []
        for d, (_, fields) in source_of.items()
    }
    dims = {
        d: F.when(~F.col("rule_id").isin(fixed[d]), value) if fixed[d] else value
        for d, (value, _) in source_of.items()
    }
    by_hits = [r.id for r in rules if "top_subnet24_hits" in r.condition and r.id not in fixed["subnets24"]]
    keep = [c for c in hits.columns if c not in (*KEYS, "id", "ts", "w", "path")]
    out = sliding_metrics(
        hits, KEYS, t="ts", seq="id", window_us=F.col("w"),
        dims=dims,
        sums={
            "fail_count": (F.col("action") == "fail").cast("int"),
            "success_count": (F.col("action") == "success").cast("int"),
        },
        top_value=F.when(F.col("rule_id").isin(by_hits), F.col("ip_subnet24")) if by_hits else None,
        numbered=True, keep=keep, slice_width=slice_width,
    )
    for d, ids in fixed.items():
        if ids:
            one = source_of[d][0].isNotNull().cast("bigint")
            out = out.withColumn(f"unique_{d}", F.when(F.col("rule_id").isin(ids), one).otherwise(F.col(f"unique_{d}")))
    hits_col = F.col("top_hits") if by_hits else F.lit(None).cast("bigint")
    same_net = F.col("rule_id").isin(fixed["subnets24"]) if fixed["subnets24"] else F.lit(False)
    return out.withColumn(
        "top_subnet24_hits",
        F.when(same_net, F.when(F.col("ip_subnet24").isNull(), 0).otherwise(F.col("count"))).otherwise(hits_col),
    ).drop("top_hits")


def candidates(metrics: DataFrame, rules: list[EventRule]) -> DataFrame:
    """Rows whose rule's condition holds, with the rule's cooldown."""
    bad = condition_errors(rules)
    same: dict[tuple, list[EventRule]] = {}  # rules with the same condition share its test
    for r in rules:
        if r.id not in bad:
            same.setdefault((r.condition, *([r.id] if r.let else [])), []).append(r)
    holds = F.lit(False)
    for group in same.values():
        rename = {n: f"let_{group[0].id}_{n}" for n in group[0].let}
        holds = F.when(F.col("rule_id").isin([r.id for r in group]), rule_condition(group[0].condition, rename)).otherwise(holds)
    cooldown = by_rule({r.id: r.cooldown_seconds * 1_000_000 for r in rules}, "bigint")
    return metrics.filter(holds).withColumn("cooldown", cooldown)


def fired(metrics: DataFrame, rules: list[EventRule]) -> DataFrame:
    """Candidates that are not in cooldown."""
    return apply_cooldown(staged(candidates(metrics, rules), "met"), KEYS, "ts", "id", "cooldown")


def window_evidence(alerts: DataFrame, metrics: DataFrame, rules: list[EventRule]) -> DataFrame:
    """Last n window rows of each alert (n = 0: all), by position in the group: an equi-join.

    The positions are sorted and merged, never broadcast: Spark estimates them by the alerts they come from, however many each has.
    """
    n = by_rule({r.id: int(r.evidence.get("last_n", 10)) for r in rules}, "bigint")
    take = F.when(n > 0, F.least(n, F.col("count"))).otherwise(F.col("count"))
    wanted = alerts.select(
        *KEYS, F.col("id").alias("alert_event"),
        F.explode(F.sequence(F.col("n_seen") - take + 1, F.col("n_seen"))).alias("n_seen"),
    )
    items = metrics.select(*KEYS, "n_seen", F.col("id").alias("event_id"), "raw_id")
    return wanted.hint("merge").join(items, [*KEYS, "n_seen"])


def top_subnets(alerts: DataFrame, metrics: DataFrame) -> DataFrame:
    """Most frequent /24 of each alert's window; ties go to the one seen first in it.

    The rows of a group are counted per block of positions; a window takes whole blocks as counts and
    only its two end blocks row by row, so long windows do not pair alerts with rows. The blocks of the
    windows are merged with them, never broadcast, as in `window_evidence`.
    """
    lo, hi = F.col("block") * BLOCK, F.col("block") * BLOCK + BLOCK - 1
    spans = alerts.select(
        *KEYS, F.col("id").alias("alert_event"), F.col("n_seen").alias("to"),
        (F.col("n_seen") - F.col("count") + 1).alias("from"),
    ).select("*", F.explode(F.expr(f"sequence(from div {BLOCK}, to div {BLOCK})")).alias("block"))
    whole = (lo >= F.col("from")) & (hi <= F.col("to"))
    items = metrics.filter("ip_subnet24 IS NOT NULL").select(
        *KEYS, "n_seen", "ip_subnet24", F.expr(f"n_seen div {BLOCK}").alias("block")
    )
    blocks = items.groupBy(*KEYS, "block", "ip_subnet24").agg(F.count(F.lit(1)).alias("n"), F.min("n_seen").alias("first"))
    cols = [*KEYS, "alert_event", "ip_subnet24", "n", "first"]
    by_block = spans.filter(whole).hint("merge").join(blocks, [*KEYS, "block"]).select(*cols)
    by_row = (
        spans.filter(~whole).hint("merge").join(items, [*KEYS, "block"]).filter("n_seen BETWEEN from AND to")
        .withColumn("n", F.lit(1).cast("bigint")).withColumn("first", F.col("n_seen")).select(*cols)
    )
    counted = by_block.unionByName(by_row).groupBy(*KEYS, "alert_event", "ip_subnet24").agg(
        F.sum("n").alias("n"), F.min("first").alias("first")
    )
    best = F.max(F.struct("n", (-F.col("first")).alias("neg_first"), "ip_subnet24")).alias("best")
    return counted.groupBy(*KEYS, "alert_event").agg(best).select(
        *KEYS, "alert_event", F.col("best.ip_subnet24").alias("top_net"), F.col("best.n").alias("top_n")
    )


def alert_columns(rules: list[EventRule], items: Column) -> list[Column]:
    """The columns of an alert, from the row that raised it with its window's numbers, and `items` (event_id, raw) of its evidence."""
    with_raw = [r.id for r in rules if r.evidence.get("include_raw", True)]
    base_values = F.map_from_arrays(
        F.array(*[F.lit(k) for k in (
            "server", "ip_client", "username", "extra.vhost", "extra.geo.country_code", "extra.asn.number", "extra.asn.org",
        )]),
        F.array("server", "ip_client", "username", "vhost", "geo_country", F.col("asn_number").cast("string"), "asn_org"),
    )
    own = F.map_filter("group_fields", lambda k, v: v.isNotNull() & ~F.map_contains_key(base_values, k))
    return [F.col(c) if isinstance(c, str) else c for c in (
        "rule_id",
        by_rule({r.id: r.name for r in rules}, "string").alias("rule_name"),
        by_rule({r.id: r.severity for r in rules}, "int").alias("severity"),
        "server", "source", "event_type", "group_key",
        F.timestamp_micros("ts").alias("triggered_at"),
        F.timestamp_micros(F.col("ts") - by_rule({r.id: r.window_seconds * 1_000_000 for r in rules}, "bigint")).alias("window_start"),
        F.timestamp_micros("ts").alias("window_end"),
        F.struct(
            "count", "unique_paths", "unique_ips", "unique_users", "unique_servers", "unique_subnets24", "top_subnet24", "top_subnet24_hits",
            "fail_count", "success_count",
            by_rule({r.id: r.window_seconds for r in rules}, "int").alias("window_seconds"),
            "trusted",
        ).alias("metrics"),
        F.struct(
            F.transform(items, lambda x: x["event_id"].cast("string")).alias("event_ids"),
            F.when(F.col("rule_id").isin(with_raw), F.filter(F.transform(items, lambda x: x["raw"]), lambda x: x.isNotNull())).alias("raw_samples"),
            by_rule({r.id: r.fields for r in rules}, "array<string>").alias("group_by"),
            F.map_filter(F.map_concat(base_values, own), lambda k, v: v.isNotNull()).alias("group_values"),
        ).alias("evidence"),
        F.lit("open").alias("status"),
        F.col("id").alias("event_id"),
    )]


def build_alerts(
    events: DataFrame,
    rules: list[EventRule],
    trust: TrustConfig | None = None,
    raw_lines: DataFrame | None = None,
    extended_fields: bool = False,
    slice_width: int = SIX_HOURS_US,
    raw_chars: int | None = None,
) -> DataFrame:
    """Alerts of all enabled rules. `raw_lines` (raw_id, raw) adds samples of the evidence lines, whole or cut to `raw_chars`."""
    rules = [r for r in rules if r.enabled]
    hits = staged(events_to_rules(events, rules, trust or TrustConfig(), extended_fields), "hits")
    metrics = staged(window_metrics(hits, rules, slice_width), "metrics")
    alerts = staged(fired(metrics, rules), "fired")
    evidence = window_evidence(alerts, metrics, rules)
    if raw_lines is not None:
        raw = raw_lines.select("raw_id", F.col("raw") if raw_chars is None else F.substring("raw", 1, raw_chars).alias("raw"))
        evidence = evidence.join(raw, "raw_id", "left")
    else:
        evidence = evidence.withColumn("raw", F.lit(None).cast("string"))
    item = F.struct("n_seen", "event_id", "raw")
    evidence = evidence.groupBy(*KEYS, "alert_event").agg(F.array_sort(F.collect_list(item)).alias("items"))
    open_nets = [r.id for r in rules if not {"ip_client", "ip_subnet24"} & set(r.fields)]
    tops = top_subnets(alerts.filter(F.col("rule_id").isin(open_nets)), metrics)
    full = (
        alerts.withColumn("alert_event", F.col("id"))
        .join(evidence, [*KEYS, "alert_event"], "left")
        .join(tops, [*KEYS, "alert_event"], "left")
    )
    is_open = F.col("rule_id").isin(open_nets)
    full = full.withColumns({
        "top_subnet24": F.when(is_open, F.col("top_net")).otherwise(F.col("ip_subnet24")),
        "top_subnet24_hits": F.when(is_open, F.coalesce("top_n", F.lit(0))).otherwise(F.col("top_subnet24_hits")),
    })
    return full.select(*alert_columns(rules, F.col("items")))


def assign_alert_ids(alerts: DataFrame, after: int = 0) -> DataFrame:
    """Consecutive ids in (triggered_at, rule_id, group_key, event_id) order, without a global sort in one task."""
    daily = alerts.withColumn("_day", F.date_trunc("day", "triggered_at"))
    ids = numbered(daily, [], ["triggered_at", "rule_id", "group_key", "event_id"], "_day", "id")
    return ids.withColumn("id", F.col("id") + F.lit(after)).drop("_day")


def reprocess_rules(
    events: DataFrame,
    alerts: DataFrame,
    rules: list[EventRule],
    trust: TrustConfig,
    time_min,
    time_max,
    server: str | None = None,
) -> DataFrame:
    """Alerts with those of `rules` in the range replaced by a recomputation from the events of the range.

    Windows and cooldowns start empty at the lower end of the range.
    """
    inside = events.filter(within(events, "timestamp_utc", time_min, time_max))
    old = F.col("triggered_at").between(time_min, time_max) & F.col("rule_id").isin([r.id for r in rules])
    if server:
        inside = inside.filter(F.col("server") == server)
        old = old & F.coalesce(F.col("server") == server, F.lit(False))
    return alerts.filter(~F.coalesce(old, F.lit(False))).unionByName(
        build_alerts(inside, rules, trust), allowMissingColumns=True
    )
