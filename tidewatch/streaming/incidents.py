"""Incident rules over a stream of alerts, one tick after the other.

State of a (rule, group): its alerts, summed for each stretch of ticks that they belong to, name and server, and the last firing. An event-time
timer stands at the next tick at which a group has alerts. When the watermark passes it, every tick up to the watermark is worked through, so
a backlog of hours gives the same firings as a run that never stopped. Firings are the log from which incidents are made; links to alerts are
added once each. Alerts from before the watermark come too late for their ticks and are written to the log as `late`. Groups share keys of the
store by buckets, as in `streaming.alerts`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.utils import AnalysisException

from tidewatch.functions.times import within
from tidewatch.operators.conditions import condition_test
from tidewatch.operators.rules import INCIDENT_CONDITION_NAMES, condition_error
from tidewatch.plans.incidents import KEYS, IncidentRule, alerts_to_rules, incident_links, unseen_links, upsert_incidents
from tidewatch.streaming.alerts import BUCKETS, bucket

SUMS = "first_tick long, last_tick long, name string, at string, n long, sum_severity long, max_severity long, first_ts long, first_id long, server string, primary string, group_json string, last_ts long"
FIRED = (
    "kind string, rule_id int, group_key string, tick_ts long, count long, unique_alerts long, unique_servers long, max_severity long, sum_severity long, "
    "first_ts long, last_ts long, server string, primary string, group_json string, window_seconds int, alert_id long"
)
FIRING, LATE = "firing", "late"


class IncidentTicks(StatefulProcessor):
    """Alerts of a (rule, bucket of groups) in, firings out. Tick t (in microseconds) covers alerts in [t - window, t]."""

    def __init__(self, rules: list[IncidentRule], step_seconds: int) -> None:
        self.rules, self.step = {r.id: r for r in rules}, step_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getListState("sums", f"group_key string, {SUMS}")
        self.about = handle.getListState("about", "group_key string, next_tick long, fired long")
        self.timer = handle.getValueState("timer", "at long")
        self.tests = {r.id: condition_test(r.condition)[0] for r in self.rules.values()}

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        rule, horizon = self.rules[key[0]], timerValues.getCurrentWatermarkInMs() * 1000
        fresh: dict[tuple, tuple] = {}
        for row in rows:
            if row.ts < horizon:
                yield self._row(LATE, (key[0], row.group_key), last_ts=row.ts, alert_id=row.id)
                continue
            at = (row.group_key, -(-row.ts // self.step), (row.ts + rule.window_seconds * 1_000_000) // self.step, row.alert_name, row.alert_server)
            if at[1] > at[2]:  # a window shorter than a step, between two ticks
                continue
            own = (1, row.severity, row.severity, row.ts, row.id, row.server, row.primary, row.group_json, row.ts)
            fresh[at] = self._added(fresh.get(at), own)
        if fresh:
            sums = {tuple(x)[:5]: tuple(x)[5:] for x in self.sums.get()}
            for at, own in fresh.items():
                sums[at] = self._added(sums.get(at), own)
            self.sums.put([(*k, *v) for k, v in sums.items()])
            next_ticks = {g: tick for g, tick, _ in self.about.get()}
            self._wake_at(min(max(k[1], next_ticks.get(k[0], k[1])) for k in sums))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        rule, horizon = self.rules[key[0]], timerValues.getCurrentWatermarkInMs() * 1000
        timer = self.timer.get()
        if timer is None or timer[0] > timerValues.getCurrentWatermarkInMs():
            return
        about = {g: (tick, fired) for g, tick, fired in self.about.get()}
        sums: dict[str, list[tuple]] = {}
        for group, *row in self.sums.get():
            sums.setdefault(group, []).append(tuple(row))
        left = []
        for group, waiting in sums.items():
            tick, fired = about.get(group, (0, None))
            waiting.sort(key=lambda x: x[0])
            inside, begun = [], 0
            while inside or begun < len(waiting):
                if not inside:
                    tick = max(tick, waiting[begun][0])
                at = tick * self.step
                if at >= horizon:
                    break
                while begun < len(waiting) and waiting[begun][0] <= tick:
                    inside.append(waiting[begun])
                    begun += 1
                found = self._totals(rule, group, inside)
                free = rule.cooldown_seconds <= 0 or fired is None or at >= fired + rule.cooldown_seconds * 1_000_000
                if free and found["primary"] and self.tests[rule.id](found):
                    fired = at
                    yield self._row(FIRING, (key[0], group), tick_ts=at, **{k: v for k, v in found.items() if k != "group_key"})
                tick += 1
                inside = [x for x in inside if x[1] >= tick]
            about[group] = (tick, fired)
            left += [(group, *x) for x in (*inside, *waiting[begun:])]
        self.about.put([(g, *a) for g, a in about.items()])
        self.timer.clear()
        if left:
            self.sums.put(left)
            self._wake_at(min(max(x[1], about[x[0]][0]) for x in left))
        else:
            self.sums.clear()

    def close(self) -> None:
        pass

    def _wake_at(self, tick: int) -> None:
        """One timer a bucket: the next tick at which one of its groups has alerts."""
        at, timer = tick * self.step // 1000 + 1, self.timer.get()
        if timer is not None and timer[0] == at:
            return
        if timer is not None:
            self.handle.deleteTimer(timer[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    @staticmethod
    def _added(old: tuple | None, new: tuple) -> tuple:
        """Sums of alerts of the same ticks, name and server; the first alert's values stay."""
        if old is None:
            return new
        first = min(old[3:8], new[3:8], key=lambda x: x[:2])
        return (old[0] + new[0], old[1] + new[1], max(old[2], new[2]), *first, max(old[8], new[8]))

    @staticmethod
    def _totals(rule: IncidentRule, group: str, sums: list[tuple]) -> dict[str, Any]:
        first = min(sums, key=lambda x: x[7:9])
        return {
            "count": sum(x[4] for x in sums), "unique_alerts": len({x[2] for x in sums}), "unique_servers": len({x[3] for x in sums}),
            "max_severity": max(x[6] for x in sums), "sum_severity": sum(x[5] for x in sums), "first_ts": first[7], "last_ts": max(x[12] for x in sums),
            "server": first[9], "primary": first[10], "group_json": first[11], "window_seconds": rule.window_seconds, "group_key": group,
        }

    @staticmethod
    def _row(kind: str, key: Any, **values: Any) -> Row:
        names = [c.split()[0] for c in FIRED.split(", ")]
        return Row(**{**dict.fromkeys(names), "kind": kind, "rule_id": key[0], "group_key": key[1], **values})


def incident_changes(alerts: DataFrame, rules: list[IncidentRule], step_seconds: int = 300, max_delay_seconds: int = 3600, buckets: int = BUCKETS) -> DataFrame:
    """Firings (and late alerts) of a stream of alerts at ticks that are multiples of the step."""
    rules = [r for r in rules if r.enabled and not condition_error(r.condition, INCIDENT_CONDITION_NAMES)]
    hits = alerts_to_rules(alerts.withWatermark("triggered_at", f"{max_delay_seconds} seconds"), rules)
    rows = hits.select(*KEYS, bucket(buckets), "ts", F.col("id").cast("long").alias("id"), "alert_name", "alert_server", "severity", "server", "primary", "group_json")
    return rows.groupBy("rule_id", "bucket").transformWithState(IncidentTicks(rules, step_seconds), FIRED, "Append", "EventTime")


def firings_of(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("kind") == FIRING).drop("kind", "alert_id")


def current_incidents(changes: DataFrame, rules: list[IncidentRule], existing: DataFrame | None = None) -> DataFrame:
    """Incidents made by the firings of the log."""
    return upsert_incidents(firings_of(changes), rules, existing)


def link_batch(rules: list[IncidentRule], read_alerts: Callable[[SparkSession], DataFrame], links: str) -> Callable[[DataFrame, int], None]:
    """Step of the link job: links of the batch's firings that are not in the table yet are added. A repeated batch finds its own and adds none."""
    key = ["code", "primary_entity_type", "primary_entity_key", "alert_id"]
    longest = max(r.window_seconds for r in rules)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        firings = firings_of(batch)
        bounds = firings.agg(F.timestamp_micros(F.min("tick_ts") - longest * 1_000_000), F.timestamp_micros(F.max("tick_ts"))).first()
        if bounds[0] is None:
            return
        alerts = read_alerts(spark)
        near = alerts.filter(within(alerts, "triggered_at", F.lit(bounds[0]), F.lit(bounds[1])))
        found = incident_links(firings, near, rules)
        try:
            found = unseen_links(found, spark.read.parquet(links), key)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        found.write.mode("append").parquet(links)

    return step
