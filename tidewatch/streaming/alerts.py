"""Alerts from a stream, as a log of changes, with the window of each group in Spark's state store.

State of a (rule, group): the rows that some window can still hold, the alerts that can still change, and the last alert that cannot. A row is
judged in the batch it arrives in. A row that comes late, but within the delay, is put in its place and the windows after it are judged again:
an alert that no longer holds, or holds with other numbers, is retracted, and what holds instead is inserted. Rows from before the watermark
change nothing any more; they are written to the log as `late`, so they can be counted and read again. Net of retractions, the log equals
`build_alerts` over all rows that were not late, whatever the order in which they came.

State, watermark and log are Spark's own: checkpointed RocksDB state, event-time timers that drop what no window needs, and the transaction log
of the file sink. A restart goes on where it stopped, and lost state stops the query instead of starting anew. The state of one group is in one
task, as the store demands; it is as large as the group's rows in one window and the delay. Ids of events are taken as unique.

A call of the store costs milliseconds and a group has few rows, so groups share their key by buckets of a hash: a batch reads and writes
each bucket that it touches once, whole.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter, deque
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidewatch.functions.fields import blank_to_null
from tidewatch.operators.conditions import condition_test
from tidewatch.operators.rules import EventRule, TrustConfig
from tidewatch.plans.alerts import KEYS, alert_columns, condition_errors, events_to_rules

HELD = "ts long, id long, raw_id long, path string, ip string, user string, server string, subnet string, outcome int, about string"
FIELDS = [c.split()[0] for c in HELD.split(", ")]
COUNTS = ["count", "unique_paths", "unique_ips", "unique_users", "unique_servers", "unique_subnets24", "top_subnet24_hits", "fail_count", "success_count"]
CHANGE = (
    "kind string, rule_id int, group_key string, version long, ts long, id long, "
    + ", ".join(f"{c} long" for c in COUNTS) + ", top_net string, event_ids array<long>, about string"
)
INSERT, RETRACT, LATE = "insert", "retract", "late"
BUCKETS = 1024  # of a rule's groups; part of the state's layout, so a checkpoint keeps its own number


class SlidingWindow:
    """Counts over rows that arrive at one end and expire at the other, each in constant time."""

    def __init__(self) -> None:
        self.values = [Counter() for _ in range(5)]
        self.count = self.fails = self.successes = self.top = 0
        self.places: dict[str, deque[int]] = {}
        self.at_level: Counter = Counter()

    def add(self, row: tuple, place: int) -> None:
        self.count += 1
        self.fails += row[8] < 0
        self.successes += row[8] > 0
        for seen, value in zip(self.values, row[3:8], strict=True):
            if value:
                seen[value] += 1
        if row[7]:
            held = self.places.setdefault(row[7], deque())
            held.append(place)
            # a network enters one level with each row; the highest level that any holds is the top count
            self.at_level[len(held)] += 1
            self.top = max(self.top, len(held))

    def expire(self, row: tuple) -> None:
        self.count -= 1
        self.fails -= row[8] < 0
        self.successes -= row[8] > 0
        for seen, value in zip(self.values, row[3:8], strict=True):
            if value:
                seen[value] -= 1
                if not seen[value]:
                    del seen[value]
        if row[7]:
            held = self.places[row[7]]
            self.at_level[len(held)] -= 1
            held.popleft()
            if not held:
                del self.places[row[7]]
            if self.top and not self.at_level[self.top]:
                self.top -= 1

    def counts(self) -> dict[str, int]:
        return dict(zip(COUNTS, (self.count, *map(len, self.values), self.top, self.fails, self.successes), strict=True))

    def top_network(self) -> str | None:
        """The most frequent network; ties go to the one seen first."""
        return min((held[0], net) for net, held in self.places.items() if len(held) == self.top)[1] if self.top else None


class AlertWindows(StatefulProcessor):
    """Rows of a (rule, bucket of groups) in, changes of the groups' alerts out."""

    def __init__(self, rules: list[EventRule]) -> None:
        self.rules = {r.id: r for r in rules}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", f"group_key string, {HELD}")
        self.unsettled = handle.getListState("unsettled", "group_key string, ts long, id long, print string")
        self.about = handle.getListState("about", "group_key string, version long, fired long")
        self.timer = handle.getValueState("timer", "at long")
        self.tests = {r.id: condition_test(r.condition) for r in self.rules.values()}

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        rule, horizon = self.rules[key[0]], timerValues.getCurrentWatermarkInMs() * 1000
        about = {g: (version, fired) for g, version, fired in self.about.get()}
        fresh: dict[str, list[tuple]] = {}
        for row in rows:
            group = row.group_key
            if row.ts < horizon:
                version, fired = about.get(group, (0, None))
                about[group] = (version + 1, fired)
                yield self._change(LATE, (key[0], group), version + 1, row.ts, row.id, about=row.about)
            else:
                fresh.setdefault(group, []).append(tuple(row[f] for f in FIELDS))
        if fresh:
            held, unsettled = self._settled(rule, horizon, about)
            for group, added in fresh.items():
                (version, fired), before, after = about.get(group, (0, None)), unsettled.get(group, {}), {}
                of_group = (key[0], group)
                kept = held.setdefault(group, [])
                kept += added
                for ts, eid, counts, net, ids, said in self._alerts(rule, group, sorted(kept, key=lambda x: x[:2]), horizon, fired):
                    shown = hashlib.blake2b(repr((counts, net, ids)).encode(), digest_size=12).hexdigest()
                    after[ts, eid] = shown
                    if before.get((ts, eid)) != shown:
                        if (ts, eid) in before:
                            version += 1
                            yield self._change(RETRACT, of_group, version, ts, eid)
                        version += 1
                        yield self._change(INSERT, of_group, version, ts, eid, counts, net, ids, said)
                for ts, eid in before:
                    if (ts, eid) not in after:
                        version += 1
                        yield self._change(RETRACT, of_group, version, ts, eid)
                about[group], unsettled[group] = (version, fired), after
            self._keep(held, unsettled)
            self._wake_at(max(x[0] for added in fresh.values() for x in added) + rule.window_seconds * 1_000_000)
        self.about.put([(g, *a) for g, a in about.items()])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """No window holds any of the rows now. What stays is the last alert, until its cooldown is over, and the number of changes."""
        rule, horizon = self.rules[key[0]], timerValues.getCurrentWatermarkInMs() * 1000
        timer = self.timer.get()
        if timer is None or timer[0] > timerValues.getCurrentWatermarkInMs():
            return iter(())
        about = {g: (version, fired) for g, version, fired in self.about.get()}
        self._keep(*self._settled(rule, horizon, about))
        over = horizon - rule.cooldown_seconds * 1_000_000
        self.about.put([(g, version, None if fired is not None and fired <= over else fired) for g, (version, fired) in about.items()])
        self.timer.clear()
        return iter(())

    def close(self) -> None:
        pass

    def _settled(self, rule: EventRule, horizon: int, about: dict) -> tuple[dict[str, list[tuple]], dict[str, dict]]:
        """Of each group the rows that windows can still hold and the alerts that can still change; `about` gets the last one that cannot."""
        held: dict[str, list[tuple]] = {}
        for group, *row in self.held.get():
            if row[0] >= horizon - rule.window_seconds * 1_000_000:
                held.setdefault(group, []).append(tuple(row))
        unsettled: dict[str, dict] = {}
        for group, ts, eid, shown in self.unsettled.get():
            if ts >= horizon:
                unsettled.setdefault(group, {})[ts, eid] = shown
            else:
                version, fired = about[group]
                about[group] = (version, ts if fired is None else max(fired, ts))
        return held, unsettled

    def _keep(self, held: dict[str, list[tuple]], unsettled: dict[str, dict]) -> None:
        for state, rows in (
            (self.held, [(g, *x) for g, of_group in held.items() for x in of_group]),
            (self.unsettled, [(g, *k, shown) for g, of_group in unsettled.items() for k, shown in of_group.items()]),
        ):
            if rows:
                state.put(rows)
            else:
                state.clear()

    def _wake_at(self, us: int) -> None:
        """One timer a bucket: when the watermark has passed the last window of its newest row."""
        at, timer = us // 1000 + 2, self.timer.get()
        if timer is not None and timer[0] >= at:
            return
        if timer is not None:
            self.handle.deleteTimer(timer[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def _alerts(self, rule: EventRule, group: str, rows: list[tuple], horizon: int, fired: int | None) -> Iterator[tuple]:
        """Alerts at rows from the horizon on. `rows` are in order of time and id and begin a window before the horizon."""
        holds, names = self.tests[rule.id]
        described = names - set(COUNTS)
        width, cooldown, last_n = rule.window_seconds * 1_000_000, rule.cooldown_seconds * 1_000_000, int(rule.evidence.get("last_n", 10))
        window, head = SlidingWindow(), 0
        for place, row in enumerate(rows):
            window.add(row, place)
            while rows[head][0] < row[0] - width:
                window.expire(rows[head])
                head += 1
            if row[0] < horizon or (cooldown > 0 and fired is not None and row[0] < fired + cooldown):
                continue
            counts = window.counts()
            values = counts
            if described:
                about = json.loads(row[9])
                values = {n: about.get(f"let_{rule.id}_{n}", about.get(n)) for n in described} | {"group_key": group} | counts
            if holds(values):
                fired = row[0]
                begin = max(head, place + 1 - last_n) if last_n > 0 else head
                yield row[0], row[1], counts, window.top_network(), [x[1] for x in rows[begin : place + 1]], row[9]

    @staticmethod
    def _change(kind: str, key: Any, version: int, ts: int, eid: int, counts: dict | None = None, net: str | None = None, ids: list | None = None, about: str | None = None) -> Row:
        counts = counts or dict.fromkeys(COUNTS)
        return Row(kind=kind, rule_id=key[0], group_key=key[1], version=version, ts=ts, id=eid, **counts, top_net=net, event_ids=ids, about=about)


def bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("group_key"), F.lit(buckets).cast("bigint")).cast("int").alias("bucket")


def _about(hits: DataFrame) -> Column:
    """What alerts and conditions say of the row itself, as one text that the state passes through."""
    names = ["server", "ip_client", "username", "source", "event_type", "ip_subnet24", "geo_country", "asn_number", "asn_org", "vhost", "trusted", "group_fields"]
    return F.struct(*names, *[c for c in hits.columns if c.startswith("let_")])


def alert_changes(events: DataFrame, rules: list[EventRule], trust: TrustConfig, max_delay_seconds: int = 3600, extended: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """The changes of alerts that a stream of events makes: kind, version (ascending in its group) and the columns of `build_alerts`.

    `late` rows have the event's id, time, rule and group alone.
    """
    bad = condition_errors(rules)
    rules = [r for r in rules if r.enabled and r.id not in bad]
    on_time = events.withWatermark("timestamp_utc", f"{max_delay_seconds} seconds")
    hits = events_to_rules(on_time, rules, trust, extended)
    about = _about(hits)
    rows = hits.select(
        *KEYS, bucket(buckets), "ts", F.col("id").cast("long").alias("id"), F.col("raw_id").cast("long").alias("raw_id"), "path",
        blank_to_null(F.col("ip_client")).alias("ip"), F.lower(blank_to_null(F.col("username"))).alias("user"), blank_to_null(F.col("server")).alias("server"),
        F.col("ip_subnet24").alias("subnet"), F.when(F.col("action") == "fail", -1).when(F.col("action") == "success", 1).otherwise(0).alias("outcome"),
        F.to_json(about, {"ignoreNullFields": "false"}).alias("about"),
    )
    kind: StructType = hits.select(about.alias("a")).schema["a"].dataType
    changed = rows.groupBy("rule_id", "bucket").transformWithState(AlertWindows(rules), CHANGE, "Append", "EventTime")
    full = changed.select("*", F.from_json("about", kind).alias("a")).select(
        "kind", "version", *KEYS, "ts", "id", *COUNTS, F.col("top_net").alias("top_subnet24"), "event_ids", "a.*"
    )
    return full.select("kind", "version", *alert_columns(rules, F.transform("event_ids", lambda x: F.struct(x.alias("event_id"), F.lit(None).cast("string").alias("raw")))))


def current_alerts(changes: DataFrame) -> DataFrame:
    """The alerts that a log of changes leaves: those inserted more often than retracted, as last inserted."""
    key = ["rule_id", "group_key", "event_id"]
    cols = [c for c in changes.columns if c not in (*key, "kind", "version")]
    inserted = F.col("kind") == INSERT
    net = changes.filter(F.col("kind") != LATE).groupBy(*key).agg(
        F.sum(F.when(inserted, 1).otherwise(-1)).alias("net"), F.max_by(F.struct(*cols), F.when(inserted, F.col("version"))).alias("row")
    )
    return net.filter("net > 0").select(*key, "row.*").select([c for c in changes.columns if c not in ("kind", "version")])


def late_rows(changes: DataFrame) -> DataFrame:
    """Rows that came after the watermark had passed them: rule, group, event and time."""
    return changes.filter(F.col("kind") == LATE).select(*KEYS, "event_id", "triggered_at")


def read_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The log that `stream_alerts` writes to its folder."""
    return spark.read.parquet(f"{folder}/changes")
