"""Streaming jobs against the batch plans: late rows, restarts, lost state, backlogs."""

import random
import shutil
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.conditions import condition_test
from tidewatch.operators.rules import EventRule, TrustConfig, rule_condition
from tidewatch.plans.alerts import build_alerts
from tidewatch.plans.entities import entity_ledger, entity_score, upsert_entities
from tidewatch.plans.incidents import IncidentRule, build_incidents, incident_links
from tidewatch.streaming import jobs
from tidewatch.streaming.alerts import LATE, SlidingWindow, current_alerts, late_rows, read_changes
from tidewatch.streaming.entities import current_entities, ledger_rows
from tidewatch.streaming.incidents import current_incidents, firings_of

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
US = int(T0.timestamp() * 1_000_000)
RULE = EventRule(1, "r", "SSH_SECURE", "auth_login", group_by=["server"], window_seconds=60, condition="count >= 4 and unique_ips > 1", cooldown_seconds=90, evidence={"last_n": 0})
FREE = EventRule(2, "all", "SSH_SECURE", "auth_login", group_by=["username"], window_seconds=30, condition="top_subnet24_hits >= floor and username != 'u3'", let={"floor": 2}, cooldown_seconds=0)


def events(spark, rows):
    """rows: (id, second)."""
    schema = "id long, source string, server string, ip_client string, username string, t long, extra struct<event_type: string, action: string>"
    made = [(i, "SSH_SECURE", f"s{i % 2}", f"44.{i % 3}.1.1", f"u{i % 5}", US + t * 10**6, ("auth_login", "fail" if i % 4 else "success")) for i, t in rows]
    return spark.createDataFrame(made, schema).withColumn("timestamp_utc", F.timestamp_micros("t"))


def whole(alerts):
    rows = alerts.withColumn("evidence", F.to_json("evidence")).withColumn("metrics", F.to_json("metrics")).collect()
    return sorted(map(str, (r.asDict() for r in rows)))


def feed(spark, frame, src, start):
    frame.coalesce(1).write.mode("append").parquet(src)
    start(spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(src)).awaitTermination()


def test_changes_net_to_the_batch_alerts_whatever_the_order(spark, tmp_path):
    """Rows out of order by up to the delay, over restarts and several batches a run."""
    rnd = random.Random(2)
    rows = list(enumerate(sorted(rnd.randrange(1500) for _ in range(240))))
    parts = [[], [], []]
    for n, row in enumerate(rows):
        parts[min(2, n // 80 + (rnd.random() < 0.25))].append(row)
    for part in parts:
        rnd.shuffle(part)
    src, folder = str(tmp_path / "in"), str(tmp_path / "job")
    for n, part in enumerate(parts):
        events(spark, part).coalesce(1).write.mode("append").parquet(src)
        if n != 1:
            stream = spark.readStream.schema(events(spark, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(src)
            jobs.stream_alerts(stream, [RULE, FREE], TrustConfig(), folder, 2000).awaitTermination()
    changes = read_changes(spark, folder)
    assert changes.filter("kind = 'retract'").count() > 0 and late_rows(changes).count() == 0
    want = build_alerts(events(spark, rows), [RULE, FREE])
    assert whole(current_alerts(changes).select(want.columns)) == whole(want) and want.count() > 20


def test_rows_past_the_delay_are_counted_and_change_nothing(spark, tmp_path):
    src, folder = str(tmp_path / "in"), str(tmp_path / "job")
    start = lambda stream: jobs.stream_alerts(stream, [RULE], TrustConfig(), folder, 100)
    on_time = [(i, 10 * i) for i in range(0, 60, 2)]
    late = [(1001, 20), (1003, 25)]
    feed(spark, events(spark, on_time), src, start)
    feed(spark, events(spark, [*late, (62, 620)]), src, start)
    changes = read_changes(spark, folder)
    assert sorted(r["event_id"] for r in late_rows(changes).collect()) == [1001, 1003] and changes.filter(F.col("kind") == LATE).count() == 2
    want = build_alerts(events(spark, [*on_time, (62, 620)]), [RULE])
    assert whole(current_alerts(changes).select(want.columns)) == whole(want)


def test_lost_state_stops_the_job(spark, tmp_path):
    src, folder = str(tmp_path / "in"), str(tmp_path / "job")
    start = lambda stream: jobs.stream_alerts(stream, [RULE], TrustConfig(), folder, 100)
    feed(spark, events(spark, [(i, i) for i in range(20)]), src, start)
    before = read_changes(spark, folder).count()
    shutil.move(f"{folder}/checkpoint/state", f"{folder}/moved")
    spark.streams.resetTerminated()
    with pytest.raises(Exception):  # noqa: B017
        feed(spark, events(spark, [(i, i) for i in range(20, 40)]), src, start)
    assert read_changes(spark, folder).count() == before


def test_window_levels_name_the_first_of_the_most_frequent():
    rnd, rows, window, head = random.Random(4), [], SlidingWindow(), 0
    for place in range(400):
        rows.append((place, place, None, "", None, None, None, rnd.choice(["a", "b", "c", None]), 0, ""))
        window.add(rows[-1], place)
        while place - head > 17:
            window.expire(rows[head])
            head += 1
        nets = [r[7] for r in rows[head:] if r[7]]
        most = max((nets.count(n) for n in nets), default=0)
        assert (window.top, window.top_network()) == (most, next((n for n in nets if nets.count(n) == most), None))


CONDITIONS = [
    "", "count >= 2", "count > 1 and not (user == 'u1')", "user == None or count % 3 == 1", "user != 'u2'", "count / zero > 1", "count / 2 - 1 >= half",
    "user in ('u1', 'u2') or count in (3, 4)", "not user in ('u1')", "count * 2 + 1 == 7 or half < count and half > 0.5", "text >= 2", "half > null", "-count < -3", "count % zero == None",
]


def test_conditions_hold_for_the_same_rows_in_a_task_as_in_a_plan(spark):
    rows = [(n, None if n % 4 == 0 else f"u{n % 3}", 0, n / 2, str(n)) for n in range(12)] + [(None, "u1", 0, None, None)]
    names = ["count", "user", "zero", "half", "text"]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "count long, user string, zero int, half double, text string, i int")
    for text in CONDITIONS:
        test, used = condition_test(text)
        assert used <= set(names)
        want = {r["i"] for r in df.filter(rule_condition(text)).select("i").collect()}
        assert {i for i, r in enumerate(rows) if test(dict(zip(names, r)))} == want, text


def alert_rows(spark, rows):
    """rows: (id, second, name, severity, user)."""
    made = [(i, n, s, "srv", US + t * 10**6, "SRC", {"username": u, "server": "srv"}) for i, t, n, s, u in rows]
    df = spark.createDataFrame(made, "id long, rule_name string, severity int, server string, us long, source string, g map<string,string>")
    return df.select("id", "rule_name", "severity", "server", "source", F.timestamp_micros("us").alias("triggered_at"), F.struct(F.col("g").alias("group_values")).alias("evidence"))


def test_a_backlog_gives_every_tick_and_each_link_once(spark, tmp_path):
    rnd = random.Random(8)
    rules = [
        IncidentRule(1, "I-1", "one", "user", "username", {"alert_codes_any": ["A"]}, ["username"], "count >= 2", window_seconds=900, cooldown_seconds=600),
        IncidentRule(2, "I-2", "two", "user", "username", {}, ["server"], "unique_alerts >= 2 and sum_severity > 9", window_seconds=1000, cooldown_seconds=0),
    ]
    rows = [(i, t, rnd.choice(["A x", "B y"]), rnd.randrange(8), rnd.choice(["u1", "u2", None])) for i, t in enumerate(sorted(rnd.randrange(20_000) for _ in range(150)))]
    late = (999, 100, "A x", 5, "u1")
    src, folder = str(tmp_path / "in"), str(tmp_path / "job")
    for part in (rows[:10], [*rows[10:140], late], rows[140:]):
        feed(spark, alert_rows(spark, part), src, lambda stream: jobs.stream_incidents(stream, rules, folder, 300, 60))
        schema = spark.read.parquet(f"{folder}/changes").schema
        changes = spark.readStream.schema(schema).parquet(f"{folder}/changes")
        jobs.stream_incident_links(changes, rules, lambda s: alert_rows(s, rows), f"{folder}/linked").awaitTermination()
    log = spark.read.parquet(f"{folder}/changes")
    assert [r["alert_id"] for r in log.filter("kind = 'late'").select("alert_id").distinct().collect()] == [999]
    end = T0 + timedelta(seconds=(rows[-1][1] - 61) // 300 * 300)
    run = build_incidents(alert_rows(spark, rows), rules, T0, end, 300)
    cols = ["code", "primary_entity_key", "opened_us", "last_us", "count", "max_severity"]
    plain = lambda df, cols: sorted(map(tuple, df.select(*cols).collect()), key=str)
    assert plain(current_incidents(log, rules), cols) == plain(run.incidents, cols)
    assert firings_of(log).count() > 20 and firings_of(log).groupBy("rule_id", "group_key", "tick_ts").count().filter("count > 1").count() == 0
    links = spark.read.parquet(f"{folder}/linked/links")
    key = ["code", "primary_entity_key", "alert_id"]
    assert plain(links, key) == plain(incident_links(firings_of(log), alert_rows(spark, rows), rules), key)


def test_entities_of_a_batch_are_written_once_and_no_others(spark, tmp_path):
    now = T0 + timedelta(days=40)
    parts = [[(1, 5, "a", 5, "bob"), (2, 6, "a", 0, "zed"), (3, 1, "a", 60, "eve")], [(4, 9, "a", 70, "eve"), (5, 2, "a", 3, "eve")], [(6, 30, "a", 0, "bob")]]
    src, folder, want, ledger = str(tmp_path / "in"), str(tmp_path / "job"), None, []
    for part in parts:
        feed(spark, alert_rows(spark, part), src, lambda stream: jobs.stream_entities(stream, folder, now))
        batch = alert_rows(spark, part)
        ledger += entity_ledger(batch, want, now).collect()
        touched = entity_score(batch, want, now)
        want = spark.createDataFrame((touched if want is None else upsert_entities(want, touched)).collect(), touched.schema)
    log = spark.read.parquet(f"{folder}/changes")
    plain = lambda rows: sorted(map(str, rows))
    assert plain(current_entities(log).select(want.columns).collect()) == plain(want.collect())
    assert plain(ledger_rows(log).collect()) == plain(ledger)
    assert {r["entity_key"]: r["count"] for r in log.filter("kind = 'entity'").groupBy("entity_key").count().collect()} == {"bob": 2, "zed": 1, "eve": 2}
