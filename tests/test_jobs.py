"""Sources, range joins, incidents, entities and streams on small inputs."""

import gzip
import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tests.models import cooldown_model
from tidewatch.functions.net import ip_to_long
from tidewatch.operators.rangejoin import range_join
from tidewatch.operators.rules import EventRule, TrustConfig
from tidewatch.plans.alerts import build_alerts
from tidewatch.plans.entities import entity_score
from tidewatch.plans.incidents import IncidentRule, build_incidents, incident_firings, seeded_rules
from tidewatch.plans.lifecycle import nearest_event
from tidewatch.sources.lines import ingest_stats, read_log_lines, write_events

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_lines_are_numbered_per_file_across_splits(spark, tmp_path):
    texts = {"a.log": [f"a{i}" for i in range(5000)], "b.log": ["", "b1", "", "b3"]}
    for name, ls in texts.items():
        (tmp_path / name).write_text("\n".join(ls) + "\n")
    with gzip.open(tmp_path / "c.gz", "wt") as f:
        f.write("c0\r\nc1\n")
    (tmp_path / "d.log").write_bytes(b"ok \xff\xfe end\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_log_lines(spark, str(tmp_path), "srv", "x").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {}
    for r in sorted(rows, key=lambda r: r["line_no"]):
        got.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["line_no"], r["raw"]))
    for name, ls in {**texts, "c.gz": ["c0", "c1"]}.items():
        assert got[name] == list(enumerate(ls, 1))
    assert got["d.log"][0][1] == "ok �� end"


def test_range_join_equals_brute_force_with_wide_ranges_and_gaps(spark):
    rnd = random.Random(3)
    edges = sorted(rnd.sample(range(0, 5_000_000), 60))
    ranges = [(a, b - 1, f"r{a}") for a, b in zip(edges[::2], edges[1::2])]
    points = [rnd.randrange(5_100_000) for _ in range(800)] + [a for a, _, _ in ranges] + [b for _, b, _ in ranges] + [None] * 500 + [ranges[3][0]] * 9000
    want = sorted((p if p is not None else -1, next((n for a, b, n in ranges if p is not None and a <= p <= b), "")) for p in points)
    r = spark.createDataFrame(ranges, "start_long long, end_long long, name string")
    p = spark.createDataFrame([(x,) for x in points], "p long")
    other = r.select("start_long", "end_long", F.length("name").alias("width"))
    for limit in ("10m", "-1"):  # with and without broadcasts by Spark itself
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        got = range_join(p, "p", r, other).collect()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert sorted((x["p"] if x["p"] is not None else -1, x["name"] or "") for x in got) == want
        assert all((x["width"] or 0) == len(x["name"] or "") for x in got)


def alert_rows(spark, rows):
    schema = "id long, rule_name string, severity int, server string, triggered_at timestamp, evidence struct<group_values: map<string, string>>"
    return spark.createDataFrame([(i, n, s, srv, T0 + timedelta(seconds=t), (gv,)) for i, (t, n, s, srv, gv) in enumerate(rows)], schema)


def test_incident_firings_equal_tick_by_tick_model(spark):
    rnd = random.Random(11)
    rows = [(rnd.randrange(4 * 3600), rnd.choice(["A-1 x", "A-2", "B-1"]), rnd.randrange(1, 30), rnd.choice(["s1", "s2"]), {"server": "s1", "username": rnd.choice(["u", "v"])}) for _ in range(250)]
    rules = [IncidentRule(1, "I1", "n", "user", "username", {"alert_codes_any": ["A-1", "A-2"]}, ["username"], "count >= 3 and unique_alerts >= 2", window_seconds=900, cooldown_seconds=1500),
             IncidentRule(2, "I2", "n", "host", "server", {"min_severity": 20}, [], "sum_severity > 60 or unique_servers == 2", window_seconds=600, cooldown_seconds=0)]
    hits = []
    for k in range(4 * 12 + 1):
        t = k * 300
        for r, gk in ((1, "u"), (1, "v"), (2, "s1|s1")):
            inside = [x for x in rows if t - rules[r - 1].window_seconds <= x[0] <= t and (
                (r == 1 and x[4]["username"] == gk and x[1] in ("A-1 x", "A-2")) or (r == 2 and x[2] >= 20))]
            ok = inside and (len(inside) >= 3 and len({x[1] for x in inside}) >= 2 if r == 1 else sum(x[2] for x in inside) > 60 or len({x[3] for x in inside}) == 2)
            if ok:
                hits.append(((r, gk if r == 1 else "s1"), t, t))
    want = cooldown_model(hits, {(1, "u"): 1500, (1, "v"): 1500, (2, "s1"): 0})
    rules[1] = IncidentRule(**{**rules[1].__dict__, "group_by": ["server"]})
    got = incident_firings(alert_rows(spark, rows), rules, T0, T0 + timedelta(hours=4), 300).collect()
    base = int(T0.timestamp())
    assert sorted(((g["rule_id"], g["group_key"]), g["tick_ts"] // 10**6 - base, g["tick_ts"] // 10**6 - base) for g in got) == want


def test_seeded_rules_and_two_runs_extend_one_incident(spark):
    assert len(seeded_rules()) == 14 and {r.score for r in seeded_rules()} <= set(range(101))
    rows = [(0, "AUTH-003 x", 5, "s1", {"server": "s1", "username": "bob"}), (10, "AUTH-003: y", 7, "s1", {"server": "s1", "username": "bob"}),
            (20, "AUTH-0035", 9, "s1", {"server": "s1", "username": "bob"}), (30, "AUTH-003", 9, "s1", {"server": "s1"})]
    al = alert_rows(spark, rows)
    first, links, last = build_incidents(al, seeded_rules(), T0 + timedelta(minutes=5))
    (i,) = first.collect()
    assert (i["code"], i["primary_entity_key"], i["count"]) == ("INC-ACC-01", "bob", 2)
    assert sorted(r["alert_id"] for r in links.collect()) == [0, 1]
    old = first.withColumn("id", F.lit(1))
    quiet = build_incidents(al, seeded_rules(), T0 + timedelta(minutes=6), existing=old, last=last)
    assert [r["count"] for r in quiet.incidents.collect()] == [2] and quiet.links.count() == 0 and quiet.last.count() == 1
    again, links, _ = build_incidents(al, seeded_rules(), T0 + timedelta(minutes=6), existing=old)
    (j,) = again.collect()
    assert (j["count"], j["opened_us"], links.count()) == (4, i["opened_us"], 2)


def test_scores_stay_in_range_and_decay_once(spark):
    now = T0 + timedelta(days=40)
    old = spark.createDataFrame([("user", "bob", "local", 20, 0, 0, int(T0.timestamp() * 1e6)), ("user", "eve", "local", 99, 0, 0, int(now.timestamp() * 1e6))],
                                "entity_type string, entity_key string, scope string, score_current int, first_seen_us long, last_seen_us long, score_updated_us long")
    al = alert_rows(spark, [(0, "a", 5, "s", {"username": " Bob"}), (1, "a", 7, "s", {"username": "bob"}), (2, "a", 30, "s", {"username": "eve"}), (3, "a", 0, "s", {"username": "zed"})])
    got = {r["entity_key"]: (r["score_current"], r["severity"]) for r in entity_score(al, old, now).collect()}
    assert got == {"bob": (12, "low"), "eve": (100, "critical"), "zed": (0, "clean")}


def test_nearest_event_reach_and_ties(spark):
    ev = spark.createDataFrame([("s", T0 + timedelta(minutes=m), i, 10 + i) for i, m in enumerate([0, 100, 300, 300])], "server string, timestamp_utc timestamp, id long, log_upload_id long")
    al = spark.createDataFrame([("s", T0 + timedelta(minutes=m), m) for m in (-121, -120, 90, 180, 420, 421, 500)] + [("x", T0, 9)], "server string, triggered_at timestamp, id long")
    got = {r["alert_id"]: r["event_id"] for r in nearest_event(al, ev).collect()}
    assert got == {-121: None, -120: 0, 90: 1, 180: 3, 420: 3, 421: None, 500: None, 9: None}


def _events(spark, rows):
    schema = "id long, source string, server string, ip_client string, username string, t long, extra struct<event_type: string, action: string>"
    df = spark.createDataFrame([(i, "SSH_SECURE", "s1", "44.1.1.1", "u", t * 10**6, ("auth_login", "fail")) for i, t in rows], schema)
    return df.withColumn("timestamp_utc", F.timestamp_micros("t"))


def test_event_table_and_stats(spark, tmp_path):
    ev = _events(spark, [(1, 5), (2, 90_000)]).select("id", "source", "server", "timestamp_utc", F.lit(None).cast("string").alias("service"), F.lit(None).cast("string").alias("message"))
    write_events(ev, str(tmp_path / "ev"))
    back = spark.read.parquet(str(tmp_path / "ev")).orderBy("id").collect()
    assert [(str(r["date"]), r["service"], r["message"]) for r in back] == [("1970-01-01", "SYSTEM", "event"), ("1970-01-02", "SYSTEM", "event")]
    lines = spark.createDataFrame([("f",), ("f",), ("g",)], "file string")
    parsed = spark.createDataFrame([("f", True)], "file string, time_parsed boolean")
    stats = {r["file"]: (r["lines_total"], r["lines_parsed"], r["lines_skipped"]) for r in ingest_stats(lines, parsed).collect()}
    assert stats == {"f": (2, 1, 1), "g": (1, 0, 1)}
