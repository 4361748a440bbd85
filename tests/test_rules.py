"""Rules and alerts on small inputs, against plain expectations and the deque model."""

import random

import pytest
from pyspark.sql import functions as F

from tests.models import cooldown_model, window_model
from tidewatch.operators.rules import EventRule, TrustConfig, condition_error
from tidewatch.plans.alerts import assign_alert_ids, build_alerts, condition_errors

SCHEMA = ("id long, raw_id long, source string, server string, ip_client string, username string, ts long, "
          "extra struct<event_type: string, action: string, http: struct<path: string, status: int>, geo: struct<country_code: string>>")
S = 1_000_000


def make(spark, rows):
    full = [(i, i, "SSH_SECURE", r.get("server", "s1"), r.get("ip", "44.1.1.1"), r.get("user", "u"), r["t"] * S,
             ("auth_login", r.get("action", "fail"), (r.get("path"), r.get("status")), (r.get("cc"),))) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).withColumn("timestamp_utc", F.timestamp_micros("ts"))


def rule(**kw):
    base = dict(id=1, name="r", source="SSH_SECURE", event_type="auth_login", group_by=["server", "username"], window_seconds=10,
                condition="count >= 2", cooldown_seconds=0)
    return EventRule(**{**base, **kw})


def fired(spark, rows, r, trust=None):
    return sorted(a["event_id"] for a in build_alerts(make(spark, rows), [r], trust).collect())


def test_ties_window_edge_and_cooldown_edge(spark):
    rows = [dict(t=0), dict(t=5), dict(t=5), dict(t=15), dict(t=26), dict(t=36)]
    assert fired(spark, rows, rule(condition="count >= 3")) == [2, 3]
    assert fired(spark, rows, rule(cooldown_seconds=10)) == [1, 3, 5]


def test_missing_group_value_and_unknown_name(spark):
    al = build_alerts(make(spark, [dict(t=0, user=None), dict(t=1, user=None)]), [rule()]).collect()
    assert [a["group_key"] for a in al] == ["s1|-"]
    bad = rule(id=2, condition="mystery > 1")
    assert fired(spark, [dict(t=0), dict(t=1)], bad) == []
    assert condition_errors([bad]) == {2: "unknown name: mystery"}
    assert condition_error("count >= 2; drop", ["count"]) and condition_error("count >= 1 and len(x)", ["count"])


@pytest.mark.parametrize("ip, seen", [("10.0.0.1", 0), ("203.0.113.9", 0), ("100.64.1.1", 0), ("fe80::1", 0), ("2a00:1450::1", 1), ("44.1.1.1", 1), ("bogus", 1)])
def test_addresses_that_are_not_global_are_trusted(spark, ip, seen):
    rows = [dict(t=0, ip=ip), dict(t=1, ip=ip)]
    assert len(fired(spark, rows, rule())) == seen
    assert len(fired(spark, rows, rule(emit={"ignore_trust": True}))) == 1


def test_trust_and_lists(spark):
    trust = TrustConfig.from_dict({"trusted_countries": "mx", "lists": {"none": [], "who": ["u"]}})
    rows = [dict(t=0, cc="MX"), dict(t=1, cc="MX"), dict(t=2, cc="FR"), dict(t=3, cc="FR")]
    assert fired(spark, rows, rule(), trust) == [3]
    assert fired(spark, rows, rule(match={"username": {"in_ref": "none"}}), trust) == []
    assert fired(spark, rows, rule(match={"username": {"in_ref": "who"}}), trust) == [3]


def test_alerts_equal_deque_and_greedy_models(spark):
    rnd = random.Random(5)
    rows = [dict(t=rnd.randrange(400), server=rnd.choice(["s1", "s1", "s1", "s2"]), ip=rnd.choice(["44.1.1.1", "44.1.2.1", "44.2.1.1", None]),
                 action=rnd.choice(["fail", "success"]), path=rnd.choice(["/a", "/b", None]), user=f"u{i}") for i in range(300)]
    model = window_model([dict(key=r["server"], t=r["t"], seq=i, path=r["path"], ip=r["ip"] and r["ip"].rsplit(".", 1)[0] + ".0/24", action=r["action"]) for i, r in enumerate(rows)], 30)
    hits = [(rows[i]["server"], rows[i]["t"], i) for i, m in model.items() if m[1] >= 3 and m[4] >= 4]
    want = cooldown_model(hits, 20)
    r = rule(group_by=["server"], window_seconds=30, condition="fail_count >= 3 and top_subnet24_hits >= 4", cooldown_seconds=20, evidence={"last_n": 2})
    got = build_alerts(make(spark, rows), [r], slice_width=77 * S).collect()
    assert sorted((a["group_key"], F_us(a), a["event_id"]) for a in got) == sorted(want)
    for a in got:
        n, fails, paths, nets, top = model[a["event_id"]]
        m = a["metrics"]
        assert (m["count"], m["fail_count"], m["unique_paths"], m["unique_subnets24"], m["top_subnet24_hits"]) == (n, fails, paths, nets, top)
        assert len(a["evidence"]["event_ids"]) == min(2, n) and a["evidence"]["event_ids"][-1] == str(a["event_id"])
    by_group = {}
    for a in got:
        by_group.setdefault(a["group_key"], []).append(F_us(a))
    assert all(b - a >= 20 for ts in by_group.values() for a, b in zip(sorted(ts), sorted(ts)[1:]))


def F_us(a):
    from datetime import timezone

    return round(a["triggered_at"].replace(tzinfo=timezone.utc).timestamp())


def test_alert_ids_are_consecutive(spark):
    al = build_alerts(make(spark, [dict(t=i * 50_000) for i in range(12)]), [rule(condition="")])
    rows = assign_alert_ids(al, 100).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(101, 113))
    assert [r["event_id"] for r in rows] == list(range(12))
