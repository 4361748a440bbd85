"""Joins of alerts with the rows of their windows: what is broadcast does not grow with the windows."""

from pyspark.sql import functions as F

from tidewatch.operators.cooldown import apply_cooldown
from tidewatch.operators.rules import EventRule
from tidewatch.operators.staging import staged
from tidewatch.plans.alerts import top_subnets, window_evidence

RULES = [EventRule(1, "all rows", "S", "t", evidence={"last_n": 0}), EventRule(2, "three", "S", "t", evidence={"last_n": 3})]
N = 1500


def _tables(spark):
    key = F.concat(F.lit("g"), F.col("rule_id"))
    metrics = spark.range(1, N + 1).crossJoin(spark.createDataFrame([(1,), (2,)], "rule_id int")).select(
        "rule_id", key.alias("group_key"), "id", F.col("id").alias("n_seen"), F.col("id").alias("raw_id"), F.col("id").alias("count"),
        F.concat(F.lit("10.0."), F.least(F.col("id") % 10, F.lit(4)), F.lit(".0/24")).alias("ip_subnet24"))
    metrics = staged(metrics, "metrics")
    return metrics, staged(metrics.filter(F.col("id") % 500 == 0), "fired")


def _broadcasts(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_evidence_of_long_windows_is_not_broadcast(spark):
    metrics, alerts = _tables(spark)
    found = window_evidence(alerts, metrics, RULES)
    got = {}
    for r in found.collect():
        got.setdefault((r.rule_id, r.alert_event), []).append(r.event_id)
    assert {k: sorted(v) for k, v in got.items()} == {
        (rule, a): list(range(1 if rule == 1 else a - 2, a + 1)) for rule in (1, 2) for a in (500, 1000, 1500)}
    assert _broadcasts(found) == 0


def test_blocks_of_long_windows_are_not_broadcast(spark):
    metrics, alerts = _tables(spark)
    found = top_subnets(alerts, metrics)
    assert {(r.rule_id, r.alert_event, r.top_net, r.top_n) for r in found.collect()} == {
        (rule, a, "10.0.4.0/24", a * 6 // 10) for rule in (1, 2) for a in (500, 1000, 1500)}
    assert _broadcasts(found) == 0


def test_kept_times_are_not_broadcast(spark):
    rows = spark.range(3000).select((F.col("id") % 7).cast("string").alias("key"), F.col("id").alias("t"), F.col("id").alias("seq"), F.lit(70).cast("bigint").alias("wait"))
    found = apply_cooldown(staged(rows, "met"), ["key"], "t", "seq", "wait")
    assert sorted(r.t for r in found.collect()) == [t for t in range(3000) if t // 7 % 10 == 0]
    assert _broadcasts(found) == 0
