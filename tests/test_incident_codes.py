"""Codes of incident rules are looked up: right for every separator, and not one test for each code of each rule."""

from pyspark.sql import functions as F

from tidewatch.plans.incidents import IncidentRule, alerts_to_rules, seeded_rules

CODES = ["A-1", "A", "AB", "X-20", "X-2"]
NAMES = ["A-1", " A-1 x", "A-12", "A\tb", "A:b", "Ab", "AB", "AB-", "X-20 y", "X-2", "X-2:", "x-2", "", None, "é A", "A_1"]


def alerts(spark, names):
    made = [(i, n, i % 4, "s1", {"server": "s1"}) for i, n in enumerate(names)]
    df = spark.createDataFrame(made, "id long, rule_name string, severity int, server string, g map<string,string>")
    return df.select("id", "rule_name", "severity", "server", F.timestamp_micros(F.col("id")).alias("triggered_at"), F.struct(F.col("g").alias("group_values")).alias("evidence"))


def rule(i, match):
    return IncidentRule(i, f"I-{i}", "n", "host", "server", match, ["server"])


def test_a_code_ends_at_a_separator_or_with_the_name(spark):
    rules = [rule(1, {"alert_codes_any": ["A-1", "A"]}), rule(2, {"alert_codes_any": ["AB", "X-2"], "min_severity": 1}), rule(3, {}), rule(4, {"alert_codes_any": []}), rule(5, {"alert_codes_any": "X-20"})]
    codes = {1: ["A-1", "A"], 2: ["AB", "X-2"], 5: ["X-20"]}
    want = [(i, 3) for i in range(len(NAMES))]
    for r, of_rule in codes.items():
        for i, n in enumerate(NAMES):
            name = (n or "").strip(" ")
            if any(name == c or name.startswith(tuple(c + s for s in " \t-:")) for c in of_rule) and (r != 2 or i % 4 >= 1):
                want.append((i, r))
    got = alerts_to_rules(alerts(spark, NAMES), rules).select("id", "rule_id").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_the_plan_has_no_test_for_each_code(spark):
    plan = alerts_to_rules(alerts(spark, NAMES), seeded_rules())._jdf.queryExecution().optimizedPlan().toString()
    assert "StartsWith" not in plan and plan.count("group_values") < 200
