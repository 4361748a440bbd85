"""The rule index against one expression a rule, and the token index against plain search."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.fields import blank_to_null, event_field, group_key
from tidewatch.functions.net import ip_to_long
from tidewatch.operators.ruleindex import INLINE
from tidewatch.operators.rules import EventRule, TrustConfig, is_trusted_for_rule, rule_match
from tidewatch.operators.tokens import keyed_token_hits, token_hits
from tidewatch.plans.alerts import events_to_rules

SCHEMA = ("id long, raw_id long, source string, server string, ip_client string, username string, ts long, message string, "
          "extra struct<event_type: string, action: string, http: struct<path: string, status: int, size: double>, geo: struct<country_code: string>>")
TRUST = TrustConfig.from_dict({"trusted_countries": ["MX"], "lists": {"few": ["/a", "/b"], "many": [f"/p{i}" for i in range(0, 300, 3)], "none": []}})


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(3)
    pick = lambda *xs: rnd.choice(xs)
    rows = [(i, i, pick("SSH_SECURE", " ssh_secure ", "APACHE_ACCESS", None), pick("s1", "s2", None), pick("44.1.1.1", "10.0.0.1", "44.9.0.7", None, "bad"),
             pick("u1", "U2 ", "u3", "", None), i * 1_000_000, pick("hello", None),
             (pick("auth_login", "AUTH_LOGIN", None), pick("fail", "success", None),
              (pick(None, "", *[f"/p{k}/x" for k in range(0, 40)], "/a/b", "4" * 9), pick(200, 404, None), pick(1.5, 200.0, None)), (pick("MX", "FR", "c8", None),)))
            for i in range(600)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("timestamp_utc", F.timestamp_micros("ts"))


def some_rules(count):
    rnd = random.Random(7)
    conds = [
        lambda i: {"server": rnd.choice(["s1", "s2", 5, None])},
        lambda i: {"username": {"in": [f"u{i % 9}", "u3", None]}},
        lambda i: {"username": {"in": [f"u{i}", "u1"]}},
        lambda i: {"username": {"in_ref": "none"}},
        lambda i: {"extra.http.path": {"contains_any_ref": rnd.choice(["few", "many", "none", "unknown"])}},
        lambda i: {"extra.http.path": {"contains_any": [f"p{i}", "", None, 4], "exists": True}},
        lambda i: {"extra.http.path": {"contains": f"{i % 10}"}},
        lambda i: {"extra.http.status": {">=": 200 + i % 3, "<": "404"}},
        lambda i: {"extra.http.status": {"in": [404, 200.0, "200", True]}},
        lambda i: {"extra.http.size": {"eq": 200}, "extra.action": "fail"},
        lambda i: {"message": {"contains": "hell"}},
        lambda i: {"extra.nothing": {"exists": False}},
        lambda i: {"server": {"eq": ["s1"]}},
        lambda i: {},
    ]
    emits = [{}, {"ignore_trust": True}, {"trusted_usernames_extra": ["U1"]}, {"trusted_countries_extra": ["c8"], "trusted_ips_extra": "44.9.0.0/21"}]
    groups = [["server"], ["ip_client", "username"], ["extra.http.path"], []]
    return [EventRule(i, f"r{i}", rnd.choice(["ssh_secure", "APACHE_ACCESS"]), "Auth_Login", match=conds[i % len(conds)](i), emit=rnd.choice(emits),
                      group_by=rnd.choice(groups), window_seconds=10 + i) for i in range(count)]


@pytest.mark.parametrize("extended", [False, True])
def test_index_equals_one_expression_a_rule(events, extended):
    rules = some_rules(84)
    prepared = events.withColumn("ip_long", ip_to_long(blank_to_null(F.col("ip_client"))))
    schema = prepared.schema
    columns = {}
    for r in rules:
        trusted = is_trusted_for_rule(schema, TRUST, r.emit)
        test = (F.upper(F.trim("source")) == r.source.upper()) & (F.lower("extra.event_type") == "auth_login") & rule_match(schema, r.match, TRUST.lists, extended)
        test = test if r.emit.get("ignore_trust") else test & ~trusted
        columns[r.id] = F.when(test, F.struct(group_key([event_field(schema, f, extended) for f in r.fields]).alias("k"), trusted.alias("t")))
    want = {}
    for at in range(0, len(rules), 42):
        for row in prepared.select("id", *[columns[r.id].alias(str(r.id)) for r in rules[at:at + 42]]).collect():
            want.update({(row["id"], r.id): (row[str(r.id)]["k"], row[str(r.id)]["t"], r.window_seconds * 1_000_000) for r in rules[at:at + 42] if row[str(r.id)]})
    got = events_to_rules(events, rules, TRUST, extended).collect()
    assert len(want) > 1000 and len(got) == len(want)
    assert {(g["id"], g["rule_id"]): (g["group_key"], g["trusted"], g["w"]) for g in got} == want
    for g in got[:50]:
        assert list(g["group_fields"]) == rules[g["rule_id"]].fields


def test_many_rules_keep_generated_code_and_a_plan_in_proportion(events):
    def plan(count):
        rules = [EventRule(i, f"r{i}", "SSH_SECURE", "auth_login", match={"username": f"u{i}", "extra.http.path": {"contains_any": [f"/p{i}/"]},
                           "extra.http.status": {">=": 400 + i % 5}}) for i in range(count)]
        df = events_to_rules(events, rules, TRUST)
        return df, df._jdf.queryExecution().toString()

    df, large = plan(500)
    _, small = plan(125)
    assert len(large) < 5 * len(small)
    got = {(r["id"], r["rule_id"]) for r in df.collect()}
    rows = events.filter("upper(trim(source)) = 'SSH_SECURE' and lower(extra.event_type) = 'auth_login'").collect()
    mine = {(e["id"], k) for e in rows for k in (1, 3) if e["username"] == f"u{k}" and f"/p{k}/" in (e["extra"]["http"]["path"] or "")
            and (e["extra"]["http"]["status"] or 0) >= 400 + k % 5 and e["ip_client"] not in ("10.0.0.1",) and e["extra"]["geo"]["country_code"] != "MX"}
    assert got == mine
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    operators = [line.lstrip(" +-:") for line in final]
    assert any(o.startswith("*") and "Generate explode" in o for o in operators), "\n".join(o[:120] for o in operators)
    # all but the cutting of tokens and texts into n-grams
    assert not [o[:120] for o in operators if o.startswith(("Generate", "Project", "Filter")) and "transform(" not in o]


def test_token_index_equals_search(spark):
    rnd = random.Random(11)
    word = lambda n: "".join(rnd.choice("abé😀 ") for _ in range(n))
    texts = [word(rnd.randrange(0, 60)) for _ in range(200)] + [None, "", "ab" * 20_000, "ab" * 20_000]
    tokens = [(word(rnd.randrange(0, 8)), rnd.randrange(20)) for _ in range(300)] + [(None, 1), ("", 2), ("ab" * 500, 3), ("zzzz", 4), ("ab", 5), ("ab", 6)]
    got = token_hits(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame(tokens, "token string, tag int")).collect()
    want = {(t, tag) for t in texts if t for token, tag in tokens if token and token in t}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    none = spark.createDataFrame([], "token string, tag int")
    assert token_hits(spark.createDataFrame([("abcd",)], "text string"), none).count() == 0


def test_tokens_of_keyed_texts(spark):
    rows = [(1, "ab cd"), (1, "xyz12"), (2, None), (3, ""), (4, "é" * 700_000 + "token"), (5, "xyz12"), (5, "xyz12"), (6, "toke"), (None, "xyz12")]
    tokens = [("ab", 1), ("xyz1", 2), ("z12", 2), ("éétoken", 3), ("c", 4), ("never there", 5)]
    got = keyed_token_hits(spark.createDataFrame(rows, "key long, text string"), spark.createDataFrame(tokens, "token string, tag int")).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 2), (1, 4), (4, 3), (5, 2)]
    empty = spark.createDataFrame([], "key long, text string")
    assert keyed_token_hits(empty, spark.createDataFrame(tokens, "token string, tag int")).count() == 0


def test_a_hundred_thousand_tokens(spark, events):
    tokens = [f"/q{i}" for i in range(100_000)] + ["/p7/"]
    rule = EventRule(1, "r", "SSH_SECURE", "auth_login", match={"extra.http.path": {"contains_any_ref": "long"}, "username": {"in_ref": "names"}}, emit={"ignore_trust": True})
    trust = TrustConfig(lists={"long": tokens, "names": [f"v{i}" for i in range(1000)] + ["u1", "u3"]})
    assert len(tokens) > INLINE
    got = {r["id"] for r in events_to_rules(events, [rule], trust).collect()}
    want = events.filter("upper(trim(source)) = 'SSH_SECURE' and lower(extra.event_type) = 'auth_login' and username in ('u1', 'u3') and extra.http.path like '%/p7/%'")
    assert got == {r["id"] for r in want.collect()} and got
