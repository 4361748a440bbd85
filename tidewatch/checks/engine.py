"""Rules, windows, cooldowns and alerts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidewatch.checks.base import WITH_SEC, events, sec_events
from tidewatch.checks.registry import check
from tidewatch.functions.fields import group_key
from tidewatch.functions.net import ip_to_long
from tidewatch.operators.cooldown import apply_cooldown
from tidewatch.operators.normalize import keep_first
from tidewatch.operators.rules import (
    event_action, EVENT_CONDITION_NAMES, event_path, EventRule, is_trusted, is_trusted_for_rule, rule_condition, rule_let, rule_match, TrustConfig, with_condition_error,
)
from tidewatch.operators.staging import staged
from tidewatch.operators.windows import sliding_metrics
from tidewatch.operators.tokens import keyed_token_hits
from tidewatch.plans.alerts import build_alerts, events_to_rules, reprocess_rules

DAY = 86_400_000_000
AUTH = "source = 'SSH_SECURE'"
KEY = "server || '|' || username"


def window_cte(name, where=AUTH, key=KEY, w=DAY, source="sec"):
    return f"""{name} AS (SELECT *, {key} AS gk, count(*) OVER w AS n, count(CASE WHEN action = 'fail' THEN 1 END) OVER w AS fail_count,
  count(CASE WHEN action = 'success' THEN 1 END) OVER w AS success_count, count(DISTINCT path) OVER w AS unique_paths, count(DISTINCT ip_client) OVER w AS unique_ips,
  count(DISTINCT username) OVER w AS unique_users, count(DISTINCT server) OVER w AS unique_servers, count(DISTINCT subnet24) OVER w AS unique_subnets24,
  list(event_id) OVER w AS ids, list(subnet24) OVER w AS nets FROM {source} WHERE {where}
  WINDOW w AS (PARTITION BY {key} ORDER BY us RANGE BETWEEN {w} PRECEDING AND CURRENT ROW))"""


def cooldown_cte(name, candidates, cooldown, key="gk"):
    """CTEs ending in `name`(key, us): greedy firing times."""
    return f"""{name}_n AS (SELECT {key}, us, min(us) OVER (PARTITION BY {key} ORDER BY us RANGE BETWEEN {cooldown} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM {candidates}),
{name} AS (SELECT {key}, min(us) AS us FROM {candidates} GROUP BY {key}
  UNION ALL SELECT x.{key}, x.nxt AS us FROM {name} f JOIN {name}_n x ON f.{key} = x.{key} AND f.us = x.us WHERE x.nxt IS NOT NULL)"""


def auth(spark, sf):
    return sec_events(spark, sf).filter(AUTH).withColumn("gk", group_key([F.col("server"), F.col("username")]))


DIMS = ["paths", "ips", "users", "servers", "subnets24"]


def metrics(df, w=DAY, keys=("gk",), **kw):
    cols = dict(zip(DIMS, ["path", "ip_client", "username", "server", "subnet24"]))
    return sliding_metrics(df, list(keys), t="us", seq="event_id", window_us=w, dims={d: F.col(c) for d, c in cols.items()},
                           sums={"fail_count": (F.col("action") == "fail").cast("int"), "success_count": (F.col("action") == "success").cast("int")}, **kw)


METRIC_COLS = "n, fail_count, success_count, unique_paths, unique_ips, unique_users, unique_servers, unique_subnets24"


def metric_sql(where, key, w):
    return f"{WITH_SEC}, {window_cte('m', where, key, w)} SELECT event_id, gk, {METRIC_COLS} FROM m"


@check("w1_sliding_window", metric_sql(AUTH, KEY, DAY))
def w1(spark, sf):
    m = metrics(auth(spark, sf)).withColumnRenamed("count", "n")
    return m.select("event_id", "gk", *METRIC_COLS.split(", "))


@check("a1_window_metrics", metric_sql("true", "server", 6 * 3600_000_000))
def a1(spark, sf):
    m = metrics(sec_events(spark, sf).withColumn("gk", F.col("server")), 6 * 3600_000_000).withColumnRenamed("count", "n")
    return m.select("event_id", "gk", *METRIC_COLS.split(", "))


@check("a2_top_subnet24_hits", f"""{WITH_SEC}, pairs AS (SELECT a.event_id, b.subnet24, count(*) AS c FROM sec a JOIN sec b
  ON a.server = b.server AND b.us BETWEEN a.us - {DAY} AND a.us GROUP BY ALL) SELECT event_id, max(c) AS top_hits FROM pairs GROUP BY event_id""")
def a2(spark, sf):
    df = sec_events(spark, sf)
    return sliding_metrics(df, ["server"], t="us", seq="event_id", window_us=DAY, top_value=F.col("subnet24")).select("event_id", "top_hits")


@check("a3_group_key", f"""{WITH_SEC} SELECT event_id, coalesce(CASE WHEN k % 5 > 0 THEN username END, '-') || '|' || server || '|' || subnet24 AS gk,
  CASE WHEN k % 3 = 0 THEN '-' ELSE username END AS incident_gk FROM sec""")
def a3(spark, sf):
    df = sec_events(spark, sf)
    return df.select("event_id", group_key([F.expr("CASE WHEN k % 5 > 0 THEN username END"), F.col("server"), F.col("subnet24")]).alias("gk"),
                     group_key([F.expr("CASE WHEN k % 3 = 0 THEN '' ELSE username END")], True).alias("incident_gk"))


@check("w2_last_n_evidence", f"""{WITH_SEC}, {window_cte('m')} SELECT event_id, array_to_string(ids[-3:], ',') AS evidence FROM m WHERE fail_count >= 2""")
def w2(spark, sf):
    from tidewatch.plans.alerts import window_evidence

    rule = EventRule(1, "r", "SSH_SECURE", "auth_login", evidence={"last_n": 3})
    m = sliding_metrics(auth(spark, sf).withColumn("rule_id", F.lit(1)).withColumn("group_key", F.col("gk")), ["rule_id", "group_key"],
                        t="us", seq="event_id", window_us=DAY, sums={"fail_count": (F.col("action") == "fail").cast("int")}, numbered=True)
    m = staged(m.withColumnRenamed("event_id", "id").withColumn("raw_id", F.col("id")), "metrics")
    ev = window_evidence(m.filter("fail_count >= 2"), m, [rule])
    return ev.groupBy(F.col("alert_event").alias("event_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_seen", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("evidence"))


@check("w3_cooldown", f"""{WITH_SEC}, c AS (SELECT *, server AS gk FROM sec WHERE action = 'fail'), {cooldown_cte('f', 'c', 7200_000_000)}
SELECT c.event_id, c.gk FROM c JOIN f ON c.gk = f.gk AND c.us = f.us""")
def w3(spark, sf):
    df = sec_events(spark, sf).filter("action = 'fail'").select("event_id", "us", F.col("server").alias("gk"), F.lit(7200_000_000).cast("bigint").alias("cd"))
    return apply_cooldown(df, ["gk"], "us", "event_id", "cd").select("event_id", "gk")


@check("w6_dedupe_keep_first", f"""{WITH_SEC} SELECT username, path, event_id FROM (SELECT *, row_number() OVER (PARTITION BY username, path ORDER BY us, event_id) AS rn FROM sec) WHERE rn = 1""")
def w6(spark, sf):
    return keep_first(sec_events(spark, sf), ["username", "path"], ["us", "event_id"]).select("username", "path", "event_id")


@check("w7_carry_forward", """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w AS last_user_turn,
  last_value(CASE WHEN turn % 4 = 0 THEN role END IGNORE NULLS) OVER w AS header FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def w7(spark, sf):
    from tidewatch.operators.prefix import carry_forward

    df = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.expr("CASE WHEN role = 'user' THEN turn END").alias("u"),
                                                                  F.expr("CASE WHEN turn % 4 = 0 THEN role END").alias("h"), F.expr("turn div 3").alias("b"))
    return carry_forward(df, ["conv_id"], ["turn"], {"u": "last_user_turn", "h": "header"}, "b").select("conv_id", "turn", "last_user_turn", "header")


# ---------------------------------------------------------------- predicates

LISTS = {"paths": ["/p/1", "/p/7"], "users": ["user1", "user2"], "empty": []}
MATCHES = {
    "m_exists": ({"extra.action": {"exists": True}}, "action IS NOT NULL"),
    "m_missing": ({"extra.action": {"exists": False}}, "action IS NULL"),
    "m_eq": ({"extra.http.status": {"eq": 404}}, "status = 404"),
    "m_eq_kind": ({"extra.http.status": {"eq": "404"}}, "false"),
    "m_contains": ({"extra.http.path": {"contains": "/p/1"}}, "contains(path, '/p/1')"),
    "m_any": ({"extra.http.path": {"contains_any": ["/p/3", "", "7"]}}, "(contains(path, '/p/3') OR contains(path, '7'))"),
    "m_any_ref": ({"extra.http.path": {"contains_any_ref": "paths"}}, "(contains(path, '/p/1') OR contains(path, '/p/7'))"),
    "m_range": ({"extra.http.status": {">=": 400, "<": "500"}}, "status >= 400 AND status < 500"),
    "m_in": ({"username": {"in": ["user3", "user4"]}}, "username IN ('user3', 'user4')"),
    "m_in_ref": ({"username": {"in_ref": "users"}}, "username IN ('user1', 'user2')"),
    "m_empty": ({"username": {"in_ref": "empty"}}, "false"),
    "m_bare": ({"server": "srv3", "extra.http.status": 200}, "server = 'srv3' AND status = 200"),
    "m_none": ({}, "true"),
    "m_hidden": ({"message": {"contains": "click"}}, "false"),
}


@check("f1_rule_match", f"{WITH_SEC} SELECT event_id, " + ", ".join(f"({s})::BIGINT AS {n}" for n, (_, s) in MATCHES.items()) + " FROM sec")
def f1(spark, sf):
    ev = events(spark, sf)
    f = lambda m: F.coalesce(rule_match(ev.schema, m, LISTS), F.lit(False)).cast("bigint")
    return ev.select(F.col("id").alias("event_id"), *[f(m).alias(n) for n, (m, _) in MATCHES.items()])


@check("f2_named_lists", f"{WITH_SEC} SELECT event_id, username, path FROM sec WHERE username IN ('user1', 'user2') AND (contains(path, '/p/1') OR contains(path, '/p/7'))")
def f2(spark, sf):
    ev = events(spark, sf)
    test = rule_match(ev.schema, {"username": {"in_ref": "users"}, "extra.http.path": {"contains_any_ref": "paths"}}, LISTS)
    return ev.filter(test).select(F.col("id").alias("event_id"), "username", F.col("extra.http.path").alias("path"))


@check("f2_long_token_lists", """WITH tokens AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS token, item_id FROM benchmark)
SELECT d.doc_id, count(DISTINCT t.item_id) AS items, min(t.item_id) AS first_item FROM documents d JOIN tokens t ON length(t.token) >= 9 AND contains(d.text, t.token) GROUP BY d.doc_id""")
def f2_long(spark, sf):
    """Documents with a long word of each benchmark item, by the index of tokens."""
    words = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.explode(F.split("text", " ")).alias("token"), F.col("item_id").alias("tag")).filter(F.length("token") >= 9)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("key"), "text")
    found = keyed_token_hits(docs, words).groupBy("key").agg(F.count("tag").alias("items"), F.min("tag").alias("first_item"))
    return found.withColumnRenamed("key", "doc_id")


@check("f3_event_field", f"""{WITH_SEC} SELECT event_id, server AS f_server, path AS f_path, subnet24 AS f_net24, '44.' || (user_id % 16) || '.0.0/16' AS f_net16,
  NULL::VARCHAR AS f_message, source || ' ' || path AS f_ext FROM sec""")
def f3(spark, sf):
    from tidewatch.functions.fields import event_field

    ev = events(spark, sf)
    f = lambda p, e=False: event_field(ev.schema, p, e)
    return ev.select(F.col("id").alias("event_id"), f("server").alias("f_server"), f("extra.http.path").alias("f_path"), f("ip_subnet24").alias("f_net24"),
                     f("ip_subnet16").alias("f_net16"), f("message").alias("f_message"),
                     F.concat_ws(" ", "source", F.element_at(F.split(f("message", True), " "), -1)).alias("f_ext"))


TRUST = TrustConfig.from_dict({
    "trusted_countries": ["c1", " C2 "], "trusted_asn_numbers": [64003, "64004", "x"], "trusted_ips": ["44.5.3.0/24", "44.6.1.7", "bad", "10.0.0.0/99"],
    "servers": {"srv7": {"server_ips": ["44.7.0.0/16"]}, "srv1": {"server_ips": []}}, "lists": LISTS,
})
COUNTRY = "CASE WHEN user_id % 16 < 9 THEN 'C' || (user_id % 16) END"
TRUST_SQL = f"""(coalesce({COUNTRY} IN ('C1', 'C2'), false) OR 64000 + user_id % 16 IN (64003, 64004) OR subnet24 = '44.5.3.0/24'
  OR ip_client = '44.6.1.7' OR (server = 'srv7' AND starts_with(ip_client, '44.7.')))"""


@check("f4_is_trusted", f"{WITH_SEC} SELECT event_id, {TRUST_SQL}::BIGINT AS trusted FROM sec")
def f4(spark, sf):
    ev = events(spark, sf).withColumn("ip_long", ip_to_long(F.col("ip_client")))
    return ev.select(F.col("id").alias("event_id"), is_trusted(ev.schema, TRUST).cast("bigint").alias("trusted"))


EMIT = {"trusted_countries_extra": ["c8"], "trusted_ips_extra": "44.9.0.0/21", "trusted_usernames_extra": ["USER10", ""]}


@check("f5_is_trusted_for_rule", f"""{WITH_SEC} SELECT event_id, ({TRUST_SQL} OR coalesce({COUNTRY} = 'C8', false) OR starts_with(ip_client, '44.9.') OR username = 'user10')::BIGINT AS trusted FROM sec""")
def f5(spark, sf):
    ev = events(spark, sf).withColumn("ip_long", ip_to_long(F.col("ip_client")))
    return ev.select(F.col("id").alias("event_id"), is_trusted_for_rule(ev.schema, TRUST, EMIT).cast("bigint").alias("trusted"))


@check("n11_event_action", f"""{WITH_SEC} SELECT event_id, CASE k % 4 WHEN 0 THEN 'fail' WHEN 1 THEN 'success' WHEN 2 THEN 'fail' END AS action FROM sec""")
def n11(spark, sf):
    df = sec_events(spark, sf).select("event_id", F.struct(
        F.expr("CASE k % 4 WHEN 0 THEN ' Failed' WHEN 1 THEN 'OK' WHEN 2 THEN 'other' END").alias("action"),
        F.struct(F.expr("CASE k % 4 WHEN 2 THEN 'FAILED' WHEN 0 THEN 'ok' END").alias("status")).alias("panel")).alias("extra"))
    return df.select("event_id", event_action(df).alias("action"))


@check("n12_event_path", f"{WITH_SEC} SELECT event_id, CASE k % 4 WHEN 0 THEN path WHEN 1 THEN 'panel' WHEN 2 THEN 'waf' END AS p FROM sec")
def n12(spark, sf):
    df = sec_events(spark, sf).select("event_id", F.struct(
        F.struct(F.expr("CASE k % 4 WHEN 0 THEN path WHEN 3 THEN ' ' END").alias("path")).alias("http"),
        F.struct(F.expr("CASE k % 4 WHEN 1 THEN 'panel' END").alias("path")).alias("panel"),
        F.struct(F.expr("CASE k % 4 WHEN 0 THEN 'no' ELSE 'waf' END").alias("uri")).alias("waf")).alias("extra"))
    return df.select("event_id", event_path(df).alias("p"))


CONDITIONS = {
    "c_and": ("status >= 400 and severity > 10", "status >= 400 AND severity > 10"),
    "c_or_not": ("not (status == 200) or severity % 2 == 0", "status <> 200 OR severity % 2 = 0"),
    "c_none": ("action == None", "action IS NULL"),
    "c_ne": ("action != 'fail'", "action IS DISTINCT FROM 'fail'"),
    "c_div": ("severity / zero > 1", "false"),
    "c_div_sum": ("(severity + status) / zero > 1 or (severity + 2) / 2 >= 5", "(severity + 2) / 2.0 >= 5"),
    "c_div_twice": ("severity / 2 / zero > 1 or severity * 3 / 2 / 5 >= 3", "severity * 3 / 2.0 / 5 >= 3"),
    "c_ne_sum": ("severity + 1 != status % zero", "true"),
    "c_empty": ("", "true"),
    "c_arith": ("severity * 2 + 1 >= status - 380", "severity * 2 + 1 >= status - 380"),
}


@check("r1_rule_condition", f"{WITH_SEC} SELECT event_id, " + ", ".join(f"({s})::BIGINT AS {n}" for n, (_, s) in CONDITIONS.items()) + " FROM sec")
def r1(spark, sf):
    df = sec_events(spark, sf).withColumn("zero", F.lit(0))
    return df.select("event_id", *[rule_condition(c).cast("bigint").alias(n) for n, (c, _) in CONDITIONS.items()])


@check("r2_rule_let", f"{WITH_SEC} SELECT event_id, CAST(5 AS BIGINT) AS lit, 'word' AS word, username AS who, CAST(status AS BIGINT) AS code, NULL::VARCHAR AS dotted, CAST(1 AS BIGINT) AS flag FROM sec")
def r2(spark, sf):
    ev = events(spark, sf)
    let = rule_let(ev.schema, {"lit": "5", "word": " word ", "who": "username", "code": "extra.http.status", "dotted": "0.5", "flag": "TRUE"})
    cast = {"lit": "bigint", "code": "bigint", "flag": "bigint"}
    return ev.select(F.col("id").alias("event_id"), *[(c.cast(cast[n]) if n in cast else c).alias(n) for n, c in let.items()])


# ---------------------------------------------------------------- alerts

RULES = [
    EventRule(1, "threshold", "ssh_secure", "AUTH_LOGIN", 12, group_by=["server", "username"], window_seconds=86400,
              condition="fail_count >= 2 and unique_paths >= 2", cooldown_seconds=172800, evidence={"last_n": 3}),
    EventRule(2, "distinct", "APACHE_ACCESS", "http_access", 15, match={"extra.http.status": {">=": 400}}, window_seconds=43200,
              condition="unique_ips >= floor_ips and top_subnet24_hits >= 2", let={"floor_ips": 4}, cooldown_seconds=3600, evidence={"last_n": 4}),
    EventRule(3, "fail then success", "SSH_SECURE", "auth_login", 20, group_by=["ip_client"], window_seconds=259200,
              condition="fail_count >= 1 and success_count >= 1 and count >= need", let={"need": "2"}, cooldown_seconds=0, evidence={"last_n": 2}),
    EventRule(4, "contains", "APACHE_ACCESS", "http_access", 25, match={"extra.http.path": {"contains_any_ref": "paths"}}, group_by=["server"],
              window_seconds=7200, condition="count >= 2", cooldown_seconds=1800, emit=EMIT, evidence={"last_n": 0}),
    EventRule(5, "ignore trust", "APACHE_ACCESS", "http_access", 3, match={"server": "srv1"}, group_by=["username", "extra.geo.country_code"], window_seconds=86400,
              condition="geo_country == 'C1' and count > 1", cooldown_seconds=86400, emit={"ignore_trust": True}),
    EventRule(6, "bad condition", "APACHE_ACCESS", "http_access", condition="nothing_known > 1"),
]
_EXTRA_TRUST = f"({TRUST_SQL} OR coalesce({COUNTRY} = 'C8', false) OR starts_with(ip_client, '44.9.') OR username = 'user10')"
# id, row test, group key, window seconds, condition, cooldown seconds, evidence size
_ORACLE_RULES = [
    (1, f"{AUTH} AND NOT {TRUST_SQL}", KEY, 86400, "fail_count >= 2 AND unique_paths >= 2", 172800, 3),
    (2, f"source = 'APACHE_ACCESS' AND status >= 400 AND NOT {TRUST_SQL}", "server", 43200, "unique_ips >= 4 AND list_max(map_values(histogram_of)) >= 2", 3600, 4),
    (3, f"{AUTH} AND NOT {TRUST_SQL}", "ip_client", 259200, "fail_count >= 1 AND success_count >= 1 AND n >= 2", 0, 2),
    (4, f"source = 'APACHE_ACCESS' AND (contains(path, '/p/1') OR contains(path, '/p/7')) AND NOT {_EXTRA_TRUST}", "server", 7200, "n >= 2", 1800, 0),
    (5, "source = 'APACHE_ACCESS' AND server = 'srv1'", f"username || '|' || coalesce({COUNTRY}, '-')", 86400, f"{COUNTRY} = 'C1' AND n > 1", 86400, 10),
]


def alert_sql(rules=_ORACLE_RULES, source="sec", trusted=TRUST_SQL):
    ctes, picks = [], []
    for rid, where, key, w, cond, cd, n in rules:
        ctes.append(window_cte(f"m{rid}", where, key, w * 1_000_000, source))
        ctes.append(f"h{rid} AS (SELECT *, list_transform(list_distinct(nets), lambda x: struct_pack(c := len(list_filter(nets, lambda y: y = x)), p := -list_position(nets, x), x := x)) AS tops FROM m{rid})")
        cond = cond.replace("list_max(map_values(histogram_of))", "list_max(tops).c")
        ctes.append(f"c{rid} AS (SELECT * FROM h{rid} WHERE {cond})")
        ids = f"ids[-{n}:]" if n else "ids"
        cols = (f"{rid}::BIGINT AS rule_id, c.gk AS group_key, c.us, c.event_id, {METRIC_COLS}, list_max(tops).c AS top_hits, list_max(tops).x AS top_net, "
                f"array_to_string({ids}, ',') AS evidence, ({trusted})::BIGINT AS trusted")
        if cd:
            ctes.append(cooldown_cte(f"f{rid}", f"c{rid}", cd * 1_000_000))
            picks.append(f"SELECT {cols} FROM c{rid} c JOIN f{rid} f ON c.gk = f.gk AND c.us = f.us")
        else:
            picks.append(f"SELECT {cols} FROM c{rid} c")
    return ", ".join(ctes), " UNION ALL ".join(picks)


def alert_rows(al):
    m = "metrics."
    return al.select(
        F.col("rule_id").cast("bigint").alias("rule_id"), "group_key", F.unix_micros("triggered_at").alias("us"), "event_id", F.col(m + "count").alias("n"),
        *[F.col(m + c) for c in METRIC_COLS.split(", ")[1:]], F.col(m + "top_subnet24_hits").alias("top_hits"), F.col(m + "top_subnet24").alias("top_net"),
        F.array_join("evidence.event_ids", ",").alias("evidence"), F.col(m + "trusted").cast("bigint").alias("trusted"))


_CTES, _PICKS = alert_sql()


@check("r3_build_alerts", f"{WITH_SEC}, {_CTES} {_PICKS}")
def r3(spark, sf):
    return alert_rows(build_alerts(events(spark, sf), RULES, TRUST))


_CTES1, _PICKS1 = alert_sql([(1, AUTH, KEY, 86400, "fail_count >= 2 AND unique_paths >= 2", 172800, 3)], trusted="false")


@check("r3_one_rule", f"{WITH_SEC}, {_CTES1} {_PICKS1}")
def r3_one(spark, sf):
    return alert_rows(build_alerts(events(spark, sf), RULES[:1]))


@check("r9_condition_errors", f"""{WITH_SEC} SELECT event_id, CASE k % 5 WHEN 1 THEN 'unknown name: path_' || k WHEN 2 THEN 'unsupported character' WHEN 3 THEN 'unknown name: ' || username END AS error FROM sec""")
def r9(spark, sf):
    """A rule written from each event: good, an unknown name, a forbidden sign, a bare word, a quoted word."""
    rules = sec_events(spark, sf).select("event_id", F.expr("""CASE k % 5 WHEN 0 THEN concat('count >= ', k, ' and fail_count != None') WHEN 1 THEN concat('count >= 1 and path_', k, ' > 2')
      WHEN 2 THEN concat('count >= 1; drop ', server) WHEN 3 THEN concat('username == ', username) ELSE concat("username == '", username, ";'") END""").alias("condition"))
    return with_condition_error(rules, "condition", EVENT_CONDITION_NAMES).select("event_id", "error")


MANY_RULES = [
    EventRule(i, f"rule {i}", "APACHE_ACCESS", "http_access", group_by=["server"], emit={"ignore_trust": i % 2 == 1},
              match={"username": {"in": [f"user{i}", f"user{i + 1}"]}, "extra.http.path": {"contains_any": [f"/p/{i % 100}"]}}) for i in range(500)
]


@check("j1_many_rules", f"""{WITH_SEC} SELECT r.i AS rule_id, event_id, server AS group_key FROM sec JOIN range(500) r(i) ON username IN ('user' || r.i, 'user' || (r.i + 1))
WHERE source = 'APACHE_ACCESS' AND contains(path, '/p/' || (r.i % 100)) AND (r.i % 2 = 1 OR NOT {TRUST_SQL})""")
def j1_many(spark, sf):
    return events_to_rules(events(spark, sf), MANY_RULES, TRUST).select(F.col("rule_id").cast("bigint").alias("rule_id"), F.col("id").alias("event_id"), "group_key")


@check("j1_events_to_rules", f"{WITH_SEC} " + " UNION ALL ".join(
    f"SELECT {rid}::BIGINT AS rule_id, event_id, {key} AS group_key FROM sec WHERE {where}" for rid, where, key, *_ in _ORACLE_RULES)
    + f" UNION ALL SELECT 6::BIGINT, event_id, server FROM sec WHERE source = 'APACHE_ACCESS' AND NOT {TRUST_SQL}")
def j1(spark, sf):
    return events_to_rules(events(spark, sf), RULES, TRUST).select(F.col("rule_id").cast("bigint").alias("rule_id"), F.col("id").alias("event_id"), "group_key")


@check("j2_alert_raw_samples", f"""{WITH_SEC}, {_CTES1}, a AS ({_PICKS1}) SELECT event_id, string_agg('line ' || x, ';' ORDER BY x) AS samples
  FROM (SELECT event_id, unnest(string_split(evidence, ','))::BIGINT AS x FROM a) WHERE x % 2 = 0 GROUP BY event_id""")
def j2(spark, sf):
    raw = sec_events(spark, sf).filter("event_id % 2 = 0").select(F.col("event_id").alias("raw_id"), F.concat(F.lit("line "), "event_id").alias("raw"))
    al = build_alerts(events(spark, sf), RULES[:1], raw_lines=raw)
    return al.filter(F.size("evidence.raw_samples") > 0).select("event_id", F.array_join("evidence.raw_samples", ";").alias("samples"))


T0, T1 = datetime(2024, 1, 10), datetime(2024, 1, 20)
_RANGE = "us BETWEEN 1704844800000000 AND 1705708800000000"
_CTES2, _PICKS2 = alert_sql([(1, f"{AUTH} AND server = 'srv2'", KEY, 86400, "fail_count >= 2 AND unique_paths >= 2", 172800, 3)], "cut", "false")


@check("u2_reprocess_rules", f"""{WITH_SEC}, cut AS (SELECT * FROM sec WHERE {_RANGE}), {_CTES1}, {', '.join([_CTES2.replace('m1', 'q1').replace('h1', 'r1').replace('c1', 's1').replace('f1', 't1')])},
  old AS ({_PICKS1}), new AS ({_PICKS2.replace('c1 c', 's1 c').replace('f1 f', 't1 f')})
  SELECT * FROM old WHERE NOT ({_RANGE} AND split_part(group_key, '|', 1) = 'srv2') UNION ALL SELECT * FROM new""")
def u2(spark, sf):
    ev = events(spark, sf)
    old = build_alerts(ev, RULES[:1])
    return alert_rows(reprocess_rules(ev, old, RULES[:1], TrustConfig(), F.lit(T0), F.lit(T1), "srv2"))
