"""Every detection of the catalogue, on events shaped like its logs.

The given events are sparse (about one per four minutes), so windows are wider and counts lower than
the catalogue's; the operators and conditions are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.checks.base import WITH_SEC, events, sec_events
from tidewatch.checks.engine import cooldown_cte, window_cte
from tidewatch.checks.registry import check
from tidewatch.plans import catalogue

# Same text for both engines: one kind of log per ten values of k.
DET = """
SELECT event_id, us, user_id, k, server, ip_client, subnet24, username, status,
  CASE WHEN k < 50 THEN 'APACHE_ACCESS' WHEN k < 60 THEN 'EXIM_MAINLOG' WHEN k < 70 THEN 'PANEL_LOGIN' WHEN k < 80 THEN 'FILEMANAGER'
    WHEN k < 90 THEN CASE WHEN k = 88 THEN 'APACHE_ERROR' WHEN k % 2 = 0 THEN 'WP_ERROR' ELSE 'SYSTEM' END ELSE CASE WHEN k % 2 = 0 THEN 'MODSEC' ELSE 'SAR_STATS' END END AS source,
  CASE WHEN k < 50 THEN 'http_access' WHEN k < 60 THEN CASE WHEN k % 3 = 0 THEN 'auth_login' ELSE 'mail_flow' END WHEN k < 70 THEN 'auth_login' WHEN k < 80 THEN 'file_action'
    WHEN k < 90 THEN CASE WHEN k % 2 = 0 THEN 'app_error' ELSE 'system_log' END ELSE CASE WHEN k % 2 = 0 THEN 'waf_block' ELSE 'metric' END END AS etype,
  CASE WHEN k >= 50 AND k < 60 AND k % 3 = 0 THEN CASE WHEN user_id % 3 = 0 THEN 'success' ELSE 'fail' END WHEN k >= 60 AND k < 70 THEN CASE WHEN k % 2 = 0 THEN 'fail' ELSE 'success' END END AS action,
  CASE WHEN k < 50 THEN CASE k % 10 WHEN 0 THEN '/wp-login.php' WHEN 1 THEN '/xmlrpc.php' WHEN 2 THEN '/a/.env' WHEN 3 THEN '/x?q=1 UNION Select 2' WHEN 4 THEN '/composer.json' ELSE concat('/p/', CAST(k AS STRING)) END
    WHEN k >= 90 AND k % 2 = 0 THEN concat('/waf/', CAST(k AS STRING)) END AS path,
  CASE k % 10 WHEN 5 THEN 'WPScan 3' WHEN 6 THEN 'SQLMAP' ELSE 'ok' END AS agent,
  CASE WHEN k % 4 = 0 THEN 'HEAD' ELSE 'GET' END AS method,
  CASE user_id % 5 WHEN 0 THEN 'RU' WHEN 1 THEN 'MX' WHEN 2 THEN 'US' WHEN 3 THEN 'FR' END AS country,
  CASE WHEN k >= 80 AND k < 90 THEN CASE WHEN k % 2 = 1 THEN CASE k % 10 WHEN 1 THEN 'ran /tmp/a.sh' WHEN 3 THEN 'Out of memory: kill' WHEN 5 THEN 'x eval(base64 y' ELSE 'quiet /tmp/' END
    ELSE CASE WHEN k IN (80, 88) THEN 'Failed opening required x' ELSE 'other error' END END WHEN k < 50 AND k % 10 = 7 THEN 'GET /wp-admin/ 200' ELSE 'm' END AS message,
  CASE k % 10 WHEN 0 THEN '/home/wp-admin/x.txt' WHEN 1 THEN '/a/installer.php' WHEN 2 THEN '/a/base64.txt' WHEN 3 THEN '/a/Redirect' ELSE '/a/b' END AS fpath,
  CASE WHEN k % 3 = 0 THEN '777' ELSE '644' END AS fmode, CASE WHEN k % 4 = 0 THEN 'Fatal error' ELSE 'Warning' END AS level,
  CASE WHEN k >= 50 AND k < 60 THEN CASE k % 3 WHEN 1 THEN 'retry' WHEN 2 THEN 'invalid_domain' END END AS kind,
  CASE WHEN k >= 50 AND k < 60 THEN 'outbound' END AS direction, k * 100 AS bytes
FROM sec
"""
WITH_DET = f"{WITH_SEC}, det AS ({DET})"


# The same with few accounts and addresses, each seen on several servers.
SHARED = """SELECT event_id, us, user_id, k, server, concat('44.9.', CAST(user_id % 3 AS STRING), '.', CAST(user_id % 5 AS STRING)) AS ip_client,
  concat('44.9.', CAST(user_id % 3 AS STRING), '.0/24') AS subnet24, concat('user', CAST(user_id % 20 AS STRING)) AS username, status, source, etype, action, path,
  agent, method, country, message, fpath, fmode, level, kind, direction, bytes FROM det"""

# The same with few addresses, each used by several accounts.
POOLED = SHARED.replace("concat('44.9.', CAST(user_id % 3 AS STRING), '.', CAST(user_id % 5 AS STRING)) AS ip_client", "concat('44.9.9.', CAST(user_id % 5 AS STRING)) AS ip_client").replace("user_id % 20", "user_id")


def det_events(spark: SparkSession, sf: str, variant: str = "det") -> DataFrame:
    d = spark.sql(DET.replace("FROM sec", "FROM {sec}"), sec=sec_events(spark, sf))
    if variant != "det":
        d = spark.sql({"shared": SHARED, "pooled": POOLED}[variant].replace("FROM det", "FROM {det}"), det=d)
    metric = "source = 'SAR_STATS'"
    return d.select(
        F.col("event_id").alias("id"), "source", "server", "ip_client", "username", F.timestamp_micros("us").alias("timestamp_utc"), "message",
        F.lit(None).cast("string").alias("domain"),
        F.struct(
            F.col("etype").alias("event_type"), "action", "kind", "direction",
            F.struct(F.expr("CASE WHEN k < 50 THEN path END").alias("path"), "status", "method", F.col("agent").alias("user_agent"), "bytes").alias("http"),
            F.struct(F.expr("CASE WHEN k >= 90 THEN path END").alias("uri")).alias("waf"),
            F.expr("CASE WHEN source = 'FILEMANAGER' THEN named_struct('path', fpath, 'action', 'put', 'mode', fmode) END").alias("file"),
            F.expr("CASE WHEN etype = 'app_error' THEN level END").alias("level"),
            F.struct(F.col("country").alias("country_code")).alias("geo"),
            F.expr(f"CASE WHEN {metric} THEN named_struct('ldavg_5', k / 13, 'ldavg_15', user_id / 10, 'mem_used_pct', 80.0D + user_id % 20, 'util_pct', CAST(k AS DOUBLE), 'device', 'sda') END").alias("metric"),
        ).alias("extra"),
    )


def threshold_sql(det_id, where, key, minutes, cond, value, source="det"):
    w = int(minutes * 60_000_000)
    base = {"sec": WITH_SEC, "det": WITH_DET, "shared": f"{WITH_DET}, shared AS ({SHARED})", "pooled": f"{WITH_DET}, pooled AS ({POOLED})"}[source]
    cte = window_cte("m", where, key, w, source)
    if source != "sec":
        cte = cte.replace("list(event_id) OVER w AS ids", "count(DISTINCT source) OVER w AS unique_sources, sum(bytes) OVER w AS total_bytes, list(event_id) OVER w AS ids")
    return (f"{base}, {cte}, c AS (SELECT * FROM m WHERE {cond}), {cooldown_cte('f', 'c', w)} "
            f"SELECT '{det_id}' AS det_id, c.gk AS group_key, c.us, c.event_id, ({value})::BIGINT AS value FROM c JOIN f ON c.gk = f.gk AND c.us = f.us")


def dash(*cols):
    return " || '|' || ".join(f"coalesce({c}, '-')" for c in cols)


MEMBER, ACCOUNT = dash("server", "ip_client"), dash("server", "username")
WEB = "source = 'APACHE_ACCESS'"
# detection, source table, row test, group key, minutes, condition, value, overrides
THRESHOLDS = [
    ("A1", "sec", "action = 'fail'", MEMBER, 4320, "n >= 2", "n", {"failures": 2}),
    ("A2", "pooled", "etype = 'auth_login'", MEMBER, 10080, "unique_users >= 3", "unique_users", {"users": 3}),
    ("A3", "sec", "action IS NOT NULL", ACCOUNT, 1440, "action = 'success' AND fail_count >= 2", "fail_count", {"failures": 2}),
    ("A4", "shared", "etype = 'auth_login' AND source = 'EXIM_MAINLOG'", ACCOUNT, 40320, "unique_ips >= 2", "unique_ips", {"ips": 2}),
    ("A9", "det", "etype = 'auth_login' AND source = 'EXIM_MAINLOG'", MEMBER, 20160, "n >= 2", "n", {"attempts": 2}),
    ("X1", "det", "action = 'fail' AND source = 'EXIM_MAINLOG'", MEMBER, 20160, "n >= 2", "n", {"failures": 2}),
    ("X2", "pooled", "etype = 'auth_login' AND source = 'EXIM_MAINLOG'", MEMBER, 20160, "action = 'success' AND fail_count >= 2", "fail_count", {"failures": 2}),
    ("S1", "sec", "action = 'fail'", MEMBER, 4320, "n >= 2", "n", {"failures": 2}),
    ("W1", "det", WEB, MEMBER, 10080, "n >= 3", "n", {"requests": 3}),
    ("W2", "det", f"{WEB} AND status >= 400", MEMBER, 20160, "unique_paths >= 2 AND n >= 2", "unique_paths", {"paths": 2, "hits": 2}),
    ("W3", "det", f"{WEB} AND path = '/xmlrpc.php'", MEMBER, 20160, "n >= 2", "n", {"hits": 2}),
    ("W4", "det", WEB, "server", 720, "n >= 15", "n", {"requests": 15}),
    ("W5", "det", WEB, MEMBER, 20160, "total_bytes >= 0.01 * 1048576", "total_bytes", {"megabytes": "0.01D"}),
    ("W7", "det", f"{WEB} AND status >= 400", MEMBER, 20160, "n >= 3", "n", {"errors": 3}),
    ("W10", "det", f"{WEB} AND path = '/wp-login.php'", MEMBER, 20160, "n >= 2", "n", {"requests": 2}),
    ("W11", "det", f"{WEB} AND method = 'HEAD'", MEMBER, 20160, "n >= 2", "n", {"requests": 2}),
    ("W12", "det", WEB, dash("server", "subnet24"), 2880, "n >= 6", "n", {"requests": 6}),
    ("W13", "det", "etype = 'waf_block'", MEMBER, 40320, "unique_paths >= 2", "unique_paths", {"uris": 2}),
    ("WP9", "det", f"{WEB} AND path = '/wp-login.php'", MEMBER, 20160, "n >= 2", "n", {"requests": 2}),
    ("WP10", "det", f"{WEB} AND path = '/xmlrpc.php'", MEMBER, 20160, "n >= 2", "n", {"hits": 2}),
    ("M3", "det", "etype = 'file_action'", ACCOUNT, 4320, "n >= 3", "n", {"changes": 3}),
    ("X3", "det", "etype = 'mail_flow' AND direction = 'outbound'", "server", 2880, "n >= 8", "n", {"mails": 8}),
    ("X6", "det", "kind = 'retry'", "server", 2880, "n >= 4", "n", {"retries": 4}),
    ("P1", "det", "source = 'PANEL_LOGIN' AND action = 'fail'", MEMBER, 20160, "n >= 2", "n", {"errors": 2}),
    ("INF2", "det", f"NOT {WEB}", "server", 720, "n >= 9 AND unique_sources >= 3", "n", {"hits": 9, "sources": 3}),
    ("MS1", "shared", "action = 'fail'", "ip_client", 1440, "unique_servers >= 2", "unique_servers", {"servers": 2}),
    ("MS2", "shared", "action = 'fail'", "username", 10080, "unique_servers >= 2", "unique_servers", {"servers": 2}),
    ("MS4", "shared", "action = 'fail'", "subnet24", 720, "unique_servers >= 2", "unique_servers", {"servers": 2}),
]


def _threshold(det_id, source, minutes, overrides):
    def run(spark, sf):
        ev = events(spark, sf) if source == "sec" else det_events(spark, sf, source)
        return catalogue.detect(ev, det_id, minutes=minutes, **overrides)

    return run


for det_id, source, where, key, minutes, cond, value, overrides in THRESHOLDS:
    check(f"det_{det_id.lower()}", threshold_sql(det_id, where, key, minutes, cond, value, source))(_threshold(det_id, source, minutes, overrides))

FOREIGN = "country NOT IN ('MX', 'US', 'CA')"
# detection, row test, group key
FILTERS = [
    ("A5", f"etype = 'auth_login' AND action = 'success' AND (country IS NULL OR {FOREIGN})", dash("username", "country")),
    ("X5", "source = 'EXIM_MAINLOG' AND country = 'RU'", MEMBER),
    ("X4", "kind = 'invalid_domain'", "server || '|-'"),
    ("W6", f"{WEB} AND k % 10 = 3", MEMBER),
    ("W8", f"{WEB} AND k % 10 IN (2, 4)", MEMBER),
    ("W9", f"{WEB} AND k % 10 IN (5, 6)", MEMBER),
    ("M1", "etype = 'file_action' AND k % 10 = 0", ACCOUNT),
    ("M2", "etype = 'file_action' AND k % 3 = 0", ACCOUNT),
    ("M4", "etype = 'file_action' AND k % 10 = 1", ACCOUNT),
    ("M5", "source = 'SYSTEM' AND k % 10 = 5", "server"),
    ("M6", "source = 'WP_ERROR' AND k % 10 = 0", "server || '|-'"),
    ("M7", "etype = 'file_action' AND k % 10 = 2", ACCOUNT),
    ("M8", "etype = 'file_action' AND k % 10 = 1", ACCOUNT),
    ("M9", "etype = 'file_action' AND k % 10 = 3", ACCOUNT),
    ("M10", "source = 'SYSTEM' AND k % 10 = 1", "server"),
    ("WP1", "source = 'WP_ERROR' AND k = 80", "server || '|-'"),
    ("WP5", "source = 'WP_ERROR' AND k % 4 = 0", "server || '|-'"),
    ("WP6", "source = 'WP_ERROR' AND k % 4 > 0", "server || '|-'"),
    ("R1", "source = 'SAR_STATS' AND (k >= 91 OR user_id >= 80)", "server"),
    ("R2", "source = 'SAR_STATS' AND user_id % 20 >= 10", "server"),
    ("R3", "source = 'SAR_STATS' AND k >= 95", "server || '|sda'"),
    ("S4", "source = 'SYSTEM' AND k % 10 = 3", "server"),
    ("R6", "source = 'SYSTEM' AND k % 10 = 3", "server"),
]
for det_id, where, key in FILTERS:
    check(f"det_{det_id.lower()}", f"{WITH_DET} SELECT '{det_id}' AS det_id, {key} AS group_key, us, event_id, CAST(1 AS BIGINT) AS value FROM det WHERE {where}")(
        lambda spark, sf, d=det_id: catalogue.detect(det_events(spark, sf), d))

SUCCESS = "CASE WHEN user_id % 16 < 9 THEN 'C' || (user_id % 16) END"


@check("det_s2", f"{WITH_SEC} SELECT 'S2' AS det_id, username || '|' || coalesce({SUCCESS}, '-') AS group_key, us, event_id, CAST(1 AS BIGINT) AS value FROM sec WHERE action = 'success'")
def s2(spark, sf):
    return catalogue.detect(events(spark, sf), "S2")


@check("det_a6", f"""{WITH_DET} SELECT 'A6' AS det_id, server || '|' || ip_client AS group_key, us, event_id, CAST(1 AS BIGINT) AS value FROM det
  WHERE source = 'PANEL_LOGIN' AND ip_client IN (SELECT ip_client FROM sec WHERE event_type = 'signup')""")
def a6(spark, sf):
    listed = sec_events(spark, sf).filter("event_type = 'signup'").select(F.col("ip_client").alias("ip"))
    return catalogue.panel_from_listed_ip(det_events(spark, sf), listed)


@check("det_a7", f"""{WITH_SEC}, l AS (SELECT *, lag(ip_client) OVER (PARTITION BY username ORDER BY us, event_id) AS prev FROM sec WHERE action IS NOT NULL),
  m AS (SELECT *, username AS gk, sum(CASE WHEN prev <> ip_client THEN 1 ELSE 0 END) OVER (PARTITION BY username ORDER BY us RANGE BETWEEN 172800000000 PRECEDING AND CURRENT ROW) AS changes FROM l),
  c AS (SELECT * FROM m WHERE changes > 3), {cooldown_cte('f', 'c', 172800000000)}
  SELECT 'A7' AS det_id, c.gk AS group_key, c.us, c.event_id, changes::BIGINT AS value FROM c JOIN f ON c.gk = f.gk AND c.us = f.us""")
def a7(spark, sf):
    return catalogue.ip_changes(events(spark, sf), minutes=2880)


@check("det_a8", f"""{WITH_DET} SELECT 'A8' AS det_id, username || '|' || ip_client AS group_key, min(us) AS us, arg_min(event_id, us) AS event_id, CAST(1 AS BIGINT) AS value FROM
  (SELECT event_id, us, username, ip_client, action FROM det WHERE source = 'PANEL_LOGIN' UNION ALL SELECT 100000000 + event_id, us, username, ip_client, action FROM sec WHERE source = 'SSH_SECURE')
  WHERE action = 'success' AND username IN ('user1', 'user2', 'user7', 'user8') GROUP BY username, ip_client""")
def a8(spark, sf):
    """Panel, mail and other logins, and SSH logins of the plain events."""
    plain = ["id", "source", "server", "ip_client", "username", "timestamp_utc", F.struct("extra.event_type", "extra.action").alias("extra")]
    ssh = events(spark, sf).withColumn("id", F.col("id") + 100000000).select(*plain)
    return catalogue.login_from_new_ip(det_events(spark, sf).select(*plain).unionByName(ssh), "A8", usernames=["User1", "user2", "user7", "user8"])


NEW_PANEL = f"""{WITH_DET} SELECT '{{0}}' AS det_id, username || '|' || ip_client AS group_key, min(us) AS us, arg_min(event_id, us) AS event_id, CAST(1 AS BIGINT) AS value FROM det
  WHERE {{1}} AND action = 'success' AND (username, ip_client) NOT IN (SELECT (username, ip_client) FROM sec WHERE event_type = 'signup') GROUP BY username, ip_client"""


def _history(spark, sf):
    return sec_events(spark, sf).filter("event_type = 'signup'").select("username", F.col("ip_client").alias("ip"))


@check("det_p2", NEW_PANEL.format("P2", "source = 'PANEL_LOGIN'"))
def p2(spark, sf):
    return catalogue.login_from_new_ip(det_events(spark, sf), "P2", history=_history(spark, sf))


@check("det_p5", NEW_PANEL.format("P5", "source = 'PANEL_LOGIN' AND username IN ('user3', 'user5', 'user9')").replace("event_type = 'signup'", "false"))
def p5(spark, sf):
    return catalogue.login_from_new_ip(det_events(spark, sf), "P5", usernames=["user3", "user5", "user9"])


@check("det_ms3", f"""{WITH_DET}, {window_cte('m', WEB, "server || '|' || 'net' || (user_id % 3)", 600_000_000, 'det')},
  c AS (SELECT * FROM m WHERE n >= 2), {cooldown_cte('f', 'c', 600_000_000)},
  h AS (SELECT c.server, 'net' || (user_id % 3) AS ip, c.us, c.event_id FROM c JOIN f ON c.gk = f.gk AND c.us = f.us UNION ALL SELECT server, 'net' || (user_id % 3), us, event_id FROM det WHERE {WEB} AND k % 10 IN (5, 6))
  SELECT 'MS3' AS det_id, ip AS group_key, min(us) AS us, arg_min(event_id, (us, event_id)) AS event_id, count(DISTINCT server) AS value FROM h GROUP BY ip HAVING count(DISTINCT server) >= 2""")
def ms3(spark, sf):
    shared = det_events(spark, sf).withColumn("ip_client", F.concat(F.lit("net"), (F.substring("username", 5, 9).cast("bigint") % 3).cast("string")))
    return catalogue.bot_seen_globally(shared, minutes=10, requests=2)


@check("det_ms5", f"""{WITH_SEC} SELECT * FROM (SELECT 'MS5' AS det_id, 'user' || (user_id % 20) AS group_key, a.us, a.event_id, (SELECT count(*) FROM sec b WHERE b.user_id % 20 = a.user_id % 20 AND b.action = 'fail' AND b.server <> a.server
    AND b.us BETWEEN a.us - 7200000000 AND a.us) AS value FROM sec a WHERE action = 'success') WHERE value > 0""")
def ms5(spark, sf):
    shared = events(spark, sf).withColumn("username", F.concat(F.lit("user"), (F.col("user_id") % 20).cast("string")))
    return catalogue.fail_then_success_elsewhere(shared, minutes=120)
