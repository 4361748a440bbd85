"""Normalization, enrichment, retention and range joins."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tidewatch.checks.base import WITH_ALERTS, WITH_SEC, alerts_raw, events, sec_events
from tidewatch.checks.registry import check
from tidewatch.functions.fields import split_address
from tidewatch.functions.net import ip_subnet, ip_to_long, is_non_global, is_private_like
from tidewatch.functions.times import lag_band, lag_seconds, time_range
from tidewatch.operators import enrich, normalize
from tidewatch.operators.rangejoin import range_join
from tidewatch.operators.retention import raw_retention

NOW = datetime(2024, 1, 25, tzinfo=timezone.utc)
NOW_US = 1706140800000000


@check("n1_clean_host", """SELECT page_id, host, CASE WHEN regexp_matches(host, '^([a-z0-9]([a-z0-9-]*[a-z0-9])?\\.)+[a-z]{2,24}$') THEN host END AS clean,
  host AS messy FROM (SELECT page_id, split_part(regexp_extract(lower(url), '^https?://([^/\\s"'']+)', 1), ':', 1) AS host FROM pages) WHERE host <> ''""")
def n1(spark, sf):
    h = F.split_part(F.regexp_extract(F.lower("url"), r"""^https?://([^/\s"']+)""", 1), F.lit(":"), F.lit(1))
    df = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", h.alias("host")).filter("host <> ''")
    messy = normalize.clean_host(F.concat(F.lit(' "<('), F.upper("host"), F.lit(':8443)>;, ')))
    return df.select("page_id", "host", normalize.clean_host(F.col("host")).alias("clean"), messy.alias("messy"))


@check("n2_infer_domain", f"""{WITH_SEC} SELECT event_id, CASE WHEN k % 5 = 4 THEN 'kept.example.org' WHEN k % 5 = 0 THEN server || '.example.com'
    WHEN k % 5 = 1 THEN 'ref-' || server || '.example.net' WHEN k % 5 = 2 THEN 'err.example.net' END AS domain,
  CASE WHEN k % 5 = 0 THEN server || '.example.com' WHEN k % 5 = 1 THEN 'ref-' || server || '.example.net' WHEN k % 5 = 2 THEN 'err.example.net' END AS vhost,
  CASE WHEN k % 5 = 1 THEN 'ref-' || server || '.example.net' END AS referer_host FROM sec""")
def n2(spark, sf):
    df = sec_events(spark, sf).select(
        "event_id", F.expr("CASE k % 5 WHEN 4 THEN 'lfd' WHEN 0 THEN 'nginx_access' ELSE 'apache_access' END").alias("log_type"),
        F.expr("CASE k % 5 WHEN 0 THEN concat('/logs/', server, '.example.com-ssl_log') ELSE '/logs/access' END").alias("file"), "source",
        F.expr("CASE k % 5 WHEN 4 THEN 'kept.example.org' ELSE lower(source) END").alias("domain"),
        F.struct(F.lit(None).cast("string").alias("vhost"),
                 F.expr("CASE k % 5 WHEN 2 THEN 'ERR.example.net:80' WHEN 1 THEN 'other.example.net' END").alias("referer_host"),
                 F.struct(F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("referer_host"),
                          F.expr("CASE k % 5 WHEN 1 THEN concat('https://REF-', server, '.example.net:444/x') END").alias("referer")).alias("http")).alias("extra"))
    out = normalize.infer_domain(df)
    return out.select("event_id", "domain", F.col("extra.vhost").alias("vhost"), F.col("extra.http.referer_host").alias("referer_host"))


@check("n3_split_address", f"{WITH_SEC} SELECT event_id, username AS usr, CASE WHEN k % 2 = 0 THEN server || '.example.com' END AS domain FROM sec")
def n3(spark, sf):
    a = F.expr("concat(' <', username, CASE WHEN k % 2 = 0 THEN concat('@', upper(server), '.Example.com') ELSE '' END, '> ')")
    user, domain = split_address(a)
    return sec_events(spark, sf).select("event_id", user.alias("usr"), domain.alias("domain"))


IP_MIX = """CASE k % 8 WHEN 0 THEN '10.1.2.3' WHEN 1 THEN '172.' || (16 + user_id % 20) || '.0.1' WHEN 2 THEN '100.64.0.' || (user_id % 250)
  WHEN 3 THEN '224.0.0.1' WHEN 4 THEN 'not an ip' WHEN 5 THEN '192.0.0.' || (user_id % 12) WHEN 6 THEN '127.0.0.1' ELSE ip_client END"""
PRIVATE_SQL = "(k % 8 IN (0, 6) OR (k % 8 = 1 AND user_id % 20 < 16) OR (k % 8 = 5 AND user_id % 12 NOT IN (9, 10)))"


@check("n4_ip_math", f"""{WITH_SEC} SELECT event_id, 44 * 16777216 + (user_id % 16) * 65536 + (k % 8) * 256 + user_id % 250 + 1 AS n, subnet24 AS net24,
  '44.' || (user_id % 16) || '.0.0/16' AS net16, NULL::BIGINT AS bad FROM sec""")
def n4(spark, sf):
    ip = F.col("ip_client")
    return sec_events(spark, sf).select("event_id", ip_to_long(ip).alias("n"), ip_subnet(ip).alias("net24"), ip_subnet(ip, 16).alias("net16"),
                                        ip_to_long(F.concat(ip, F.lit("9.1"))).alias("bad"))


def _mixed(spark, sf):
    return sec_events(spark, sf).withColumn("ip", F.expr(IP_MIX)).withColumn("n", ip_to_long(F.col("ip")))


@check("n5_is_private_like", f"{WITH_SEC} SELECT event_id, ({PRIVATE_SQL} OR k % 8 = 3)::BIGINT AS v FROM sec")
def n5(spark, sf):
    return _mixed(spark, sf).select("event_id", is_private_like(F.col("ip"), F.col("n")).cast("bigint").alias("v"))


@check("n6_is_non_global", f"{WITH_SEC} SELECT event_id, ({PRIVATE_SQL} OR k % 8 = 2)::BIGINT AS v FROM sec")
def n6(spark, sf):
    return _mixed(spark, sf).select("event_id", is_non_global(F.col("ip"), F.col("n")).cast("bigint").alias("v"))


def geo_ranges(spark, sf):
    """One /16 per address block in use but one, named after the nations, and one block wider than /16."""
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    n = F.col("n_nationkey").cast("bigint")
    small = nation.filter("n_nationkey < 12 AND n_nationkey <> 5 OR n_nationkey > 15").select(
        (F.lit(738197504) + n * 65536).alias("start_long"), (F.lit(738197504) + n * 65536 + 65535).alias("end_long"), "n_nationkey", "n_name")
    wide = nation.filter("n_nationkey = 12").select(
        (F.lit(738197504) + n * 65536).cast("bigint").alias("start_long"), (F.lit(738197504) + F.lit(15) * 65536 - 1).cast("bigint").alias("end_long"), "n_nationkey", "n_name")
    return small.unionByName(wide).select("start_long", "end_long", F.concat(F.lit("N"), "n_nationkey").alias("country_code"), F.col("n_name").alias("country_name"),
                                          (F.col("n_nationkey") + 100).cast("bigint").alias("number"), F.concat(F.lit("org "), "n_name").alias("org"))


GEO_KEY = "CASE WHEN user_id % 16 < 12 AND user_id % 16 <> 5 THEN user_id % 16 WHEN user_id % 16 BETWEEN 12 AND 14 THEN 12 END"
WITH_GEO = f"{WITH_SEC}, g AS (SELECT sec.*, n_name, n_nationkey FROM sec LEFT JOIN nation ON n_nationkey = {GEO_KEY})"
RANGE_SQL = f"{WITH_GEO} SELECT event_id, 'N' || n_nationkey AS country_code, n_name AS country_name FROM g"


@check("j3_range_join", RANGE_SQL)
def j3(spark, sf):
    df = sec_events(spark, sf).select("event_id", ip_to_long(F.col("ip_client")).alias("ip_long"))
    return range_join(df, "ip_long", geo_ranges(spark, sf).drop("number", "org")).select("event_id", "country_code", "country_name")


@check("j3_range_join_shuffled", f"""{WITH_GEO} SELECT event_id, CASE WHEN event_id % 10 > 0 THEN 'N1' ELSE 'N' || n_nationkey END AS country_code,
  CASE WHEN event_id % 10 > 0 THEN (SELECT n_name FROM nation WHERE n_nationkey = 1) ELSE n_name END AS country_name FROM g WHERE event_id % 20 <> 10
  UNION ALL SELECT event_id, NULL, NULL FROM g WHERE event_id % 20 = 10""")
def j3_shuffled(spark, sf):
    """Nine tenths of the rows have one address, a twentieth has none."""
    address = F.when(F.expr("event_id % 20 = 10"), None).when(F.expr("event_id % 10 > 0"), F.lit("44.1.0.2")).otherwise(F.col("ip_client"))
    df = sec_events(spark, sf).select("event_id", ip_to_long(address).alias("ip_long"))
    return range_join(df, "ip_long", geo_ranges(spark, sf).drop("number", "org")).select("event_id", "country_code", "country_name")


def _bare(spark, sf):
    """Events without geo and operator blocks but for a few known countries; a seventh of the addresses are private."""
    ev = events(spark, sf)
    return ev.withColumn("ip_client", F.expr("CASE WHEN k % 7 = 0 THEN CASE WHEN k % 2 = 0 THEN '127.0.0.1' ELSE '10.0.0.9' END ELSE ip_client END")).withColumn(
        "extra", F.struct("extra.event_type", F.struct(F.expr("CASE WHEN k % 11 = 0 THEN 'ZZ' END").alias("country_code")).alias("geo")))


@check("n7_enrich_geo", f"""{WITH_GEO} SELECT event_id, CASE WHEN k % 11 = 0 THEN 'ZZ' WHEN k % 7 = 0 THEN 'PRV' ELSE coalesce('N' || n_nationkey, 'UNK') END AS cc,
  CASE WHEN k % 11 = 0 THEN NULL WHEN k % 7 = 0 THEN 'Private' ELSE coalesce(n_name, 'Unknown') END AS cn, (k % 7 = 0)::BIGINT AS private FROM g""")
def n7(spark, sf):
    out = enrich.enrich_geo(_bare(spark, sf), geo_ranges(spark, sf))
    return out.select(F.col("id").alias("event_id"), F.col("extra.geo.country_code").alias("cc"), F.col("extra.geo.country_name").alias("cn"),
                      F.col("extra.geoip.is_private").cast("bigint").alias("private"))


@check("n8_enrich_asn", f"{WITH_GEO} SELECT event_id, CASE WHEN k % 7 > 0 THEN n_nationkey + 100 END::BIGINT AS num, CASE WHEN k % 7 > 0 THEN 'org ' || n_name END AS org FROM g")
def n8(spark, sf):
    out = enrich.enrich_asn(_bare(spark, sf), geo_ranges(spark, sf))
    return out.select(F.col("id").alias("event_id"), F.col("extra.asn.number").alias("num"), F.col("extra.asn.org").alias("org"))


# both kinds of address, in networks of five lengths that lie in each other
IP6 = "concat('2a00:', lower(hex(user_id % 16)), ':', lower(hex(k)), '::', CAST(event_id % 7 AS STRING))"
NETWORKS = """SELECT DISTINCT concat('2a00:', lower(hex(user_id % 16)), '::/32') AS network, concat('S', CAST(user_id % 16 AS STRING)) AS cc, CAST(1 AS BIGINT) AS num FROM sec WHERE user_id % 2 = 0
  UNION ALL SELECT DISTINCT concat('2A00:', lower(hex(user_id % 16)), ':', lower(hex(k)), '::/48'), concat('T', CAST(k AS STRING)), CAST(2 AS BIGINT) FROM sec WHERE k % 10 = 0
  UNION ALL SELECT DISTINCT concat('2a00:', lower(hex(user_id % 16)), ':', lower(hex(k)), ':0:0:0:0:5'), 'U', CAST(3 AS BIGINT) FROM sec WHERE k % 3 = 0
  UNION ALL SELECT DISTINCT concat('44.', CAST(user_id % 16 AS STRING), '.0.0/16'), concat('V', CAST(user_id % 16 AS STRING)), CAST(4 AS BIGINT) FROM sec WHERE user_id % 3 = 0
  UNION ALL SELECT DISTINCT subnet24, 'W', CAST(5 AS BIGINT) FROM sec WHERE k % 8 = 3
  UNION ALL SELECT '2a00::/12', 'X', CAST(6 AS BIGINT)"""
BEST = """CASE WHEN v6 THEN CASE WHEN k % 3 = 0 AND event_id % 7 = 5 THEN 3 WHEN k % 10 = 0 THEN 2 WHEN user_id % 2 = 0 THEN 1 ELSE 6 END
  ELSE CASE WHEN subnet24 IN (SELECT subnet24 FROM sec WHERE k % 8 = 3) THEN 5 WHEN user_id % 16 IN (SELECT user_id % 16 FROM sec WHERE user_id % 3 = 0) THEN 4 END END"""


def _both_kinds(spark, sf):
    ev = events(spark, sf)
    ip = F.when(F.expr("k % 4 < 3"), F.expr(IP6.replace("event_id", "id"))).otherwise(F.col("ip_client"))
    bare = ev.withColumn("ip_client", ip).withColumn("extra", F.struct("extra.event_type"))
    return bare, spark.sql(NETWORKS.replace("FROM sec", "FROM {sec}"), sec=sec_events(spark, sf))


@check("n7_networks_of_both_kinds", f"""{WITH_SEC}, b AS (SELECT *, k % 4 < 3 AS v6 FROM sec), c AS (SELECT *, {BEST} AS best FROM b)
  SELECT event_id, CASE best WHEN 1 THEN 'S' || (user_id % 16) WHEN 2 THEN 'T' || k WHEN 3 THEN 'U' WHEN 4 THEN 'V' || (user_id % 16) WHEN 5 THEN 'W' WHEN 6 THEN 'X' ELSE 'UNK' END AS cc, best::BIGINT AS num FROM c""")
def n7_networks(spark, sf):
    ev, nets = _both_kinds(spark, sf)
    out = enrich.enrich(ev, nets.select("network", F.col("cc").alias("country_code"), F.col("cc").alias("country_name")), nets.select("network", F.col("num").alias("number"), F.lit("o").alias("org")))
    return out.select(F.col("id").alias("event_id"), F.col("extra.geo.country_code").alias("cc"), F.col("extra.asn.number").alias("num"))


@check("n9_flag_internal", f"""{WITH_SEC} SELECT event_id, CASE WHEN k % 7 = 0 AND (k % 11 > 0 OR k % 2 = 0) THEN 1 END::BIGINT AS internal,
  CASE WHEN k % 14 = 0 THEN 'loopback' END AS internal_kind FROM sec""")
def n9(spark, sf):
    out = enrich.enrich(_bare(spark, sf), geo_ranges(spark, sf), geo_ranges(spark, sf))
    return out.select(F.col("id").alias("event_id"), F.col("extra.internal").cast("bigint").alias("internal"), F.col("extra.internal_kind").alias("internal_kind"))


@check("n10_drop_redundant_domain", f"{WITH_SEC} SELECT event_id, CASE WHEN k % 3 > 0 THEN path END AS domain FROM sec")
def n10(spark, sf):
    df = sec_events(spark, sf).withColumn("domain", F.expr("CASE WHEN k % 3 = 0 THEN concat(' ', lower(source)) ELSE path END"))
    return normalize.drop_redundant_domain(df).select("event_id", "domain")


FP = """sha256(server || '|' || source || '|' || CASE WHEN source = 'SSH_SECURE' THEN 'SSH' ELSE 'HTTP' END || '||' || strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%S')
  || '+00:00|' || subnet24 || '||' || username || '|' || path)"""


def _repeats(spark, sf):
    s = sec_events(spark, sf)
    return s.select(F.col("event_id").alias("id"), "server", "source", F.expr("CASE WHEN source = 'SSH_SECURE' THEN ' SSH' ELSE 'HTTP' END").alias("service"),
                    F.date_trunc("day", F.timestamp_micros("us")).alias("timestamp_utc"), F.col("subnet24").alias("ip_client"),
                    F.lit(None).cast("string").alias("domain"), F.upper("username").alias("username"), F.concat(F.lit(" "), "path").alias("message"))


@check("n13_fingerprint", f"{WITH_SEC} SELECT event_id AS id, {FP} AS fp FROM sec")
def n13(spark, sf):
    df = _repeats(spark, sf)
    return df.select("id", normalize.fingerprint(df).alias("fp"))


@check("n13_dedupe_events", f"{WITH_SEC} SELECT {FP} AS fp, min(event_id) AS id FROM sec GROUP BY ALL")
def n13_dedupe(spark, sf):
    return normalize.dedupe_events(_repeats(spark, sf)).select(F.col("fingerprint").alias("fp"), "id")


@check("n14_normalize_severity", f"""{WITH_SEC} SELECT v, CASE WHEN v IS NULL OR v IN ('0', '1', 'Info', ' baja', 'x') THEN 'low' WHEN v IN ('2', '7', 'MEDIA') THEN 'medium'
  WHEN v IN ('3', 'high') THEN 'high' ELSE 'critical' END AS severity, count(*) AS n FROM (SELECT
  (['0', '1', '2', '3', '4', '7', 'Info', ' baja', 'MEDIA', 'high', 'Crítica', 'x', NULL])[1 + k % 13] AS v FROM sec) GROUP BY ALL""")
def n14(spark, sf):
    v = F.expr("element_at(array('0', '1', '2', '3', '4', '7', 'Info', ' baja', 'MEDIA', 'high', 'Crítica', 'x', NULL), CAST(1 + k % 13 AS INT))")
    df = sec_events(spark, sf).select(v.alias("v"))
    return df.groupBy("v", normalize.normalize_severity(F.col("v")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@check("n15_raw_retention", f"""{WITH_SEC} SELECT event_id, (CASE k % 12 WHEN 0 THEN true WHEN 1 THEN user_id % 2 = 0 WHEN 2 THEN k >= 60 WHEN 3 THEN 90 + user_id % 5 >= 92
  WHEN 4 THEN status >= 400 WHEN 5 THEN false WHEN 6 THEN true WHEN 7 THEN user_id % 3 > 0 WHEN 8 THEN user_id % 2 = 0 WHEN 9 THEN user_id % 2 = 0
  WHEN 10 THEN user_id % 2 = 1 ELSE false END)::BIGINT AS keep FROM sec""")
def n15(spark, sf):
    pick = lambda *v: F.expr("CASE k % 12 " + " ".join(f"WHEN {i} THEN {x}" for i, x in v) + " END")
    df = sec_events(spark, sf).select(
        "event_id",
        pick((0, "'LFD '"), (1, "'auth'"), (2, "'sar'"), (3, "'sar'"), (4, "'apache_access'"), (5, "'apache_access'"), (6, "'apache_access'"), (7, "'apache_access'"),
             (8, "'exim'"), (9, "'system'"), (10, "'apache_error'"), (11, "'nginx_access'")).alias("log_type"),
        F.lit("S").alias("source"), pick((9, "CASE WHEN user_id % 2 = 0 THEN 'x Invalid User y' ELSE 'quiet' END")).alias("message"),
        F.expr("CASE WHEN k % 12 = 7 AND user_id % 3 = 0 THEN '127.0.0.1' ELSE ip_client END").alias("ip_client"),
        F.struct(
            pick((1, "CASE WHEN user_id % 2 = 0 THEN 'auth_login' ELSE 'x' END"), (2, "'metric'"), (3, "'metric'")).alias("event_type"),
            F.struct(pick((2, "'load'"), (3, "'memory'")).alias("name"), (F.col("k") / 10).alias("ldavg_1"), (90 + F.col("user_id") % 5).cast("double").alias("mem_used_pct")).alias("metric"),
            F.struct(pick((4, "status"), (5, "500")).alias("status"), pick((4, "path"), (5, "'/Server-Status?auto'"), (6, "'/x/WP-login.php'")).alias("path"),
                     pick((7, "'Curl/8'")).alias("user_agent")).alias("http"),
            pick((8, "user_id % 2 = 1")).alias("auth_success"), pick((10, "user_id % 2 = 0")).alias("noise")).alias("extra"))
    return df.select("event_id", raw_retention(df).cast("bigint").alias("keep"))


@check("n16_lag_band", f"""{WITH_SEC}, l AS (SELECT username, ({NOW_US} - max(us)) // 1000000 AS lag FROM sec WHERE us <= {NOW_US} GROUP BY username)
  SELECT username, lag, CASE WHEN lag >= 43200 THEN 'error' WHEN lag >= 7200 THEN 'warning' ELSE 'ok' END AS band FROM l""")
def n16(spark, sf):
    last = sec_events(spark, sf).filter(F.col("us") <= NOW_US).groupBy("username").agg(F.timestamp_micros(F.max("us")).alias("t"))
    lag = lag_seconds(F.col("t"), NOW)
    return last.select("username", lag.alias("lag"), lag_band(lag, 7200, 43200).alias("band"))


@check("n17_time_range", f"""{WITH_SEC} SELECT count_if(us BETWEEN epoch_us(TIMESTAMP '2024-01-05') AND epoch_us(TIMESTAMP '2024-01-08') + 86399000000) AS days,
  count_if(us BETWEEN epoch_us(TIMESTAMP '2024-01-05 10:00:00') AND epoch_us(TIMESTAMP '2024-01-08 12:00:00')) AS exact,
  count_if(us BETWEEN {NOW_US} - 7 * 86400000000 AND {NOW_US}) AS week FROM sec""")
def n17(spark, sf):
    t = F.timestamp_micros("us")
    n = lambda r: F.count_if(t.between(F.lit(r[0]), F.lit(r[1])))
    return sec_events(spark, sf).agg(
        n(time_range(NOW, None, "2024-01-05", "2024-01-08")).alias("days"), n(time_range(NOW, None, "2024-01-05T10:00:00Z", "2024-01-08T06:00:00-06:00")).alias("exact"),
        n(time_range(NOW, None, "2024-01-05", None)).alias("week"))


@check("n18_alert_ip", f"""{WITH_ALERTS} SELECT id, CASE k % 3 WHEN 0 THEN gv_ip WHEN 1 THEN '44.1.1.1' END AS e, CASE WHEN k % 3 = 0 AND gv_ip IS NOT NULL THEN gv_ip
  WHEN k % 3 = 1 THEN '44.1.1.1' ELSE '44.2.' || (k % 8) || '.7' END AS ip FROM alerts""")
def n18(spark, sf):
    df = alerts_raw(spark, sf).select(
        "id", F.struct(F.expr("CASE WHEN k % 3 = 0 THEN gv_ip ELSE '' END").alias("ip_client")).alias("evidence"),
        F.struct(F.expr("CASE WHEN k % 3 = 1 THEN '44.1.1.1' END").alias("ip")).alias("metrics"),
        F.expr("concat('srv|x44|44.2.', k % 8, '.7|z')").alias("group_key"))
    named = F.coalesce(F.nullif("evidence.ip_client", F.lit("")), "metrics.ip")
    return df.select("id", named.alias("e"), normalize.alert_ip(df).alias("ip"))


@check("n19_alert_snippet", f"""{WITH_ALERTS} SELECT id, CASE k % 3 WHEN 0 THEN repeat(rule_name, 400) WHEN 1 THEN 'sample ' || id ELSE '{{' || chr(10) || '  "note": "' || server || '"' || chr(10) || '}}' END AS snippet FROM alerts""")
def n19(spark, sf):
    df = alerts_raw(spark, sf).select("id", F.struct(
        F.expr("CASE WHEN k % 3 = 0 THEN repeat(rule_name, 400) END").alias("raw"), F.expr("CASE WHEN k % 3 = 1 THEN concat('sample ', id) END").alias("sample"),
        F.expr("CASE WHEN k % 3 = 2 THEN server END").alias("note")).alias("evidence"))
    return df.select("id", normalize.alert_snippet(df).alias("snippet"))


@check("n20_entity_servers", f"""{WITH_SEC} SELECT event_id, CASE WHEN k % 2 = 0 THEN 'srvA,' || server || CASE WHEN k % 3 = 0 THEN ',host' || (k % 4) ELSE '' END
  ELSE server || CASE WHEN k % 3 = 0 THEN ',host' || (k % 4) ELSE '' END END AS servers FROM sec""")
def n20(spark, sf):
    df = sec_events(spark, sf).select("event_id", F.struct(
        F.expr("CASE WHEN k % 2 = 0 THEN array('srvA', server, ' ', 'srvA') END").alias("servers"), F.expr("concat(' ', server)").alias("server"),
        F.expr("CASE WHEN k % 3 = 0 THEN concat('host', k % 4) END").alias("hostname")).alias("attrs"))
    return df.select("event_id", F.array_join(normalize.entity_servers(df), ",").alias("servers"))


