"""Inputs of the registered queries, derived from the given tables by SQL both engines accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEC = """
SELECT e.*,
  concat('srv', CAST(user_id % 8 AS STRING)) AS server,
  concat('44.', CAST(user_id % 16 AS STRING), '.', CAST(k % 8 AS STRING), '.', CAST(user_id % 250 + 1 AS STRING)) AS ip_client,
  concat('44.', CAST(user_id % 16 AS STRING), '.', CAST(k % 8 AS STRING), '.0/24') AS subnet24,
  concat('user', CAST(user_id AS STRING)) AS username,
  CASE WHEN event_type IN ('view','click') THEN 'APACHE_ACCESS' ELSE 'SSH_SECURE' END AS source,
  CASE WHEN event_type IN ('view','click') THEN 'http_access' ELSE 'auth_login' END AS sec_event_type,
  CASE WHEN event_type = 'error' THEN 'fail' WHEN event_type IN ('signup','purchase') THEN 'success' END AS action,
  concat('/p/', CAST(k % 20 AS STRING)) AS path,
  CASE WHEN k % 10 = 0 THEN 500 WHEN k % 10 < 3 THEN 404 ELSE 200 END AS status,
  1 + k % 30 AS severity
FROM (SELECT event_id, ts, {us} AS us, user_id, event_type, value,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM {events}) e
"""

# Alerts derived from the same rows; a bar joins server and username.
ALERTS = """
SELECT event_id + 1 AS id,
  CASE event_type WHEN 'error' THEN 'AUTH-003 success after failures' WHEN 'signup' THEN 'AUTH-005 login geo'
    WHEN 'purchase' THEN 'MAIL-002 takeover' WHEN 'click' THEN 'WEB-001 scan' ELSE 'WEB-003 exploit' END AS rule_name,
  severity, server, source, sec_event_type AS event_type, concat(server, '|', username) AS group_key, us,
  CASE k % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'triage' WHEN 2 THEN 'closed' ELSE 'false_positive' END AS status,
  CASE WHEN k % 5 = 0 THEN NULL ELSE username END AS gv_username,
  CASE WHEN k % 7 = 0 THEN NULL ELSE ip_client END AS gv_ip,
  CASE WHEN user_id % 16 < 9 THEN concat('C', CAST(user_id % 16 AS STRING)) END AS gv_country,
  CASE WHEN k % 3 = 0 THEN NULL ELSE 64000 + user_id % 16 END AS gv_asn,
  user_id, k
FROM sec
"""

SEC_DUCK = SEC.format(us="epoch_us(ts)", events="events")
WITH_SEC = f"WITH RECURSIVE sec AS ({SEC_DUCK})"
WITH_ALERTS = f"{WITH_SEC}, alerts AS ({ALERTS})"


def sec_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    table = f"parquet.`{sf_dir}/events.parquet`"
    return spark.sql(SEC.format(us="unix_micros(CAST(ts AS TIMESTAMP))", events=table))


def alerts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    sec = sec_events(spark, sf_dir)
    return spark.sql(ALERTS.replace("FROM sec", "FROM {sec}"), sec=sec)


def spread(rows: DataFrame) -> DataFrame:
    """The same rows in enough tasks for all cores, however few row groups the file has."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism)


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert rows in the library's shape: triggered_at and evidence.group_values."""
    raw = spark.sql(ALERTS.replace("FROM sec", "FROM {sec}"), sec=spread(sec_events(spark, sf_dir)))
    names = {
        "server": "server", "username": "gv_username", "ip_client": "gv_ip",
        "extra.geo.country_code": "gv_country", "extra.asn.number": "gv_asn",
    }
    values = F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]), F.array(*[F.col(c).cast("string") for c in names.values()])
    )
    return raw.select(
        "id", "rule_name", F.col("severity").cast("int").alias("severity"), "server", "source", "event_type", "group_key",
        F.timestamp_micros("us").alias("triggered_at"), "us", "status", "user_id", "k",
        F.struct(F.map_filter(values, lambda k, v: v.isNotNull()).alias("group_values")).alias("evidence"),
        F.struct(F.col("k").alias("count")).alias("metrics"),
        F.lit(None).cast("string").alias("disposition"),
        F.lit(None).cast("string").alias("resolution_note"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized events in the library's shape."""
    s = spread(sec_events(spark, sf_dir))
    return s.select(
        F.col("event_id").alias("id"), F.col("event_id").alias("raw_id"), "source", "server",
        F.when(F.col("source") == "SSH_SECURE", "SSH").otherwise("HTTP").alias("service"),
        "ip_client", "username", F.timestamp_micros("us").alias("timestamp_utc"),
        F.concat_ws(" ", F.col("event_type"), "path").alias("message"),
        F.lit(None).cast("string").alias("domain"),
        F.struct(
            F.col("sec_event_type").alias("event_type"), "action",
            F.struct("path", "status", (F.col("k") * 100).alias("bytes")).alias("http"),
            F.struct(F.when(F.col("user_id") % 16 < 9, F.concat(F.lit("C"), (F.col("user_id") % 16).cast("string"))).alias("country_code")).alias("geo"),
            F.struct((F.col("user_id") % 16 + 64000).alias("number"), F.lit("org").alias("org")).alias("asn"),
        ).alias("extra"),
        "us", "k", "user_id", "event_type", "value",
    )

# ---------------------------------------------------------------- operational tables

INCIDENTS = """
SELECT user_id + 1 AS id, CASE user_id % 3 WHEN 0 THEN 'INC-ACC-01' WHEN 1 THEN 'INC-WEB-01' ELSE 'INC-MAIL-01' END AS code,
  concat('case ', CAST(user_id AS STRING)) AS name, 'local' AS scope,
  CASE user_id % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'triage' WHEN 2 THEN 'contained' WHEN 3 THEN 'closed' ELSE 'false_positive' END AS status,
  CAST(60 AS BIGINT) AS severity_base, 50 + user_id % 50 AS severity_current, user_id % 101 AS score,
  concat('srv', CAST(user_id % 8 AS STRING)) AS server, 'user' AS primary_entity_type, concat('user', CAST(user_id AS STRING)) AS primary_entity_key,
  min(us) AS opened_us, max(us) AS last_us, count(*) AS count, CAST(2 AS BIGINT) AS unique_alerts, CAST(1 AS BIGINT) AS unique_servers,
  max(severity) AS max_severity, CAST(sum(severity) AS BIGINT) AS sum_severity, CAST(3600 AS BIGINT) AS window_seconds, 'old' AS group_key
FROM alerts GROUP BY user_id
"""
ENTITIES = """
SELECT user_id + 1 AS id, CASE WHEN user_id % 4 = 0 THEN 'ip' ELSE 'user' END AS entity_type,
  CASE WHEN user_id % 4 = 0 THEN concat('44.0.0.', CAST(user_id AS STRING)) ELSE concat('user', CAST(user_id AS STRING)) END AS entity_key,
  (user_id * 7) % 101 AS score_current, CASE WHEN user_id % 6 = 0 THEN 'closed' WHEN user_id % 6 = 1 THEN 'odd' END AS state,
  concat('srv', CAST(user_id % 8 AS STRING)) AS server, max(us) AS last_us, max(us) + user_id AS updated_us, min(us) AS first_us,
  CASE WHEN user_id % 16 < 9 THEN concat('c', CAST(user_id % 16 AS STRING)) END AS cc, CASE WHEN user_id % 8 < 6 THEN 64000 + user_id % 8 END AS asn
FROM alerts GROUP BY user_id
"""
ALERT_LINKS = "SELECT user_id + 1 AS incident_id, id AS alert_id FROM alerts WHERE k % 3 = 0"
ENTITY_LINKS = """
SELECT DISTINCT user_id + 1 AS incident_id, user_id + 1 AS entity_id, 'primary' AS relation FROM alerts
UNION ALL SELECT DISTINCT user_id + 1, (user_id + 3) % 100 + 1, NULL FROM alerts
"""
UPLOADS = """
SELECT user_id + 1 AS id, concat('srv', CAST(user_id % 8 AS STRING)) AS server,
  CASE user_id % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'parsing' WHEN 2 THEN 'parsed' WHEN 3 THEN 'processing_engine' WHEN 4 THEN 'error' ELSE 'processed' END AS status,
  min(us) + user_id * 14400000000 AS uploaded_us, CASE WHEN user_id % 3 > 0 THEN user_id END AS user_id, user_id % 7 + 1 AS api_key_id
FROM sec GROUP BY user_id
"""
API_KEYS = "SELECT DISTINCT user_id % 7 + 1 AS id, CASE WHEN user_id % 7 < 6 THEN user_id % 7 + 501 END AS created_by_user_id FROM sec"
QUEUE = """
SELECT event_id AS id, user_id + 1 AS log_upload_id, server, us,
  CASE WHEN user_id % 12 = 3 THEN 'done' ELSE CASE k % 20 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'error' ELSE 'done' END END AS engine_status
FROM sec
"""
WITH_OPS = (
    f"{WITH_ALERTS}, incidents AS ({INCIDENTS}), entities AS ({ENTITIES}), alert_links AS ({ALERT_LINKS}), "
    f"entity_links AS ({ENTITY_LINKS}), uploads AS ({UPLOADS}), api_keys AS ({API_KEYS}), queue AS ({QUEUE})"
)


def _derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    sec = sec_events(spark, sf_dir)
    if "FROM sec" in sql:
        return spark.sql(sql.replace("FROM sec", "FROM {sec}"), sec=sec)
    return spark.sql(sql.replace("FROM alerts", "FROM {alerts}"), alerts=alerts_raw(spark, sf_dir))


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = F.lit(None)
    return _derive(spark, sf_dir, INCIDENTS).withColumns({
        "last_activity_at": F.timestamp_micros("last_us"), "opened_at": F.timestamp_micros("opened_us"), "created_at": F.timestamp_micros("opened_us"),
        "disposition": null.cast("string"), "closed_at": null.cast("timestamp"), "resolved_by": null.cast("string"),
    })


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.plans.entities import score_severity

    e = _derive(spark, sf_dir, ENTITIES)
    return e.select(
        "id", "entity_type", "entity_key", "score_current", score_severity(F.col("score_current")).alias("severity"), F.lit("local").alias("scope"),
        F.struct(
            "state", "server", F.struct(F.col("cc").alias("country_code"), F.expr("CASE WHEN id % 2 = 0 THEN concat('Land ', cc) END").alias("country_name")).alias("geo"),
            F.struct(F.col("asn").alias("number"), F.expr("CASE WHEN id % 3 > 0 THEN 'Net' END").alias("org")).alias("asn"),
        ).alias("attrs"),
        F.timestamp_micros("last_us").alias("last_seen_at"), F.timestamp_micros("updated_us").alias("updated_at"), "last_us", "first_us", "updated_us",
    )


def alert_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, ALERT_LINKS)


def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, ENTITY_LINKS.replace("SELECT DISTINCT user_id + 1, (", "SELECT DISTINCT user_id + 1 AS incident_id, ("))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, UPLOADS).withColumn("uploaded_at", F.timestamp_micros("uploaded_us"))


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, API_KEYS)


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, QUEUE).withColumn("created_at", F.timestamp_micros("us")).withColumn("timestamp_utc", F.timestamp_micros("us"))
