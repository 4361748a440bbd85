"""Raw log lines in, event tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.prefix import numbered
from tidewatch.sources.content import stream_lines_by_content

# Tag of a shipped log -> log type.
LOG_TYPE_OF_TAG = {
    "access_log": "apache_access",
    "apache_access": "apache_access",
    "apache": "apache_access",
    "apache_error": "apache_error",
    "apache_error_log": "apache_error",
    "nginx_access": "nginx_access",
    "nginx": "nginx_access",
    "nginx_domlogs": "nginx_access",
    "nginx_domains": "nginx_access",
    "exim_mainlog": "exim_mainlog",
    "exim": "exim_mainlog",
    "maillog": "maillog",
    "dovecot": "maillog",
    "wp_error_log": "wp_error_log",
    "wp": "wp_error_log",
    "modsec": "modsec",
    "secure": "secure",
    "lfd": "lfd",
    "lfd_log": "lfd",
    "system": "system",
    "messages": "system",
    "cpanel": "cpanel_access",
    "cpanel_access": "cpanel_access",
    "panel_logs": "panel_logs",
    "login_log": "panel_logs",
    "sar": "sar",
}
# Further names accepted by the older ingestion job.
LEGACY_LOG_TYPES = {
    "http_access": "apache_access", "domlog": "apache_access", "domlogs": "apache_access",
    "error_log": "apache_error", "apache_err": "apache_error", "http_error": "apache_error",
    "wordpress_error": "wp_error_log", "wp_error": "wp_error_log",
    "modsec_audit": "modsec", "modsec_audit_log": "modsec", "modsecurity": "modsec",
    "ssh": "secure", "ssh_secure": "secure", "system_secure": "secure",
    "panel": "panel_logs", "lfd.log": "lfd", "filemanager": "filemanager",
    "syslog": "system", "sar_stats": "sar",
}
MAX_LINE_ERRORS = 5000


def read_log_lines(
    spark: SparkSession, paths: str | list[str], server: str | Column, log_type: str | Column | None = None, *, number: bool = True
) -> DataFrame:
    """Lines of plain or .gz text files with their file and 1-based line number.

    Plain files are read in splits; numbers come from counts per split, so no file is read by one task.
    Without `number` the (split start, order) pair is kept instead, which saves a pass for line-local logs.
    """
    lines = spark.read.text(paths).select(
        F.make_valid_utf8("value").alias("raw"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("in_split"),
        (server if isinstance(server, Column) else F.lit(server)).alias("server"),
        (log_type if isinstance(log_type, Column) else F.lit(log_type).cast("string")).alias("log_type"),
    )
    if not number:
        return lines
    return numbered(lines, ["file"], ["split", "in_split"], "split", "line_no").drop("split", "in_split")


def stream_log_lines(spark: SparkSession, folder: str, server: str, log_type: str) -> DataFrame:
    """New files of a folder as a stream of numbered lines; each file is read once per checkpoint.

    Packed files are known by their first bytes; see `sources/content.py`, which has further parameters.
    """
    return stream_lines_by_content(spark, folder, server, log_type)


def _lookup(key: Column, table: dict[str, str]) -> Column:
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(entries, key)


def resolve_log_type(df: DataFrame, tag: str = "tag", filename: str = "filename", legacy: bool = False) -> DataFrame:
    """Add `log_type` from the tag, else from the file name; null where neither is known (the rejects)."""
    table = {**LOG_TYPE_OF_TAG, **LEGACY_LOG_TYPES} if legacy else LOG_TYPE_OF_TAG
    name = F.lower(F.trim(F.col(filename)))
    by_name = F.when(name.endswith("_log"), "nginx_access").when(name.startswith("maillog"), "maillog")
    return df.withColumn("log_type", F.coalesce(_lookup(F.lower(F.trim(F.col(tag))), table), by_name))


def by_log_type(lines: DataFrame, path: str) -> DataFrame:
    """The lines written once to folders of their log type and read back, so that each parser of `parse_all` opens its own lines only."""
    lines.filter(F.col("log_type").isNotNull()).hint("rebalance", "log_type").write.partitionBy("log_type").parquet(path)
    return lines.sparkSession.read.schema(lines.schema).parquet(path)


def skip_already_ingested(lines: DataFrame, events: DataFrame) -> DataFrame:
    """Lines of files that have no events yet."""
    return lines.join(events.select("file").distinct(), "file", "left_anti")


def ingest_stats(lines: DataFrame, events: DataFrame, retained: Column | None = None) -> DataFrame:
    """Per file: total, parsed, skipped and failed lines, events and kept raw lines.

    A line fails when it was parsed but its time could not be read.
    """
    kept = retained if retained is not None else F.lit(False)
    total = lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines_total"))
    parsed = events.groupBy("file").agg(
        F.count(F.lit(1)).alias("events_created"),
        F.count_if(~F.col("time_parsed")).alias("lines_failed"),
        F.count_if(kept).alias("raw_saved"),
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return total.join(parsed, "file", "left").select(
        "file", "lines_total",
        (n("events_created") - n("lines_failed")).alias("lines_parsed"),
        (F.col("lines_total") - n("events_created")).alias("lines_skipped"),
        n("lines_failed").alias("lines_failed"),
        n("events_created").alias("events_created"),
        n("raw_saved").alias("raw_saved"),
    )


def too_many_errors(stats: DataFrame, limit: int = MAX_LINE_ERRORS) -> DataFrame:
    """Files whose failed lines reach the limit."""
    return stats.filter(F.col("lines_failed") >= limit)


def with_event_defaults(events: DataFrame) -> DataFrame:
    """Fill missing server, service, source and message, and add the stored columns `date` and `id`."""
    fill = {"server": "unknown", "service": "SYSTEM", "source": "unknown", "message": "event"}
    out = events.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})
    if "id" not in out.columns:
        out = out.withColumn("id", F.sha2(F.concat_ws("|", "file", F.col("line_no").cast("string")), 256))
    return out.withColumn("date", F.to_date("timestamp_utc"))


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Event table partitioned by day and source."""
    out = with_event_defaults(events)
    # adaptive execution splits what is large and joins what is small, so a busy source has as many writers as its rows need
    out.hint("rebalance", "date", "source").write.mode(mode).partitionBy("date", "source").parquet(path)


def incremental_alerts(alerts: DataFrame, last_id: int = 0, from_ts=None, from_id: int | None = None) -> DataFrame:
    """Alerts after the cursor. `from_ts` restarts at the first id triggered at or after it; `from_id` wins over both."""
    if from_id is not None:
        return alerts.filter(F.col("id") > from_id)
    if from_ts is None:
        return alerts.filter(F.col("id") > last_id)
    first = alerts.filter(F.col("triggered_at") >= from_ts).agg(F.min("id")).scalar()
    return alerts.filter(F.when(first.isNull(), F.col("id") > last_id).otherwise(F.col("id") >= first))


# ---------------------------------------------------------------- export


def export_tables(
    tables: dict[str, DataFrame],
    since,
    dispositions: dict[str, list[str]] | None = None,
    statuses: list[str] | None = None,
) -> dict[str, DataFrame]:
    """Tables restricted by time, disposition and status, newest first."""
    times = {"events": "timestamp_utc", "alerts": "triggered_at", "incidents": "last_activity_at", "entities": "updated_at"}
    out = {}
    for name, df in tables.items():
        if name not in times:
            out[name] = df.orderBy(F.desc("id"))
            continue
        kept = df.filter(F.col(times[name]) >= since)
        wanted = (dispositions or {}).get(name)
        if wanted:
            kept = kept.filter(F.col("disposition").isin(wanted))
        if statuses and name in ("alerts", "incidents"):
            kept = kept.filter(F.col("status").isin(statuses))
        out[name] = kept.orderBy(F.desc(times[name]))
    return out


def write_csv(tables: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder per table; nested columns as JSON text."""
    for name, df in tables.items():
        flat = [
            F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("struct", "map", "array", "variant") else F.col(c)
            for c in df.columns
        ]
        df.select(*flat).write.mode("overwrite").csv(f"{folder}/{name}", header=True)
