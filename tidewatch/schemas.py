"""The normalized event: one schema for every log type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GEO = "is_private boolean, country_code string, country_name string"
EXTRA_DDL = f"""
  event_type string, action string, kind string, protocol string, auth_user string, auth_success boolean,
  auth_method string, port int, ports array<int>, direction string, mail_from string, `from` string, `to` string,
  proto string, subject string, recipient string, policy_domain string, detail string, reason string,
  smtp_reply_code int, noise boolean, referer_host string, app string, level string, signature string,
  wp struct<kind: string, core_file: string, missing_file: string>,
  http struct<method: string, path: string, status: int, bytes: bigint, user_agent: string, referer: string,
    host: string, referer_host: string>,
  panel struct<area: string, action: string, status: string, http_method: string, path: string, url: string,
    status_code: int, bytes: bigint, cpanel_user: string, cpanel_module: string, cpanel_func: string,
    query: map<string, array<string>>>,
  panel_user string,
  file struct<action: string, dir: string, path: string, size: bigint, mode: string>,
  lfd_trigger string, lfd_tag string, count bigint, window_secs bigint, block_seconds bigint, blocked_tool string,
  waf struct<engine: string, rule_id: string, uri: string, audit_txid: string,
    http: struct<method: string, url: string, status_code: int, host: string>, seen_sections: array<string>>,
  process string,
  metric struct<family: string, name: string, cpu_count: int, runq_sz: double, plist_sz: double, blocked: double,
    ldavg_1: double, ldavg_5: double, ldavg_15: double,
    ldavg_1_per_cpu: double, ldavg_5_per_cpu: double, ldavg_15_per_cpu: double,
    kb_mem_free: bigint, kb_mem_used: bigint, kb_mem_avail: bigint, mem_used_pct: double,
    device: string, tps: double, util_pct: double, rest: string>,
  geo struct<{GEO}>, geoip struct<{GEO}>, asn struct<number: bigint, org: string>,
  internal boolean, traffic_class string, internal_kind string, vhost string
"""
_extra: T.StructType | None = None
LINE_COLUMNS = ["file", "line_no", "server", "log_type", "raw"]


def _extra_type() -> T.StructType:
    global _extra
    if _extra is None:
        _extra = T.StructType.fromDDL(EXTRA_DDL)
    return _extra


def typed_struct(kind: T.StructType, values: dict) -> Column:
    """Struct of exactly this type; fields that are not given are null, and (condition, fields) is null unless it holds."""
    unknown = set(values) - set(kind.names)
    if unknown:
        raise KeyError(f"no such event fields: {sorted(unknown)}")
    out = []
    for f in kind:
        v = values.get(f.name)
        if isinstance(v, dict):
            col = typed_struct(f.dataType, v)
        elif isinstance(v, tuple):
            col = F.when(v[0], typed_struct(f.dataType, v[1]))
        elif v is None:
            col = F.lit(None).cast(f.dataType)
        else:
            col = (v if isinstance(v, Column) else F.lit(v)).cast(f.dataType)
        out.append(col.alias(f.name))
    return F.struct(*out)


def make_events(
    parsed: DataFrame,
    *,
    source: str,
    service: Column | str,
    ts: Column,
    message: Column | str,
    extra: dict,
    ip: Column | None = None,
    domain: Column | None = None,
    username: Column | None = None,
) -> DataFrame:
    """Event rows from parsed lines. `time_parsed` is false where the line's time could not be read."""
    def text(v):
        return F.lit(None).cast("string") if v is None else v if isinstance(v, Column) else F.lit(v)

    return parsed.select(
        *[F.col(c) if c in parsed.columns else F.lit(None).cast("string").alias(c) for c in LINE_COLUMNS],
        ts.alias("timestamp_utc"),
        ts.isNotNull().alias("time_parsed"),
        F.lit(source).alias("source"),
        text(service).alias("service"),
        text(ip).alias("ip_client"),
        F.lit(None).cast("string").alias("ip_server"),
        text(domain).alias("domain"),
        text(username).alias("username"),
        text(message).alias("message"),
        typed_struct(_extra_type(), extra).alias("extra"),
    )
