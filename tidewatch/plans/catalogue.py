"""The detection catalogue: thresholds over sliding windows, filters, and a few small jobs.

Where the catalogue names no grouping, window or threshold, the value here is our choice and is marked so.
Every detection returns (det_id, group_key, us, event_id, value).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.fields import blank_to_null, event_field, group_key, text, truthy
from tidewatch.operators.cooldown import apply_cooldown
from tidewatch.operators.prefix import SIX_HOURS_US, carry_forward, slice_start
from tidewatch.operators.rules import event_action, event_path
from tidewatch.operators.staging import staged
from tidewatch.operators.windows import sliding_metrics

MAIL = ["EXIM_MAINLOG", "MAILLOG_DOVECOT"]
PANEL = ["PANEL_LOGIN", "PANEL_ACCESS"]
ACCESS = ["APACHE_ACCESS", "NGINX_ACCESS"]


def _field(path: str) -> Callable[[DataFrame], Column]:
    return lambda df: event_field(df.schema, path, extended=True)


def _text(path: str) -> Callable[[DataFrame], Column]:
    return lambda df: text(event_field(df.schema, path, extended=True))


def _source(*names: str) -> Callable[[DataFrame], Column]:
    return lambda df: F.upper(F.trim("source")).isin(*names)


def _kind(name: str) -> Callable[[DataFrame], Column]:
    return lambda df: _text("extra.event_type")(df) == name


def _action(name: str) -> Callable[[DataFrame], Column]:
    return lambda df: truthy(event_action(df) == name)


def _contains_any(paths: list[str], words: list[str]) -> Callable[[DataFrame], Column]:
    def test(df):
        out = F.lit(False)
        for p in paths:
            low = F.lower(_text(p)(df))
            for w in words:
                out = out | low.contains(w.lower())
        return out

    return test


def _all(*tests: Callable[[DataFrame], Column]) -> Callable[[DataFrame], Column]:
    def test(df):
        out = F.lit(True)
        for t in tests:
            out = out & truthy(t(df))
        return out

    return test


@dataclass(frozen=True)
class Threshold:
    """Rows passing `where`, per group, over a window; `condition` may use the parameters."""

    where: Callable[[DataFrame], Column]
    group: list[str]
    minutes: float
    condition: str
    value: str = "count"
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Filter:
    where: Callable[[DataFrame], Column]
    group: list[str]


AUTH = _kind("auth_login")
WEB = _all(_source(*ACCESS), _kind("http_access"))
ERROR_STATUS = lambda df: truthy(event_field(df.schema, "extra.http.status") >= 400)
MEMBER = ["server", "ip_client"]
ACCOUNT = ["server", "username"]
PATH = ["extra.http.path"]
FILE = ["extra.file.path", "extra.file.action", "message"]
WP_LOGIN, XMLRPC = _contains_any(PATH, ["/wp-login.php"]), _contains_any(PATH, ["/xmlrpc.php"])

# Thresholds, windows and patterns of the catalogue.
DETECTIONS: dict[str, Threshold | Filter] = {
    "A1": Threshold(_all(AUTH, _action("fail")), MEMBER, 15, "count >= {failures}", params={"failures": 10}),
    "A2": Threshold(AUTH, MEMBER, 20, "unique_users >= {users}", "unique_users", {"users": 5}),
    "A3": Threshold(AUTH, ACCOUNT, 30, "action = 'success' AND fail_count >= {failures}", "fail_count", {"failures": 5}),
    "A4": Threshold(_all(AUTH, _source(*MAIL, "WP_AUTH")), ACCOUNT, 20, "unique_ips >= {ips}", "unique_ips", {"ips": 5}),
    "A9": Threshold(_all(AUTH, _source(*MAIL)), MEMBER, 15, "count >= {attempts}", params={"attempts": 15}),
    "X1": Threshold(_all(_source("EXIM_MAINLOG"), _action("fail")), MEMBER, 15, "count >= {failures}", params={"failures": 15}),
    "X2": Threshold(_all(AUTH, _source("EXIM_MAINLOG")), MEMBER, 20, "action = 'success' AND fail_count >= {failures}", "fail_count", {"failures": 5}),
    # no threshold or window in the catalogue: those of A1
    "S1": Threshold(_all(AUTH, _source("SSH_SECURE"), _action("fail")), MEMBER, 15, "count >= {failures}", params={"failures": 10}),
    "W1": Threshold(WEB, MEMBER, 10, "count >= {requests}", params={"requests": 200}),
    "W2": Threshold(_all(WEB, ERROR_STATUS), MEMBER, 10, "unique_paths >= {paths} AND count >= {hits}", "unique_paths", {"paths": 15, "hits": 50}),
    "W3": Threshold(_all(WEB, XMLRPC), MEMBER, 10, "count >= {hits}", params={"hits": 50}),
    "W4": Threshold(WEB, ["server"], 5, "count >= {requests}", params={"requests": 1000}),
    "W5": Threshold(WEB, MEMBER, 30, "bytes >= {megabytes} * 1048576L", "bytes", {"megabytes": 500}),
    "W7": Threshold(_all(WEB, ERROR_STATUS), MEMBER, 10, "count >= {errors}", params={"errors": 50}),
    "W10": Threshold(_all(WEB, WP_LOGIN), MEMBER, 10, "count >= {requests}", params={"requests": 40}),
    # no window in the catalogue: ten minutes
    "W11": Threshold(_all(WEB, lambda df: _text("extra.http.method")(df).isin("HEAD", "OPTIONS")), MEMBER, 10, "count >= {requests}", params={"requests": 30}),
    "W12": Threshold(WEB, ["server", "ip_subnet24"], 10, "count >= {requests}", params={"requests": 250}),
    "W13": Threshold(_kind("waf_block"), MEMBER, 10, "unique_paths >= {uris}", "unique_paths", {"uris": 5}),
    # no threshold or window in the catalogue for the next two: those of W10 and W3
    "WP9": Threshold(_all(WEB, WP_LOGIN), MEMBER, 10, "count >= {requests}", params={"requests": 40}),
    "WP10": Threshold(_all(WEB, XMLRPC), MEMBER, 10, "count >= {hits}", params={"hits": 50}),
    "M3": Threshold(_kind("file_action"), ACCOUNT, 20, "count >= {changes}", params={"changes": 30}),
    "X3": Threshold(_all(_kind("mail_flow"), lambda df: _text("extra.direction")(df) == "outbound"), ["server"], 60, "count >= {mails}", params={"mails": 500}),
    # no window in the catalogue: one hour
    "X6": Threshold(lambda df: _text("extra.kind")(df) == "retry", ["server"], 60, "count >= {retries}", params={"retries": 20}),
    "P1": Threshold(_all(_source(*PANEL), _action("fail")), MEMBER, 60, "count >= {errors}", params={"errors": 10}),
    "INF2": Threshold(
        lambda df: ~_source(*ACCESS)(df), ["server"], 30, "count >= {hits} AND unique_sources >= {sources}", params={"hits": 80, "sources": 2}),
    "MS1": Threshold(_action("fail"), ["ip_client"], 7 * 24 * 60, "unique_servers >= {servers}", "unique_servers", {"servers": 2}),
    # no window in the catalogue for the next two: one day, and ten minutes
    "MS2": Threshold(_action("fail"), ["username"], 24 * 60, "unique_servers >= {servers}", "unique_servers", {"servers": 2}),
    "MS4": Threshold(_action("fail"), ["ip_subnet24"], 10, "unique_servers >= {servers}", "unique_servers", {"servers": 2}),
    "A5": Filter(_all(AUTH, _action("success"), lambda df: ~F.coalesce(_text("extra.geo.country_code")(df).isin("MX", "US", "CA"), F.lit(True))), ["username", "extra.geo.country_code"]),
    "S2": Filter(_all(AUTH, _source("SSH_SECURE"), _action("success"), lambda df: ~F.coalesce(_text("extra.geo.country_code")(df).isin("MX", "US", "CA"), F.lit(True))), ["username", "extra.geo.country_code"]),
    "X5": Filter(_all(_source("EXIM_MAINLOG"), lambda df: _text("extra.geo.country_code")(df).isin("RU", "CN", "IR", "KP")), MEMBER),
    "X4": Filter(lambda df: _text("extra.kind")(df) == "invalid_domain", ["server", "domain"]),
    "W6": Filter(_all(WEB, _contains_any(PATH, ["union select", "sleep(", "concat(", "../etc/passwd", "wp-config.php"])), MEMBER),
    "W8": Filter(_all(WEB, _contains_any(PATH, ["/etc/passwd", "composer.json", ".git", ".env"])), MEMBER),
    "W9": Filter(_all(WEB, _contains_any(["extra.http.user_agent"], ["WPScan", "sqlmap", "nikto"])), MEMBER),
    "M1": Filter(_all(_source("FILEMANAGER", "MODSEC", "SYSTEM"), _contains_any(FILE, ["/wp-admin/", "/wp-includes/", "/public_html/"])), ACCOUNT),
    "M2": Filter(lambda df: _text("extra.file.mode")(df).isin("777", "775"), ACCOUNT),
    "M4": Filter(_all(_kind("file_action"), _contains_any(FILE, [".php", ".phtml"])), ACCOUNT),
    "M5": Filter(_all(_source("MODSEC", "SYSTEM"), _contains_any(["message", "extra.waf.uri"], ["eval(base64", "gzuncompress(", "assert("])), ["server"]),
    "M6": Filter(_all(_source("WP_ERROR"), _contains_any(["message"], ["Failed opening required"])), ["server", "domain"]),
    "M7": Filter(_all(_kind("file_action"), _contains_any(FILE, ["base64", "rot13", "strrev"])), ACCOUNT),
    "M8": Filter(_all(_kind("file_action"), _contains_any(FILE, ["installer.php", "setup.php"])), ACCOUNT),
    "M9": Filter(_all(_kind("file_action"), _contains_any(FILE, ["RewriteRule", "Redirect"])), ACCOUNT),
    "M10": Filter(_all(_source("SYSTEM"), _contains_any(["message"], ["/tmp/"]), _contains_any(["message"], ["php", "sh"])), ["server"]),
    "WP1": Filter(_all(_source("WP_ERROR"), _kind("app_error"), _contains_any(["message"], ["Failed opening required"])), ["server", "domain"]),
    "WP5": Filter(_all(_source("WP_ERROR"), _kind("app_error"), lambda df: F.lower(_text("extra.level")(df)) == "fatal error"), ["server", "domain"]),
    "WP6": Filter(_all(_source("WP_ERROR"), _kind("app_error"), lambda df: F.lower(_text("extra.level")(df)) == "warning"), ["server", "domain"]),
    "R1": Filter(lambda df: truthy(event_field(df.schema, "extra.metric.ldavg_5") >= 7.0) | truthy(event_field(df.schema, "extra.metric.ldavg_15") >= 8.0), ["server"]),
    "R2": Filter(lambda df: event_field(df.schema, "extra.metric.mem_used_pct") >= 90, ["server"]),
    "R3": Filter(lambda df: event_field(df.schema, "extra.metric.util_pct") >= 95, ["server", "extra.metric.device"]),
    "S4": Filter(_all(_source("SYSTEM"), _contains_any(["message", "extra.process"], ["oom-killer", "out of memory", "kernel panic"])), ["server"]),
    "R6": Filter(_all(_source("SYSTEM"), _contains_any(["message", "extra.process"], ["oom-killer", "out of memory"])), ["server"]),
}


def _rows(events: DataFrame, test: Column, group: list[str]) -> DataFrame:
    return events.filter(truthy(test)).select(
        group_key([event_field(events.schema, g, True) for g in group]).alias("group_key"),
        F.unix_micros("timestamp_utc").alias("us"), F.col("id").alias("event_id"),
        F.upper(F.trim("source")).alias("source"), blank_to_null(F.col("server")).alias("server"),
        blank_to_null(F.col("ip_client")).alias("ip"), F.lower(blank_to_null(F.col("username"))).alias("username"),
        event_path(events).alias("path"), event_action(events).alias("action"),
        event_field(events.schema, "extra.http.bytes").try_cast("bigint").alias("bytes"),
    )


def _result(rows: DataFrame, det_id: str, value: Column) -> DataFrame:
    return rows.select(F.lit(det_id).alias("det_id"), "group_key", "us", "event_id", value.cast("bigint").alias("value"))


def detect(events: DataFrame, det_id: str, minutes: float | None = None, cooldown_seconds: int | None = None, **params) -> DataFrame:
    """Run one threshold or filter detection; any parameter of the catalogue may be replaced.

    Threshold detections stay quiet for `cooldown_seconds` (by default one window) after a hit.
    """
    d = DETECTIONS[det_id]
    rows = _rows(events, d.where(events), d.group)
    if isinstance(d, Filter):
        return _result(rows, det_id, F.lit(1))
    unknown = set(params) - set(d.params)
    if unknown:
        raise KeyError(f"{det_id} has no parameters {sorted(unknown)}")
    rows = staged(rows, f"rows-{det_id}")
    window = int((minutes if minutes is not None else d.minutes) * 60 * 1_000_000)
    condition = d.condition.format(**{**d.params, **params})
    columns = {"unique_paths": "path", "unique_ips": "ip", "unique_users": "username", "unique_servers": "server", "unique_sources": "source"}
    dims = {n.removeprefix("unique_"): F.col(c) for n, c in columns.items() if n in condition}
    sums = {}
    if "fail_count" in condition:
        sums["fail_count"] = F.col("action") == "fail"
    if "bytes" in condition:
        sums["bytes"] = F.col("bytes")
    metrics = sliding_metrics(rows, ["group_key"], t="us", seq="event_id", window_us=window, dims=dims, sums={
        n: c.cast("bigint") for n, c in sums.items()}, keep=["action"])
    quiet = window if cooldown_seconds is None else cooldown_seconds * 1_000_000
    hits = staged(metrics.filter(condition).withColumn("cooldown", F.lit(quiet).cast("bigint")), f"det-{det_id}")
    return _result(apply_cooldown(hits, ["group_key"], "us", "event_id", "cooldown"), det_id, F.col(d.value))


# ---------------------------------------------------------------- jobs of their own


def panel_from_listed_ip(events: DataFrame, listed: DataFrame) -> DataFrame:
    """A6: panel use from an address of a list (ip)."""
    rows = _rows(events, _source(*PANEL)(events), MEMBER)
    return _result(rows.join(listed.select("ip").distinct(), "ip", "left_semi"), "A6", F.lit(1))


def ip_changes(events: DataFrame, max_changes: int = 3, minutes: float = 30, cooldown_seconds: int | None = None) -> DataFrame:
    """A7: a user's address changes more than `max_changes` times in the window."""
    rows = _rows(events, AUTH(events), ["username"]).filter("username IS NOT NULL AND ip IS NOT NULL")
    rows = staged(rows.select("group_key", "us", "event_id", "ip"), "rows-A7")
    sliced = rows.withColumn("slice", slice_start(F.col("us"), SIX_HOURS_US))
    changed = carry_forward(sliced, ["group_key"], ["us", "event_id"], {"ip": "ip_before"}, "slice", include_current=False)
    moved = F.coalesce(F.col("ip") != F.col("ip_before"), F.lit(False)).cast("bigint")
    moves = staged(changed.select("group_key", "us", "event_id", moved.alias("moved")), "moves")
    window = int(minutes * 60 * 1_000_000)
    metrics = sliding_metrics(moves, ["group_key"], t="us", seq="event_id", window_us=window, sums={"changes": F.col("moved")})
    quiet = window if cooldown_seconds is None else cooldown_seconds * 1_000_000
    hits = staged(metrics.filter(F.col("changes") > max_changes).withColumn("cooldown", F.lit(quiet).cast("bigint")), "det-A7")
    return _result(apply_cooldown(hits, ["group_key"], "us", "event_id", "cooldown"), "A7", F.col("changes"))


def login_from_new_ip(
    events: DataFrame, det_id: str = "P2", usernames: list[str] | None = None, history: DataFrame | None = None
) -> DataFrame:
    """A8 / P2 / P5: the first success of a user from an address; `history` (username, ip) lists known pairs.

    A8 reads panel and SSH logins, the others panel logins only.
    """
    where = _all(_source(*PANEL, *(["SSH_SECURE"] if det_id == "A8" else [])), _action("success"))
    rows = _rows(events, where(events), ["username", "ip_client"]).filter("username IS NOT NULL AND ip IS NOT NULL")
    if usernames is not None:
        rows = rows.filter(F.col("username").isin([u.lower() for u in usernames]))
    first = rows.groupBy("group_key", "username", "ip").agg(F.min(F.struct("us", "event_id")).alias("f"))
    first = first.select("group_key", "username", "ip", "f.*")
    if history is not None:
        first = first.join(history.select("username", "ip").distinct(), ["username", "ip"], "left_anti")
    return _result(first, det_id, F.lit(1))


# Account names of the privileged-login detection.
PRIVILEGED = ["root", "admin", "reseller"]


def bot_seen_globally(events: DataFrame, **w1_params) -> DataFrame:
    """MS3: addresses that W1 or W9 flag on at least two servers; one row per address."""
    hits = detect(events, "W1", **w1_params).unionByName(detect(events, "W9"))
    parts = hits.withColumn("server", F.substring_index("group_key", "|", 1)).withColumn("ip", F.substring_index("group_key", "|", -1))
    seen = parts.groupBy("ip").agg(F.count_distinct("server").alias("servers"), F.min(F.struct("us", "event_id")).alias("f"))
    rows = seen.filter("servers >= 2").select(F.col("ip").alias("group_key"), "f.us", "f.event_id", "servers")
    return _result(rows, "MS3", F.col("servers"))


def fail_then_success_elsewhere(events: DataFrame, minutes: float = 30) -> DataFrame:
    """MS5: a success of a user after a failure on another server within the window.

    Failures elsewhere are the user's failures minus those on the same server: two running counts, no self-join.
    """
    window = int(minutes * 60 * 1_000_000)
    rows = _rows(events, _all(AUTH, lambda df: event_action(df).isNotNull())(events), ["username"]).filter("username IS NOT NULL")
    rows = staged(rows.select("group_key", "us", "event_id", "server", "action"), "rows-MS5")
    fails = {"fails": (F.col("action") == "fail").cast("bigint")}
    total = sliding_metrics(rows, ["group_key"], t="us", seq="event_id", window_us=window, sums=fails, keep=["server", "action"])
    total = staged(total.withColumnRenamed("fails", "fails_all"), "fails-MS5")
    local = sliding_metrics(
        total.select("group_key", "us", "event_id", "server", "action", "fails_all"), ["group_key", "server"],
        t="us", seq="event_id", window_us=window, sums=fails, keep=["action", "fails_all"],
    )
    return _result(local.filter("action = 'success' AND fails_all > fails"), "MS5", F.col("fails_all") - F.col("fails"))
