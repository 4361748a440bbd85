"""Host logs: SSH, syslog, panel logins and accesses, file manager, firewall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.fields import truthy
from tidewatch.functions.times import to_utc
from tidewatch.parsers.capture import pinned
from tidewatch.functions.cut import (
    after, at, before, between, contains_any, is_digits, is_ipv4, next_to, quoted, stamped, syslog, syslog_process, syslog_time, text_or_null, word_with, words,
)
from tidewatch.schemas import make_events

# Fixed value: prefix of debug chatter that is kept but flagged as noise.
DEBUG_PREFIX = "auth-worker: debug: imunify360:"


def _syslog_lines(lines: DataFrame, process: str | None = None) -> DataFrame:
    """Lines with `t`, the words of a system log line; with a process name, that process's lines only."""
    wanted = lines if process is None else lines.filter(F.col("raw").contains(f" {process}["))
    m = pinned(wanted, "t", syslog(F.col("raw"))).filter("t IS NOT NULL")
    return m if process is None else m.filter(syslog_process(F.col("t")) == process)


def parse_ssh(lines: DataFrame, ref_now=None, lenient: bool = False) -> DataFrame:
    """Accepted and failed SSH logins: one word of user name between `for` and the last `from`, address and port behind that. Lines without a name are dropped."""
    m = _syslog_lines(lines, "sshd")
    msg = F.get("t", F.lit(5))
    w = words(msg)
    place = F.size(w) - F.array_position(F.reverse(w), "from")  # of the last one, from 0
    ok = at(w, 0) == "Accepted"
    named = (place == 4) | (~ok & (place == 6) & (at(w, 3) == "invalid") & (at(w, 4) == "user"))
    fields = F.struct(
        ok.alias("ok"), F.when(ok, at(w, 1)).alias("method"), F.when(named, at(w, place - 1)).alias("user"),
        at(w, place + 1).alias("ip"), (at(w, place + 2) == "port").alias("has_port"), at(w, place + 3).alias("port"),
    )
    login = (msg.startswith("Failed password for ") | (msg.startswith("Accepted ") & (at(w, 2) == "for"))) & F.array_contains(w, "from")
    m = pinned(m.filter(login), "f", fields).filter("f.has_port AND f.user IS NOT NULL").filter(is_ipv4(F.col("f.ip")) & is_digits(F.col("f.port")))
    ok = F.col("f.ok")
    return make_events(
        m, source="SSH_SECURE", service="SSH", ts=to_utc(syslog_time(F.col("t")), ref_now, lenient), ip=F.col("f.ip"), username=F.col("f.user"),
        message=F.when(ok, "SSH AUTH OK").otherwise("SSH AUTH FAIL"),
        extra={
            "event_type": "auth_login", "protocol": "ssh", "action": F.when(ok, "success").otherwise("fail"),
            "port": F.col("f.port"), "auth_method": F.col("f.method"), "auth_success": ok,
        },
    )


def parse_syslog(lines: DataFrame, ref_now=None, lenient: bool = False) -> DataFrame:
    m = _syslog_lines(lines)
    m = m.withColumn("proc", F.lower(syslog_process(F.col("t")))).withColumn("msg", F.trim(F.get("t", F.lit(5)))).filter("proc <> ''")
    proc, msg = F.col("proc"), F.col("msg")
    debug = F.lower(msg).startswith(DEBUG_PREFIX)
    service = (
        F.when(proc.contains("httpd") | proc.contains("apache"), "HTTP")
        .when(proc.contains("exim"), "SMTP").when(proc.contains("sshd"), "SSH").otherwise("SYSTEM")
    )
    return make_events(
        m, source="SYSTEM", service=service, ts=to_utc(syslog_time(F.col("t")), ref_now, lenient), message=msg,
        extra={
            "event_type": "system_log", "process": proc,
            "noise": F.when(debug, F.lit(True)), "kind": F.when(debug, "imunify_debug"),
        },
    )


def parse_panel_login(lines: DataFrame, ref_now=None, lenient: bool = False) -> DataFrame:
    """Panel log lines that quote a login with its outcome."""
    m = pinned(lines.filter(F.lower("raw").contains('"login')), "q", quoted(F.col("raw")))
    said = F.get(F.filter(F.transform("q", lambda x: words(F.lower(x), 3)), lambda x: (at(x, 0) == "login") & (at(x, 1).startswith("ok") | at(x, 1).startswith("failed"))), F.lit(0))
    head = F.get("q", F.lit(0))
    client = words(before(head, "["))
    m = pinned(m, "f", F.struct(
        at(client, F.size(client) - 3).alias("ip"), at(client, F.size(client) - 1).alias("user"), between(head, "[", "]").alias("time"), at(said, 1).startswith("ok").alias("ok"),
    )).filter("f.ok IS NOT NULL AND f.time IS NOT NULL AND f.user IS NOT NULL").filter(is_ipv4(F.col("f.ip")))
    ok = F.col("f.ok")
    return make_events(
        m, source="PANEL_LOGIN", service="PANEL", ts=to_utc(F.col("f.time"), ref_now, lenient), ip=F.col("f.ip"),
        username=F.col("f.user"), message=F.when(ok, "PANEL LOGIN OK").otherwise("PANEL LOGIN FAIL"),
        extra={
            "event_type": "auth_login", "protocol": "cpanel", "action": F.when(ok, "success").otherwise("fail"),
            "panel_user": F.col("f.user"),
        },
    )


def parse_file_action(lines: DataFrame, ref_now=None, lenient: bool = False) -> DataFrame:
    """File manager lines: a time and key=value words."""
    raw = F.trim("raw")
    w = words(raw)
    fields = F.struct(stamped(raw).alias("time"), *[word_with(w, f"{k}=").alias(k) for k in ("user", "ip", "action", "path", "size", "mode")])
    m = pinned(lines.filter(F.col("raw").contains(" action=")), "f", fields)
    m = m.filter("f.time IS NOT NULL AND f.user IS NOT NULL AND f.action IS NOT NULL AND f.path IS NOT NULL").filter(is_ipv4(F.col("f.ip")))
    number = lambda k: F.when(is_digits(F.col(f"f.{k}")), F.col(f"f.{k}"))
    return make_events(
        m, source="FILEMANAGER", service="SYSTEM", ts=to_utc(F.col("f.time"), ref_now, lenient), ip=F.col("f.ip"),
        username=F.col("f.user"), message=F.concat_ws(" ", F.lit("FILE"), "f.action", "f.path"),
        extra={
            "event_type": "file_action",
            "file": {"action": F.col("f.action"), "path": F.col("f.path"), "size": number("size"), "mode": number("mode")},
        },
    )


# ---------------------------------------------------------------- panel accesses


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def query_values(query: Column) -> Column:
    """Query text to (key, decoded values) in order; blank values are dropped."""
    pairs = F.transform(
        F.split(query, "[&]"),
        lambda p: F.struct(
            _decoded(F.substring_index(p, "=", 1)).alias("k"),
            F.when(F.instr(p, "=") > 0, _decoded(F.regexp_replace(p, r"^[^=]*=", ""))).alias("v"),
        ),
    )
    return F.filter(pairs, lambda p: p["v"] != "")


def _first(pairs: Column, key: str) -> Column:
    return _decoded(F.get(F.filter(pairs, lambda p: p["k"] == key), F.lit(0))["v"])


def _query_map(pairs: Column, limit: int | None) -> Column:
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    of = lambda k: F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])
    return F.map_from_arrays(keys, F.transform(keys, lambda k: of(k) if limit is None else F.slice(of(k), 1, limit)))


def _address(text: Column) -> Column:
    """The text if it looks like an address of either kind, else null."""
    six = text.contains(":") & (F.translate(F.lower(text), "0123456789abcdef:", "") == "")
    return F.when(is_ipv4(text) | six, text)


def parse_panel_access(lines: DataFrame, ref_now=None, lenient: bool = False, values_per_key: int | None = None) -> DataFrame:
    """Hosting panel access log: area, action and outcome of every request (all values of a query key, or the first few)."""
    m = pinned(lines, "q", quoted(F.trim("raw"))).filter("size(q) >= 3")
    head, request, answer = F.get("q", F.lit(0)), words(F.get("q", F.lit(1))), words(F.get("q", F.lit(2)))
    client = words(before(head, "["))
    m = pinned(m, "f", F.struct(
        at(client, 0).alias("client"), F.when(F.size(client) == 3, at(client, 2)).alias("user"), between(head, "[", "]").alias("time"),
        at(request, 0).alias("method"), at(request, 1).alias("url"), at(answer, 0).alias("status"), at(answer, 1).alias("size"),
        at(F.split(F.ltrim(after(F.col("raw"), "X-Forwarded-For:")), r'[\s",]+'), 0).alias("forwarded"),
    )).filter("f.user IS NOT NULL AND f.time IS NOT NULL AND f.url IS NOT NULL AND f.method = upper(f.method) AND length(f.status) = 3").filter(is_digits(F.col("f.status")))
    ip = F.coalesce(_address(F.col("f.forwarded")), _address(F.col("f.client")))
    m = pinned(m, "ip", ip).filter(F.col("ip").isNotNull()).withColumn("url", F.col("f.url"))
    # the path of an address with or without scheme and host
    local = F.when(F.col("url").contains("://"), F.concat(F.lit("/"), F.coalesce(after(after(F.col("url"), "://"), "/"), F.lit("")))).otherwise(F.col("url"))
    path = before(before(before(local, "?"), "#"), ";")
    m = m.withColumn("path", F.coalesce(F.nullif(path, F.lit("")), F.col("url")))
    m = m.withColumn("pairs", query_values(F.coalesce(before(after(F.col("url"), "?"), "#"), F.lit(""))))
    low, pairs = F.lower("path"), F.col("pairs")
    m = m.withColumn("module", F.nullif(F.lower(_first(pairs, "cpanel_jsonapi_module")), F.lit("")))
    m = m.withColumn("func", F.nullif(F.lower(_first(pairs, "cpanel_jsonapi_func")), F.lit("")))
    m = m.withColumn("exec_func", text_or_null(before(after(F.lower("path"), "/execute/fileman/"), "/")))
    login_only = F.exists(pairs, lambda p: p["k"] == "login_only")
    files = (
        truthy(F.col("module") == "fileman") | F.col("exec_func").isNotNull()
        | low.contains("/fileman") | low.contains("/filemanager")
    )
    api = low.contains("/json-api/") | low.contains("/execute/") | F.col("path").contains("cpanel_jsonapi")
    login = low.contains("/login") | login_only
    m = m.withColumn("area", F.when(files, "filemanager").otherwise("panel"))
    m = m.withColumn(
        "action",
        F.when(login, "login").when(api & files, "file_action").when(api, "api").otherwise("view"),
    )
    is_file = F.col("action") == "file_action"
    m = m.withColumn("file_func", F.when(is_file, F.coalesce("exec_func", "func", F.lit("api"))))
    status = F.col("f.status").cast("int")
    outcome = F.when(status.isin(401, 403), "failed").when(
        status.between(200, 299) & (login | low.contains("/json-api/") | low.contains("/execute/")), "ok"
    )
    user = F.when(~F.lower("f.user").isin("-", "(null)", "null"), F.col("f.user"))
    message = F.concat_ws(
        " · ",
        F.concat(F.lit("CPANEL "), F.upper("area")), F.upper("action"),
        F.concat_ws(" ", "f.method", "path"),
        F.concat(F.lit("HTTP "), "f.status"),
        F.concat(F.lit("file_func="), F.col("file_func")),
        F.concat(F.lit("module="), F.col("module")),
        F.concat(F.lit("func="), F.col("func")),
    )
    return make_events(
        m, source="PANEL_ACCESS", service="PANEL", ts=to_utc(F.col("f.time"), ref_now, lenient), ip=F.col("ip"),
        username=user, message=message,
        extra={
            "event_type": F.when(is_file, "file_action").otherwise("panel_access"),
            "panel": {
                "area": F.col("area"), "action": F.col("action"), "status": outcome, "http_method": F.col("f.method"),
                "path": F.col("path"), "url": F.col("url"), "status_code": status,
                "bytes": F.col("f.size").try_cast("bigint"), "cpanel_user": user,
                "cpanel_module": F.col("module"), "cpanel_func": F.col("func"), "query": _query_map(pairs, values_per_key),
            },
            "file": (is_file, {"action": F.col("file_func"), "dir": F.nullif(F.trim(_first(pairs, "dir")), F.lit(""))}),
        },
    )


# ---------------------------------------------------------------- firewall

# Message fragments (all of one line must occur) and the reason they stand for, in order.
REASONS = [
    (["smtp brute force"], "smtp_bruteforce"),
    (["failed smtp auth"], "smtp_auth_failed"),
    (["invalid helo"], "smtp_invalid_helo"),
    (["no such user"], "smtp_no_such_user"),
    (["xmlrpc"], "xmlrpc_activity"),
    (["wlwmanifest.xml"], "wlwmanifest_activity"),
    (["python-requests"], "python_requests_activity"),
    (["crawler"], "crawler_bot"),
    (["spider"], "crawler_bot"),
    (["robots.txt"], "robots_txt_activity"),
    (["add-to-cart"], "add_to_cart_activity"),
    (["connection", "limit"], "connection_limit"),
    (["connection", "found to have"], "connection_limit"),
]


def _named_address(w: Column, low: Column) -> Column:
    """The address that a message names: behind `from`, `IP` or a version word, or the first of a message about an ignored one."""
    clean = F.transform(w, lambda x: F.rtrim(x, F.lit(".:;")))
    pairs = F.transform(clean, lambda x, i: F.struct(x.alias("text"), F.lower(F.get(clean, i - 1)).alias("lead")))
    addresses = F.filter(pairs, lambda p: is_ipv4(p["text"]))
    version = lambda p: p["lead"].startswith("v") & is_digits(p["lead"].substr(F.lit(2), F.length(p["lead"])))
    led = F.filter(addresses, lambda p: truthy(p["lead"].isin("from", "ip")))
    named = F.filter(addresses, lambda p: truthy(version(p)))
    return F.coalesce(F.get(led, F.lit(0))["text"], F.get(named, F.lit(0))["text"], F.when(low.contains("ignored"), F.get(addresses, F.lit(0))["text"]))


def parse_firewall(lines: DataFrame, ref_now=None, lenient: bool = False) -> DataFrame:
    """Login-failure daemon lines; those without an address are dropped."""
    m = _syslog_lines(lines, "lfd")
    rest = F.trim(F.get("t", F.lit(5)))
    opens = rest.startswith("(") & rest.contains(")")
    m = m.withColumn("trigger", F.when(opens, between(rest, "(", ")"))).withColumn("msg", F.when(opens, F.trim(after(rest, ")"))).otherwise(rest))
    msg, low = F.col("msg"), F.lower("msg")
    m = pinned(m, "w", F.split(msg, r"[\s,()]+"))
    m = pinned(m, "ip", _named_address(F.col("w"), low)).filter(F.col("ip").isNotNull())
    m = pinned(m, "plain", F.split(low, "[^a-z0-9_]+"))
    plain = F.col("plain")
    said = lambda word: F.array_contains(plain, word)
    m = m.withColumn("action", F.when(said("blocked") | said("csf"), "blocked").when(said("ignored"), "ignored").otherwise("info"))
    # `port=22` words, and the numbers that stand behind `port:` or `ports:`
    single = F.transform(F.filter("w", lambda x: F.lower(x).startswith("port=")), lambda x: x.substr(F.lit(6), F.length(x)))
    lead = F.transform("w", lambda x: F.lower(x))
    place = F.greatest(*[F.coalesce(F.array_position(lead, x), F.lit(0)) for x in ("port:", "ports:", "ports=")])
    tail = F.slice("w", place.cast("int") + 1, F.size("w"))
    run = F.aggregate(tail, F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("got")), lambda acc, x: F.struct(
        (acc["on"] & is_digits(x)).alias("on"), F.when(acc["on"] & is_digits(x), F.concat(acc["got"], F.array(x))).otherwise(acc["got"]).alias("got")))["got"]
    listed = F.when(place > 0, run).otherwise(F.array().cast("array<string>"))
    ports = F.array_distinct(F.filter(F.transform(F.concat(single, listed), lambda p: p.try_cast("int")), lambda p: p.isNotNull()))
    m = m.withColumn("ports", F.when(F.size(ports) > 0, ports))
    joined = F.array_join(F.split(F.lower("trigger"), r"[\s-]+"), "_")
    token = F.array_join(F.split(joined, "[^a-z0-9_.]"), "")
    by_message = F.lit("lfd_event")
    for words, reason in reversed(REASONS):
        test = low.contains(words[0])
        for w in words[1:]:
            test = test & low.contains(w)
        by_message = F.when(test, reason).otherwise(by_message)
    reason = F.when(F.col("trigger").isNotNull(), F.coalesce(F.nullif(token, F.lit("")), F.lit("lfd_event"))).otherwise(by_message)
    service = (
        F.when(truthy(F.lower("trigger").contains("ssh")) | low.contains("sshd"), "SSH")
        .when(contains_any(low, ["smtp", "helo", "mail"]), "SMTP")
        .when(contains_any(low, ["xmlrpc", "http", "robots.txt", "wlwmanifest", "add-to-cart"]), "HTTP")
        .otherwise("SYSTEM")
    )
    seconds = lambda word: F.when(next_to(plain, word, 2) == "secs", next_to(plain, word))
    in_the_last = (next_to(plain, "last", -2) == "in") & (next_to(plain, "last", -1) == "the") & seconds("last").isNotNull()
    tag = F.when(F.rtrim(msg).endswith("]"), before(F.substring_index(msg, "[", -1), "]"))
    return make_events(
        m, source="LFD", service=service, ts=to_utc(syslog_time(F.col("t")), ref_now, lenient), ip=F.col("ip"), message=msg,
        extra={
            "event_type": "security_signal", "kind": "lfd", "action": F.col("action"), "reason": reason,
            "lfd_trigger": F.col("trigger"),
            "lfd_tag": F.upper(F.when(F.size(F.split(tag, "[^A-Za-z0-9_]")) == 1, text_or_null(tag))),
            "ports": F.col("ports"), "port": F.get(F.col("ports"), F.lit(0)),
            "count": F.when(in_the_last, next_to(plain, "last", -3)), "window_secs": F.when(in_the_last, seconds("last")),
            "block_seconds": F.when(F.col("action") == "blocked", F.when(is_digits(seconds("for")), seconds("for"))),
            "blocked_tool": F.when(said("csf"), "csf"),
        },
    )
