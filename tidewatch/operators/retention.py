"""Which raw lines are worth keeping as evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.fields import optional, text, truthy

# Fixed values.
ALWAYS = ["lfd", "modsec", "secure", "system_secure", "cpanel_access", "filemanager", "panel_logs"]
SENSITIVE_PATHS = ["/wp-login.php", "/xmlrpc.php", "/wp-admin", "/.env", "/.git", "/phpmyadmin", "/admin", "/login"]
IGNORED_PATHS = ["/whm-server-status", "/server-status"]
LOOPBACK = ["127.0.0.1", "::1"]
SUSPICIOUS_AGENTS = [
    "python-requests", "python-httpx", "go-http-client", "curl/", "wget/", "masscan", "zgrab", "sqlmap", "nikto",
]
SYSTEM_HINTS = [
    "sshd", "sudo", "authentication failure", "failed password", "invalid user", "csf", "lfd", "oom-killer",
    "out of memory", "kernel:", "segfault", "imunify", "modsecurity",
]
MAIL_WORDS = [
    "rejected", "reject", "deny", "bounced", "bounce", "deferred", "defer", "spam", "blacklist", "rbl",
    "authentication failed", "auth failed", "failed authentication",
]
ALIASES = {
    "exim": "exim_mainlog", "exim4": "exim_mainlog", "exim_main": "exim_mainlog",
    "dovecot_auth": "dovecot", "mailauth": "dovecot", "mail": "maillog", "maillog": "maillog", "auth": "auth",
}
MAILBOX_TYPES = ["maillog_dovecot", "dovecot", "auth"]
MAILBOX_WORDS = ["dovecot", "imap-login", "pop3-login"]
TRANSFER_WORDS = [" exim", "exim_mainlog"]
LOAD_LIMIT = 6.0
MEMORY_LIMIT = 92.0


def _any_of(value: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | value.contains(w)
    return out


def raw_retention(events: DataFrame, log_type: str = "log_type") -> Column:
    """True where the event's raw line should be stored.

    The mail branch asks for direction in/out, which no parser writes, and web logs of the second
    server type have no branch; both follow the original decisions.
    """
    kind = F.lower(F.trim(F.col(log_type)))
    aliases = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    kind = F.coalesce(F.try_element_at(aliases, kind), kind)
    field = lambda p, t="string": optional(events, f"extra.{p}", t)
    event_type = F.lower(F.trim(text(field("event_type"))))
    process = F.lower(text(F.coalesce(field("process"), field("program"), field("daemon"))))
    source, message = F.lower(F.trim(text(F.col("source")))), F.lower(text(F.col("message")))

    mailbox = (
        kind.isin(MAILBOX_TYPES) | source.contains("dovecot") | process.contains("dovecot")
        | _any_of(message, MAILBOX_WORDS)
    )
    metric = F.lower(F.trim(text(field("metric.name"))))
    load = F.coalesce(field("metric.ldavg_1", "double"), field("metric.ldavg_1_per_cpu", "double"))
    sar = (event_type == "metric") & truthy(
        F.when(metric == "load", load >= LOAD_LIMIT).when(metric == "memory", field("metric.mem_used_pct", "double") >= MEMORY_LIMIT)
    )
    path, agent = F.lower(text(field("http.path"))), F.lower(text(field("http.user_agent")))
    access = (
        F.when(_any_of(path, IGNORED_PATHS), False)
        .when(field("http.status", "int") >= 400, True)
        .when(_any_of(path, SENSITIVE_PATHS), True)
        .when(_any_of(agent, SUSPICIOUS_AGENTS), ~F.coalesce(F.col("ip_client").isin(LOOPBACK), F.lit(False)))
        .otherwise(False)
    )
    transfer = (
        (kind == "exim_mainlog") | source.contains("exim") | process.contains("exim")
        | message.startswith("exim") | _any_of(message, TRANSFER_WORDS)
    )
    mail = (F.lower(text(field("direction"))).isin("in", "out") & _any_of(message, MAIL_WORDS)) | truthy(
        ~field("auth_success", "boolean")
    )
    return (
        F.when(kind.isin(ALWAYS), True)
        .when(mailbox, event_type == "auth_login")
        .when(kind == "sar", sar)
        .when(kind == "apache_access", access)
        .when(transfer, mail)
        .when(kind == "system", _any_of(F.concat_ws(" ", F.lower(text(field("process"))), message), SYSTEM_HINTS))
        .when(kind == "apache_error", ~truthy(field("noise", "boolean")))
        .otherwise(False)
    )


def raw_lines(events: DataFrame, log_type: str = "log_type") -> DataFrame:
    """Kept raw lines as a table of evidence."""
    return events.filter(raw_retention(events, log_type)).select(
        F.col("id").alias("raw_id") if "id" in events.columns else F.sha2(F.concat_ws("|", "file", "line_no"), 256).alias("raw_id"),
        "server", F.trim(F.col(log_type)).alias("source_hint"), "raw", "file", "line_no",
    )
