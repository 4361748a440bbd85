"""Mail logs: mailbox logins and message flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.fields import split_address
from tidewatch.functions.times import to_utc
from tidewatch.parsers.capture import pinned
from tidewatch.functions.cut import after, at, before, between, contains_any, is_digits, is_ipv4, stamped, syslog, syslog_process, syslog_time, text_or_null, word_with, words
from tidewatch.schemas import make_events

# What the mail server writes.
NO_SUCH_DOMAIN = ["unrouteable address", "host or domain name not found"]
LIMIT_ROUTER = "r=enforce_mail_permissions"


def parse_mail_login(lines: DataFrame, ref_now=None, lenient: bool = False) -> DataFrame:
    """Mailbox (IMAP/POP3) logins, accepted or refused; other lines are dropped."""
    m = pinned(lines.filter(F.col("raw").contains("-login:")), "t", syslog(F.col("raw"))).filter("t IS NOT NULL").filter(syslog_process(F.col("t")) == "dovecot")
    msg = F.get("t", F.lit(5))
    low = F.lower(msg)
    ours = low.startswith("imap-login:") | low.startswith("pop3-login:")
    fields = F.struct(
        low.contains("logged in:").alias("ok"), low.contains("(auth_failed):").alias("refused"),
        between(msg, "user=<", ">").alias("user"), word_with(F.split(msg, r"[\s,]+"), "rip=").alias("ip"),
    )
    m = pinned(m.filter(ours), "f", fields).filter("(f.ok OR f.refused) AND f.user IS NOT NULL").filter(is_ipv4(F.col("f.ip")))
    m = m.withColumn("ok", F.col("f.ok")).withColumn("user", F.col("f.user"))
    return make_events(
        m, source="MAILLOG_DOVECOT", service="IMAP/POP3", ts=to_utc(syslog_time(F.col("t")), ref_now, lenient), ip=F.col("f.ip"),
        domain=split_address(F.col("user"))[1], username=F.col("user"),
        message=F.when(F.col("ok"), "DOVECOT LOGIN OK").otherwise("DOVECOT AUTH FAIL"),
        extra={
            "event_type": "auth_login", "protocol": "imap_pop3",
            "action": F.when(F.col("ok"), "success").otherwise("fail"),
            "auth_user": F.col("user"), "auth_success": F.col("ok"),
        },
    )


def delivery_outcome(code: Column) -> tuple[Column, Column]:
    """(action, kind) of an SMTP reply code."""
    c = code.cast("string").try_cast("int")
    action = F.when(c.between(200, 299), "success").when(c.between(400, 499), "defer").when(c.between(500, 599), "fail")
    kind = F.when(c.between(400, 499), "temporary_failure").when(c.between(500, 599), "permanent_failure")
    return action, kind


def parse_mail_flow(lines: DataFrame, ref_now=None, lenient: bool = False) -> DataFrame:
    """Mail transfer lines; the first shape that fits decides.

    Address, protocol and reply code are read wherever they stand in the line, and the accepted
    submission shape takes its host and user in either order.
    """
    raw = F.col("raw")
    low = F.lower(raw)
    # the arrow says what a line is; the word behind it is the address
    arrow = F.get(F.filter(words(raw), lambda w: w.isin("<=", "=>", "->", "**")), F.lit(0))
    m = pinned(lines, "h", F.struct(stamped(F.trim(raw)).alias("time"), arrow.alias("arrow"), words(raw).alias("w"))).filter("h.time IS NOT NULL")
    w, arrow = F.col("h.w"), F.col("h.arrow")
    refused = after(raw, "authenticator failed", low)
    refused_ip = F.substring_index(before(refused, "]: "), "[", -1)
    host = F.substring_index(before(after(raw, " H="), "]"), "[", -1)
    title = after(raw, ' T="')
    behind = text_or_null(before(after(after(title, '"'), "for "), " "))
    fields = F.struct(
        arrow.alias("arrow"), at(w, F.array_position(w, arrow).cast("int")).alias("address"), word_with(w, "A=", "authenticated_id=").alias("user"),
        F.when(is_ipv4(host), host).alias("host_ip"), F.when(is_ipv4(refused_ip), refused_ip).alias("refused_ip"),
        F.when(after(title, '"').startswith(" for "), text_or_null(before(title, '"'))).alias("subject"), behind.alias("subject_rcpt"),
        F.lower(word_with(w, "P=")).alias("proto"), before(after(raw, ' C="'), '"').substr(1, 3).alias("code"),
    )
    m = pinned(m, "f", fields)
    f = lambda name: F.col(f"f.{name}")
    accepted = (arrow == "<=") & f("address").isNotNull()
    failed = (arrow == "**") & f("address").isNotNull()
    limited = failed & low.contains(LIMIT_ROUTER) & low.contains(" has exceeded ") & low.contains("message discarded.")
    shape = (
        F.when(f("refused_ip").isNotNull(), "auth_fail")
        .when(accepted & f("user").isNotNull() & f("host_ip").isNotNull(), "auth_ok")
        .when(limited, "rate_limit")
        .when(failed & raw.contains(": "), "hard_fail")
        .when(f("user").isNotNull(), None)
        .when(accepted & f("subject").isNotNull() & f("subject_rcpt").isNotNull(), "inbound_subject")
        .when(accepted, "inbound")
        .when(arrow.isin("=>", "->") & f("address").isNotNull(), "outbound")
        .when(contains_any(low, NO_SUCH_DOMAIN) & between(raw, "<", ">").isNotNull(), "invalid_domain")
        .when(low.contains("retry time not reached for any host"), "retry")
    )
    m = pinned(m, "shape", shape).filter(F.col("shape").isNotNull())

    def only(shapes, value):
        return F.when(F.col("shape").isin(*shapes), value)

    inbound = ["inbound", "inbound_subject"]
    m = m.select(
        "*",
        only(["auth_ok", *inbound], f("address")).alias("sender"),
        only(["auth_ok"], f("user")).alias("user"),
        only(["outbound"], F.coalesce(between(f("address"), "<", ">"), f("address"))).alias("to_addr"),
        only(["outbound"], F.when(is_digits(f("code")) & (F.length(f("code")) == 3), f("code"))).alias("code"),
        F.when(F.col("shape").isin("rate_limit", "hard_fail"), f("address"))
        .when(F.col("shape") == "invalid_domain", before(F.substring_index(raw, "<", -1), ">")).alias("rcpt"),
        only(["inbound_subject"], f("subject_rcpt")).alias("subject_rcpt"),
    )
    action, kind = delivery_outcome(F.col("code"))
    limit_domain = F.lower(only(["rate_limit"], at(words(after(raw, "domain ", low)), 0)))
    s = F.col("shape")
    domain_of = lambda c: split_address(F.col(c))[1]
    message = (
        F.when(s == "auth_fail", F.concat(F.lit("SMTP AUTH FAIL: "), F.trim(after(refused, "]: "))))
        .when(s == "auth_ok", "SMTP AUTH OK (submission)")
        .when(s == "rate_limit", "SMTP OUTBOUND RATE LIMIT (discarded)")
        .when(s == "hard_fail", "SMTP OUTBOUND FAIL")
        .when(s.isin(*inbound), "SMTP INBOUND")
        .when(s == "outbound", F.when(action == "success", "SMTP OUTBOUND DELIVERED").when(action == "defer", "SMTP OUTBOUND DEFERRED")
              .when(action == "fail", "SMTP OUTBOUND FAILED").otherwise("SMTP OUTBOUND"))
        .when(s == "invalid_domain", F.concat(F.lit("INVALID DOMAIN for "), F.coalesce("rcpt", F.lit(""))))
        .otherwise("SMTP RETRY")
    )
    login = s.isin("auth_fail", "auth_ok")
    return make_events(
        m, source="EXIM_MAINLOG", service="SMTP", ts=to_utc(F.col("h.time"), ref_now, lenient),
        ip=F.when(s == "auth_fail", f("refused_ip")).when(s.isin("auth_ok", "outbound", *inbound), f("host_ip")),
        domain=F.coalesce(
            domain_of("user"), limit_domain, domain_of("subject_rcpt"), domain_of("rcpt"), domain_of("to_addr"), domain_of("sender"),
        ),
        username=F.col("user"), message=message,
        extra={
            "event_type": F.when(login, "auth_login").otherwise("mail_flow"),
            "protocol": F.when(login, "smtp"),
            "action": F.when(s == "auth_ok", "success").when(s.isin("auth_fail", "rate_limit", "hard_fail", "invalid_domain"), "fail").otherwise(action),
            "direction": F.when(s.isin(*inbound), "inbound").otherwise("outbound"),
            "auth_success": F.when(s == "auth_ok", True).when(s.isin("auth_fail", "outbound", *inbound), False),
            "auth_user": F.col("user"),
            "mail_from": only(["auth_ok"], F.col("sender")),
            "from": only(inbound, F.col("sender")),
            "to": F.coalesce("subject_rcpt", "to_addr"),
            "proto": only(inbound, f("proto")),
            "subject": only(["inbound_subject"], f("subject")),
            "kind": F.when(s == "hard_fail", "delivery_failure").when(s.isin("rate_limit", "invalid_domain", "retry"), s).otherwise(kind),
            "recipient": F.col("rcpt"),
            "policy_domain": limit_domain,
            "detail": only(["rate_limit"], text_or_null(before(after(raw, " has exceeded ", low), " allowed."))),
            "reason": only(["hard_fail"], text_or_null(after(after(raw, "** "), ": "))),
            "smtp_reply_code": F.col("code"),
        },
    )


