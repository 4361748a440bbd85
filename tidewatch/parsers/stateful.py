"""Logs whose lines need earlier lines: WAF audit sections and SAR reports.

The carried values come from `carry_forward` over blocks of lines, so one large file is split over tasks.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_uppercase

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.fields import truthy
from tidewatch.functions.times import to_utc
from tidewatch.operators.prefix import carry_forward
from tidewatch.parsers.capture import pinned
from tidewatch.functions.cut import after, at, between, is_clock, is_digits, is_number, text_or_null, words
from tidewatch.schemas import make_events

LINE_BLOCK = 100_000
# Request methods that an audit log holds.
METHODS = ["GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH"]
WAF_FIELDS = ["id", "msg", "hostname", "uri", "client"]


def _bracketed(raw, name: str):
    """Value of a `[name "value"]` part."""
    return between(raw, f'[{name} "', '"')


def _single_line(raw):
    """Time and fields of a WAF block on one line; null when one is missing."""
    parts = F.struct(between(raw, "[", "]").alias("time"), *[_bracketed(raw, n).alias(n) for n in WAF_FIELDS])
    whole = is_clock(between(raw, "[", "]").substr(12, 8))
    for n in WAF_FIELDS:
        whole = whole & _bracketed(raw, n).isNotNull()
    return F.when(whole, parts)


def parse_waf_line(lines: DataFrame, ref_now=None, lenient: bool = False) -> DataFrame:
    """Single-line WAF blocks."""
    m = pinned(lines.filter(F.col("raw").contains('[id "')), "f", _single_line(F.col("raw"))).filter("f IS NOT NULL")
    return make_events(
        m, source="MODSEC", service="HTTP", ts=to_utc(F.col("f.time"), ref_now, lenient), ip=F.col("f.client"), domain=F.col("f.hostname"),
        message=F.concat(F.lit("ModSec "), "f.id", F.lit(": "), "f.msg"),
        extra={"event_type": "waf_block", "waf": {"engine": "modsecurity", "rule_id": F.col("f.id"), "uri": F.col("f.uri")}},
    )


def _blocks(lines: DataFrame) -> DataFrame:
    return lines.withColumn("block", F.floor(F.col("line_no") / LINE_BLOCK))


def assemble_waf_transactions(lines: DataFrame, ref_now=None, lenient: bool = False) -> DataFrame:
    """One event per audit transaction: time and address (A), request (B), status (F), closed by H or Z."""
    keys = ["server", "file"]
    raw = F.col("raw")
    base = _blocks(lines.filter(~(raw.contains('[id "') & _single_line(raw).isNotNull())))
    # a marker is --transaction-section-- alone on its line
    mark = F.col("mark")
    name, section = F.get(mark, F.lit(2)), F.get(mark, F.lit(3))
    marker = (F.size(mark) == 6) & (F.length(section) == 1) & (F.concat(F.get(mark, F.lit(4)), F.get(mark, F.lit(5))) == "") & name.rlike("^[0-9A-Za-z]+$")
    marked = pinned(base, "mark", F.when(raw.startswith("--"), F.split(F.trim(raw), "-"))).withColumns({
        "tx_at": F.when(marker, name), "sec_at": F.when(marker & section.between("A", "Z"), section),
    })
    held = carry_forward(marked.drop("mark"), keys, ["line_no"], {"tx_at": "tx", "sec_at": "section"}, "block").filter("tx IS NOT NULL")
    # the words of a line, behind the time where it starts with one, are cut once
    w, plain = F.col("w"), ~raw.startswith("[")
    cut = pinned(held, "w", F.when(F.col("sec_at").isNull() & F.col("section").isin("A", "B", "F"), words(F.when(plain, raw).otherwise(after(raw, "]")))))
    # A: [time] unique-id address ...; B: request line and host header; F: status line
    is_head = ~plain & (F.size(w) > 2)
    is_request = plain & F.upper(at(w, 0)).isin(*METHODS) & at(w, 2).startswith("HTTP/") & (F.size(w) == 3)
    is_host = plain & (F.lower(at(w, 0)) == "host:") & (F.size(w) == 2)
    is_status = plain & at(w, 0).startswith("HTTP/") & is_digits(at(w, 1)) & (F.length(at(w, 1)) == 3)
    told = {
        "time": ("A", F.when(is_head, between(raw, "[", "]"))), "ip": ("A", F.when(is_head, at(w, 1))),
        "request": ("B", F.when(is_request, F.struct(F.upper(at(w, 0)).alias("method"), at(w, 1).alias("url")))),
        "host": ("B", F.when(is_host, at(w, 1))), "status": ("F", F.when(is_status, at(w, 1))),
    }
    closes = truthy(F.col("sec_at").isin("H", "Z"))
    # lines that say nothing are not moved: a transaction ends with the line that closes it
    values = pinned(cut, "told", F.struct(*[F.when(F.col("section") == s, v).alias(c) for c, (s, v) in told.items()]))
    heard = values.filter(reduce(lambda a, b: a | b, [F.col(f"told.{c}").isNotNull() for c in told], F.col("sec_at").isNotNull()))
    lines_told = heard.select(*keys, "log_type", "tx", "line_no", "sec_at", F.when(closes, raw).alias("raw"), "told.*")
    in_tx = Window.partitionBy(*keys, "tx").orderBy("line_no")
    opens = truthy(F.col("sec_at") == "A") | truthy(F.lag(closes).over(in_tx))
    part = lines_told.withColumn("opens", opens.cast("int")).withColumn("n", F.sum("opens").over(in_tx))

    def latest(value: str):
        return F.max(F.when(F.col(value).isNotNull(), F.struct("line_no", F.col(value).alias("v"))))["v"].alias(value)

    # sections as bits: strings and sets in the buffer would send every group through the sort of an object aggregation
    bit = F.call_function("shiftleft", F.lit(1), F.ascii("sec_at") - ord("A"))
    seen = lambda letter: F.col("seen").bitwiseAND(1 << ord(letter) - ord("A")) != 0
    tx = part.groupBy(*keys, "log_type", "tx", "n").agg(
        F.max("line_no").alias("line_no"),
        F.max("raw").alias("raw"),
        *[latest(c) for c in told],
        F.coalesce(F.bit_or(bit), F.lit(0)).alias("seen"),
    ).filter((seen("H") | seen("Z")) & F.col("time").isNotNull() & F.col("ip").isNotNull())
    tx = tx.select(
        "*", "request.method", "request.url",
        F.array_compact(F.array(*[F.when(seen(c), F.lit(c)) for c in ascii_uppercase])).alias("sections"),
    )
    return make_events(
        tx, source="MODSEC", service="HTTP", ts=to_utc(F.col("time"), ref_now, lenient), ip=F.col("ip"), domain=F.col("host"),
        message=F.concat_ws(
            " | ", F.lit("ModSec audit"), F.concat(F.lit("HTTP "), F.col("status")),
            F.when(F.col("url").isNotNull(), F.concat_ws(" ", "method", "url")),
        ),
        extra={
            "event_type": "waf_audit",
            "waf": {
                "engine": "modsecurity", "audit_txid": F.col("tx"),
                "http": {"method": F.col("method"), "url": F.col("url"), "status_code": F.col("status"), "host": F.col("host")},
                "seen_sections": F.col("sections"),
            },
        },
    )


def parse_waf(lines: DataFrame, ref_now=None, lenient: bool = False) -> DataFrame:
    return parse_waf_line(lines, ref_now, lenient).unionByName(assemble_waf_transactions(lines, ref_now, lenient))


def _setting(line, name: str):
    """Value of `NAME=value`, also behind a comment sign."""
    plain = F.ltrim(line, F.lit("#"))
    return F.when(plain.startswith(f"{name}="), text_or_null(after(plain, "=")))


def parse_sar(lines: DataFrame, ref_now=None, lenient: bool = False) -> DataFrame:
    """System activity reports: load, memory and disk rows under the date, mode and CPU count seen before them."""
    base = _blocks(lines.withColumn("line", F.trim("raw")).filter("line <> ''"))
    line = F.col("line")
    cpus_said = at(words(F.substring_index(F.when(line.contains(" CPU)"), F.substring_index(line, " CPU)", 1)), "(", -1)), 0)
    headed = (
        base.withColumn("date_at", F.when(_setting(line, "SAR_DATE").cast("string").rlike(r"^[0-9]{4}(-[0-9]{2}){2}$"), _setting(line, "SAR_DATE")))
        .withColumn("mode_at", F.when(_setting(line, "SAR_MODE").startswith("-"), _setting(line, "SAR_MODE")))
        .withColumn("cpu_at", F.when(is_digits(cpus_said), cpus_said))
    )
    held = carry_forward(
        headed, ["server", "file"], ["line_no"], {"date_at": "date", "mode_at": "mode", "cpu_at": "cpus"}, "block"
    )
    low = F.lower(line)
    header = (
        F.col("date_at").isNotNull() | F.col("mode_at").isNotNull() | line.startswith("Linux ") | line.startswith("Average:")
        | line.contains("LINUX RESTART") | (line.contains("runq-sz") & line.contains("ldavg-1"))
        | (low.contains("kbmemfree") & low.contains("%memused"))
    )
    m = held.filter(~header & F.col("date").isNotNull())
    # columns: clock, perhaps AM or PM, values
    c = words(line)
    half = F.upper(at(c, 1)).isin("AM", "PM")
    m = pinned(m, "c", F.struct(at(c, 0).alias("clock"), F.when(half, F.upper(at(c, 1))).alias("half"), F.slice(c, F.when(half, 3).otherwise(2), F.size(c)).alias("v")))
    m = m.filter(is_clock(F.col("c.clock")))
    v = F.col("c.v")
    value = lambda i: at(v, i)
    whole = lambda *places: reduce(lambda a, b: a & b, [is_digits(value(i)) for i in places])
    mode = F.lower(F.coalesce("mode", F.lit("")))
    load = (F.size(v) == 6) & F.forall(v, is_number) & mode.isin("", "-q")
    avail = whole(0, 1, 2) & is_number(value(3))
    plain = whole(0, 1) & is_number(value(2))
    memory = (avail | plain) & mode.isin("", "-r")
    last = F.size(v) - 1
    disk = (F.size(v) > 2) & is_number(value(1)) & is_number(value(last)) & mode.isin("", "-d") & (F.upper(value(0)) != "DEV")
    m = m.withColumn("what", F.when(load, "load").when(memory, "memory").when(disk, "disk")).filter("what IS NOT NULL")
    what = F.col("what")
    clock = F.split("c.clock", ":")
    hour = clock[0].cast("int")
    hour = F.when((F.col("c.half") == "PM") & (hour != 12), hour + 12).when((F.col("c.half") == "AM") & (hour == 12), 0).otherwise(hour)
    day = F.split("date", "-")
    ts = F.try_make_timestamp(day[0].cast("int"), day[1].cast("int"), day[2].cast("int"), hour, clock[1].cast("int"), clock[2].cast("decimal(16,6)"), F.lit("UTC"))
    cpus = F.coalesce(F.col("cpus").cast("int"), F.lit(0))

    def only(kind, value):
        return F.when(what == kind, value)

    def load_value(i, per_cpu=False):
        found = F.when(what == "load", value(i).try_cast("double"))
        return F.when(cpus > 0, found / F.nullif(cpus, F.lit(0))) if per_cpu else found

    return make_events(
        m, source="SAR_STATS", service="INFRA", ts=ts,
        message=F.when(what == "load", "sar -q load").when(what == "memory", "sar -r memory").otherwise("sar -d disk"),
        extra={
            "event_type": "metric",
            "metric": {
                "family": "sar", "name": what, "cpu_count": only("load", cpus),
                "runq_sz": load_value(0), "plist_sz": load_value(1), "blocked": load_value(5),
                "ldavg_1": load_value(2), "ldavg_5": load_value(3), "ldavg_15": load_value(4),
                "ldavg_1_per_cpu": load_value(2, True), "ldavg_5_per_cpu": load_value(3, True), "ldavg_15_per_cpu": load_value(4, True),
                "kb_mem_free": only("memory", value(0)),
                "kb_mem_used": only("memory", F.when(avail, value(2)).otherwise(value(1))),
                "kb_mem_avail": only("memory", F.when(avail, value(1))),
                "mem_used_pct": only("memory", F.when(avail, value(3)).otherwise(value(2))),
                "device": only("disk", value(0)), "tps": only("disk", value(1)),
                "util_pct": only("disk", value(last)), "rest": only("disk", F.array_join(F.slice(v, 3, F.greatest(F.size(v) - 3, F.lit(0))), " ")),
            },
        },
    )
