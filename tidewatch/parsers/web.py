"""Web access and error logs, and the PHP errors inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.times import to_utc
from tidewatch.parsers.capture import pinned
from tidewatch.functions.cut import after, at, before, between, contains_any, is_digits, quoted, text_or_null, words
from tidewatch.schemas import make_events

# Marks of directory-index noise.
AUTOINDEX_MARKS = ["ah01276", "autoindex:error"]
# The levels that the language writes before its message.
PHP_LEVELS = ["Warning", "Fatal error", "Parse error", "Notice"]
WORD_SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789_"
# What replaces home folders and numbers in a signature.
REDACTED = [(r"/home/\S+", "/home/<redacted>"), (r"\b\d+\b", "<n>")]
# Messages about files that could not be loaded.
LOAD_MARKS = ["failed opening required", "no such file or directory", "require_once", "require(", "include_once", "include("]
# Folders of the blog application.
APP_FOLDERS = ["wp-content", "wp-includes", "/wp-admin/"]


def parse_http_access(lines: DataFrame, ref_now=None, source: str = "APACHE_ACCESS", lenient: bool = False) -> DataFrame:
    """Combined access log lines: the quoted parts are request, referer and agent; status and size stand between the first two."""
    m = pinned(lines, "q", quoted(F.col("raw"))).filter("size(q) >= 6")
    head, answer, request = F.get("q", F.lit(0)), words(F.get("q", F.lit(2))), words(F.get("q", F.lit(1)))
    client = words(before(head, "["))
    m = pinned(m, "f", F.struct(
        at(client, F.size(client) - 3).alias("ip"), between(head, "[", "]").alias("time"), at(request, 0).alias("method"), at(request, 1).alias("path"),
        at(answer, 0).alias("status"), at(answer, 1).alias("size"),
    )).filter("f.ip IS NOT NULL AND f.time IS NOT NULL AND f.path IS NOT NULL AND f.size IS NOT NULL AND length(f.status) = 3").filter(is_digits(F.col("f.status")))
    size = F.nullif(F.col("f.size"), F.lit("-"))
    return make_events(
        m, source=source, service="HTTP", ts=to_utc(F.col("f.time"), ref_now, lenient), ip=F.col("f.ip"),
        message=F.concat_ws(" ", "f.method", "f.path", "f.status"),
        extra={
            "event_type": "http_access",
            "http": {
                "method": F.col("f.method"), "path": F.col("f.path"), "status": F.col("f.status"), "bytes": size.try_cast("bigint"),
                "user_agent": at(F.col("q"), 5), "referer": at(F.col("q"), 3),
            },
        },
    )


def _with_client(lines: DataFrame, rest: str) -> DataFrame:
    """Add `client`: the address of the bracket that names the client, without its port."""
    m = pinned(lines, "_bracket", between(F.col(rest), "[client ", "]"))
    m = pinned(m, "_first", F.get(words(F.col("_bracket")), F.lit(0)))
    return pinned(m, "client", text_or_null(before(text_or_null(F.col("_first")), ":"))).drop("_bracket", "_first")


def _with_referer_host(lines: DataFrame, rest: str) -> DataFrame:
    """Add `referer_host`: lower-cased host of the address behind the word referer."""
    m = pinned(lines, "_parts", F.split(F.ltrim(after(F.lower(rest), "referer:")), "/", 4))
    parts = F.col("_parts")
    web = F.get(parts, F.lit(0)).isin("http:", "https:") & (F.get(parts, F.lit(1)) == "")
    return pinned(m, "referer_host", F.when(web, at(words(F.get(parts, F.lit(2))), 0))).drop("_parts")


def _with_php(lines: DataFrame, text: Column, name: str = "p") -> DataFrame:
    """Add level and message of the first PHP error in a text, else null: a level of the language behind its name, with a colon and a blank."""
    m = pinned(pinned(lines, "_text", text), "_low", F.lower("_text"))
    m = pinned(m, "_start", F.least(*[F.nullif(F.instr("_low", f"php {level.lower()}: "), F.lit(0)) for level in PHP_LEVELS]))
    text, start = F.col("_text"), F.col("_start")
    m = pinned(m, "_rest", F.ltrim(text.substr(start + F.lit(len("php ")), F.length(text))))
    own_word = (start == 1) | ~F.lower(text.substr(start - 1, F.lit(1))).isin(*WORD_SIGNS)
    rest = F.col("_rest")
    php = F.when(own_word, F.struct(text_or_null(before(rest, ":")).alias("level"), text_or_null(after(rest, ":")).alias("message")))
    return pinned(m, name, php).drop("_text", "_low", "_start", "_rest")


def _files(message: Column, *starts: str) -> Column:
    """Names in a message that end in .php and begin with one of the starts."""
    names = F.split(message, r"[^\w.-]+")
    begins = lambda n: F.lower(n).rlike("^(" + "|".join(starts) + ")")
    return F.filter(names, lambda n: F.lower(n).endswith(".php") & begins(n))


def _with_about(lines: DataFrame, message: Column) -> DataFrame:
    """Add `about`, what a PHP message tells of the application: core file, file that is missing, out of memory, load error, application named."""
    m = pinned(pinned(lines, "_message", message), "_low", F.lower("_message"))
    m = pinned(m, "_core", F.get(_files(F.col("_message"), "wp-", "class-wp"), F.lit(0)))
    m = pinned(m, "_opened", after(F.col("_message"), "failed opening required '", F.col("_low")))
    low, opened = F.col("_low"), F.col("_opened")
    about = F.struct(
        F.col("_core").alias("core"), F.when(opened.contains("'"), text_or_null(before(opened, "'"))).alias("missing"),
        (low.contains("allowed memory size of ") & low.contains(" bytes exhausted")).alias("memory"),
        contains_any(low, LOAD_MARKS).alias("load"),
        (contains_any(low, APP_FOLDERS) | F.col("_core").isNotNull()).alias("app"),
    )
    return pinned(m, "about", about).drop("_message", "_low", "_core", "_opened")


def with_php_error(lines: DataFrame, rest: str) -> DataFrame:
    """Add `php`: the PHP error inside a web error line that concerns the blog application, else null."""
    m = _with_about(_with_php(lines, F.col(rest)), F.col("p.message"))
    kind = (
        F.when(F.col("about.core").isNotNull() | F.col("about.missing").isNotNull(), "missing_file")
        .when(F.col("about.memory"), "memory_exhausted").otherwise("php_error")
    )
    error = F.struct(
        F.col("p.level").alias("level"), F.col("p.message").alias("message"), kind.alias("kind"),
        F.col("about.core").alias("core_file"), F.col("about.missing").alias("missing_file"), F.when(F.col("about.memory"), F.lit(True)).alias("noise"),
    )
    return m.withColumn("php", F.when(F.expr("p IS NOT NULL AND about.app AND (about.memory OR about.load)"), error)).drop("p", "about")


def parse_http_error(lines: DataFrame, ref_now=None, lenient: bool = False) -> DataFrame:
    """Web error log: directory-index noise, application errors, everything else."""
    m = pinned(lines.filter(F.col("raw").startswith("[")), "time", between(F.col("raw"), "[", "]")).filter("time IS NOT NULL")
    m = pinned(m, "rest", F.trim(after(F.col("raw"), "]")))
    m = with_php_error(m, "rest")
    low = F.lower("rest")
    m = pinned(m, "auto", low.contains(AUTOINDEX_MARKS[0]) | low.contains(AUTOINDEX_MARKS[1]))
    m = pinned(m, "php", F.when(~F.col("auto"), F.col("php")))
    m = _with_referer_host(_with_client(m, "rest"), "rest")
    is_php = F.col("php").isNotNull()
    return make_events(
        m, source="APACHE_ERROR", service=F.when(is_php, "WORDPRESS").otherwise("HTTP"),
        ts=to_utc(F.col("time"), ref_now, lenient), ip=F.col("client"),
        message=F.when(F.col("auto"), "AUTOINDEX forbidden (AH01276)").when(is_php, F.col("php.message")).otherwise(F.col("rest")),
        extra={
            "event_type": F.when(is_php, "app_error").otherwise("http_error"),
            "kind": F.when(F.col("auto"), "autoindex_forbidden").when(~is_php, "apache_error"),
            "noise": F.when(F.col("auto"), F.lit(True)).otherwise(F.col("php.noise")),
            "referer_host": F.col("referer_host"),
            "app": F.when(is_php, "wordpress"),
            "level": F.col("php.level"),
            "wp": (is_php, {
                "kind": F.col("php.kind"), "core_file": F.col("php.core_file"), "missing_file": F.col("php.missing_file"),
            }),
        },
    )


def parse_php_error(lines: DataFrame, ref_now=None, lenient: bool = False) -> DataFrame:
    """Only the application errors of a web error log."""
    return parse_http_error(lines, ref_now, lenient).filter(F.col("extra.event_type") == "app_error")


def parse_wp_error(lines: DataFrame, ref_now=None, lenient: bool = False, signature_chars: int | None = None) -> DataFrame:
    """The application's own PHP error log, with a redacted signature (whole, or cut to a number of characters)."""
    m = pinned(lines.filter(F.col("raw").contains("[")), "time", between(F.col("raw"), "[", "]"))
    m = _with_php(m, after(F.col("raw"), "]"), "php").filter("time IS NOT NULL AND php IS NOT NULL")
    msg = F.col("php.message")
    m = _with_about(m, msg)
    own = F.size(_files(msg, "wp-")) > 0
    m = m.filter(contains_any(F.lower(msg), APP_FOLDERS) | own)
    kind = F.when(F.col("about.memory"), "memory_exhausted").when(F.col("about.core").isNotNull() | F.col("about.missing").isNotNull(), "missing_file").otherwise("php_error")
    signature = msg
    for pattern, instead in REDACTED:
        signature = F.regexp_replace(signature, pattern, instead)
    return make_events(
        m, source="WP_ERROR", service="WORDPRESS", ts=to_utc(F.col("time"), ref_now, lenient), message=msg,
        extra={
            "event_type": "app_error", "app": "wordpress", "level": F.col("php.level"),
            "signature": signature if signature_chars is None else F.substring(signature, 1, signature_chars),
            "wp": {"kind": kind, "core_file": F.col("about.core"), "missing_file": F.col("about.missing")},
            "noise": F.when(F.col("about.memory"), F.lit(True)),
        },
    )
