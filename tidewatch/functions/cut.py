"""Cutting log lines by position and by plain marks: words, quoted parts, text after or between marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.fields import truthy


def text_or_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def at(parts: Column, i: int | Column) -> Column:
    """Trimmed part; null when there is none or it is blank."""
    return text_or_null(F.get(parts, i if isinstance(i, Column) else F.lit(i)))


def after(text: Column, mark: str, where: Column | None = None) -> Column:
    """What follows the first mark; null without one. `where` is a same-length text in which to look for it (lower-cased, say)."""
    place = F.instr(text if where is None else where, mark)
    return F.when(place > 0, text.substr(place + len(mark), F.length(text)))


def before(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def between(text: Column, opening: str, closing: str) -> Column:
    rest = after(text, opening)
    return F.when(rest.contains(closing), text_or_null(before(rest, closing)))


def words(text: Column, limit: int = -1) -> Column:
    return F.split(F.trim(text), r"\s+", limit)


def quoted(text: Column) -> Column:
    """The line cut at its quotes: even parts lie outside, odd ones inside."""
    return F.split(text, '"')


def word_with(parts: Column, *starts: str) -> Column:
    """What follows the first of the starts that a word begins with (`key=` gives the value)."""
    hit = lambda w: _any([w.startswith(s) for s in starts])
    word = F.get(F.filter(parts, hit), F.lit(0))
    value = F.lit(None).cast("string")
    for s in starts:
        value = F.when(word.startswith(s), word.substr(F.lit(len(s) + 1), F.length(word))).otherwise(value)
    return text_or_null(value)


def next_to(parts: Column, word: str, step: int = 1) -> Column:
    """The word so many places after (or before) the first occurrence of a word."""
    place = F.array_position(parts, word)
    target = (place - 1 + step).cast("int")
    return F.when((place > 0) & (target >= 0), at(parts, target))


def is_ipv4(text: Column) -> Column:
    """Four numbers of one to three digits with dots between."""
    parts = F.split(text, "[.]")
    return truthy((F.size(parts) == 4) & F.forall(parts, lambda p: (F.length(p) <= 3) & is_digits(p)))


def is_digits(text: Column) -> Column:
    return truthy((F.length(text) > 0) & (F.translate(text, "0123456789", "") == ""))


def is_number(text: Column) -> Column:
    """Digits, with at most one point inside."""
    parts = F.split(text, "[.]")
    return truthy((F.size(parts) <= 2) & F.forall(parts, is_digits))


def is_clock(text: Column) -> Column:
    """Hours, minutes and seconds of two digits each (one digit of hours will do)."""
    parts = F.split(text, ":")
    return truthy((F.size(parts) == 3) & F.forall(parts, is_digits) & F.length(text).between(7, 8))


def stamped(text: Column) -> Column:
    """Leading `YYYY-MM-DD HH:MM:SS`, else null."""
    head = text.substr(1, 19)
    return F.when(is_clock(head.substr(12, 8)) & (head.substr(5, 1) == "-") & (head.substr(8, 1) == "-"), head)


def syslog(text: Column) -> Column:
    """Words of a system log line: month, day, clock, host, tag with its colon, rest; null when it is none."""
    parts = words(text, 6)
    shaped = (F.size(parts) == 6) & (F.length(F.get(parts, F.lit(0))) == 3) & is_clock(F.get(parts, F.lit(2))) & F.get(parts, F.lit(4)).endswith(":")
    return F.when(shaped, parts)


def syslog_time(parts: Column) -> Column:
    return F.concat_ws(" ", F.slice(parts, 1, 3))


def syslog_process(parts: Column) -> Column:
    """The tag without its colon and process number."""
    return before(F.rtrim(F.get(parts, F.lit(4)), F.lit(":")), "[")


def contains_any(text: Column, marks: list[str]) -> Column:
    return _any([text.contains(m) for m in marks])


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out
