"""Counting predicate index: which of many rules an event meets, without one expression a rule.

Each distinct (field, test) of all rules is evaluated once an event and gives one bit of a few words. An event then meets the rules of its
source and type only, and of those the ones whose bits are all set. Equality tests of a text field share one look-up of its value; a field with
more than `INLINE` distinct values or tokens is looked up by joins, so lists may be as long as a table. Plan text and generated code grow with the
distinct tests and never with rules times tests.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.fields import event_field, field_type, group_key, text
from tidewatch.operators.rules import EventRule, TrustConfig, extra_trust, rule_match
from tidewatch.operators.staging import staged
from tidewatch.operators.tokens import token_hits

WORD = 62  # tests a word: a bigint without its sign
INLINE = 64  # distinct values or tokens of a field that stand in the plan; more of them are joined
COMPARISONS = (">=", ">", "<=", "<")


def literal(value: Any, ddl: str) -> Column:
    """A nested constant in one expression, folded when the plan is made."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def by_rule(values: dict[int, Any], ddl: str) -> Column:
    """The value of the row's rule."""
    return F.element_at(literal({str(k): v for k, v in values.items()}, f"map<string,{ddl}>"), F.col("rule_id").cast("string"))


@dataclass(frozen=True)
class FieldTest:
    """One operator on one field; `value` is its JSON text, so that equal tests are the same test."""

    path: str
    op: str
    value: str

    @property
    def items(self) -> list[Any]:
        found = json.loads(self.value)
        return found if isinstance(found, list) else []

    def column(self, schema: T.StructType, extended: bool) -> Column:
        return rule_match(schema, {self.path: {self.op: json.loads(self.value)}}, None, extended)


def field_tests(match: dict[str, Any] | None, lists: dict[str, list[str]]) -> list[FieldTest]:
    """The tests that all have to hold; references to lists are resolved, equality is a list of one value."""
    out = []
    for path, cond in (match or {}).items():
        cond = cond if isinstance(cond, dict) else {"eq": cond}
        for op in ("exists", "eq", "contains", *COMPARISONS):
            if op == "eq" and op in cond and not isinstance(cond["eq"], (list, dict)):
                out.append(FieldTest(path, "in", json.dumps([cond["eq"]])))
            elif op in cond:
                out.append(FieldTest(path, op, json.dumps(cond[op], sort_keys=True)))
        for op in ("contains_any", "in"):
            if op in cond or f"{op}_ref" in cond:
                values = lists.get(str(cond[f"{op}_ref"] or "").strip()) if f"{op}_ref" in cond else cond[op]
                out.append(FieldTest(path, op, json.dumps(values if isinstance(values, list) else [])))
    return out


def _tokens(test: FieldTest) -> list[str]:
    return [str(t) for t in test.items if t is not None and str(t) != ""]


class _Words:
    """The words of bits under construction: the parts of each, to be joined by or."""

    def __init__(self) -> None:
        self.parts: list[list[Column]] = []
        self.places: dict[Any, int] = {}

    def place(self, test: Any) -> int:
        at = self.places.setdefault(test, len(self.places))
        while len(self.parts) <= at // WORD:
            self.parts.append([])
        return at

    def mask(self, places: list[int]) -> list[int]:
        out = [0] * len(self.parts)
        for p in places:
            out[p // WORD] |= 1 << p % WORD
        return out

    def add(self, place: int, test: Column) -> None:
        self.parts[place // WORD].append(F.when(test, F.lit(1 << place % WORD).cast("bigint")).otherwise(F.lit(0).cast("bigint")))

    def add_masks(self, places: list[int], masks: Column) -> None:
        """Bits that a look-up gives as an array of words, from the first word of `places` on."""
        first, last = min(places) // WORD, max(places) // WORD
        for w in range(first, last + 1):
            self.parts[w].append(F.coalesce(F.get(masks, F.lit(w - first)), F.lit(0).cast("bigint")))

    def local(self, places: list[int], held: list[int]) -> list[int]:
        """Mask of `held` in the words of `places`."""
        return self.mask(held)[min(places) // WORD:max(places) // WORD + 1]

    def columns(self) -> dict[str, Column]:
        out = {}
        for w, parts in enumerate(self.parts):
            while len(parts) > 1:  # a balanced tree: depth grows with the logarithm of the tests
                parts = [a.bitwiseOR(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) & ~1:]
            out[f"_bits{w}"] = parts[0] if parts else F.lit(0).cast("bigint")
        return out


def _value_masks(events: DataFrame, words: _Words, number: int, col: Column, tests: list[FieldTest]) -> DataFrame:
    """Equality tests of one text field: value to the tests it meets."""
    places = [words.place(t) for t in tests]
    of: dict[str, list[int]] = {}
    for test, place in zip(tests, places):
        for value in test.items:
            of.setdefault(value, []).append(place)
    if len(of) <= INLINE:
        words.add_masks(places, F.element_at(literal({v: words.local(places, held) for v, held in of.items()}, "map<string,array<bigint>>"), col))
        return events
    rows = [(v, words.local(places, held)) for v, held in of.items()]
    table = staged(events.sparkSession.createDataFrame(rows, f"_value{number} string, _masks{number} array<bigint>"), "rule-values")
    words.add_masks(places, F.col(f"_masks{number}"))
    return events.join(table, col == F.col(f"_value{number}"), "left").drop(f"_value{number}")


def _token_masks(events: DataFrame, words: _Words, number: int, col: Column, tests: list[FieldTest]) -> DataFrame:
    """Token tests of one field: tests whose tokens the text contains, by the index of tokens."""
    places = [words.place(t) for t in tests]
    rows = [(token, place) for test, place in zip(tests, places) for token in set(_tokens(test))]
    spark = events.sparkSession
    tokens = staged(spark.createDataFrame(rows, "token string, tag int"), "rule-tokens")
    hits = token_hits(events.select(text(col).alias("text")), tokens)
    first, count = min(places) // WORD, max(places) // WORD - min(places) // WORD + 1
    bit = F.expr(f"shiftleft(1L, tag % {WORD})")
    masks = [F.coalesce(F.bit_or(F.when(F.floor(F.col("tag") / WORD) == first + w, bit)), F.lit(0).cast("bigint")) for w in range(count)]
    found = hits.groupBy(F.col("text").alias(f"_text{number}")).agg(F.array(*masks).alias(f"_masks{number}"))
    words.add_masks(places, F.col(f"_masks{number}"))
    return events.join(found, text(col) == F.col(f"_text{number}"), "left").drop(f"_text{number}")


def matched_rules(events: DataFrame, rules: list[EventRule], trust: TrustConfig, extended: bool = False) -> DataFrame:
    """One row per (event, rule that it meets), with rule_id, group_key, w, trusted and group_fields beside the event's columns.

    `events` has rule_source, rule_type, ip_long and trusted_base. Texts of a stream cannot be grouped before the join, so token tests of a
    stream stay in the plan, however many; its equality tests are joined as others are. Two columns of an event may hold equal texts.
    """
    schema, words = events.schema, _Words()
    tests = {r.id: field_tests(r.match, trust.lists) for r in rules}
    distinct = list(dict.fromkeys(t for of_rule in tests.values() for t in of_rule))
    by_value: dict[str, list[FieldTest]] = {}
    by_token: dict[str, list[FieldTest]] = {}
    inline = []
    for t in distinct:
        is_text = isinstance(field_type(schema, t.path) or T.StringType(), T.StringType)
        if t.op == "in" and is_text and t.items and all(isinstance(v, str) for v in t.items):
            by_value.setdefault(t.path, []).append(t)
        elif t.op == "contains_any":
            by_token.setdefault(t.path, []).append(t)
        else:
            inline.append(t)
    for path, of_field in list(by_token.items()):
        if events.isStreaming or len({token for t in of_field for token in _tokens(t)}) <= INLINE:
            inline += by_token.pop(path)
    rows = events
    for number, (path, of_field) in enumerate(by_value.items()):
        rows = _value_masks(rows, words, number, event_field(schema, path, extended), of_field)
    for number, (path, of_field) in enumerate(by_token.items(), len(by_value)):
        rows = _token_masks(rows, words, number, event_field(schema, path, extended), of_field)
    for t in inline:
        words.add(words.place(t), t.column(schema, extended))
    extras = {r.id: extra_trust(schema, r.emit) for r in rules}
    for extra in extras.values():
        if extra and extra[0] not in words.places:
            words.add(words.place(extra[0]), extra[1])

    fields = list(dict.fromkeys(tuple(r.fields) for r in rules))
    wanted: dict[str, list[dict[str, Any]]] = {}
    for r in sorted(rules, key=lambda r: r.id):
        wanted.setdefault(f"{r.source.strip().upper()}\n{r.event_type.strip().lower()}", []).append({
            "rule_id": r.id, "w": r.window_seconds * 1_000_000, "fields": fields.index(tuple(r.fields)), "any": bool(r.emit.get("ignore_trust")),
            "need": words.mask([words.places[t] for t in tests[r.id]]), "extra": words.mask([words.places[extras[r.id][0]]] if extras[r.id] else []),
        })
    rule = "struct<rule_id:int,w:bigint,fields:int,any:boolean,need:array<bigint>,extra:array<bigint>>"
    own = F.element_at(literal(wanted, f"map<string,array<{rule}>>"), F.concat("rule_source", F.lit("\n"), "rule_type"))
    names = list(words.columns())
    rows = rows.withColumns(words.columns()).withColumn("_rule", F.explode(own))
    word = lambda name, w: F.get(F.col(f"_rule.{name}"), F.lit(w))
    extra = F.lit(False)
    for w, n in enumerate(names):
        rows = rows.filter(F.col(n).bitwiseAND(word("need", w)) == word("need", w))
        extra = extra | (F.col(n).bitwiseAND(word("extra", w)) != 0)
    rows = rows.withColumn("trusted", F.col("trusted_base") | extra).filter(F.col("_rule.any") | ~F.col("trusted"))

    def of_fields(value) -> Column:
        out = F.lit(None)
        for place, names_ in reversed(list(enumerate(fields))):
            out = F.when(F.col("_rule.fields") == place, value(list(names_))).otherwise(out)
        return out

    values = lambda fs: [event_field(schema, f, extended) for f in fs]
    return rows.withColumns({
        "rule_id": F.col("_rule.rule_id"), "w": F.col("_rule.w"), "group_key": of_fields(lambda fs: group_key(values(fs))),
        "group_fields": of_fields(lambda fs: F.map_from_arrays(F.array(*map(F.lit, fs)), F.array(*[v.cast("string") for v in values(fs)]))),
    }).drop("_rule", *names)
