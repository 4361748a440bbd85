"""Event rules: definition, matching, trust, scalars and conditions as Column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.fields import blank_to_null, event_field, field_type, text, truthy
from tidewatch.functions.net import ip_in_any, ip_to_long, is_non_global, networks_hold


@dataclass(frozen=True)
class EventRule:
    id: int
    name: str
    source: str
    event_type: str
    severity: int = 3
    match: dict[str, Any] = field(default_factory=dict)
    group_by: list[str] = field(default_factory=list)
    window_seconds: int = 300
    let: dict[str, Any] = field(default_factory=dict)
    condition: str = ""
    cooldown_seconds: int = 900
    evidence: dict[str, Any] = field(default_factory=dict)
    emit: dict[str, Any] = field(default_factory=dict)
    enabled: bool = True

    @property
    def fields(self) -> list[str]:
        return list(self.group_by) or ["server"]


def _strings(value: Any) -> list[str]:
    items = value if isinstance(value, list) else [] if value is None else [value]
    return [str(x).strip() for x in items if x is not None and str(x).strip()]


@dataclass(frozen=True)
class TrustConfig:
    """Trusted countries, networks, operators and per-server addresses, plus named token lists."""

    countries: list[str] = field(default_factory=list)
    asn_numbers: list[int] = field(default_factory=list)
    ips: list[str] = field(default_factory=list)
    server_ips: dict[str, list[str]] = field(default_factory=dict)
    lists: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, cfg: dict[str, Any]) -> TrustConfig:
        servers = cfg.get("servers") if isinstance(cfg.get("servers"), dict) else {}
        lists = cfg.get("lists") if isinstance(cfg.get("lists"), dict) else {}
        return cls(
            countries=[c.upper() for c in _strings(cfg.get("trusted_countries"))],
            asn_numbers=[int(a) for a in _strings(cfg.get("trusted_asn_numbers")) if re.fullmatch(r"-?\d+", a)],
            ips=_strings(cfg.get("trusted_ips")),
            server_ips={s: _strings(e.get("server_ips")) for s, e in servers.items() if isinstance(e, dict)},
            lists={n: _strings(v) for n, v in lists.items()},
        )


# ---------------------------------------------------------------- matching


def _same(schema: T.StructType, path: str, col: Column, literal: Any) -> Column:
    """Equality without text/number coercion: values of different kinds are unequal."""
    if literal is None:
        return col.isNull()
    kind = field_type(schema, path) or T.StringType()
    is_text = isinstance(kind, T.StringType)
    if is_text != isinstance(literal, str) or isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.lit(False)
    if isinstance(kind, T.BooleanType) or isinstance(literal, bool):
        return truthy(col.cast("double") == float(literal))
    return truthy(col == F.lit(literal))


def _one_of(schema: T.StructType, path: str, col: Column, values: list[Any]) -> Column:
    """Equality with any of the values. Texts and whole numbers are looked up in a set, however many they are."""
    kind = field_type(schema, path) or T.StringType()
    texts = [v for v in values if isinstance(v, str)]
    whole = [v for v in values if isinstance(v, int) and not isinstance(v, bool) and abs(v) < 1 << 63]
    hit = F.lit(False)
    if isinstance(kind, T.StringType) and texts:
        hit = hit | truthy(col.isin(texts))
    elif isinstance(kind, T.IntegralType) and whole:
        hit = hit | truthy(col.cast("bigint").isin(whole))
    else:
        whole = []
    for v in values:
        if not isinstance(v, str) and v not in whole:
            hit = hit | _same(schema, path, col, v)
    return hit


def rule_match(
    schema: T.StructType, match: dict[str, Any], lists: dict[str, list[str]] | None = None, extended: bool = False
) -> Column:
    """All listed field conditions hold; an empty match is always true, an empty list never."""
    lists = lists or {}
    out = F.lit(True)
    for path, cond in (match or {}).items():
        col = event_field(schema, path, extended)
        if not isinstance(cond, dict):
            out = out & _same(schema, path, col, cond)
            continue
        if "exists" in cond:
            out = out & (col.isNotNull() if cond["exists"] else col.isNull())
        if "eq" in cond:
            out = out & _same(schema, path, col, cond["eq"])
        if "contains" in cond:
            out = out & text(col).contains("" if cond["contains"] is None else str(cond["contains"]))
        if "contains_any" in cond or "contains_any_ref" in cond:
            tokens = cond.get("contains_any")
            if "contains_any_ref" in cond:
                tokens = lists.get(str(cond["contains_any_ref"] or "").strip())
            hit = F.lit(False)
            for token in tokens if isinstance(tokens, list) else []:
                if token is not None and str(token) != "":
                    hit = hit | text(col).contains(str(token))
            out = out & hit
        for op in (">=", ">", "<=", "<"):
            if op in cond:
                out = out & _compare(col.cast("string").try_cast("double"), op, cond[op])
        if "in" in cond or "in_ref" in cond:
            values = cond.get("in")
            if "in_ref" in cond:
                values = lists.get(str(cond["in_ref"] or "").strip())
            out = out & _one_of(schema, path, col, values if isinstance(values, list) else [])
    return out


def _compare(number: Column, op: str, bound: Any) -> Column:
    try:
        b = F.lit(float(bound))
    except (TypeError, ValueError):
        return F.lit(False)
    test = {">=": number >= b, ">": number > b, "<=": number <= b, "<": number < b}[op]
    return truthy(test)


# ---------------------------------------------------------------- trust


def geo_country(schema: T.StructType) -> Column:
    """Country code of the event's geo block."""
    geo = event_field(schema, "extra.geo.country_code")
    return F.coalesce(geo, event_field(schema, "extra.geoip.country_code"))


def asn_number(schema: T.StructType) -> Column:
    nested = event_field(schema, "extra.asn.number")
    return F.coalesce(nested, event_field(schema, "extra.asn_number")).cast("string").try_cast("bigint")


def _ip_long(schema: T.StructType) -> Column:
    """Numeric client address: the column of that name when the caller has prepared it."""
    return F.col("ip_long") if "ip_long" in schema.names else ip_to_long(blank_to_null(F.col("ip_client")))


def is_trusted(schema: T.StructType, cfg: TrustConfig) -> Column:
    """Non-global address, trusted country, operator, address or the server's own address."""
    ip, n = blank_to_null(F.col("ip_client")), _ip_long(schema)
    out = is_non_global(ip, n) | ip_in_any(ip, cfg.ips, n)
    if cfg.countries:
        out = out | truthy(F.upper(geo_country(schema)).isin(cfg.countries))
    if cfg.asn_numbers:
        out = out | truthy(asn_number(schema).isin(cfg.asn_numbers))
    server = F.trim(F.col("server"))
    return truthy(out | networks_hold(ip, cfg.server_ips, server, n))


def extra_trust(schema: T.StructType, emit: dict[str, Any]) -> tuple[tuple, Column] | None:
    """The rule's own extra countries, addresses and usernames: a key that equal lists share, and their test. None without any."""
    emit = emit if isinstance(emit, dict) else {}
    countries = [c.upper() for c in _strings(emit.get("trusted_countries_extra"))]
    users = [u.lower() for u in _strings(emit.get("trusted_usernames_extra"))]
    ips = _strings(emit.get("trusted_ips_extra"))
    if not (countries or users or ips):
        return None
    out = ip_in_any(blank_to_null(F.col("ip_client")), ips, _ip_long(schema))
    if countries:
        out = out | truthy(F.upper(geo_country(schema)).isin(countries))
    if users:
        out = out | truthy(F.lower(F.trim(F.col("username"))).isin(users))
    return ("trust", tuple(countries), tuple(users), tuple(ips)), out


def is_trusted_for_rule(schema: T.StructType, cfg: TrustConfig, emit: dict[str, Any]) -> Column:
    """Trust plus the rule's own extra countries, addresses and usernames."""
    base = F.col("trusted_base") if "trusted_base" in schema.names else is_trusted(schema, cfg)
    extra = extra_trust(schema, emit)
    return base | extra[1] if extra else base


# ---------------------------------------------------------------- derived values


def event_action(df: DataFrame) -> Column:
    """fail / success from the action, else from the panel status."""
    action = F.lower(F.trim(text(event_field(df.schema, "extra.action"))))
    panel = F.lower(F.trim(text(event_field(df.schema, "extra.panel.status"))))
    return (
        F.when(action.isin("fail", "failed"), "fail")
        .when(action.isin("success", "ok", "passed"), "success")
        .when(panel.isin("failed", "fail"), "fail")
        .when(panel.isin("ok", "success"), "success")
    )


def event_path(df: DataFrame) -> Column:
    """First present of web path, panel path and WAF uri; blank counts as missing."""
    first = F.coalesce(*[event_field(df.schema, f"extra.{p}") for p in ("http.path", "panel.path", "waf.uri")])
    return blank_to_null(first)


def rule_let(schema: T.StructType, block: dict[str, Any] | None, extended: bool = False) -> dict[str, Column]:
    """Named scalars: literals, or event fields when the text has a dot or names a field.

    Field text is offered as a number when it reads as one, so that conditions can compare it.
    """
    out: dict[str, Column] = {}
    for key, value in (block or {}).items():
        name = str(key).strip()
        if not name:
            continue
        if not isinstance(value, str):
            out[name] = F.lit(value)
            continue
        v = value.strip()
        if "." in v or v.startswith("extra") or v in ("server", "ip_client", "username", "ip_subnet24", "ip_subnet16"):
            out[name] = event_field(schema, v, extended)
        elif v.lower() in ("true", "false"):
            out[name] = F.lit(v.lower() == "true")
        elif re.fullmatch(r"[+-]?\d+(\.\d*)?([eE][+-]?\d+)?", v):
            out[name] = F.lit(int(float(v)) if float(v).is_integer() else float(v))
        else:
            out[name] = F.lit(v or None)
    return out


# ---------------------------------------------------------------- conditions

# The names that conditions of event rules and of incident rules may use.
EVENT_CONDITION_NAMES = [
    "count", "unique_paths", "unique_ips", "unique_users", "unique_servers", "unique_subnets24",
    "top_subnet24_hits", "fail_count", "success_count", "server", "source", "event_type", "group_key",
    "ip_client", "ip_subnet24", "username", "geo_country", "asn_number",
]
INCIDENT_CONDITION_NAMES = [
    "count", "unique_alerts", "unique_servers", "max_severity", "sum_severity", "window_seconds",
    "group_key", "primary", "server",
]
_QUOTED = r"'[^']*'|\"[^\"]*\""
_WORDS = {"and", "or", "not", "in", "true", "false", "null", "is", "contains", "try_divide", "try_mod"}


def condition_error(condition: str, names: list[str]) -> str | None:
    """Why a condition cannot be used, or None. Only names, numbers, text and operators are allowed."""
    bare = re.sub(_QUOTED, " ", condition or "").replace("None", "null")
    if re.search(r"[^\w\s.()<>=!+\-*/%,]", bare):
        return "unsupported character"
    for word in re.findall(r"[A-Za-z_]\w*", bare):
        if word.lower() not in _WORDS and word not in names:
            return f"unknown name: {word}"
    return None


def with_condition_error(rules: DataFrame, condition: str, names: list[str]) -> DataFrame:
    """Adds `error` to a table of rules: why the condition of a row cannot be used, or null. The same tests as `condition_error`."""
    bare = F.regexp_replace(F.coalesce(F.col(condition), F.lit("")), _QUOTED, " ")
    known = F.array(*[F.lit(n) for n in [*names, "None"]])
    words = F.regexp_extract_all(bare, F.lit(r"([A-Za-z_]\w*)"), F.lit(1))
    strange = F.get(F.filter(words, lambda w: ~F.lower(w).isin(*sorted(_WORDS)) & ~F.array_contains(known, w)), F.lit(0))
    error = F.when(bare.rlike(r"[^\w\s.()<>=!+\-*/%,]"), "unsupported character").when(strange.isNotNull(), F.concat(F.lit("unknown name: "), strange))
    return rules.withColumn("error", error)


_BOOLEAN = {"and", "or", "not"}
_SAFE = {"/": "try_divide", "%": "try_mod"}


def _operands(tokens: list[str]) -> list[str]:
    """Tokens up to the closing bracket, with each bracketed part and each call as one operand."""
    out: list[str] = []
    while tokens:
        token = tokens.pop(0)
        if token == ")":
            break
        if token == "(":
            inner = "(" + _safe(_operands(tokens)) + ")"
            # a word before a bracket names a function, or is `in`
            called = out and re.fullmatch(r"[A-Za-z_]\w*", out[-1]) and out[-1].lower() not in _BOOLEAN | {"in"}
            token = out.pop() + inner if called else inner
        out.append(token)
    return out


def _safe(items: list[str]) -> str:
    """Items with products taken from left to right, division and remainder in their forms that yield null, and null-safe inequality."""
    terms: list[str] = []
    for item in items:
        if len(terms) > 1 and terms[-1] in ("*", "/", "%"):
            sign, left = terms.pop(), terms.pop()
            item = f"({left} * {item})" if sign == "*" else f"{_SAFE[sign]}({left}, {item})"
        terms.append(item)
    parts: list[list[str]] = [[]]
    for term in terms:
        if term.lower() in _BOOLEAN or term == ",":
            parts += [[term], []]
        else:
            parts[-1].append(term)
    for part in parts:
        if "!=" in part:
            at = part.index("!=")
            part[:] = [f"(NOT ({' '.join(part[:at])} <=> {' '.join(part[at + 1:])}))"]
    return " ".join(" ".join(p) for p in parts if p)


def condition_text(condition: str, rename: dict[str, str] | None = None) -> str:
    """Condition as Spark SQL: null-safe equality, and division that yields null instead of failing, whatever its operands are."""
    tokens = re.findall(rf"{_QUOTED}|[\w.]+|<=>|[<>=!]=|[^\s]", condition or "true")
    renamed = {"None": "NULL", **(rename or {})}
    sql = _safe(_operands([renamed.get(t, t) for t in tokens]))
    return re.sub(r"==", "<=>", sql)


def rule_condition(condition: str, rename: dict[str, str] | None = None) -> Column:
    """Boolean over metric columns; empty is true, null is false."""
    if not (condition or "").strip():
        return F.lit(True)
    return truthy(F.expr(condition_text(condition.strip(), rename)))
