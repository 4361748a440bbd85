"""Access to nested event fields by dotted path, and small text helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.net import ip_subnet

# The event attributes a rule may refer to.
RULE_ROOTS = ["id", "raw_id", "source", "server", "ip_client", "username", "timestamp_utc", "extra"]
# Attributes that rules see only with extended_fields=True.
EXTENDED_ROOTS = ["message", "domain", "service"]


def text(col: Column) -> Column:
    """Value as text, empty when missing."""
    return F.coalesce(col.cast("string"), F.lit(""))


def blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def field_type(schema: T.StructType, path: str) -> T.DataType | None:
    """Type at a dotted path, or None when the path does not exist."""
    here: T.DataType = schema
    for part in path.split("."):
        if not isinstance(here, T.StructType) or part not in here.names:
            return None
        here = here[part].dataType
    return here


def optional(df: DataFrame, path: str, as_type: str = "string") -> Column:
    """Column at a path, or a typed null when the frame has no such field."""
    return F.col(path) if field_type(df.schema, path) is not None else F.lit(None).cast(as_type)


def event_field(schema: T.StructType, path: str, extended: bool = False) -> Column:
    """Event attribute as a rule sees it; unknown or hidden paths are null."""
    if path in ("ip_subnet24", "ip_subnet16"):
        return ip_subnet(blank_to_null(F.col("ip_client")), int(path[-2:]))
    roots = RULE_ROOTS + (EXTENDED_ROOTS if extended else [])
    if not path or path.split(".")[0] not in roots or field_type(schema, path) is None:
        return F.lit(None).cast("string")
    return F.col(path)


def group_key(values: list[Column], empty_is_missing: bool = False) -> Column:
    """Values joined by a bar; missing ones become a dash."""
    as_text = [v.cast("string") for v in values]
    if empty_is_missing:
        as_text = [F.nullif(v, F.lit("")) for v in as_text]
    return F.concat_ws("|", *[F.coalesce(v, F.lit("-")) for v in as_text])


def split_address(address: Column) -> tuple[Column, Column]:
    """(user, lower-cased domain) of a mail address; without an at-sign there is only a user."""
    a = F.trim(F.regexp_replace(F.trim(address), r"^[<>]+|[<>]+$", ""))
    at = F.instr(a, "@")
    user = F.when(at > 0, F.substring(a, F.lit(1), at - 1)).otherwise(a)
    domain = F.when(at > 0, F.lower(F.substring(a, at + 1, F.length(a))))
    return blank_to_null(user), blank_to_null(domain)


def truthy(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))
