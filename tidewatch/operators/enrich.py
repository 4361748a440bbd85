"""Country, network operator and internal-traffic marks of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.fields import field_type
from tidewatch.functions.net import ip_to_long, is_private_like
from tidewatch.operators.prefixjoin import prefix_join
from tidewatch.operators.rangejoin import range_join


def _with_address(events: DataFrame) -> DataFrame:
    if "ip_long" in events.columns:
        return events
    out = events.withColumn("ip_long", ip_to_long(F.col("ip_client")))
    return out.withColumn("ip_private", is_private_like(F.col("ip_client"), F.col("ip_long")))


def _field(df: DataFrame, path: str, kind: str):
    return F.col(path).cast(kind) if field_type(df.schema, path) is not None else F.lit(None).cast(kind)


def _place(table: DataFrame) -> list[str]:
    return ["network"] if "network" in table.columns else ["start_long", "end_long"]


def _looked_up(events: DataFrame, *sides: DataFrame) -> DataFrame:
    """Tables of networks are matched by longest prefix, for addresses of both kinds; tables of IPv4 ranges by range."""
    nets, ranges = [s for s in sides if "network" in s.columns], [s for s in sides if "network" not in s.columns]
    out = _with_address(events)
    out = range_join(out, "ip_long", *ranges) if ranges else out
    return prefix_join(out, "ip_client", *nets) if nets else out


def _geo_side(ranges: DataFrame) -> DataFrame:
    return ranges.select(*_place(ranges), F.col("country_code").alias("_cc"), F.col("country_name").alias("_cn"))


def _asn_side(ranges: DataFrame) -> DataFrame:
    return ranges.select(*_place(ranges), F.col("number").cast("bigint").alias("_num"), F.col("org").alias("_org"))


def enrich_geo(events: DataFrame, ranges: DataFrame) -> DataFrame:
    """Fill extra.geo (and its copy extra.geoip); private addresses are PRV, unknown ones UNK, known countries stay."""
    return _fill_geo(_looked_up(events, _geo_side(ranges)))


def _fill_geo(df: DataFrame) -> DataFrame:
    has_ip, private = F.col("ip_client").isNotNull() & (F.col("ip_client") != ""), F.col("ip_private")
    code, name = (_field(df, f"extra.geo.{c}", "string") for c in ("country_code", "country_name"))
    known = F.coalesce(code != "", F.lit(False))
    is_private = _field(df, "extra.geo.is_private", "boolean")
    geo = F.struct(
        F.when(private | known, F.coalesce(is_private, private)).otherwise(F.lit(False)).alias("is_private"),
        F.when(known, code).when(private, F.lit("PRV")).otherwise(F.coalesce("_cc", F.lit("UNK"))).alias("country_code"),
        F.when(known | (private & name.isNotNull()), name).when(private, F.lit("Private"))
        .otherwise(F.coalesce("_cn", F.lit("Unknown"))).alias("country_name"),
    )
    before = F.col("extra.geo") if field_type(df.schema, "extra.geo") == field_type(df.select(geo.alias("g")).schema, "g") else F.lit(None)
    filled = F.when(has_ip, geo).otherwise(before)
    return df.withColumn("extra", F.col("extra").withField("geo", filled).withField("geoip", filled)).drop("_cc", "_cn")


def enrich_asn(events: DataFrame, ranges: DataFrame) -> DataFrame:
    """Fill extra.asn where the number is missing; private addresses get none."""
    return _fill_asn(_looked_up(events, _asn_side(ranges)))


def _fill_asn(df: DataFrame) -> DataFrame:
    number, org = _field(df, "extra.asn.number", "bigint"), _field(df, "extra.asn.org", "string")
    fill = number.isNull() & ~F.col("ip_private")
    asn = F.struct(
        F.when(fill, F.col("_num")).otherwise(number).alias("number"),
        F.when(fill, F.coalesce("_org", org)).otherwise(org).alias("org"),
    )
    return df.withColumn("extra", F.col("extra").withField("asn", asn)).drop("_num", "_org")


def flag_internal(events: DataFrame) -> DataFrame:
    """Mark private and loopback traffic as internal."""
    loopback = F.col("ip_client").isin("127.0.0.1", "::1")
    private = F.coalesce(F.upper(_field(events, "extra.geo.country_code", "string")) == "PRV", F.lit(False))
    internal = F.coalesce(loopback, F.lit(False)) | private
    old = lambda c, t: _field(events, f"extra.{c}", t)
    extra = (
        F.col("extra")
        .withField("internal", F.coalesce(old("internal", "boolean"), F.when(internal, F.lit(True))))
        .withField("traffic_class", F.coalesce(old("traffic_class", "string"), F.when(internal, F.lit("internal"))))
        .withField("internal_kind", F.coalesce(old("internal_kind", "string"), F.when(loopback, F.lit("loopback"))))
    )
    return events.withColumn("extra", extra)


def enrich(events: DataFrame, geo_ranges: DataFrame, asn_ranges: DataFrame) -> DataFrame:
    """Country, operator and internal marks, from one lookup of each address; helper columns removed."""
    looked_up = _looked_up(events, _geo_side(geo_ranges), _asn_side(asn_ranges))
    return flag_internal(_fill_asn(_fill_geo(looked_up))).drop("ip_long", "ip_private")
