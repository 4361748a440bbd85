"""Point-in-range lookup for numeric addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET = 65536


def _pieces(ranges: DataFrame) -> DataFrame:
    """A range once for each block of 65536 addresses that it touches."""
    blocks = F.explode(F.expr(f"sequence(_start div {BUCKET}, _end div {BUCKET})"))
    return ranges.withColumnsRenamed({"start_long": "_start", "end_long": "_end"}).withColumn("_block", blocks)


def range_join(points: DataFrame, point: str, *tables: DataFrame) -> DataFrame:
    """Left join of points to the range [start_long, end_long] of each table that holds them; ranges of a table must not overlap.

    One plan for every size: each distinct address is looked up once in all tables (a block holds at most 65536 addresses, however often
    they occur), and the answers are joined back. Points without an address get keys that no address has, one for each partition they come
    from, so they are not gathered; an address that fills a partition is split by adaptive execution, which may also broadcast what is small.
    """
    found = points.select(F.col(point).alias("_address")).filter("_address IS NOT NULL").distinct()
    for ranges in tables:
        held = F.expr(f"_block = _address div {BUCKET} AND _address BETWEEN _start AND _end")
        found = found.join(_pieces(ranges), held, "left").drop("_block", "_start", "_end")
    key = F.coalesce(F.col(point), F.lit(-1) - F.spark_partition_id())
    return points.withColumn("_key", key).join(found, F.col("_key") == F.col("_address"), "left").drop("_key", "_address")
