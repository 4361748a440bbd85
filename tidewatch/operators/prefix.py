"""Ordered running state over keyed rows, split by slices so that no key needs a single task.

Every helper works in two levels. Inside a slice (a stretch of time, or of line numbers) the state
comes from an ordinary window; across slices it comes from one pre-aggregated row per (key, slice),
which enters the slice as an "opening" row. A key that holds a third of all rows is therefore spread
over as many tasks as it has slices, and only the aggregated rows are ever ordered per key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("t", "phase", "seq")
SIX_HOURS_US = 6 * 3600 * 1_000_000


def slice_start(t: Column, width: int) -> Column:
    return t - F.pmod(t, F.lit(width).cast("bigint"))


def running_sums(
    deltas: DataFrame,
    keys: list[str],
    values: list[str],
    slice_width: int = SIX_HOURS_US,
) -> DataFrame:
    """Replace each value by its running total per key in (t, phase, seq) order.

    Rows with equal (t, phase, seq) are peers and see each other's contribution.
    """
    part = keys + ["_slice"]
    sliced = deltas.withColumn("_slice", slice_start(F.col("t"), slice_width))
    totals = sliced.groupBy(*part).agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    opening = totals.select(
        *part,
        F.col("_slice").alias("t"),
        F.lit(-1).alias("phase"),
        F.lit(True).alias("_opening"),
        *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(v) for v in values],
    ).filter(reduce(lambda a, b: a | b, [F.col(v) != 0 for v in values]))
    both = sliced.withColumn("_opening", F.lit(False)).unionByName(opening, allowMissingColumns=True)
    so_far = Window.partitionBy(*part).orderBy(*ORDER)
    rest = [c for c in both.columns if c not in values]
    return (
        both.select(*rest, *[F.sum(v).over(so_far).alias(v) for v in values])
        .filter(~F.col("_opening"))
        .drop("_opening", "_slice")
    )


def carry_forward(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    cols: dict[str, str],
    slice_col: str,
    include_current: bool = True,
) -> DataFrame:
    """Last non-null value of each column up to (or strictly before) the current row of its key.

    `cols` maps source column to output name. `slice_col` must grow with `order` inside a key.
    """
    part = keys + [slice_col]
    last_of = [
        F.max_by(F.col(src), F.when(F.col(src).isNotNull(), F.struct(*order))).alias(f"_in_{dst}")
        for src, dst in cols.items()
    ]
    totals = rows.groupBy(*part).agg(*last_of)
    earlier = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    opening = totals.select(
        *part,
        F.lit(True).alias("_opening"),
        *[F.last(f"_in_{dst}", ignorenulls=True).over(earlier).alias(src) for src, dst in cols.items()],
    ).filter(reduce(lambda a, b: a | b, [F.col(src).isNotNull() for src in cols]))
    both = rows.withColumn("_opening", F.lit(False)).unionByName(opening, allowMissingColumns=True)
    seen = (
        Window.partitionBy(*part)
        .orderBy(F.desc("_opening"), *order)
        .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    )
    return (
        both.select("*", *[F.last(src, ignorenulls=True).over(seen).alias(dst) for src, dst in cols.items()])
        .filter(~F.col("_opening"))
        .drop("_opening")
    )


def numbered(
    rows: DataFrame, keys: list[str], order: list[str], slice_col: str, name: str
) -> DataFrame:
    """1-based position of each row inside its key."""
    part = keys + [slice_col]
    counts = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    local = rows.withColumn("_pos", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
    return local.join(offsets, part).withColumn(name, F.col("_pos") + F.col("_offset")).drop("_pos", "_offset")
