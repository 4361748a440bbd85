"""Exact sliding event-time metrics per key, as running sums of arrivals and expiries.

A row at time ts belongs to the window of every later row up to ts + w (inclusive), so it adds 1 when
it arrives and takes 1 away just after ts + w. A value of a counted dimension is present from its
first row until w after its last one; the +1 and -1 of its presence come from rows pre-aggregated per
(key, value, stretch of length w), inside which presence cannot be interrupted. Work is linear in the
rows however many of them a window holds, and every step splits a hot key by time.

Keys of few rows are not split: a slice would hold a row or two, and its totals as many. They are moved once, whole; a
row's own neighbours of the same value tell whether presence begins or ends with it, so it needs no rows of its own.

The running sums read their input twice (slice totals, then rows), so the inputs that cost a shuffle
are staged first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.prefix import ORDER, SIX_HOURS_US, running_sums
from tidewatch.operators.staging import staged

SPLIT_ROWS = 20_000  # rows of a key from which it is split by time


def _presence_deltas(rows: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in dims])
    seen = (
        rows.select(*keys, "w", "t", "seq", F.explode(pairs).alias("p"))
        .select(*keys, "w", "t", "seq", "p.dim", "p.value", F.expr("t - pmod(t, w)").alias("stretch"))
        .filter("value IS NOT NULL AND value <> ''")
        .groupBy(*keys, "w", "dim", "value", "stretch")
        .agg(F.min(F.struct("t", "seq")).alias("first"), F.max("t").alias("last"))
    )
    nearby = Window.partitionBy(*keys, "dim", "value").orderBy("stretch")
    edges = seen.select(
        *keys, "w", "dim", "first", "last",
        F.lag("last").over(nearby).alias("before"),
        F.lead("first.t").over(nearby).alias("after"),
    ).select(
        *keys, "dim",
        F.explode(F.array_compact(F.array(
            F.when(
                F.col("before").isNull() | (F.col("before") < F.col("first.t") - F.col("w")),
                F.struct(F.col("first.t").alias("t"), F.lit(1).alias("phase"), F.col("first.seq").alias("seq"), F.lit(1).alias("d")),
            ),
            F.when(
                F.col("after").isNull() | (F.col("after") > F.col("last") + F.col("w")),
                F.struct((F.col("last") + F.col("w") + 1).alias("t"), F.lit(0).alias("phase"), F.col("first.seq").alias("seq"), F.lit(-1).alias("d")),
            ),
        ))).alias("e"),
    )
    return edges.select(
        *keys, "e.t", "e.phase", "e.seq",
        *[F.when(F.col("dim") == d, F.col("e.d")).otherwise(0).cast("bigint").alias(f"unique_{d}") for d in dims],
    )


def _arrive_and_expire(rows: DataFrame, keys: list[str], sums: dict[str, Column], keep: list[str]) -> DataFrame:
    add = [c.cast("bigint").alias(n) for n, c in sums.items()]
    take = [(-c.cast("bigint")).alias(n) for n, c in sums.items()]
    kept = [F.col(c) for c in keep]
    gone = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in keep]
    arrive = F.struct(F.col("t"), F.lit(1).alias("phase"), *add, *kept)
    expire = F.struct((F.col("t") + F.col("w") + 1).alias("t"), F.lit(0).alias("phase"), *take, *gone)
    return rows.select(*keys, "seq", F.explode(F.array(arrive, expire)).alias("e")).select(*keys, "seq", "e.*")


def _whole_keys(rows: DataFrame, keys: list[str], dims: list[str], flow: dict[str, Column]) -> DataFrame:
    """Totals of each row over its window, for keys that fit a task with room to spare."""
    moved = rows.repartition(*keys).withColumn("_hash", F.xxhash64(*keys))  # a number first: most rows are sorted by it alone
    for d in dims:
        same = Window.partitionBy("_hash", *keys, d).orderBy("t", "seq")
        held = F.col(d).isNotNull() & (F.col(d) != "")
        before, after = F.lag("t").over(same), F.lead("t").over(same)
        moved = moved.withColumns({
            f"_first_{d}": (held & (before.isNull() | (before < F.col("t") - F.col("w")))).cast("bigint"),
            f"_last_{d}": (held & (after.isNull() | (after > F.col("t") + F.col("w")))).cast("bigint"),
        })
    kept = moved.schema["_kept"].dataType
    arrive = F.struct(
        F.col("t"), F.lit(1).alias("phase"), "_kept", F.lit(1).cast("bigint").alias("n_seen"),
        *[c.cast("bigint").alias(n) for n, c in flow.items()], *[F.coalesce(f"_first_{d}", F.lit(0)).alias(f"unique_{d}") for d in dims],
    )
    expire = F.struct(
        (F.col("t") + F.col("w") + 1).alias("t"), F.lit(0).alias("phase"), F.lit(None).cast(kept).alias("_kept"), F.lit(0).cast("bigint").alias("n_seen"),
        *[(-c.cast("bigint")).alias(n) for n, c in flow.items()], *[(-F.coalesce(f"_last_{d}", F.lit(0))).alias(f"unique_{d}") for d in dims],
    )
    deltas = moved.select("_hash", *keys, "seq", F.explode(F.array(arrive, expire)).alias("e")).select("_hash", *keys, "seq", "e.*")
    so_far = Window.partitionBy("_hash", *keys).orderBy(*ORDER)
    values = ["n_seen", *flow, *[f"unique_{d}" for d in dims]]
    return deltas.select(*keys, "t", "phase", "seq", "_kept", *[F.sum(v).over(so_far).alias(v) for v in values]).filter("phase = 1").drop("phase")


def _max_multiplicity_deltas(rows: DataFrame, keys: list[str], value: str, slice_width: int) -> DataFrame:
    """Changes of "how often does the most frequent value occur in the window".

    That number is the count of levels k such that some value occurs at least k times, so each
    arrival of a value enters one level and each expiry leaves one.
    """
    valued = rows.filter(F.col(value).isNotNull())
    flow = _arrive_and_expire(valued, keys + [value], {"c": F.lit(1)}, [])
    counts = staged(running_sums(flow, keys + [value], ["c"], slice_width), "multiplicity")
    up = F.col("phase") == 1
    levels = counts.select(
        *keys, "t", "phase", "seq",
        F.when(up, F.col("c")).otherwise(F.col("c") + 1).alias("level"),
        F.when(up, 1).otherwise(-1).cast("bigint").alias("holders"),
    )
    held = running_sums(levels, keys + ["level"], ["holders"], slice_width)
    up = F.col("phase") == 1
    return held.filter((up & (F.col("holders") == 1)) | (~up & (F.col("holders") == 0))).select(
        *keys, "t", "phase", "seq", F.when(up, 1).otherwise(-1).cast("bigint").alias("top_hits")
    )


def sliding_metrics(
    rows: DataFrame,
    keys: list[str],
    *,
    t: str,
    seq: str,
    window_us: Column | int,
    dims: dict[str, Column] | None = None,
    sums: dict[str, Column] | None = None,
    top_value: Column | None = None,
    numbered: bool = False,
    keep: list[str] | None = None,
    slice_width: int = SIX_HOURS_US,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Per row: `count`, each `sums` total, `unique_<dim>` and, if asked, `top_hits` over [t - w, t].

    Rows with the same time are taken in `seq` order, and a row sees only peers up to itself.
    `keep` columns pass through; `numbered` adds the row's position in its key as `n_seen`.
    Keys of at least `split_rows` rows, and those with a `top_value`, are split by time.
    """
    dims, sums, keep = dims or {}, dict(sums or {}), keep or []
    w = window_us if isinstance(window_us, Column) else F.lit(window_us)
    base = rows.select(
        *keys,
        F.col(t).cast("bigint").alias("t"),
        F.col(seq).alias("seq"),
        w.cast("bigint").alias("w"),
        *[c.cast("string").alias(d) for d, c in dims.items()],
        *[c.cast("bigint").alias(f"_s_{n}") for n, c in sums.items()],
        *([top_value.alias("_top")] if top_value is not None else []),
        F.struct(*[F.col(c) for c in keep]).alias("_kept") if keep else F.lit(None).cast("int").alias("_kept"),
    )
    flow = {"count": F.lit(1), **{n: F.coalesce(F.col(f"_s_{n}"), F.lit(0)) for n in sums}}
    tops = F.count("_top") if top_value is not None else F.lit(0)
    large = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), tops.alias("_tops")).filter((F.col("_n") >= split_rows) | (F.col("_tops") > 0))
    large = staged(large.select(*keys), "large-keys")
    split = base.join(large, keys, "left_semi")
    deltas = _arrive_and_expire(split, keys, flow, ["_kept"])
    values = list(flow)
    if numbered:
        deltas = deltas.withColumn("n_seen", (F.col("phase") == 1).cast("bigint"))
        values.append("n_seen")
    extra = []
    if dims:
        extra.append(staged(_presence_deltas(split, keys, list(dims)), "presence"))
        values += [f"unique_{d}" for d in dims]
    whole = _whole_keys(base.join(large, keys, "left_anti"), keys, list(dims), flow)
    if top_value is not None:
        extra.append(staged(_max_multiplicity_deltas(split, keys, "_top", slice_width), "top"))
        values.append("top_hits")
        whole = whole.withColumn("top_hits", F.lit(0).cast("bigint"))
    deltas = deltas.withColumn("_row", F.col("phase") == 1)
    for d in extra:
        deltas = deltas.unionByName(d.withColumn("_row", F.lit(False)), allowMissingColumns=True)
    deltas = deltas.select(
        *keys, "t", "phase", "seq", "_row", "_kept", *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values]
    )
    cols = [*keys, "t", "seq", "_kept", *values]
    out = running_sums(deltas, keys, values, slice_width).filter("_row").select(*cols).unionByName(whole.select(*cols))
    return out.select(*keys, F.col("t").alias(t), F.col("seq").alias(seq), *values, *([F.col("_kept.*")] if keep else []))
