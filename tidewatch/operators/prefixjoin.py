"""Longest-prefix match of addresses of both kinds against networks, by equi-joins.

The prefix lengths that occur (129 at most) are searched by halving: at each step an address is looked up, cut to the middle length; a hit means
that a longer one may fit, a miss that only a shorter one can. So that a long network is found on its way, it leaves markers at the shorter
lengths the search passes, and a marker knows the longest network that holds it. Seven joins at most, each row of one key, whatever the
lengths; each distinct address is looked up once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.net import ip_bits, masked_bits, network_bits
from tidewatch.operators.staging import staged


def _passed(count: int) -> list[list[int]]:
    """For each place of a sorted list, the smaller places that a search by halving looks at on its way to it."""
    out = []
    for place in range(count):
        low, high, seen = 0, count - 1, []
        while (middle := (low + high) // 2) != place:
            if middle < place:
                seen.append(middle)
                low = middle + 1
            else:
                high = middle - 1
        out.append(seen)
    return out


def cut_to(length: Column) -> Column:
    return F.get(F.transform(F.array(length), lambda n: masked_bits(F.col("hi"), F.col("lo"), n)), F.lit(0))


def _entries(networks: DataFrame) -> tuple[DataFrame, list[int]]:
    """Networks and markers: level (place of the length), hi, lo and best (the values of the longest network that holds it)."""
    values = [c for c in networks.columns if c != "network"]
    nets = networks.select(network_bits(F.col("network")).alias("n"), F.struct(*values).alias("best")).filter("n IS NOT NULL")
    nets = staged(nets.groupBy("n.length", "n.hi", "n.lo").agg(F.min("best").alias("best")), "networks")
    lengths = sorted(r["length"] for r in nets.select("length").distinct().collect())  # one row a length, 129 at most
    if not lengths:
        return nets.select(F.lit(0).alias("level"), "hi", "lo", "best"), lengths
    level = F.array_position(F.array(*map(F.lit, lengths)), F.col("length")).cast("int") - 1
    real = nets.select(level.alias("level"), "hi", "lo", "best")
    length_at = lambda i: F.get(F.array(*map(F.lit, lengths)), i)
    on_way = F.array(*[F.array(*[F.lit(p) for p in places]).cast("array<int>") for places in _passed(len(lengths))])
    markers = real.withColumn("at", F.explode(F.get(on_way, F.col("level"))))
    markers = markers.select(F.col("at").alias("level"), cut_to(length_at(F.col("at"))).alias("m")).select("level", "m.hi", "m.lo").distinct()
    # the longest network that holds a marker: one look-up for each shorter length
    shorter = markers.withColumn("own", F.explode(F.sequence(F.lit(0), F.col("level")))).select(
        F.col("level").alias("marker"), F.col("hi").alias("mhi"), F.col("lo").alias("mlo"), F.col("own").alias("level"), cut_to(length_at(F.col("own"))).alias("m")
    ).select("marker", "mhi", "mlo", "level", "m.hi", "m.lo")
    held = shorter.join(real, ["level", "hi", "lo"], "left").groupBy(F.col("marker").alias("level"), F.col("mhi").alias("hi"), F.col("mlo").alias("lo")).agg(
        F.max_by("best", F.when(F.col("best").isNotNull(), F.col("level"))).alias("best"))
    both = held.join(real.select("level", "hi", "lo"), ["level", "hi", "lo"], "left_anti").unionByName(real)
    return staged(both, "network-entries"), lengths


def longest_prefix(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """Adds the values of the longest network that holds an address. `addresses` has hi and lo, each pair once."""
    entries, lengths = _entries(networks)
    values = [c for c in networks.columns if c != "network"]
    e = entries.select(F.col("level").alias("_level"), F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), F.col("best").alias("_hit"))
    found = addresses.withColumns({"_from": F.lit(0), "_to": F.lit(len(lengths) - 1), "_best": F.lit(None).cast(e.schema["_hit"].dataType)})
    for _ in range(len(lengths).bit_length()):
        middle = F.when(F.col("_from") <= F.col("_to"), F.expr("(_from + _to) div 2").cast("int"))
        found = found.withColumn("_middle", middle).withColumn("_cut", cut_to(F.get(F.array(*map(F.lit, lengths)), F.col("_middle"))))
        same = (F.col("_middle") == F.col("_level")) & (F.col("_cut.hi") == F.col("_hi")) & (F.col("_cut.lo") == F.col("_lo"))
        hit = F.col("_level").isNotNull()
        found = found.join(e, same, "left").select(
            *addresses.columns, F.when(hit, F.col("_middle") + 1).otherwise(F.col("_from")).alias("_from"), F.when(hit, F.col("_to")).otherwise(F.col("_middle") - 1).alias("_to"),
            F.coalesce("_hit", "_best").alias("_best"))
    return found.select(*addresses.columns, *[F.col(f"_best.{c}").alias(c) for c in values])


def prefix_join(points: DataFrame, ip: str, *tables: DataFrame) -> DataFrame:
    """Left join of rows to the longest network that holds their address, in each table. `network` is `a.b.c.d/n`, `x::/n` or one address.

    Rows without an address get keys of their own partition, so they are not gathered; a hot address is split by adaptive execution.
    """
    bits = F.explode(F.array(ip_bits(F.col(ip))))  # once a row, not once a use
    found = points.select(bits.alias("b")).filter("b IS NOT NULL").select("b.hi", "b.lo").distinct()
    for networks in tables:
        found = longest_prefix(found, networks)
    found = found.withColumn("_address", F.concat_ws(":", "hi", "lo")).drop("hi", "lo")
    rows = points.withColumn("_bits", bits)
    key = F.when(F.col("_bits").isNull(), F.concat(F.lit("none:"), F.spark_partition_id())).otherwise(F.concat_ws(":", "_bits.hi", "_bits.lo"))
    return rows.withColumn("_key", key).join(found, F.col("_key") == F.col("_address"), "left").drop("_key", "_address", "_bits")
