"""Mixing sources to target weights by a low-discrepancy schedule.

Each source is a cycle of its shuffled documents, cut into blocks of equally many words. Slot j of the mix takes the golden-ratio
point frac((j + 1) * 0.618...) through the cumulative target shares to a source; the r-th slot of a source takes its r-th block.
So any stretch of the schedule is close to the targets. What a document gives are its words in the blocks that slots have taken: ranked slots
are joined with the blocks that each pass of the document lies in, and summed a document.

Defined results: a null or empty text has no words and takes no part but keeps its row; a null source is a source of its own, last in
order; equal rows each have their own place; no documents, no rows; other columns are passed by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.inputs import column_or_null, staged, table, whole_row

WEIGHTS = (1, 2, 3)
REPEATS = 3
#: Words of a block. A source's share of the slots is right to a few blocks.
BLOCK_WORDS = 64
#: Documents of a stretch of a cycle that one task sorts.
STRETCH_ROWS = 2_000
POINTS = 0.6180339887498949
CELLS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats=REPEATS) -> DataFrame:
    """One row a source: its words, documents, weight and target. `sizes` has source and size.

    Targets are in proportion to the weights, but at most `repeats` times the source. With sources in the order of limit/weight,
    those at their limit come first, and the rest share what these leave; so one pass of running sums finds all targets.
    """
    cut = F.col("limit").cast("double")
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1))
        .withColumn("limit", F.col("source_size") * repeats)
        .withColumn("left_words", F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(by_ratio), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
        .withColumn("full", cut * F.col("left_weight") <= F.col("weight") * F.col("left_words").cast("double"))
        .withColumn("rest_words", F.sum("source_size").over(whole) - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(whole), F.lit(0)))
        .withColumn("rest_weight", F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole))
        .withColumn("target", F.when(F.col("full"), cut).otherwise(F.col("weight") * F.col("rest_words") / F.col("rest_weight")))
        .select("source", "source_size", "documents", "weight", "limit", "target")
    )


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row a slot of the mix: slot and source. The slots reach the source by cells of [0, 1), an equi-join on a bounded key."""
    spark = targets.sparkSession
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    total = F.sum("target").over(Window.partitionBy())
    shares = (
        targets.filter("target > 0")
        .withColumn("hi", F.sum("target").over(by_source.rowsBetween(Window.unboundedPreceding, 0)) / total)
        .withColumn("lo", F.coalesce(F.lag("hi").over(by_source), F.lit(0.0)))
        .withColumn("hi", F.when(F.lead("hi").over(by_source).isNull(), F.lit(2.0)).otherwise(F.col("hi")))
        .withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)).cast("int"))))
    )
    words = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    slots = spark.range(-(-words // block_words)).withColumnRenamed("id", "slot")
    point = (F.col("slot") + 1) * F.lit(POINTS)
    return (
        slots.withColumn("point", point - F.floor(point)).withColumn("cell", F.floor(F.col("point") * CELLS).cast("int"))
        .join(shares.select("cell", "source", "lo", "hi"), "cell").filter("point >= lo AND point < hi").select("slot", "source")
    )


def ranked(slots: DataFrame, stretch: int = 100_000) -> DataFrame:
    """slot, source and rank: the block of the source's cycle that the slot takes. Long sources are ranked by stretches of slots."""
    slots = slots.withColumn("part", F.floor(F.col("slot") / stretch))
    per = slots.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("source", "part").orderBy("slot")) - 1
    return slots.join(per, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).select("slot", "source", (inside + F.col("before")).alias("rank"))


def blocks(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each block that a pass of a document lies in: the placed rows with block, begins (the pass begins in it) and words.

    A document without words lies where the one before it ends. Only passes that begin within the source's taken words are looked at.
    """
    at = F.least(F.col("place"), F.col("source_size") - 1)
    last = F.expr("(taken_source - 1 - _at) DIV source_size")
    begin = F.col("_at") + F.col("_pass") * F.col("source_size")
    end = F.col("_begin") + F.col("size")
    return (
        placed.withColumn("_at", at).filter("source_size > 0 AND _at < taken_source")
        .withColumn("_pass", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("_begin", begin)
        .withColumn("_first", F.expr(f"_begin DIV {block_words}"))
        .withColumn("block", F.explode(F.sequence(F.col("_first"), F.expr(f"greatest(_begin, _begin + size - 1) DIV {block_words}"))))
        .withColumn("begins", F.col("block") == F.col("_first"))
        .withColumn("words", F.greatest(F.lit(0), F.least(end, (F.col("block") + 1) * block_words) - F.greatest(F.col("_begin"), F.col("block") * block_words)))
        .drop("_at", "_pass", "_begin", "_first")
    )


def mix(rows: DataFrame, weights=WEIGHTS, repeats=REPEATS, block_words=BLOCK_WORDS, seed: str = "mix", stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """Adds to rows with doc_id, source and size: source_size, target, place (in the source's cycle), taken_source, taken and copies.

    `taken` counts the document's words in the blocks that the source's slots take, in all passes of its cycle; `copies` the passes that begin
    in one of them. A hot source is sorted by stretches of its shuffled order, with one running sum over the stretches' totals.
    """
    targets = staged(source_targets(rows, weights, repeats), "mix-targets")
    slots = schedule(targets, block_words)
    counted = slots.groupBy("source").agg(F.count(F.lit(1)).alias("slots"))
    taken = F.least(F.col("slots") * block_words, F.col("limit"))
    per_source = staged(
        targets.alias("t").join(counted.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source")), "left")
        .select(F.col("t.source").alias("of_source"), "source_size", "target", F.coalesce(taken, F.lit(0)).alias("taken_source"), F.ceil(F.col("documents") / stretch_rows).alias("stretches")),
        "mix-sources",
    )
    order = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = (
        rows.join(per_source, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
        .withColumn("order", order)
        .withColumn("stretch", F.conv(F.substring("order", 1, 8), 16, 10).cast("long") % F.col("stretches"))
    )
    sums = placed.groupBy("source", "stretch").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("in_source"), F.col("stretch").alias("in_stretch"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "stretch").orderBy("order", "doc_id", "size")
    # written once, as rows that tie in the order have no other number
    placed = staged(
        placed.join(sums, F.col("source").eqNullSafe(F.col("in_source")) & (F.col("stretch") == F.col("in_stretch")))
        .withColumn("place", F.col("before") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("number", F.row_number().over(inside))
        .drop("order", "stretches", "in_source", "in_stretch", "before"),
        "mix-placed",
    )
    ranks = ranked(slots).select(F.col("source").alias("slot_source"), "rank")
    parts = blocks(placed.select("source", "stretch", "number", "size", "place", "source_size", "taken_source"), block_words)
    of_slots = parts.join(ranks, (F.col("block") == F.col("rank")) & F.col("source").eqNullSafe(F.col("slot_source")))
    key = ["source", "stretch", "number"]
    given = of_slots.groupBy(*[F.col(c).alias(f"of_{c}") for c in key]).agg(F.sum("words").alias("taken"), F.sum(F.col("begins").cast("long")).alias("copies"))
    same = F.col("source").eqNullSafe(F.col("of_source")) & (F.col("stretch") == F.col("of_stretch")) & (F.col("number") == F.col("of_number"))
    return (
        placed.join(given, same, "left")
        .withColumn("taken", F.coalesce("taken", F.lit(0))).withColumn("copies", F.coalesce("copies", F.lit(0)))
        .drop("stretch", "number", "of_source", "of_stretch", "of_number")
    )


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", column_or_null(docs, "source", "string").alias("source"), word_count(F.col("text")).alias("size"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(sized(table(spark, sf_dir, "documents")), "mix-sizes")
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken", "source", "place", "taken_source")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix: one whole copy for each pass of its source's cycle in which the document begins in a block of a slot.

    Sums of words are those of the mix to within one document a source. Equal rows are brought together before copies are made.
    """
    whole = whole_row(docs)
    keyed = docs.select(whole, "doc_id", column_or_null(docs, "source", "string").alias("source"), word_count(F.col("text")).alias("size")).withColumn("key", F.xxhash64(F.to_json("whole")))
    rows = staged(keyed.drop("whole"), "mix-rows")
    counts = mix(rows).groupBy(F.col("key").alias("of_key"), F.col("doc_id").alias("of_doc")).agg(F.sum("copies").alias("copies")).filter("copies > 0")
    once = keyed.select("whole", "key", "doc_id").dropDuplicates(["key", "doc_id"])
    same = (F.col("key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of_doc"))
    return once.join(counts, same).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("whole.*")


_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n, 3 * CAST(sum(size) AS BIGINT) AS lim FROM d GROUP BY source),
b AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM a),
c AS (SELECT *, sum(source_size) OVER () - coalesce(sum(lim) OVER r, 0) AS lw, sum(w) OVER () - coalesce(sum(w) OVER r, 0) AS lwt
  FROM b WINDOW r AS (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, CAST(lim AS DOUBLE) * lwt <= w * CAST(lw AS DOUBLE) AS capped FROM c),
t AS (SELECT source, source_size, n, lim, CASE WHEN capped THEN CAST(lim AS DOUBLE) ELSE
    CAST(w * (sum(source_size) OVER () - coalesce(sum(lim) FILTER (WHERE capped) OVER (), 0)) AS DOUBLE) / (sum(w) FILTER (WHERE NOT capped) OVER ()) END AS target FROM f),
h AS (SELECT source, sum(target) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) / sum(target) OVER () AS hi FROM t WHERE target > 0),
i AS (SELECT source, coalesce(lag(hi) OVER (ORDER BY source NULLS LAST), 0) AS lo,
    CASE WHEN lead(hi) OVER (ORDER BY source NULLS LAST) IS NULL THEN 2 ELSE hi END AS hi FROM h),
p AS (SELECT (j + 1) * 0.6180339887498949::DOUBLE AS g FROM (SELECT unnest(range((SELECT CAST(ceil(sum(size) / 64) AS BIGINT) FROM d))) AS j)),
k AS (SELECT source, count(*) AS slots FROM p JOIN i ON g - floor(g) >= lo AND g - floor(g) < hi GROUP BY source),
s AS (SELECT t.source, t.source_size, target, coalesce(least(slots * 64, lim), 0) AS taken_source, CAST(ceil(n / 2000) AS BIGINT) AS parts
  FROM t LEFT JOIN k ON t.source IS NOT DISTINCT FROM k.source),
o AS (SELECT d.*, s.source_size, target, taken_source, parts, md5(concat('mix|', coalesce(CAST(doc_id AS VARCHAR), ''))) AS m FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
q AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY CAST(('0x' || m[1:8]) AS BIGINT) % parts, m, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM o),
z AS (SELECT *, CASE WHEN source_size > 0 THEN taken_source // source_size ELSE 0 END AS full_passes FROM q)
SELECT doc_id, size, source_size, target, source, CAST(place AS BIGINT) AS place, CAST(taken_source AS BIGINT) AS taken_source,
  CAST(full_passes * size + greatest(0, least(place + size, taken_source - full_passes * source_size) - place) AS BIGINT) AS taken FROM z
"""

QUERIES = {"op10_mixing": op10_mixing}
ORACLES = {"op10_mixing": _SQL}
