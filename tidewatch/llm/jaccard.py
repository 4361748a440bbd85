"""Similarity join of documents on the Jaccard index of their word n-grams, with Bayesian candidate pruning.

1. Each document becomes the set of fingerprints of its runs of five words and a MinHash signature. Documents with equal sets are one
   class, joined by a digest of the set; only the class goes on.
2. Bands of the signature find candidates. Classes that share a band are tied to the band's first class, and ties are followed to connected
   candidate clusters; so a band of thousands gives as many rows as it has members, not their pairs.
3. Inside a cluster all pairs are candidates. They are compared value by value of their signatures, a few at a time; after each step
   a pair is dropped when, by the posterior of its index under a uniform prior, the probability that it reaches the threshold is under the
   tolerance. The other pairs are verified exactly on the sets. A cluster larger than a block is cut into blocks, and each pair of blocks is a
   task row of its own. What leaves a task is a number of links for each class and a spanning forest of the links, never the pairs.
4. The forests are followed to the groups.

Defined results: words are runs of characters other than U+0020 and U+0009 to U+000D, compared exactly; a text of one to four words is one
run; null texts and texts without a word are alone, each in a group of its own row; equal rows are in one group; a group is named by the
smallest id of its documents, null ids being left out of that unless there is no other; no documents, no rows; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.inputs import staged, table, whole_row
from tidewatch.llm.text import fingerprints, groups, mix64, pieces, spans, utf8

RUN = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 24, 4
VALUES = BANDS * BAND_ROWS
#: Values compared between two looks at the posterior.
STEP = 16
#: A pair is dropped when it reaches the threshold with less than this probability.
TOLERANCE = 1e-6
#: Classes of a block, and the runs that they may have together (a single class may have more).
BLOCK_CLASSES = 512
BLOCK_RUNS = 1_000_000

_SEEDS = np.random.default_rng(3).integers(0, 2**64, VALUES, np.uint64) | np.uint64(1)
U = np.uint64


def runs_of(texts: pa.Array, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints of each text's runs of words, rising, and where each text's begin."""
    buf, offsets = utf8(texts)
    starts, ends, bounds = spans(buf, offsets)
    words = fingerprints(buf, starts, ends)
    count = np.diff(bounds)
    n_runs = np.where(count > 0, np.maximum(1, count - run + 1), 0)
    text = np.repeat(np.arange(len(count)), n_runs)
    first = bounds[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
    last = bounds[1:][text]
    keys = np.zeros(len(text), np.uint64)
    for k in range(run):
        inside = first + k < last
        keys = mix64(keys * U(31) + np.where(inside, words[np.minimum(first + k, max(0, len(words) - 1))], U(k + 1)) if len(words) else keys)
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    keys, text = keys[new], text[new]
    return keys, np.searchsorted(text, np.arange(len(count) + 1))


def signatures(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values, one row of VALUES 32-bit numbers for each text (zeros for a text without a run)."""
    n = len(bounds) - 1
    found = np.zeros((n, VALUES), np.uint32)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        at = bounds[:-1][full]
        for k in range(VALUES):
            x = keys ^ _SEEDS[k]
            x *= _SEEDS[k]
            x ^= x >> U(29)
            x *= U(0xBF58476D1CE4E5B9)
            found[full, k] = np.minimum.reduceat((x >> U(32)).astype(np.uint32), at)
    return found


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _numbered(pieces(batches, "text")):
        keys, bounds = runs_of(batch.column("text"))
        values = signatures(keys, bounds)
        size = np.diff(bounds)
        full = np.flatnonzero(size > 0)
        digest = np.zeros((len(size), 2), np.uint64)
        if len(full):
            digest[full, 0] = np.add.reduceat(mix64(keys), bounds[:-1][full])
            digest[full, 1] = np.add.reduceat(mix64(keys ^ U(0x5851F42D4C957F2D)), bounds[:-1][full])
        digest[:, 0] ^= size.astype(np.uint64)
        yield pa.record_batch(
            [
                batch.column("row"), batch.column("doc_id"), batch.column("print"), pa.array([x.tobytes() if s else None for x, s in zip(digest, size, strict=True)], pa.binary()),
                pa.array(size), pa.array([x.tobytes() if s else None for x, s in zip(values, size, strict=True)], pa.binary()),
            ],
            names=["row", "doc_id", "print", "digest", "n_runs", "signature"],
        )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = b"".join(batch.column("signature").to_pylist())
        values = np.frombuffer(raw, np.uint32).reshape(-1, BANDS, BAND_ROWS)
        for band in range(BANDS):
            key = np.full(len(values), band + 1, np.uint64)
            for k in range(BAND_ROWS):
                key = mix64(key * U(31) + values[:, band, k])
            yield pa.record_batch([pa.array(key.view(np.int64)), batch.column("class")], names=["band", "class"])


def components(ties: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """node and root (the smallest of its component) of all that is tied. Each round ties every node to the smallest of its neighbourhood,
    and its neighbours to that (large star, then small star), until nothing changes; the number of rounds goes with the logarithm of the size."""
    edges = ties.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, label)
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        after = staged(large.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), label)
        change = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() != after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        edges = after
        if not change:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


@cache
def least_matches(compared: int, threshold: float, tolerance: float) -> int:
    """Fewest equal values of `compared` with which a pair stays. After m of n, the index is Beta(m + 1, n - m + 1) distributed, and it is
    at least t with the probability that n + 1 draws of chance t succeed at most m times."""
    total = 0.0
    for m in range(compared + 1):
        total += comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if total >= tolerance:
            return m
    return compared


def linked(values_a: np.ndarray, values_b: np.ndarray, sets_a: list[np.ndarray], sets_b: list[np.ndarray], same: bool, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a and b (for the same block: i before j) whose index is at least the threshold."""
    agree = np.zeros((len(values_a), len(values_b)), np.int16)
    for k in range(STEP):
        agree += values_a[:, k, None] == values_b[None, :, k]
    if same:
        agree[np.tril_indices(len(values_a))] = -1
    i, j = np.nonzero(agree >= least_matches(STEP, threshold, tolerance))
    agree = agree[i, j].astype(np.int64)
    for k in range(STEP, VALUES, STEP):
        agree += (values_a[i, k : k + STEP] == values_b[j, k : k + STEP]).sum(1)
        stay = agree >= least_matches(min(k + STEP, VALUES), threshold, tolerance)
        i, j, agree = i[stay], j[stay], agree[stay]
    if not len(i):
        return i, j
    size_a, size_b = np.array([len(x) for x in sets_a]), np.array([len(x) for x in sets_b])
    if len(i) <= 64:
        common = np.array([len(np.intersect1d(sets_a[p], sets_b[q], assume_unique=True)) for p, q in zip(i.tolist(), j.tolist(), strict=True)])
    else:
        common = _common(sets_a, sets_b, np.unique(i), np.unique(j), i, j)
    # |A and B| >= t |A or B|, in whole numbers where t is a decimal fraction
    keep = common * (1 + threshold) >= threshold * (size_a[i] + size_b[j]) - 1e-9
    return i[keep], j[keep]


def _common(sets_a: list[np.ndarray], sets_b: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections, by products of membership matrices over the runs that both sides have, some thousands at a time."""
    left, right = np.concatenate([sets_a[r] for r in rows]), np.concatenate([sets_b[c] for c in columns])
    both = np.intersect1d(left, right)
    of_left = np.repeat(np.arange(len(rows)), [len(sets_a[r]) for r in rows])
    of_right = np.repeat(np.arange(len(columns)), [len(sets_b[c]) for c in columns])
    place_left, place_right = np.searchsorted(both, left), np.searchsorted(both, right)
    ok_left = (place_left < len(both)) & (both[np.minimum(place_left, len(both) - 1)] == left) if len(both) else np.zeros(len(left), bool)
    ok_right = (place_right < len(both)) & (both[np.minimum(place_right, len(both) - 1)] == right) if len(both) else np.zeros(len(right), bool)
    total = np.zeros((len(rows), len(columns)), np.float32)
    width = 4096
    by_left, by_right = np.argsort(place_left[ok_left], kind="stable"), np.argsort(place_right[ok_right], kind="stable")
    of_left, place_left = of_left[ok_left][by_left], place_left[ok_left][by_left]
    of_right, place_right = of_right[ok_right][by_right], place_right[ok_right][by_right]
    for a in range(0, len(both), width):
        x, y = np.zeros((len(rows), width), np.float32), np.zeros((len(columns), width), np.float32)
        p, q = np.searchsorted(place_left, [a, a + width])
        x[of_left[p:q], place_left[p:q] - a] = 1
        p, q = np.searchsorted(place_right, [a, a + width])
        y[of_right[p:q], place_right[p:q] - a] = 1
        total += x @ y.T
    return total[np.searchsorted(rows, i), np.searchsorted(columns, j)].astype(np.int64)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        p, q = find(a), find(b)
        if p != q:
            root[max(p, q)] = min(p, q)
            found.append((a, b))
    return found


def _link(batches: Iterator[pa.RecordBatch], threshold: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    """Rows of a pair of blocks together. Gives links of each class (other, links), and forest ties (other, 0 links)."""
    for task in groups(batches, ["cluster", "i", "j"]):
        task = task.take(pa.array(np.unique(task.column("class").to_numpy(), return_index=True)[1]))
        block = task.column("block").to_numpy()
        classes, copies = task.column("class").to_numpy(), task.column("copies").to_numpy()
        values = np.frombuffer(b"".join(task.column("signature").to_pylist()), np.uint32).reshape(-1, VALUES)
        sets = [np.frombuffer(x, np.uint64) for x in task.column("runs").to_pylist()]
        low, high = task.column("i")[0].as_py(), task.column("j")[0].as_py()
        a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
        p, q = linked(values[a], values[b], [sets[x] for x in a], [sets[x] for x in b], low == high, threshold, tolerance)
        p, q = a[p], b[q]
        links = np.bincount(p, copies[q], len(classes)) + np.bincount(q, copies[p], len(classes))
        some = np.flatnonzero(links)
        ties = _forest(len(classes), p, q)
        yield pa.record_batch(
            [
                pa.array(np.concatenate([classes[some], classes[[x for x, _ in ties]]]).astype(np.int64)),
                pa.array(np.concatenate([np.full(len(some), -1), classes[[y for _, y in ties]]]).astype(np.int64)),
                pa.array(np.concatenate([links[some], np.zeros(len(ties))]).astype(np.int64)),
            ],
            names=["class", "tie", "links"],
        )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        keys, bounds = runs_of(batch.column("text"))
        sets = [keys[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.record_batch([batch.column("class"), pa.array(sets, pa.binary())], names=["class", "runs"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        yield pa.record_batch([pa.array(np.arange(row, row + batch.num_rows)), *batch.columns], names=["row", *batch.schema.names])
        row += batch.num_rows


def similar(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, class_id, n_links, print of the text, is_head (one row of each group) and has_words of each row: the group, and to how many other rows its index is at least the threshold."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("print", F.xxhash64("text"))
    sets = staged(rows.mapInArrow(_sets, f"row long, doc_id {dict(docs.dtypes)['doc_id']}, print long, digest binary, n_runs long, signature binary"), "jaccard-sets")
    # a class is named by the first row of its documents
    of_digest = sets.filter("n_runs > 0").groupBy("digest").agg(F.min("row").alias("class"), F.count(F.lit(1)).alias("copies"))
    classes = staged(of_digest, "jaccard-classes")
    single = sets.join(classes.select(F.col("class").alias("row"), "class", "copies"), "row")
    bands = single.select("class", "signature").mapInArrow(_bands, "band long, class long")
    first = bands.groupBy("band").agg(F.min("class").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    clusters = staged(components(bands.join(first, "band"), "class", "first", "jaccard-candidates"), "jaccard-clusters")
    members = staged(single.join(clusters, F.col("class") == F.col("node")).select("class", "copies", F.col("root").alias("cluster"), "n_runs", "signature", F.col("doc_id").alias("of_doc"), F.col("print").alias("of_print")), "jaccard-members")
    # blocks by running sums over spread-out stretches of a cluster: each stretch is cut by itself
    sums = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("n_runs").alias("all_runs"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_CLASSES), F.ceil(F.col("all_runs") / BLOCK_RUNS)).cast("int")
    dealt = members.join(sums.select("cluster", blocks.alias("blocks")), "cluster").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    # the sets themselves, of candidates only; equal rows give a class's set more than once
    wanted = members.select("class", "of_doc", "of_print")
    texts = rows.join(wanted, (F.col("print") == F.col("of_print")) & F.col("doc_id").eqNullSafe(F.col("of_doc"))).select("class", "text").mapInArrow(_runs, "class long, runs binary")
    dealt = dealt.select("class", "copies", "cluster", "blocks", "block", "signature").join(texts, "class")
    other = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = other.select("cluster", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "class", "copies", "signature", "runs")
    work = tasks.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    found = staged(work.mapInArrow(lambda b: _link(b, threshold, tolerance), "class long, tie long, links long"), "jaccard-links")
    groups_ = components(found.filter("tie >= 0"), "class", "tie", "jaccard-groups")
    links = found.filter("tie < 0").groupBy("class").agg(F.sum("links").alias("links"))
    named = (
        sets.select("row", "doc_id", "print", "digest").join(classes, "digest", "left")
        .join(groups_.withColumnRenamed("node", "class"), "class", "left").join(links, "class", "left")
        .select("row", "doc_id", "print", "digest", F.coalesce("root", "class", "row").alias("group"), (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"))
    )
    named = staged(named, "jaccard-named")
    smallest = named.groupBy("group").agg(F.min("doc_id").alias("class_id"), F.min("row").alias("head"))
    return named.join(smallest, "group").select("doc_id", "print", "class_id", "n_links", (F.col("row") == F.col("head")).alias("is_head"), F.col("digest").isNotNull().alias("has_words"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group, and all without a word."""
    found = staged(similar(docs), "jaccard-found")
    heads = found.filter("is_head AND has_words").select(F.col("doc_id").alias("of_doc"), F.col("print").alias("of_print"))
    worded = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded")
    rows = docs.select(whole_row(docs), "doc_id", F.xxhash64(F.col("text").cast("string")).alias("print"), worded)
    stay = rows.filter("worded").join(heads, (F.col("print") == F.col("of_print")) & F.col("doc_id").eqNullSafe(F.col("of_doc")), "left_semi")
    return stay.dropDuplicates(["print", "doc_id"]).union(rows.filter("NOT worded")).select("whole.*")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


QUERIES = {"op3_jaccard": op3_jaccard}
ORACLES: dict[str, str] = {}
