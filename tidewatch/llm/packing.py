"""Packing documents into sequences by a grouping genetic algorithm.

A document longer than a sequence is cut; whole-length pieces are sequences of their own. The other pieces are dealt by hash into shards of
a bounded number of pieces, each a bin-packing problem of its own. A solution is a grouping of a shard's pieces. Crossover takes whole
well-filled bins of one parent into the other, drops the bins there that hold one of their pieces a second time, and best-fits the pieces
that lost their place. Several islands work on each shard as tasks of their own; between rounds their best solutions move on to the next
island of the ring, as rows. A solution is better with fewer bins, then with fuller ones (the sum of squared fill).

Defined results: a null or empty text is its end id alone; equal rows are packed each on its own; no documents, no rows; other columns are
passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.inputs import staged, table
from tidewatch.llm.text import pieces as batch_pieces
from tidewatch.llm.tokens import crc32_of, encoder, tokenizer_path

LENGTH = 2048
END_ID = 0
SHARD_PIECES = 4096
ISLANDS = 3
ROUNDS = 2
GENERATIONS = 3
POPULATION = 4
PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def _cut(batches: Iterator[pa.RecordBatch], path: str, end_id: int, length: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    uid = TaskContext.get().partitionId() << 33
    for batch in batch_pieces(batches, "text"):
        ids, at = encoder(path).encode(batch.column("text"), end_id)
        ids = ids.astype("<u4")
        count = -(-np.diff(at) // length)
        doc = np.repeat(np.arange(len(count)), count)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = piece * length
        size = np.minimum(np.diff(at)[doc] - start, length)
        first = at[doc] + start
        views = [ids[a : a + n] for a, n in zip(first.tolist(), size.tolist(), strict=True)]
        yield pa.record_batch(
            [
                pa.array(uid + np.arange(len(doc))), batch.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size),
                pa.array([crc32_of(v) for v in views], pa.int64()), pa.array([v.tobytes() for v in views] if with_ids else [None] * len(views), pa.binary()),
            ],
            names=["uid", "doc_id", "piece", "start", "length", "ids_crc32", "ids"],
        )
        uid += len(doc)


def document_pieces(docs: DataFrame, path: str | None = None, end_id: int = END_ID, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """A row a piece, with a number of its own. Kept, as numbers are given by the task."""
    path = path or tokenizer_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return staged(rows.mapInArrow(lambda b: _cut(b, path, end_id, length, with_ids), PIECES), "packing-pieces")


class Shard:
    """One bin-packing problem: sizes, and solutions as arrays that name each piece's bin."""

    def __init__(self, sizes: np.ndarray, capacity: int, seed: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.listed = sizes.tolist()
        self.random = np.random.default_rng(seed)

    def best_fit(self, bins: np.ndarray, homeless: np.ndarray) -> np.ndarray:
        """Puts the homeless pieces, in the order given, each into the bin it fills best, or a new one. Bins are renumbered from 0."""
        placed = bins >= 0
        used, renamed = np.unique(bins[placed], return_inverse=True)
        bins = bins.copy()
        bins[placed] = renamed
        free = (self.capacity - np.bincount(renamed, self.sizes[placed], len(used))).astype(int).tolist()
        by_free: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        some = 0
        for b, f in enumerate(free):
            by_free[f].append(b)
            some |= 1 << f
        for i in homeless.tolist():
            n = self.listed[i]
            fits = some >> n
            if fits:
                f = n + (fits & -fits).bit_length() - 1
                b = by_free[f].pop()
                if not by_free[f]:
                    some ^= 1 << f
            else:
                f, b = self.capacity, len(free)
                free.append(f)
            bins[i] = b
            by_free[f - n].append(b)
            some |= 1 << (f - n)
        return bins

    def _falling(self, items: np.ndarray, noise: float = 0.0) -> np.ndarray:
        return items[np.argsort(-self.sizes[items] * (1 + noise * self.random.standard_normal(len(items))), kind="stable")]

    def start(self, noise: float) -> np.ndarray:
        return self.best_fit(np.full(len(self.sizes), -1), self._falling(np.arange(len(self.sizes)), noise))

    def fill(self, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, self.sizes) / self.capacity

    def rank(self, bins: np.ndarray) -> tuple[float, float]:
        fill = self.fill(bins)
        return len(fill), -float((fill**2).sum())

    def cross(self, into: np.ndarray, giver: np.ndarray) -> np.ndarray:
        """`into` with some of the giver's well-filled bins."""
        good = np.flatnonzero(self.fill(giver) >= 0.98)
        given = self.random.choice(good, max(1, len(good) // 4), replace=False) if len(good) else good
        moved = np.isin(giver, given)
        gone = np.isin(into, into[moved])
        child = np.where(gone, -1, into)
        child[moved] = giver[moved] + len(self.sizes)
        return self.best_fit(child, self._falling(np.flatnonzero(gone & ~moved)))

    def mutate(self, bins: np.ndarray) -> np.ndarray:
        """Opens the emptiest bins and a few others again."""
        fill = self.fill(bins)
        opened = np.union1d(np.argsort(fill, kind="stable")[: 1 + len(fill) // 50], self.random.integers(0, len(fill), 1 + len(fill) // 50))
        gone = np.isin(bins, opened)
        return self.best_fit(np.where(gone, -1, bins), self._falling(np.flatnonzero(gone), 0.05))

    def least(self) -> int:
        return -(-int(self.sizes.sum()) // self.capacity)

    def evolve(self, population: list[np.ndarray], size: int, generations: int) -> list[np.ndarray]:
        population = [*population, *(self.start(0.1 * k) for k in range(max(0, size - len(population))))]
        population.sort(key=self.rank)
        for _ in range(generations):
            if self.rank(population[0])[0] <= self.least():
                break
            children = []
            for _ in range(size):
                a, b = self.random.integers(0, len(population), 2)
                child = self.cross(population[a], population[b]) if a != b else self.mutate(population[a])
                children.append(child)
            children.append(self.mutate(population[0]))
            population = sorted([*population, *children], key=self.rank)[:size]
        return population


def _evolve(batches: Iterator[pa.RecordBatch], capacity: int, size: int, generations: int, turn: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            own = Shard(np.array(row["sizes"]), capacity, row["shard"] * 1009 + row["island"] * 31 + turn)
            best = own.evolve([np.frombuffer(x, np.int32).astype(np.int64) for x in row["elites"] or []], size, generations)[:2]
            for bins in best:
                n, squares = own.rank(bins)
                yield pa.record_batch([[row["shard"]], pa.array([row["island"]], pa.int32()), pa.array([bins.astype(np.int32).tobytes()]), pa.array([int(n)], pa.int32()), [squares]], names=["shard", "island", "bins", "n_bins", "squares"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            bins, sizes = np.frombuffer(row["bins"], np.int32).astype(np.int64), np.array(row["sizes"])
            by = np.argsort(bins, kind="stable")
            ends = np.cumsum(sizes[by])
            first = np.concatenate([[True], bins[by][1:] != bins[by][:-1]])
            begin = np.maximum.accumulate(np.where(first, ends - sizes[by], 0))
            yield pa.record_batch([pa.array(np.array(row["uids"])[by]), pa.array((row["shard"] << 32) + bins[by]), pa.array(ends - sizes[by] - begin)], names=["uid", "sequence_id", "offset"])


def pack(pieces: DataFrame, length: int = LENGTH, shard_pieces: int = SHARD_PIECES, islands: int = ISLANDS, rounds: int = ROUNDS, generations: int = GENERATIONS, population: int = POPULATION) -> DataFrame:
    """uid, sequence_id and offset of each piece. `pieces`: uid and length, at most `length`, read more than once."""
    part = pieces.filter(F.col("length") < length)
    n_shards = max(1, -(-part.count() // shard_pieces))
    shards = staged(
        part.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(n_shards))).groupBy("shard").agg(F.sort_array(F.collect_list(F.struct(F.col("length").cast("int").alias("size"), "uid"))).alias("items"))
        .select("shard", F.col("items.uid").alias("uids"), F.col("items.size").alias("sizes")),
        "packing-shards",
    )
    everywhere = shards.select("shard", "sizes", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    elites = None
    for turn in range(rounds):
        if elites is None:
            given = everywhere.withColumn("elites", F.lit(None).cast("array<binary>"))
        else:  # each island goes on with its own two best and those of the island before it
            own = elites.select("shard", "island", "bins")
            moved = elites.select("shard", ((F.col("island") + 1) % islands).alias("island"), "bins")
            given = everywhere.join(own.union(moved).groupBy("shard", "island").agg(F.collect_list("bins").alias("elites")), ["shard", "island"])
        work = given.repartition("shard", "island")
        elites = staged(work.mapInArrow(lambda b, t=turn: _evolve(b, length, population, generations, t), "shard long, island int, bins binary, n_bins int, squares double"), "packing-elites")
    best = elites.groupBy("shard").agg(F.min_by("bins", F.struct("n_bins", "squares", "island")).alias("bins"))
    places = shards.join(best, "shard").mapInArrow(_places, "uid long, sequence_id long, offset long")
    whole = pieces.filter(F.col("length") >= length).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return places.union(whole)


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = END_ID, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Each piece of each document with its sequence and place in it."""
    pieces = document_pieces(docs, path, end_id, length, with_ids)
    found = pieces.join(pack(pieces.select("uid", "length"), length), "uid")
    return found.drop("uid") if with_ids else found.drop("uid", "ids")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences of `pack_documents(..., with_ids=True)`: ids as little-endian unsigned 32-bit integers, and where pieces begin."""
    put = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(put.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.col("p.offset").alias("starts"), F.col("p.doc_id").alias("doc_ids"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op8_packing": op8_packing}
ORACLES: dict[str, str] = {}
