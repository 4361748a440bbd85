"""Approximate nearest neighbours by a navigable small-world graph for each shard.

Equal vectors are one node: the graph has each distinct vector once (named by its smallest vec_id), and the k + 1 smallest ids of each
are kept beside it, which is all that a list of k neighbours can hold. Distinct vectors are dealt by hash into shards; a task builds a
shard's graph and stores it as one row: ids, vectors, and for every level a flat array of neighbours (nodes are numbered by falling level,
so the nodes of a level are a prefix). Nodes enter in batches, and both building and searching move a batch of beams in step. A query
goes to every shard; the shards' nearest are merged by exact distance in double precision on the stored vectors.

Defined results: vectors that are null, empty, all zero or hold null or non-finite components take no part, neither as queries nor as
candidates; vectors are compared with those of their own length only; ties go to the smaller vec_id; a repeated query id is searched once;
rows with one id are never each other's candidates; no vectors, no rows; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.inputs import staged, table
from tidewatch.llm.text import groups

K = 10
SHARD_VECTORS = 8192
DEGREE = 16
BUILD_BEAM = 96
SEARCH_BEAM = 160
BATCH = 256
QUERY_EVERY = 100


def distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Squared distances of each query (rows) to its own candidates (rows, candidates, components)."""
    apart = vectors - queries[:, None, :]
    return np.einsum("ijk,ijk->ij", apart, apart)


class Graph:
    """Nodes numbered by falling level; `links[l]` is an array of neighbours of the first nodes, those of level l or more, -1 where none."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray]) -> None:
        self.vectors, self.links = np.asarray(vectors, np.float32), links

    @classmethod
    def build(cls, vectors: np.ndarray, levels: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM) -> Graph:
        """`levels` must fall. """
        n = len(vectors)
        sizes = [int((levels >= at).sum()) for at in range(int(levels[0]) + 1)] if n else [0]
        graph = cls(vectors, [np.full((size, degree * (2 if at == 0 else 1)), -1, np.int32) for at, size in enumerate(sizes)])
        a = 1
        while a < n:
            b = min(n, a + min(BATCH, a))
            graph._insert(a, b, levels, degree, beam)
            a = b
        return graph

    def _insert(self, a: int, b: int, levels: np.ndarray, degree: int, beam: int) -> None:
        new = np.arange(a, b)
        found = np.zeros((b - a, 1), np.int64)
        for at in range(len(self.links) - 1, -1, -1):
            old = min(a, len(self.links[at]))
            if not old:
                continue
            joins = int((levels[a:b] >= at).sum())  # a prefix, as levels fall
            if joins < b - a:
                found[joins:, :1] = self._walk(self.vectors[new[joins:]], found[joins:, :1], 1, at, old)[0]
            if joins:
                near, _ = self._walk(self.vectors[new[:joins]], found[:joins], beam, at, old)
                self._connect(at, new[:joins], near, degree)
                wide = np.full((b - a, near.shape[1]), -1, np.int64)
                wide[:joins] = near
                wide[joins:, 0] = found[joins:, 0]
                found = wide

    def _connect(self, at: int, new: np.ndarray, near: np.ndarray, degree: int) -> None:
        links = self.links[at]
        beside = np.broadcast_to(new, (len(new), len(new)))  # nodes of the same batch
        among = distances(self.vectors[new], np.broadcast_to(self.vectors[new], (len(new), *self.vectors[new].shape)))
        among[np.arange(len(new)), np.arange(len(new))] = np.inf
        few = np.argsort(among, axis=1)[:, : min(degree, len(new) - 1)] if len(new) > 1 else np.zeros((len(new), 0), np.int64)
        options = np.concatenate([near, np.take_along_axis(beside, few, 1)], axis=1)
        chosen = self._select(new, options, degree)
        links[new, :degree] = chosen
        # links back, each old node with all that came to it
        source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        if not len(nodes):
            return
        came = np.full((len(nodes), int(count.max())), -1, np.int64)
        came[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        for i in range(0, len(nodes), 512):
            part = slice(i, i + 512)
            options = np.concatenate([links[nodes[part]].astype(np.int64), came[part]], axis=1)
            links[nodes[part]] = self._select(nodes[part], options, links.shape[1])

    def _select(self, nodes: np.ndarray, options: np.ndarray, limit: int) -> np.ndarray:
        """Up to `limit` options for each node: nearest first, those nearer to the node than to any chosen one, then the nearest of the rest."""
        options = np.sort(options, axis=1)
        options[:, 1:][options[:, 1:] == options[:, :-1]] = -1
        options[options == nodes[:, None]] = -1
        apart = np.where(options >= 0, distances(self.vectors[nodes], self.vectors[options]), np.inf)
        order = np.argsort(apart, axis=1)[:, : max(2 * limit, limit + 16)]
        options, apart = np.take_along_axis(options, order, 1), np.take_along_axis(apart, order, 1)
        near = self.vectors[options]
        squares = np.einsum("ijk,ijk->ij", near, near)
        between = squares[:, :, None] + squares[:, None, :] - 2 * np.matmul(near, near.transpose(0, 2, 1))
        chosen = np.zeros(options.shape, bool)
        closest = np.full(options.shape, np.inf, np.float32)  # of each option to the chosen ones
        for j in range(options.shape[1]):
            take = (options[:, j] >= 0) & (apart[:, j] < closest[:, j]) & (chosen.sum(1) < limit)
            chosen[take, j] = True
            closest[take] = np.minimum(closest[take], between[take, j])
        rank = np.argsort(np.where(options < 0, 2, ~chosen).astype(np.int8), axis=1, kind="stable")[:, :limit]
        best = np.take_along_axis(options, rank, 1)
        return np.pad(best, ((0, 0), (0, limit - best.shape[1])), constant_values=-1)

    def _walk(self, queries: np.ndarray, entry: np.ndarray, beam: int, at: int, size: int, widen: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` nearest found of each query among the first `size` nodes of a level, and their squared distances."""
        m, links = len(queries), self.links[at]
        rows = np.arange(m)[:, None]
        seen = np.zeros((m, size + 1), np.int32)
        entry = np.where((entry >= 0) & (entry < size), entry, -1)
        apart = np.where(entry >= 0, distances(queries, self.vectors[entry]), np.inf).astype(np.float32)
        seen[rows, entry] = 1
        ids, open_ = entry, entry >= 0
        turn = 1
        while True:
            if ids.shape[1] > beam:
                order = np.argsort(apart, axis=1, kind="stable")[:, :beam]
            else:
                order = np.argsort(apart, axis=1, kind="stable")
            ids, apart, open_ = (np.take_along_axis(x, order, 1) for x in (ids, apart, open_))
            if not open_.any():
                return ids, apart
            pick = np.argsort(~open_, axis=1, kind="stable")[:, : min(widen, beam)]
            live = np.take_along_axis(open_, pick, 1)
            nodes = np.where(live, np.take_along_axis(ids, pick, 1), -1)
            np.put_along_axis(open_, pick, False, 1)
            around = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(m, -1).astype(np.int64)
            around = np.where(around < size, around, -1)
            around[seen[rows, around] > 0] = -1
            stamp = turn + 1 + np.arange(around.shape[1], dtype=np.int32)
            seen[rows, around] = stamp
            around[seen[rows, around] != stamp] = -1  # the same node by two ways
            turn = int(stamp[-1])
            far = np.where(around >= 0, distances(queries, self.vectors[around]), np.inf).astype(np.float32)
            ids, apart = np.concatenate([ids, around], 1), np.concatenate([apart, far], 1)
            open_ = np.concatenate([open_, around >= 0], 1)

    def search(self, queries: np.ndarray, count: int, beam: int = SEARCH_BEAM) -> np.ndarray:
        """Numbers of the nearest nodes found, `count` a query at most, -1 where there are fewer."""
        queries = np.asarray(queries, np.float32)
        found = np.zeros((len(queries), 1), np.int64)
        for at in range(len(self.links) - 1, 0, -1):
            found = self._walk(queries, found, 1, at, len(self.links[at]))[0]
        ids, apart = self._walk(queries, found, max(beam, count), 0, len(self.vectors))
        return np.where(np.isfinite(apart), ids, -1)[:, :count]


def _levels(n: int, degree: int, seed: int) -> np.ndarray:
    draws = np.random.default_rng(seed).random(n)
    return np.sort(np.floor(-np.log(1 - draws) / np.log(degree)).astype(int))[::-1]


INDEX = "shard long, width int, ids binary, vectors binary, sizes array<int>, links array<binary>"


def _build(batches: Iterator[pa.RecordBatch], degree: int, beam: int) -> Iterator[pa.RecordBatch]:
    for shard in groups(batches, ["shard"]):
        shard = shard.combine_chunks()
        number, width = shard.column("shard")[0].as_py(), len(shard.column("vector")[0])
        vectors = np.concatenate([c.flatten().to_numpy() for c in shard.column("vector").chunks]).reshape(-1, width)
        levels = _levels(len(vectors), degree, number)
        graph = Graph.build(vectors, levels, degree, beam)
        yield pa.record_batch(
            [
                pa.array([number]), pa.array([width], pa.int32()), pa.array([shard.column("vec_id").to_numpy().astype(np.int64).tobytes()]), pa.array([vectors.tobytes()]),
                pa.array([[len(x) for x in graph.links]], pa.list_(pa.int32())), pa.array([[x.tobytes() for x in graph.links]], pa.list_(pa.binary())),
            ],
            names=["shard", "width", "ids", "vectors", "sizes", "links"],
        )


def _search(batches: Iterator[pa.RecordBatch], count: int, beam: int) -> Iterator[pa.RecordBatch]:
    """Rows of a shard: its index first, then queries."""
    shard, graph, ids, vectors = None, None, None, None
    for batch in batches:
        rows = batch.num_rows
        numbers, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
        at = 0
        while at < rows:
            if kind[at] == 0:
                row = batch.slice(at, 1).to_pylist()[0]
                shard, ids = row["shard"], np.frombuffer(row["ids"], np.int64)
                vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), row["width"])
                graph = Graph(vectors, [np.frombuffer(x, np.int32).reshape(n, -1) for n, x in zip(row["sizes"], row["links"], strict=True)])
                at += 1
                continue
            end = at
            while end < rows and end - at < BATCH and kind[end] == 1 and numbers[end] == numbers[at]:
                end += 1
            if numbers[at] == shard:
                own = batch.slice(at, end - at)
                queries = own.column("vector").flatten().to_numpy().reshape(end - at, -1)
                near = graph.search(queries, count, beam)
                real = near >= 0
                exact = np.sqrt(distances(queries, vectors[near]))
                of = np.repeat(own.column("vec_id").to_numpy(), real.sum(1))
                yield pa.record_batch([pa.array(of), pa.array(ids[near[real]]), pa.array(exact[real])], names=["query_id", "node", "score"])
            at = end


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and vector, in double precision, of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).filter(F.coalesce(good, F.lit(False)))


def build_index(vectors: DataFrame, k: int = K, shard_vectors: int = SHARD_VECTORS, degree: int = DEGREE, beam: int = BUILD_BEAM) -> tuple[DataFrame, DataFrame]:
    """The index, one row a shard, and the members (node, vec_id) of each node, the k + 1 smallest ids at most."""
    # the limit on ranks is also put before the shuffle, so a vector that a third of the rows share does not travel whole
    alike = Window.partitionBy("vector")
    few = vectors.withColumn("turn", F.row_number().over(alike.orderBy("vec_id"))).filter(F.col("turn") <= k + 1)
    few = staged(few.withColumn("node", F.min("vec_id").over(alike)), "hnsw-members")
    nodes = few.filter("turn = 1")
    widths = nodes.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a vector length
    first, shard = 0, F.lit(None).cast("long")
    for row in sorted(widths):
        parts = -(-row.n // shard_vectors)
        shard = F.when(F.size("vector") == row.width, first + F.pmod(F.xxhash64("vec_id"), F.lit(parts))).otherwise(shard)
        first += parts
    dealt = nodes.select("vec_id", "vector", shard.alias("shard")).repartition("shard").sortWithinPartitions("shard", "vec_id")
    index = staged(dealt.mapInArrow(lambda b: _build(b, degree, beam), INDEX), "hnsw-index")
    return index, few.select("node", "vec_id")


def search(index: DataFrame, members: DataFrame, queries: DataFrame, k: int = K, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found. `queries`: vec_id and vector."""
    once = queries.dropDuplicates(["vec_id"])
    ranges = index.groupBy("width").agg(F.min("shard").alias("a"), F.max("shard").alias("b")).collect()  # a row a vector length
    shards = F.lit(None).cast("array<long>")
    for row in ranges:
        shards = F.when(F.size("vector") == row.width, F.sequence(F.lit(row.a), F.lit(row.b))).otherwise(shards)
    everywhere = once.withColumn("width", F.size("vector")).withColumn("shard", F.explode(shards))  # the stated queries against all shards
    empty = {c: F.lit(None).cast(t) for c, t in (("ids", "binary"), ("vectors", "binary"), ("sizes", "array<int>"), ("links", "array<binary>"))}
    asked = everywhere.select("shard", F.lit(1).alias("kind"), "vec_id", "vector", "width", *[c.alias(n) for n, c in empty.items()])
    graphs = index.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("vector"), "width", *empty)
    found = graphs.union(asked).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(lambda b: _search(b, k + 1, beam), "query_id long, node long, score double")
    nearest = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "node"))
    nodes = found.withColumn("turn", nearest).filter(F.col("turn") <= k + 1)
    rows = nodes.join(members, "node").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return rows.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    index, members = build_index(vectors)
    return search(index, members, vectors.filter(F.col("vec_id") % QUERY_EVERY == 0))


QUERIES = {"op9_hnsw": op9_hnsw}
ORACLES: dict[str, str] = {}
