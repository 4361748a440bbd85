"""Near-duplicate vectors by int8 tile products with error bounds.

A unit vector u is held as int8 codes q and a scale s, with e = |u - s q|. For two vectors the true cosine is within (1 + e)(1 + e') - 1 of
s s' q.q', so most pairs are decided by a product of codes alone; only pairs whose interval holds the threshold are worked out again from the
full vectors. Products of codes are whole numbers below 2**24, so a single-precision matrix product gives them exactly, tile by tile.

Which tiles meet: equal vectors are one node. Nodes lie in the cell of their nearest pivot (a bounded sample, spread out). If x of cell i and y of
cell j are within the threshold's distance r, then x.(p_i - p_j) <= r |p_i - p_j|; so x visits only the cells for which this holds, and no link
is lost. Cells are cut into blocks, and a task compares two blocks; inside, tiles are skipped, or linked as a whole, where their centres and
radii prove it. A task gives links counted for each node and a tie of each node to one root, never pairs, so a group of copies of any size
gives rows in proportion to its nodes. On data without any clusters the bounds exclude little and the comparison is quadratic, as the method is.

Defined results: a vector that is null, empty or zero, or holds null or non-finite components, has no links, its own id as component and is kept;
vectors of other lengths never link; rows of one vec_id are rows of their own (all kept if the id is their component's smallest); a null id
takes part, is nobody's component id unless its component has no other, and is kept only then; no rows, no result; other columns are passed by.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.inputs import staged, table
from tidewatch.llm.jaccard import components
from tidewatch.llm.text import groups

THRESHOLD = 0.95
#: Nodes of a cell aimed at, and most cells (and bytes of pivots) that every task is sent.
CELL_VECTORS, MAX_CELLS, PIVOT_BYTES = 8_192, 1_024, 8 << 20
#: Rows of the sample that pivots are spread over, for each pivot.
SAMPLE = 4
#: Nodes, and bytes of full vectors, of a block.
BLOCK_VECTORS, BLOCK_BYTES = 8_192, 32 << 20
TILE = 1_024
#: Longest stretch of components whose product of codes is exact in single precision.
EXACT_WIDTH = 1_024
#: What rounding in double precision can add to any bound here.
SLACK = 1e-9

PLACED = "cell long, home boolean, node long, copies long, near double, scale double, error double, codes binary, vector binary"


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale of each row, and how far the codes are from the row at most."""
    scale = np.abs(units).max(1) / 127
    codes = np.rint(units / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((units - scale[:, None] * codes) ** 2).sum(1)) + SLACK


def spread_out(sample: np.ndarray, k: int) -> np.ndarray:
    """k rows of a sample of unit vectors, each the farthest from those before."""
    chosen, best = [0], sample @ sample[0]
    while len(chosen) < min(k, len(sample)):
        chosen.append(int(best.argmin()))
        best = np.maximum(best, sample @ sample[chosen[-1]])
    return sample[chosen]


class Linked:
    """Smallest linked node of each node, as far as ties have come."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def tie(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            low = np.minimum(a, b)
            np.minimum.at(self.root, a, low)
            np.minimum.at(self.root, b, low)
            while (after := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = after


def _place(batches: Iterator[pa.RecordBatch], pivots: dict[int, tuple[int, np.ndarray]], threshold: float, dtype: str) -> Iterator[pa.RecordBatch]:
    """A row for the cell of each node, and one for each cell that it visits. Of two cells only one visits the other."""
    radius = math.sqrt(2 - 2 * threshold)
    for batch in batches:
        vectors = batch.column("vector")
        widths = np.diff(vectors.offsets.to_numpy())
        for width in np.unique(widths).tolist():
            base, points = pivots[width]
            cells = len(points)
            apart = np.sqrt(np.maximum(0, 2 - 2 * points @ points.T))
            every = np.flatnonzero(widths == width)
            for rows in np.array_split(every, -(-len(every) * width // (1 << 20)) or 1):
                part = batch.take(pa.array(rows))
                own = part.column("vector").flatten().to_numpy().reshape(len(rows), width)
                units = unit(own)
                codes, scale, error = quantised(units)
                near = units @ points.T
                home = near.argmax(1)
                best = near[np.arange(len(rows)), home]
                ahead = (np.arange(cells)[None, :] - home[:, None]) % cells
                visits = (best[:, None] - near <= radius * apart[home] + SLACK) & (ahead > 0) & (2 * ahead <= cells)
                visits &= (2 * ahead < cells) | (home[:, None] < np.arange(cells)[None, :])
                i, j = np.nonzero(visits)
                at, cell = np.concatenate([np.arange(len(rows)), i]), np.concatenate([home, j])
                raw = own.astype(dtype)
                order = pa.array(at)
                packed = [pa.array([x.tobytes() for x in codes], pa.binary()), pa.array([x.tobytes() for x in raw], pa.binary())]
                for a in range(0, len(at), 4096):
                    few = order.slice(a, 4096)
                    here = slice(a, a + 4096)
                    columns = [pa.array(base + cell[here]), pa.array(np.arange(len(at))[here] < len(rows)), part.column("node").take(few), part.column("copies").take(few), *(pa.array(x[at[here]]) for x in (best, scale, error)), *(x.take(few) for x in packed)]
                    yield pa.record_batch(columns, names=["cell", "home", "node", "copies", "near", "scale", "error", "codes", "vector"])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows of codes, exact whole numbers."""
    if a.shape[1] <= EXACT_WIDTH:
        return a @ b.T
    return sum((a[:, k : k + EXACT_WIDTH] @ b[:, k : k + EXACT_WIDTH].T).astype(float) for k in range(0, a.shape[1], EXACT_WIDTH))


class Block:
    """Nodes of a task in the order of their nearness to their pivot, with the centre and angular radius of each tile."""

    def __init__(self, table: pa.Table, width: int, dtype: str) -> None:
        raw = np.frombuffer(b"".join(table.column("vector").to_pylist()), dtype).reshape(-1, width).astype(float)
        self.units = unit(raw)
        self.codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int8).reshape(-1, width)
        self.scale, self.error, self.copies = (table.column(c).to_numpy() for c in ("scale", "error", "copies"))
        self.tiles = [slice(a, min(a + TILE, len(raw))) for a in range(0, len(raw), TILE)]
        self.centres, self.radii = [], []
        for t in self.tiles:
            centre = self.units[t].sum(0)
            size = np.sqrt((centre * centre).sum())
            centre = centre / size if size > 1e-6 else self.units[t.start]
            self.centres.append(centre)
            self.radii.append(float(np.arccos(np.clip(self.units[t] @ centre, -1, 1)).max()) + 1e-7)


def linked_pairs(a: Block, s: slice, b: Block, t: slice, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in the two tiles of all pairs whose cosine is at least the threshold; of one tile with itself, each pair once."""
    product = _products(a.codes[s].astype(np.float32), b.codes[t].astype(np.float32))
    scale_a, scale_b, wide_a, wide_b = a.scale[s], b.scale[t], 1 + a.error[s], 1 + b.error[t]
    least = threshold + 1 - wide_a * wide_b.max()
    # product * scale * scale' >= threshold - bound, with the widest bound and scale of the tile
    bound = np.where(least > 0, least / (scale_a * scale_b.max()) - 0.5, -np.inf).astype(product.dtype)
    possible = product >= bound[:, None]
    if same:
        possible &= np.tri(*possible.shape, -1, dtype=bool).T
    i, j = np.nonzero(possible)
    about = scale_a[i] * scale_b[j] * product[i, j].astype(float)
    off = wide_a[i] * wide_b[j] - 1
    keep = about - off >= threshold
    open_ = np.flatnonzero(~keep & (about + off >= threshold))
    step = max(1, (4 << 20) // a.units.shape[1])
    for k in range(0, len(open_), step):
        few = open_[k : k + step]
        keep[few] = (a.units[s][i[few]] * b.units[t][j[few]]).sum(1) >= threshold
    return i[keep], j[keep]


def _link(batches: Iterator[pa.RecordBatch], threshold: float, dtype: str) -> Iterator[pa.RecordBatch]:
    """Two blocks of a cell, or one with itself. Gives (node, -1, links) and (node, root, 0)."""
    angle = math.acos(threshold)
    for task in groups(batches, ["cell", "i", "j"]):
        low, high = task.column("i")[0].as_py(), task.column("j")[0].as_py()
        task = task.sort_by([("block", "ascending"), ("near", "ascending"), ("node", "ascending")])
        width = len(task.column("codes")[0].as_py())
        block, node = task.column("block").to_numpy(), task.column("node").to_numpy()
        split = int(np.searchsorted(block, low, "right"))
        a = Block(task.slice(0, split), width, dtype) if split else None
        if a is None or (low < high and split == len(node)):
            continue
        b, shift = (a, 0) if low == high else (Block(task.slice(split), width, dtype), split)
        links, roots = np.zeros(len(node), np.int64), Linked(len(node))
        for x, s in enumerate(a.tiles):
            for y, t in enumerate(b.tiles):
                if low == high and y < x:
                    continue
                same = low == high and x == y
                between = math.acos(min(1.0, max(-1.0, float(a.centres[x] @ b.centres[y])))) if not same else 0.0
                if between - a.radii[x] - b.radii[y] > angle + 1e-6:
                    continue
                left, right = np.arange(s.start, s.stop), np.arange(t.start, t.stop) + shift
                if (2 * a.radii[x] if same else between + a.radii[x] + b.radii[y]) < angle - 1e-6:
                    links[left] += int(b.copies[t].sum()) - (a.copies[s] if same else 0)
                    if not same:
                        links[right] += int(a.copies[s].sum())
                    roots.tie(np.concatenate([left, right]), np.full(len(left) + len(right), left[0]))
                    continue
                i, j = linked_pairs(a, s, b, t, same, threshold)
                if not len(i):
                    continue
                links[left] += np.bincount(i, b.copies[t][j], len(left)).astype(np.int64)
                links[right] += np.bincount(j, a.copies[s][i], len(right)).astype(np.int64)
                roots.tie(left[i], right[j])
        some, tied = np.flatnonzero(links), np.flatnonzero(roots.root != np.arange(len(node)))
        columns = [np.concatenate([node[some], node[tied]]), np.concatenate([np.full(len(some), -1), node[roots.root[tied]]]), np.concatenate([links[some], np.zeros(len(tied), np.int64)])]
        yield pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], names=["node", "tie", "links"])


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, cell_vectors: int = CELL_VECTORS, block_vectors: int = BLOCK_VECTORS) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row. `rows` has vec_id and embedding (an array of floats or doubles); threshold over 0."""
    dtype = "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8"
    spark = rows.sparkSession
    vector = F.col("embedding").cast("array<double>")
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    numbered = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), F.monotonically_increasing_id().alias("row"))
    numbered = staged(numbered.withColumn("vector", F.when(F.coalesce(good, F.lit(False)), F.col("vector"))), "vectors-rows")
    fit = numbered.filter("vector IS NOT NULL")
    nodes = staged(fit.groupBy("vector").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies")), "vectors-nodes")

    pivots, base, block_of = {}, 0, {}
    for row in sorted(nodes.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n")).collect()):  # a row a vector length
        k = max(1, min(MAX_CELLS, PIVOT_BYTES // (8 * row.width), -(-row.n // cell_vectors)))
        sample = nodes.filter(F.size("vector") == row.width).orderBy(F.xxhash64("node"), "node").limit(SAMPLE * k).select("vector").collect()  # at most SAMPLE * MAX_CELLS rows
        pivots[row.width] = base, spread_out(unit(np.array([r.vector for r in sample])), k)
        size = max(1, min(block_vectors, BLOCK_BYTES // (8 * row.width)))
        block_of |= {base + c: size for c in range(len(pivots[row.width][1]))}
        base += len(pivots[row.width][1])
    placed = staged(nodes.mapInArrow(lambda b: _place(b, pivots, threshold, dtype), PLACED), "vectors-placed")

    sizes = {c: [0, 0] for c in block_of}
    for row in placed.groupBy("cell", "home").agg(F.count(F.lit(1)).alias("n")).collect():  # two rows a cell
        sizes[row.cell][not row.home] = -(-row.n // block_of[row.cell])
    blocks = spark.createDataFrame([(c, h, v) for c, (h, v) in sizes.items()], "of_cell long, homes int, visitors int")
    tasks = sum(h * (h + 1) // 2 + h * v for h, v in sizes.values())
    dealt = placed.join(blocks, F.col("cell") == F.col("of_cell")).filter("homes > 0")
    block = F.when(F.col("home"), F.pmod(F.xxhash64("node"), F.col("homes"))).otherwise(F.col("homes") + F.pmod(F.xxhash64("node"), F.col("visitors"))).cast("int")
    meets = F.sequence(F.lit(0), F.when(F.col("home"), F.col("homes") + F.col("visitors")).otherwise(F.col("homes")) - 1)
    dealt = dealt.withColumn("block", block).withColumn("with", F.explode(meets)).withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with"))
    work = dealt.select("cell", "i", "j", "block", "node", "copies", "near", "scale", "error", "codes", "vector").repartition(max(1, tasks), "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    found = staged(work.mapInArrow(lambda b: _link(b, threshold, dtype), "node long, tie long, links long"), "vectors-links")

    roots = components(found.filter("tie >= 0"), "node", "tie", "vectors-groups")
    links = found.filter("tie < 0").groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.join(links, "node", "left").join(roots, "node", "left").select("vector", "copies", F.coalesce("root", "node").alias("group"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    of_row = fit.join(named, "vector").select("vec_id", "n_links", "group")
    alone = numbered.filter("vector IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    in_groups = staged(of_row, "vectors-named")
    least = in_groups.groupBy("group").agg(F.min("vec_id").alias("component_id"))
    out = in_groups.join(least, "group").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT * FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM u UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM v LEFT JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a
"""

QUERIES = {"op12_embedding_dedup": op12_embedding_dedup}
ORACLES = {"op12_embedding_dedup": _SQL}
