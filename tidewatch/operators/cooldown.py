"""Cooldown suppression: of the candidate times of a key, keep those at least `cooldown` after the last kept one.

The choice is sequential, but only through the time of the last kept candidate. Distinct candidates are sorted into ranges of (key, time), so
a frequent key is spread over as many ranges as its rows need. A key that lies inside one range is done there. Of a key that crosses a border, each
range writes its times and, for each, the last time that would be kept in the range if that one were kept first: one file, mapped by who
reads it. The ranges of a key are then walked with one look-up each, which gives every range the time from which it may keep; with that the
ranges are replayed apart from each other. Nothing larger than a range is ever held.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.staging import shared_root, staged

BEGIN = np.iinfo(np.int64).min


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if urlsplit(folder).scheme else (pafs.LocalFileSystem(), folder)


def _save(folder: str, times: np.ndarray, last: np.ndarray) -> str:
    """Under a name of its own: a task that runs again writes another file, and only rows of finished tasks name files."""
    fs, base = _store(folder)
    fs.create_dir(base, recursive=True)
    name = uuid.uuid4().hex
    batch = pa.record_batch([pa.array(times), pa.array(last)], names=["t", "last"])
    with fs.open_output_stream(f"{base}/{name}") as out, pa.ipc.new_file(out, batch.schema) as file:
        file.write_batch(batch)
    return name


def _load(folder: str, name: str) -> tuple[np.ndarray, np.ndarray]:
    fs, base = _store(folder)
    source = pa.memory_map(f"{base}/{name}") if fs.type_name == "local" else fs.open_input_file(f"{base}/{name}")
    batch = pa.ipc.open_file(source).get_batch(0)
    return batch.column("t").to_numpy(), batch.column("last").to_numpy()


def _following(times: np.ndarray, cooldown: int) -> np.ndarray:
    """Place of the next time kept after each one; the number of times where there is none."""
    return np.searchsorted(times, times + cooldown)


def _kept(times: np.ndarray, cooldown: int, start: int) -> np.ndarray:
    following, at, places = _following(times, cooldown).tolist(), int(np.searchsorted(times, start)), []
    while at < len(times):
        places.append(at)
        at = following[at]
    return times[places]


def _last_kept(times: np.ndarray, cooldown: int) -> np.ndarray:
    """The last time kept if each one were kept first; steps double, so a long chain takes few rounds."""
    n = len(times)
    step = np.append(_following(times, cooldown), n)
    last = np.arange(n + 1)
    while True:
        more = step < n
        if not more.any():
            return times[last[:n]]
        last[more] = last[step[more]]
        step[more] = step[step[more]]


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of sorted batches, one table for each run of equal keys."""
    held, current = [], None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        start = 0
        rows = list(zip(*columns, strict=True))
        while start < len(rows):
            end = start + 1
            while end < len(rows) and rows[end] == rows[start]:
                end += 1
            if rows[start] != current and held:
                yield pa.Table.from_batches(held)
                held = []
            current = rows[start]
            held.append(batch.slice(start, end - start))
            start = end
    if held:
        yield pa.Table.from_batches(held)


def _result(run: pa.Table, keys: list[str], schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(c for c in columns.values() if c is not None))
    of_key = [run.column(k).combine_chunks().take(pa.array(np.zeros(n, np.int64))) for k in keys]
    rest = [pa.array(columns[f.name], f.type) if columns.get(f.name) is not None else pa.nulls(n, f.type) for f in schema if f.name not in keys]
    flat = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in of_key]
    return pa.record_batch([*flat, *rest], names=[*keys, *(f.name for f in schema if f.name not in keys)])


_OUT = pa.schema([("part", pa.int32()), ("file", pa.string()), ("kept", pa.int64())])


def _ranges(ids: list[str], folder: str):
    """Pass over a range: times kept of keys inside it, a file for each key at its ends."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def edge(run):
            times, cooldown = run.column("_t").to_numpy(), run.column("_cooldown")[0].as_py()
            return _result(run, ids, _OUT, part=[part], file=[_save(folder, times, _last_kept(times, cooldown))])

        before, first = None, True
        for run in _runs(batches, ids):
            if before is not None:
                if first:
                    yield edge(before)
                    first = False
                else:
                    kept = _kept(before.column("_t").to_numpy(), before.column("_cooldown")[0].as_py(), BEGIN)
                    yield _result(before, ids, _OUT, kept=kept)
            before = run
        if before is not None:
            yield edge(before)

    return work


def _walk(ids: list[str], folder: str):
    """For each file of a key, in order, the time from which it may keep."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("file", pa.string()), ("start", pa.int64())])
        for run in _runs(batches, ids):
            start, cooldown, files, starts = BEGIN, run.column("_cooldown")[0].as_py(), [], []
            for file in run.column("file").to_pylist():
                times, last = _load(folder, file)
                at = int(np.searchsorted(times, start))
                if at < len(times):
                    files.append(file)
                    starts.append(start)
                    start = int(last[at]) + cooldown
            if files:
                yield _result(run, ids, out, file=files, start=starts)

    return work


def _replay(ids: list[str], folder: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("kept", pa.int64())])
        for batch in batches:
            for i in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                times, _ = _load(folder, row.column("file")[0].as_py())
                yield _result(row, ids, out, kept=_kept(times, row.column("_cooldown")[0].as_py(), row.column("start")[0].as_py()))

    return work


def kept_times(candidates: DataFrame, keys: list[str], t: str, cooldown_us: str) -> DataFrame:
    """Distinct (keys, t) that fire. `t` and `cooldown_us` are bigint micros; cooldown must be positive."""
    ids = [*keys, "_cooldown"]
    folder = f"{shared_root(candidates.sparkSession)}/cooldown-{uuid.uuid4().hex}"
    times = staged(candidates.select(*keys, F.col(cooldown_us).cast("bigint").alias("_cooldown"), F.col(t).alias("_t")).distinct(), "candidates")
    of_ids = [times.schema[c] for c in ids]
    schema = lambda **more: T.StructType([*of_ids, *(T.StructField(n, k) for n, k in more.items())])
    ordered = times.repartitionByRange(*ids, "_t").sortWithinPartitions(*ids, "_t")
    ranges = staged(ordered.mapInArrow(_ranges(ids, folder), schema(part=T.IntegerType(), file=T.StringType(), kept=T.LongType())), "cooldown")
    edges = ranges.filter("file IS NOT NULL").repartition(*ids).sortWithinPartitions(*ids, "part")
    starts = edges.drop("kept").mapInArrow(_walk(ids, folder), schema(file=T.StringType(), start=T.LongType()))
    replayed = starts.repartition("file").mapInArrow(_replay(ids, folder), schema(kept=T.LongType()))
    return ranges.filter("kept IS NOT NULL").select(*keys, F.col("kept").alias(t)).union(replayed.select(*keys, F.col("kept").alias(t)))


def apply_cooldown(candidates: DataFrame, keys: list[str], t: str, seq: str, cooldown_us: str) -> DataFrame:
    """Candidates that fire; among equal times the lowest `seq` does. A cooldown of 0 keeps every candidate."""
    always = candidates.filter(F.col(cooldown_us) <= 0)
    limited = candidates.filter(F.col(cooldown_us) > 0)
    kept = kept_times(limited, keys, t, cooldown_us)
    peers = Window.partitionBy(*keys, t).orderBy(seq)
    fired = (
        limited.join(kept.hint("merge"), keys + [t], "left_semi")  # dealt as the window below is; kept times are many rows in small files
        .withColumn("_peer", F.row_number().over(peers))
        .filter("_peer = 1")
        .drop("_peer")
    )
    return fired.unionByName(always)
