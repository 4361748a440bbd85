"""Token ids of a corpus in Arrow IPC files of equal-length sequences, read back without copies.

A shard is one file of record batches with two fixed-size-list columns, `ids` and `mask`, of `length` items a row; every batch but the last
has the same number of rows, so row and place of any token are known by division, and a mapped file hands them out as views. The last row is
filled up with 0 under a false mask. Beside it lies an Arrow file of the shard's documents: doc_id, start in the shard, n_tokens.

Shards are ranges of ascending doc_id. A task writes under a name of its own and only names reported by finished tasks are read, so a task
that is run again leaves no half-written shard behind.

Defined results: a null or empty text is its end id alone; null ids come first; rows with equal ids are in the order of their text; no
documents, no files and no rows; other columns are passed by.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.inputs import filesystem, new_folder, staged, table
from tidewatch.llm.text import pieces
from tidewatch.llm.tokens import crc32_of, encoder, tokenizer_path

LENGTH = 2048
ROWS = 256
END_ID = 2
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class ShardWriter:
    """Takes ids of documents one batch after the other and writes them as rows of `length`."""

    def __init__(self, folder: str, name: str, kind: pa.DataType, length: int, rows: int) -> None:
        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.kind, self.length, self.block = kind, length, rows * length
        self.out = self.fs.open_output_stream(f"{base}/{name}.arrow")
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.side = self.fs.open_output_stream(f"{base}/{name}.docs.arrow")
        self.index = pa.ipc.new_file(self.side, INDEX)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_docs = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, at: np.ndarray) -> None:
        self.index.write_batch(pa.record_batch([doc_ids.cast(pa.int64()), pa.array(at[:-1] + self.n_tokens), pa.array(np.diff(at))], schema=INDEX))
        self.n_docs, self.n_tokens = self.n_docs + len(doc_ids), self.n_tokens + len(ids)
        self.held.append(ids.astype(self.kind.to_pandas_dtype()))
        self.n_held += len(ids)
        if self.n_held >= self.block:
            whole = np.concatenate(self.held)
            cut = len(whole) // self.block * self.block
            for a in range(0, cut, self.block):
                self._batch(whole[a : a + self.block], self.block)
            self.held, self.n_held = [whole[cut:]], len(whole) - cut

    def _batch(self, ids: np.ndarray, real: int) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(ids), pa.array(np.arange(len(ids)) < real))]
        self.file.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        rest = np.concatenate(self.held) if self.held else np.zeros(0, self.kind.to_pandas_dtype())
        if len(rest):
            self._batch(np.pad(rest, (0, -len(rest) % self.length)), len(rest))
        for x in (self.file, self.out, self.index, self.side):
            x.close()


class TokenShard:
    """Random access to one shard. `sequence` and `mask` are views of the mapped file; `parts` are views that make up any stretch of ids."""

    def __init__(self, folder: str, name: str) -> None:
        fs, base = filesystem(folder)
        self.file = pa.ipc.open_file(self._open(fs, f"{base}/{name}.arrow"))
        self.index = pa.ipc.open_file(self._open(fs, f"{base}/{name}.docs.arrow"))
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0
        self._last: tuple[int, pa.RecordBatch] | None = None

    @staticmethod
    def _open(fs, path: str):
        return pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)

    def _batch(self, k: int) -> pa.RecordBatch:
        if self._last is None or self._last[0] != k:
            self._last = k, self.file.get_batch(k)
        return self._last[1]

    def sequence(self, i: int) -> np.ndarray:
        batch, row = self._batch(i // self.rows), i % self.rows
        return batch.column("ids").values.to_numpy()[row * self.length : (row + 1) * self.length]

    def mask(self, i: int) -> pa.Array:
        batch, row = self._batch(i // self.rows), i % self.rows
        return batch.column("mask").values.slice(row * self.length, self.length)

    def parts(self, start: int, n: int) -> Iterator[np.ndarray]:
        block = self.rows * self.length
        while n > 0:
            k, place = divmod(start, block)
            view = self._batch(k).column("ids").values.to_numpy()[place : place + n]
            yield view
            start, n = start + len(view), n - len(view)

    def documents(self) -> Iterator[pa.RecordBatch]:
        return (self.index.get_batch(k) for k in range(self.index.num_record_batches))


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int, length: int, rows: int, by_words: bool) -> Iterator[pa.RecordBatch]:
    writer, name = None, uuid.uuid4().hex
    for batch in pieces(batches, "text"):
        tool = encoder(path, by_words)
        if writer is None:
            kind = pa.uint16() if max(tool.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else pa.uint32()
            writer = ShardWriter(folder, name, kind, length, rows)
        writer.add(batch.column("doc_id"), *tool.encode(batch.column("text"), end_id))
    if writer is not None:
        writer.close()
        part = TaskContext.get().partitionId()
        yield pa.record_batch([pa.array([part], pa.int32()), [name], pa.array([writer.n_docs]), pa.array([writer.n_tokens])], names=["part", "name", "n_docs", "n_tokens"])


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard in batch.to_pylist():
            opened = TokenShard(folder, shard["name"])
            for docs in opened.documents():
                starts, counts = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                crcs = np.zeros(len(starts), np.int64)
                for i, (a, n) in enumerate(zip(starts.tolist(), counts.tolist(), strict=True)):
                    crc = 0
                    for view in opened.parts(a, n):
                        crc = crc32_of(view, crc)
                    crcs[i] = crc
                start = pa.array(starts + shard["before"])
                yield pa.record_batch([docs.column("doc_id"), start, docs.column("n_tokens"), pa.array(crcs), pa.array([shard["name"]] * len(starts))], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, length: int = LENGTH, rows: int = ROWS, by_words: bool = True) -> DataFrame:
    """Writes the shards and returns one row for each: part, name, n_docs, n_tokens and before, the ids of all shards before it."""
    path = path or tokenizer_path()
    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows_in.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = staged(ordered.mapInArrow(lambda b: _write(b, folder, path, end_id, length, rows, by_words), "part int, name string, n_docs long, n_tokens long"), "token-shards")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(shards: DataFrame, folder: str) -> DataFrame:
    """A row a document, from the files: doc_id, start among all ids, n_tokens, ids_crc32 and the shard it is in."""
    spread = shards.repartition(max(shards.count(), 1), "name")  # a stated number: rows are small, adaptive execution would read all files in one task
    return spread.mapInArrow(lambda b: _read(b, folder), "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), folder), folder).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op6_token_files": op6_token_files}
ORACLES: dict[str, str] = {}
