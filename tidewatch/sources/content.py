"""Log files read by what they hold, not by their names: gzip by its first two bytes, all else in pieces of a few megabytes.

Spark's own file listing (`binaryFile` without its content column) gives names and sizes, in batches and in streams alike, so which files a stream
has read is Spark's record. Each piece is a row and is read by the task that gets it; a gzip file cannot be split and is one piece, streamed
through. A line belongs to the piece in which it begins. Lines end with \\n, \\r\\n or \\r. No task holds more than a block and one line.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.prefix import numbered

PIECE = 32 << 20
BLOCK = 1 << 20
MOST_TASKS = 100_000  # pieces beyond it share tasks
# The bytes that begin a gzip file and a UTF-8 file with a byte order mark.
GZIP, BOM = b"\x1f\x8b", b"\xef\xbb\xbf"
LISTED = "path string, modificationTime timestamp, length bigint, content binary"
PIECES = "file string, path string, start bigint, stop bigint, size bigint, first bigint"
LINES = "value binary, file string, split bigint, at bigint"
_END = re.compile(rb"\n|\r(?!\n)")


def _open(path: str) -> pa.NativeFile:
    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    fs, name = pafs.FileSystem.from_uri(quote(path, safe=":/@"))
    return fs.open_input_file(name)


def _span(file: pa.NativeFile, start: int, stop: int) -> Iterator[bytes]:
    file.seek(start)
    while start < stop and (block := file.read(min(BLOCK, stop - start))):
        start += len(block)
        yield block


def _next_line(file: pa.NativeFile, place: int, size: int) -> int:
    """Where the first line at or behind `place` begins; `size` where none does."""
    if place == 0:
        return 0
    at, held = place, b""
    for block in _span(file, place - 1, size):
        held += block
        found = _END.search(held)
        if found and found.end() < len(held):
            return at + found.start()
        at, held = at + len(held) - 1, held[-1:]  # a \r at the end is judged with the byte behind it
    return size


def _lines(blocks: Iterator[bytes]) -> Iterator[list[bytes]]:
    """The lines of each block; the start of a line that goes on is kept until it ends."""
    parts: list[bytes] = []
    returned = False  # the last block ended with \r
    for block in blocks:
        if returned:
            block = b"\r" + block
        returned = block.endswith(b"\r")
        if returned:
            block = block[:-1]
        found = block.replace(b"\r\n", b"\n").replace(b"\r", b"\n").split(b"\n")
        parts.append(found[0])
        if len(found) > 1:
            yield [b"".join(parts), *found[1:-1]]
            parts = [found[-1]]
    last = b"".join(parts)
    if last or returned:
        yield [last]


def _without_mark(blocks: Iterator[bytes]) -> Iterator[bytes]:
    for i, block in enumerate(blocks):
        yield block.removeprefix(BOM) if i == 0 else block


def _unpacked(file: pa.NativeFile) -> Iterator[bytes]:
    file.seek(0)
    with gzip.GzipFile(fileobj=file) as plain:
        while block := plain.read(BLOCK):
            yield block


def _is_gzip(file: pa.NativeFile) -> bool:
    file.seek(0)
    return file.read(2) == GZIP


def _read_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in batch.to_pylist():
            with _open(piece["path"]) as file:
                start, stop, size, at = piece["start"], piece["stop"], piece["size"], piece["first"]
                if _is_gzip(file):
                    if start > 0:
                        continue
                    blocks = _unpacked(file)
                else:
                    start_line = _next_line(file, start, size)
                    blocks = _span(file, start_line, _next_line(file, stop, size) if stop < size else size)
                for lines in _lines(_without_mark(blocks) if start == 0 else blocks):
                    n = len(lines)
                    columns = [pa.array(lines, pa.binary()), pa.array([piece["file"]] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array(range(at, at + n), pa.int64())]
                    yield pa.record_batch(columns, names=["value", "file", "split", "at"])
                    at += n


def _count_pieces(piece_bytes: int):
    """Cut files into pieces with the number of their first line. One task passes over a file and only counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size, first, before, rows = row["size"], 1, b"\n", []
                with _open(row["path"]) as file:
                    if _is_gzip(file):
                        rows.append({**row, "start": 0, "stop": size, "first": 1})
                    else:
                        for start in range(0, size, piece_bytes):
                            stop = min(start + piece_bytes, size)
                            rows.append({**row, "start": start, "stop": stop, "first": first})
                            for block in _span(file, start, stop):
                                seen = before + block
                                first += seen.count(b"\n", 0, len(seen) - 1) + seen.count(b"\r", 0, len(seen) - 1) - seen.count(b"\r\n")
                                before = seen[-1:]
                names = ["file", "path", "start", "stop", "size", "first"]
                types = [pa.string(), pa.string()] + [pa.int64()] * 4
                yield pa.record_batch([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)

    return count


def _listed(files: DataFrame) -> DataFrame:
    return files.select(F.col("_metadata.file_path").alias("file"), "path", F.col("length").alias("size")).filter("size > 0")


def _column(value: str | Column | None) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("string")


def read_lines_by_content(
    spark: SparkSession, paths: str | list[str], server: str | Column, log_type: str | Column | None = None, *, number: bool = True,
    piece_bytes: int = PIECE,
) -> DataFrame:
    """As `read_log_lines`, for files whose names do not tell whether they are packed. `server` and `log_type` may be made from `file`.

    Empty files and folders give no rows. A damaged gzip file fails the read. The JVM's reader is faster where `.gz` names can be trusted.
    """
    files = _listed(spark.read.format("binaryFile").load(paths))
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(piece_bytes).cast("bigint")))
    pieces = files.withColumn("start", starts).select(
        "file", "path", "start", F.least(F.col("start") + piece_bytes, "size").alias("stop"), "size", F.lit(0).cast("bigint").alias("first"))
    count = files.agg(F.coalesce(F.sum(F.ceil(F.col("size") / piece_bytes)), F.lit(0))).first()[0]
    read = pieces.repartition(max(1, min(int(count), MOST_TASKS))).mapInArrow(_read_pieces, LINES)
    lines = read.select(
        F.make_valid_utf8(F.col("value").cast("string")).alias("raw"), "file", "split", F.col("at").alias("in_split"),
        _column(server).alias("server"), _column(log_type).alias("log_type"),
    )
    if not number:
        return lines
    return numbered(lines, ["file"], ["split", "in_split"], "split", "line_no").drop("split", "in_split")


def stream_lines_by_content(
    spark: SparkSession, folder: str, server: str | Column, log_type: str | Column | None = None, *, piece_bytes: int = PIECE, **options: str
) -> DataFrame:
    """New files of a folder as a stream of numbered lines; each file is read once per checkpoint, in pieces that are tasks of their own.

    A file must be whole when it appears: what is added later is not read. `options` go to Spark's file source (maxFilesPerTrigger and so on).
    """
    files = _listed(spark.readStream.format("binaryFile").schema(LISTED).options(**options).load(folder))
    pieces = files.mapInArrow(_count_pieces(piece_bytes), PIECES).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return pieces.mapInArrow(_read_pieces, LINES).select(
        F.make_valid_utf8(F.col("value").cast("string")).alias("raw"), "file", F.col("at").alias("line_no"),
        _column(server).alias("server"), _column(log_type).alias("log_type"),
    )
