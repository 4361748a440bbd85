"""Files read by content: packed files without a suffix, pieces that cut lines and line ends, large streamed files."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.sources.content import read_lines_by_content, stream_lines_by_content
from tidewatch.sources.lines import read_log_lines


def expected(data: bytes) -> list[str]:
    text = data.removeprefix(b"\xef\xbb\xbf").replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    lines = text.split(b"\n")
    return [x.decode("utf-8", "replace") for x in (lines[:-1] if lines[-1] == b"" else lines)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rnd, path = random.Random(5), tmp_path_factory.mktemp("by content")
    contents = {
        "empty": b"", "one": b"x", "end": b"\n", "returns": b"a\rb\r\n\r\nc\n\rd\r", "mark": b"\xef\xbb\xbfa\nb", "bad": b"a\xff\xc3\nb\xe2\x82",
        "long": b"y" * 3_000_000 + b"\nz", "name with space": "é\n😀\r\nx".encode(),
    }
    for i in range(12):
        contents[f"mixed{i}"] = b"".join(rnd.choice([b"\n", b"\r", b"\r\n", b"a", "é".encode(), b"bcd" * 4]) for _ in range(rnd.randrange(1, 400)))
    for name, data in contents.items():
        (path / name).write_bytes(data)
        (path / f"{name}-packed").write_bytes(gzip.compress(data[: len(data) // 2]) + gzip.compress(data[len(data) // 2:]))
        contents = contents | {f"{name}-packed": data}
    return path, contents


def by_file(rows) -> dict[str, list[str]]:
    got: dict[str, list[tuple[int, str]]] = {}
    for r in rows:
        got.setdefault(r["file"].rsplit("/", 1)[1].replace("%20", " "), []).append((r["line_no"], r["raw"]))
    assert all([n for n, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())
    return {k: [raw for _, raw in sorted(v)] for k, v in got.items()}


@pytest.mark.parametrize("piece", [1, 61, 1 << 20])
def test_batch_reads_every_line_once(spark, folder, piece):
    path, contents = folder
    most = {1: 30, 61: 5_000}.get(piece, 1 << 30)  # a piece is a task
    files = [n for n in contents if len(contents[n]) <= most]
    got = by_file(read_lines_by_content(spark, [str(path / n) for n in files], "s", "t", piece_bytes=piece).collect())
    assert got == {n: expected(contents[n]) for n in files if expected(contents[n])}


def test_agrees_with_the_reader_by_name(spark, folder):
    path, contents = folder
    files = [str(path / n) for n in contents if not n.endswith("-packed")]
    rows = lambda df: sorted(map(tuple, df.select("raw", "line_no", "server", "log_type").collect()))
    assert rows(read_lines_by_content(spark, files, "s", "t", piece_bytes=64 << 10)) == rows(read_log_lines(spark, files, "s", "t"))


def streamed(spark, source, out, **options):
    stream = stream_lines_by_content(spark, str(source), F.lit("s"), "t", **options)
    query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def test_stream_numbers_pieces(spark, folder, tmp_path):
    path, contents = folder
    source = tmp_path / "in"
    source.mkdir()
    names = [n for n in contents if not n.startswith("long")]
    for n in names[:5]:
        (source / n).write_bytes((path / n).read_bytes())
    streamed(spark, source, tmp_path, piece_bytes=7)
    for n in names[5:]:
        (source / n).write_bytes((path / n).read_bytes())
    got = by_file(streamed(spark, source, tmp_path, piece_bytes=7).collect())
    assert got == {n: expected(contents[n]) for n in names if expected(contents[n])}


def test_a_large_streamed_file_is_many_tasks(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines, block = 1 << 20, 1 << 15
    with open(source / "access", "wb") as out:
        for start in range(0, lines, block):
            out.write(b"".join(b"%d %s\n" % (i, b"x" * 1024) for i in range(start, start + block)))
    assert (source / "access").stat().st_size > 1 << 30
    stream = stream_lines_by_content(spark, str(source), "s", "t")
    slim = stream.select("line_no", F.substring_index("raw", " ", 1).cast("bigint").alias("i"), F.length("raw").alias("n"), F.spark_partition_id().alias("task"))
    query = slim.writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/rows")
    wrong = F.count_if((F.col("line_no") != F.col("i") + 1) | (F.col("n") != F.length(F.col("i").cast("string")) + 1025))
    got = rows.agg(F.count("*").alias("n"), F.countDistinct("i").alias("distinct"), wrong.alias("wrong"), F.countDistinct("task").alias("tasks")).first()
    assert (got["n"], got["distinct"], got["wrong"]) == (lines, lines, 0) and got["tasks"] >= 6
