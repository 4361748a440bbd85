"""Counts of streamed batches equal those of the batch job over the same files."""

from datetime import datetime

from pyspark.sql import functions as F

from tidewatch.parsers.host import parse_ssh
from tidewatch.sources.lines import ingest_stats, read_log_lines, stream_log_lines
from tidewatch.streaming.ingest import observed_events, recent_stats

NOW = datetime(2024, 2, 1)
GOOD = "Jan  5 10:00:00 h1 sshd[9]: Failed password for bob from 44.1.2.3 port 2222 ssh2"
OTHER = "Jan  5 10:00:01 h1 sshd[9]: Accepted password for amy from 44.1.2.4 port 2222 ssh2"
NO_TIME = GOOD.replace("Jan", "Xxx")


def test_counts_of_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    files = {"a.log": [GOOD, "noise", NO_TIME, OTHER], "b.log": [OTHER, GOOD, GOOD], "c.log": ["noise"]}
    failed = F.col("extra.action") == "fail"
    parse = lambda lines: parse_ssh(lines, NOW)
    stream = observed_events(stream_log_lines(spark, str(folder), "s1", "secure"), parse, failed)
    query = (stream.select("file", "line_no").writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "state")).start())
    try:
        for name, lines in files.items():
            (folder / name).write_text("\n".join(lines) + "\n")
            query.processAllAvailable()
        got = recent_stats(query)
    finally:
        query.stop()
    raw = read_log_lines(spark, str(folder), "s1", "secure")
    want = {r["file"].rsplit("/", 1)[1]: r.asDict() for r in ingest_stats(raw, parse(raw), failed).collect()}
    assert len(got) == 3 and [g["batch"] for g in got] == [0, 1, 2]
    for counts, name in zip(got, files):
        assert {k: v for k, v in counts.items() if k != "batch"} == {k: v for k, v in want[name].items() if k != "file"}
    assert want["a.log"]["lines_failed"] == 1 and want["c.log"]["lines_skipped"] == 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == sum(g["events_created"] for g in got) == 6
