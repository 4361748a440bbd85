"""Readers of the event table bound its `date` partitions along with the time."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tidewatch.functions.times import within
from tidewatch.operators.filters import search_events
from tidewatch.plans.lifecycle import notify_owner
from tidewatch.sources.lines import write_events


def _events(spark, path):
    raw = spark.range(400).select(
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 3_600_000_000).alias("timestamp_utc"), F.lit("srv").alias("server"),
        F.lit("SSH").alias("service"), F.lit("SSH_SECURE").alias("source"), F.lit("m").alias("message"), F.lit("f").alias("file"), F.col("id").alias("line_no"),
    )
    write_events(raw, path)
    return spark.read.parquet(path)


def test_search_reads_the_days_it_needs(spark, tmp_path):
    events = _events(spark, str(tmp_path / "events"))
    start, end = datetime(2024, 1, 3, 12, tzinfo=timezone.utc), datetime(2024, 1, 5, tzinfo=timezone.utc)
    for found in (search_events(events, start=start, end=end), events.filter(within(events, "timestamp_utc", start, end))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        bounds = plan[plan.index("PartitionFilters"):].split("]")[0]
        assert "date" in bounds and ">=" in bounds and "<=" in bounds
        assert found.count() == 37
    assert search_events(events, start=end).count() == 400 - 96


def test_owner_named_by_the_alert_comes_first(spark):
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000))
    alerts = spark.createDataFrame([(1, 7, None), (2, None, 20), (3, None, None)], "id long, user long, up long").select(
        "id", F.lit("s").alias("server"), at.alias("triggered_at"), F.struct(F.col("user").alias("user_id")).alias("metrics"), F.struct(F.col("up").alias("log_upload_id")).alias("evidence"))
    events = spark.range(1).select("id", F.lit("s").alias("server"), at.alias("timestamp_utc"), F.lit(10).cast("long").alias("log_upload_id"))
    uploads = spark.createDataFrame([(10, 100, None), (20, None, 5)], "id long, user_id long, api_key_id long")
    keys = spark.createDataFrame([(5, 200)], "id long, created_by_user_id long")
    assert {r.alert_id: r.user_id for r in notify_owner(alerts, events, uploads, keys).collect()} == {1: 7, 2: 200, 3: 100}
