"""Groups of a rule share keys of the state store: few calls for many groups, and the same alerts in one bucket as in many."""

from pyspark.sql import functions as F

from tests.test_streams import FREE, RULE, events, feed, whole
from tidewatch.operators.rules import TrustConfig
from tidewatch.plans.alerts import build_alerts
from tidewatch.streaming import alerts as stream_alerts
from tidewatch.streaming import jobs


def test_groups_of_one_bucket_do_not_meet(spark, tmp_path):
    rows = [(i, 7 * i % 600) for i in range(120)]
    want = whole(build_alerts(events(spark, rows), [RULE, FREE]))
    for buckets in (1, 3):
        src, folder = str(tmp_path / f"in{buckets}"), str(tmp_path / f"job{buckets}")

        def start(stream, buckets=buckets, folder=folder):
            return jobs._log(stream_alerts.alert_changes(stream, [RULE, FREE], TrustConfig(), 2000, buckets=buckets), folder)

        feed(spark, events(spark, rows[:60]), src, start)
        feed(spark, events(spark, rows[60:]), src, start)
        got = stream_alerts.current_alerts(stream_alerts.read_changes(spark, folder))
        assert whole(got.select(build_alerts(events(spark, rows), [RULE, FREE]).columns)) == want


def test_keys_of_the_store_are_bounded_however_many_groups(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("group_key")).select(stream_alerts.bucket(stream_alerts.BUCKETS))
    assert keys.distinct().count() <= stream_alerts.BUCKETS
