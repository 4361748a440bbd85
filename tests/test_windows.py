import random

from pyspark.sql import functions as F

from tests.models import cooldown_model, window_model
from tidewatch.operators.cooldown import apply_cooldown
from tidewatch.operators.prefix import carry_forward, numbered, running_sums
from tidewatch.operators.windows import sliding_metrics


def _rows(n, span, keys, seed):
    rnd = random.Random(seed)
    return [
        dict(key=rnd.choice(keys), t=rnd.randrange(span), seq=i,
             path=rnd.choice([None, "", "/a", "/b", "/c"]), ip=rnd.choice([None, "x", "y", "z"]),
             action=rnd.choice(["fail", "success", None]))
        for i in range(n)
    ]


def test_sliding_metrics_equal_deque_model(spark):
    schema = "key string, t long, seq long, path string, ip string, action string"
    for seed, span, w, width in [(1, 3000, 100, 400), (2, 300, 50, 37), (3, 90, 30, 1000)]:
        rows = _rows(500, span, ["a", "a", "a", "b", None], seed)
        df = spark.createDataFrame(rows, schema).fillna({"key": "-"})
        got = sliding_metrics(
            df, ["key"], t="t", seq="seq", window_us=w,
            dims={"path": F.col("path"), "ip": F.col("ip")},
            sums={"fails": (F.col("action") == "fail").cast("int")},
            top_value=F.col("ip"), keep=["action"], slice_width=width,
        ).collect()
        want = window_model([{**r, "key": r["key"] or "-"} for r in rows], w)
        assert len(got) == len(rows)
        by_seq = {r["seq"]: r["action"] for r in rows}
        for g in got:
            assert (g["count"], g["fails"], g["unique_path"], g["unique_ip"], g["top_hits"]) == want[g["seq"]]
            assert g["action"] == by_seq[g["seq"]]


def test_keys_taken_whole_equal_keys_split_by_time(spark):
    schema = "key string, t long, seq long, path string, ip string, action string"
    rows = _rows(600, 700, ["a", "a", "a", "b", "c"], 7)
    df = spark.createDataFrame(rows, schema)
    want = window_model(rows, 60)
    for most in (1, 200, 10_000):
        got = sliding_metrics(
            df, ["key"], t="t", seq="seq", window_us=60, dims={"path": F.col("path"), "ip": F.col("ip")},
            sums={"fails": (F.col("action") == "fail").cast("int")}, numbered=True, keep=["action"], slice_width=90, split_rows=most,
        ).collect()
        assert len(got) == len(rows)
        assert all((g["count"], g["fails"], g["unique_path"], g["unique_ip"]) == want[g["seq"]][:4] for g in got)
        for key in "abc":
            assert sorted(g["n_seen"] for g in got if g["key"] == key) == list(range(1, 1 + sum(r["key"] == key for r in rows)))


def test_presence_of_few_rows_is_not_moved_apart(spark):
    df = spark.createDataFrame([("k", 0, 1, "x"), ("k", 10, 2, None), ("k", 21, 3, "x")], "key string, t long, seq long, v string")
    out = sliding_metrics(df, ["key"], t="t", seq="seq", window_us=10, dims={"v": F.col("v")})
    assert [r["unique_v"] for r in out.orderBy("seq").collect()] == [1, 1, 1]
    moves = out._jdf.queryExecution().optimizedPlan().toString().split("Union")[-1]
    assert "RepartitionByExpression" in moves and "presence" not in moves


def test_ties_count_one_by_one_and_window_edge_is_inside(spark):
    df = spark.createDataFrame([("k", 0, 1), ("k", 10, 2), ("k", 10, 3), ("k", 21, 4)], "key string, t long, seq long")
    got = sliding_metrics(df, ["key"], t="t", seq="seq", window_us=10, numbered=True).orderBy("seq").collect()
    assert [r["count"] for r in got] == [1, 2, 3, 1]
    assert [r["n_seen"] for r in got] == [1, 2, 3, 4]


def test_cooldown_equals_greedy_model(spark):
    for seed, span, c in [(1, 2000, 50), (2, 2000, 7), (3, 500, 100), (4, 4000, 90), (5, 300, 1), (6, 3000, 5000)]:
        rnd = random.Random(seed)
        rows = [(rnd.choice("aaab"), rnd.randrange(span), i) for i in range(700)]
        df = spark.createDataFrame(rows, "key string, t long, seq long").withColumn("cd", F.lit(c).cast("bigint"))
        got = sorted((r["key"], r["t"], r["seq"]) for r in apply_cooldown(df, ["key"], "t", "seq", "cd").collect())
        assert got == cooldown_model(rows, c)


def test_cooldown_of_keys_that_cross_ranges(spark):
    """Ranges are kept apart, so the frequent keys cross borders; one cooldown is longer than the data."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for seed, c in [(1, 30), (2, 700), (3, 10_000_000)]:
            rnd = random.Random(seed)
            rows = [(rnd.choice("aaaaaabc"), rnd.randrange(20_000), i) for i in range(6000)]
            df = spark.createDataFrame(rows, "key string, t long, seq long").withColumn("cd", F.lit(c).cast("bigint"))
            got = sorted((r["key"], r["t"], r["seq"]) for r in apply_cooldown(df, ["key"], "t", "seq", "cd").collect())
            assert got == cooldown_model(rows, c)
        many = spark.range(1_000_000).select(F.lit("k").alias("key"), F.col("id").alias("t"), F.col("id").alias("seq"))
        for c, n in [(2_000_000, 1), (10, 100_000)]:
            assert apply_cooldown(many.withColumn("cd", F.lit(c).cast("bigint")), ["key"], "t", "seq", "cd").count() == n
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_cooldown_edge_and_zero(spark):
    df = spark.createDataFrame([("k", 0, 1), ("k", 9, 2), ("k", 10, 3), ("z", 5, 4), ("z", 5, 5)], "key string, t long, seq long")
    df = df.withColumn("cd", F.when(F.col("key") == "k", 10).otherwise(0).cast("bigint"))
    assert sorted(r["seq"] for r in apply_cooldown(df, ["key"], "t", "seq", "cd").collect()) == [1, 3, 4, 5]


def test_prefix_helpers(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice("ab"), i, rnd.choice([None, f"v{i}"])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, n long, v string").withColumn("blk", F.floor(F.col("n") / 13))
    last, want = {}, {}
    for k, n, v in rows:
        before = last.get(k)
        last[k] = v if v is not None else before
        want[n] = (last[k], before)
    got = carry_forward(df, ["k"], ["n"], {"v": "now"}, "blk")
    assert {r["n"]: r["now"] for r in got.collect()} == {n: w[0] for n, w in want.items()}
    got = carry_forward(df, ["k"], ["n"], {"v": "prev"}, "blk", include_current=False)
    assert {r["n"]: r["prev"] for r in got.collect()} == {n: w[1] for n, w in want.items()}
    pos = {r["n"]: r["pos"] for r in numbered(df, ["k"], ["n"], "blk", "pos").collect()}
    seen = {"a": 0, "b": 0}
    for k, n, _ in rows:
        seen[k] += 1
        assert pos[n] == seen[k]
    d = df.select("k", F.col("n").alias("t"), F.lit(1).alias("phase"), F.col("n").alias("seq"), F.lit(2).cast("bigint").alias("x"))
    got = {r["t"]: r["x"] for r in running_sums(d, ["k"], ["x"], 17).collect()}
    assert all(got[n] == 2 * pos[n] for n in pos)
