"""Importance resampling, vector near-duplicates and fill-in-middle: against SQL, plain versions, and odd input."""

import hashlib
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import embedding_dedup, fill_middle, importance

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("module", [importance, embedding_dedup, fill_middle])
def test_oracle(spark, module):
    (name, query), = module.QUERIES.items()
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want, got = con.execute(module.ORACLES[name]).df(), query(spark, DATA).toPandas()
    rows = lambda df: sorted(tuple(None if pd.isna(x) else x for x in r) for r in df[sorted(want.columns)].astype(object).itertuples(index=False))
    assert sorted(map(str, rows(got.convert_dtypes()))) == sorted(map(str, rows(want.convert_dtypes())))


def test_checksums_of_long_and_odd_words():
    texts = ["", None, "A b", "x" * 300 + " " + "y" * 700, "été a-b_c 12 z", "solo", "Q " * 40 + "w" * 256 + " " + "v" * 257]
    word, pair, first, before = importance.feature_checksums(pa.array(texts))
    for k, text in enumerate(texts):
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        a, b = before[k], before[k + 1]
        assert word[a:b].tolist() == [zlib.crc32(w.encode()) for w in own]
        assert pair[(first >= a) & (first < b)].tolist() == [zlib.crc32(f"{x} {y}".encode()) for x, y in zip(own, own[1:])]


def test_cutoff_among_ties(spark):
    """Few scores, repeated ids: the first k in order of score, id and row, whatever k is, and ranks without a gap over many ranges."""
    rng = np.random.default_rng(3)
    keys = [(int(a), int(b), i) for i, (a, b) in enumerate(zip(rng.integers(-4, 4, 300), rng.integers(-(2**62), 2**62, 300) // 2**60))]
    rows = spark.createDataFrame(keys, "a long, b long, c long").repartition(3)
    for k in (0, 1, 7, 150, 299, 300):
        got = rows.filter(importance.within_first(rows, ["a", "b", "c"], k)).collect() if k else []
        assert sorted(map(tuple, got)) == sorted(keys)[:k]
    ranked = importance.with_ranks(rows, ["a", "b", "c"], 300, 40).collect()
    assert [tuple(r)[:3] for r in sorted(ranked, key=lambda r: r["rank"])] == sorted(keys) and sorted(r["rank"] for r in ranked) == list(range(1, 301))


def test_importance_of_odd_documents(spark, odd_documents, no_documents):
    target = spark.createDataFrame([("the people of the town and the river",), (None,), ("",)], "text string")
    rows = importance.resample(odd_documents, target, percent=50).toPandas()
    assert len(rows) == 13 and rows.columns.tolist() == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    none = rows[rows.n_words == 0]
    assert set(none.doc_id.dropna()) == {3, 4, 5} and (none.weight == 0).all() and none["rank"].isna().all()
    drawn = rows[rows["rank"].notna()].sort_values("rank")
    assert len(drawn) == (rows.n_words >= 20).sum() // 2 and drawn["rank"].tolist() == list(range(1, len(drawn) + 1)) and drawn.score.is_monotonic_decreasing
    assert rows[(rows.n_words >= 20) & rows["rank"].isna()].score.max() <= drawn.score.min()
    assert importance.resample(no_documents, target).count() == 0
    assert importance.resample(odd_documents, target.limit(0)).count() == 13
    assert importance.resample(odd_documents, target, percent=0).filter("rank IS NOT NULL").count() == 0
    assert importance.resample(odd_documents, target, percent=100).filter("rank IS NULL AND n_words >= 20").count() == 0


def plain_dedup(ids, vectors, threshold=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors]
    n, link = len(ids), {}
    unit = [embedding_dedup.unit(np.array([v], float))[0] if good else None for v, good in zip(vectors, ok)]
    for i in range(n):
        link[i] = [j for j in range(n) if i != j and ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]) and float(unit[i] @ unit[j]) >= threshold]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in link[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        least = min((ids[j] for j in seen if ids[j] is not None), default=None)
        out.append((ids[i], len(link[i]), least, ids[i] == least))
    return sorted(out, key=str)


def dedup(spark, ids, vectors, kind="float", **more):
    rows = spark.createDataFrame(list(zip(ids, vectors, range(len(ids)))), f"vec_id long, embedding array<{kind}>, node long").repartition(3)
    return sorted(map(tuple, embedding_dedup.near_duplicates(rows, **more).collect()), key=str)


@pytest.mark.parametrize("kind, scale", [("float", 1.0), ("double", 1e200), ("double", 1e-200)])
def test_links_over_cells_and_blocks(spark, kind, scale):
    """Clusters, chains of near copies, a hot group of copies and noise, in many small cells and blocks, against all pairs."""
    rng = np.random.default_rng(5)
    points = [rng.standard_normal((120, 16)), np.repeat(rng.standard_normal((1, 16)), 60, 0), np.repeat(rng.standard_normal((1, 16)), 70, 0) + 0.02 * rng.standard_normal((70, 16))]
    centre = rng.standard_normal((4, 16))
    points += [centre[rng.integers(0, 4, 120)] + 0.22 * rng.standard_normal((120, 16))]
    angles = np.arange(30) * 0.3
    points += [np.stack([np.cos(angles), np.sin(angles), *np.zeros((14, 30))], 1)]
    vectors = (np.concatenate(points).astype(np.float32).astype(float) * scale).tolist()
    ids = rng.permutation(len(vectors)).tolist()
    want = plain_dedup(ids, vectors)
    assert sum(n for _, n, _, _ in want) > 8000
    assert dedup(spark, ids, vectors, kind) == want
    assert dedup(spark, ids, vectors, kind, cell_vectors=25, block_vectors=20) == want


def test_bounds_hold_and_wide_vectors_are_exact(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((6, 2500))
    vectors = np.concatenate([base + s * rng.standard_normal(base.shape) for s in (0, 0.2, 0.22, 0.23, 0.235, 0.3)])
    units = embedding_dedup.unit(vectors)
    codes, scale, error = embedding_dedup.quantised(units)
    product = embedding_dedup._products(codes.astype(np.float32), codes.astype(np.float32))
    assert (product == codes.astype(int) @ codes.astype(int).T).all()
    off = (1 + error)[:, None] * (1 + error)[None, :] - 1
    assert (np.abs(units @ units.T - scale[:, None] * scale[None, :] * product) <= off).all()
    ids = list(range(len(vectors)))
    assert dedup(spark, ids, vectors.tolist(), "double", cell_vectors=10, block_vectors=4) == plain_dedup(ids, vectors.tolist())


def test_vectors_without_links(spark):
    ids = [1, 2, 3, 4, 5, 6, 6, None, None, 7, 8, 9]
    vectors = [None, [], [0.0, 0.0], [1.0, None], [1.0, float("nan")], [1.0, 2.0], [1.0, 2.0], [1.0, 2.0], [-5.0, 1.0], [float("inf"), 1.0], [1.0, 2.0, 0.0], [2.0, 4.0]]
    assert dedup(spark, ids, vectors) == plain_dedup(ids, vectors)
    assert dedup(spark, [], []) == []


def test_wavelet_ranks():
    values = np.random.default_rng(9).integers(0, 8, 1000).astype(np.uint8)
    matrix = fill_middle.WaveletMatrix(values, 3)
    places = np.array([0, 1, 63, 64, 65, 500, 999, 1000])
    for v in range(8):
        assert matrix.rank(v, places).tolist() == [int((values[:p] == v).sum()) for p in places]
    assert fill_middle.WaveletMatrix(np.zeros(0, np.uint8)).rank(1, np.array([0])).tolist() == [0]


def test_every_cut_is_a_token_border():
    texts = ["", "abc", "a1b2", "été \U0001f600x", None, "ab\n cd--ef ", "zz"]
    found = fill_middle.TokenBorders(pa.array(texts))
    for i, text in enumerate(texts):
        tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "")
        assert found.tokens[i] == len(tokens)
        for k in range(len(tokens) + 1):
            wanted = np.zeros(len(texts), np.int64)
            wanted[i] = k
            assert found.cuts(wanted)[i] - found.offsets[i] == len("".join(tokens[:k]).encode())


def test_fill_in_middle_of_odd_documents(spark, odd_documents, no_documents):
    more = odd_documents.selectExpr("*").union(odd_documents.limit(3).withColumn("text", F.concat(F.lit("has <S> in it <"), "text")))
    found = fill_middle.fill_in_middle(more, form_percent=100, spm_percent=50)
    rows = found.withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).toPandas()
    texts = {(None if pd.isna(r.doc_id) else r.doc_id, r.text or "") for r in more.select("doc_id", "text").collect()}
    assert len(rows) == 16 and {(None if pd.isna(i) else i, t) for i, t in zip(rows.doc_id, rows.again)} == texts
    assert {"plain", "psm", "spm"} == set(rows.form)
    for r in rows.itertuples():
        if not r.again or "<S>" in r.again:
            assert r.form == "plain" and pd.isna(r.prefix_chars)
            continue
        h = hashlib.sha256(f"1:{'' if pd.isna(r.doc_id) else int(r.doc_id)}".encode()).hexdigest()
        tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", r.again)
        a, b = sorted(int(h[8 * k : 8 * k + 8], 16) % (len(tokens) + 1) for k in range(2))
        p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
        assert r.output == (f"<P>{p}<S>{s}<M>{m}" if r.form == "psm" else f"<S>{s}<P>{p}<M>{m}") and (r.prefix_chars, r.middle_chars) == (len(p), len(m))
    assert fill_middle.fill_in_middle(no_documents).count() == 0
