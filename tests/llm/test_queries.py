"""Each query against a brute-force version on the smallest given tables, or held-out accuracy."""

import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidewatch.llm import hnsw, jaccard, language, line_rules, mixing, packing, quality, token_files, trie_lm, url_templates
from tidewatch.llm.tokens import tokenizer_path

DATA = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{DATA}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("module, query", [(url_templates, "op1_url_templates"), (mixing, "op10_mixing")])
def test_oracle(spark, module, query):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want, got = con.execute(module.ORACLES[query]).df(), module.QUERIES[query](spark, DATA).toPandas()
    rows = lambda df: sorted(map(str, df[sorted(want.columns)].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_language_of_held_out_documents(spark, docs):
    got = language.op2_language(spark, DATA).toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() >= 0.95


def test_similar_pairs(spark, docs):
    sets = {}
    for i, t in zip(docs.doc_id, docs.text):
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root, links = {i: i for i in sets}, Counter(x for p in pairs for x in p)
    for _ in sets:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = jaccard.op3_jaccard(spark, DATA).toPandas()
    assert len(pairs) > 0 and set(got.itertuples(index=False, name=None)) == {(i, root[i], links[i]) for i in sets}


def test_trie_scores(spark, docs):
    tokens = {i: words(re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [""] for i, t in zip(docs.doc_id, docs.text)}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 10]
    one, two, three, after = Counter(), Counter(), Counter(), Counter()
    for i in train:
        x = ["", *tokens[i]]
        one.update(tokens[i])
        two.update(zip(x, x[1:]))
        three.update(zip(x, x[1:], x[2:]))
    for (a, b, _), n in three.items():
        after[a, b] += n
    total, distinct, (mu1, mu2) = sum(one.values()), len(one), trie_lm.MU
    got = trie_lm.op4_trie_lm(spark, DATA).toPandas().set_index("doc_id")
    assert (got.train_tokens == total).all() and len(got) == len(tokens)
    for i, own in tokens.items():
        x, base, score = ["", *own], 0.0, 0.0
        for j in range(1, len(x)):
            p = (one[x[j]] + 0.1) / (total + 0.1 * (distinct + 1))
            base += math.log10(p)
            p = (two[x[j - 1], x[j]] + mu1 * p) / (one[x[j - 1]] + mu1)
            if j > 1:
                p = (three[x[j - 2], x[j - 1], x[j]] + mu2 * p) / (after[x[j - 2], x[j - 1]] + mu2)
            score += math.log10(p)
        row = got.loc[i]
        assert (row.n_tokens, row.n_known) == (len(own), sum(one[w] > 0 for w in own))
        assert row.base_score == pytest.approx(base) and abs(row.score - score) < 0.02 * len(own)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_line_rules(spark, docs):
    got = line_rules.op5_line_rules(spark, DATA).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text):
        w = words(t)
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {j + k for j in range(len(w) - 2) if seen[w[j], w[j + 1], w[j + 2]] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        row = got.loc[i]
        assert row.n_words == len(w) and row.word_chars == sum(map(len, w)) and row.n_symbols == len(re.findall(r"[#*$%&|<>]", t))
        assert row.n_dup_lines == len(lines) - len(set(lines)) and row.n_repeat_words == len(covered)
        assert row.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (row.base_failed and row.kept)
    labels = pd.read_parquet(f"{DATA}/labels.parquet").set_index("doc_id")
    both = got.join(labels, how="inner")
    clean = both[(both.quality == 1) & ~both.base_failed]
    assert clean.kept.mean() > 0.98 and both[both.quality == 0].kept.mean() < 0.2


def encoded(docs, end):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer_path())
    return [e.ids + [end] for e in tool.encode_batch(docs.text.tolist(), add_special_tokens=False)]


def test_token_files_round_trip(spark, docs):
    got = token_files.op6_token_files(spark, DATA).toPandas().sort_values("doc_id")
    ids = encoded(docs, 2)
    sizes = np.array(list(map(len, ids)))
    assert got.doc_id.tolist() == docs.doc_id.tolist() and got.n_tokens.tolist() == sizes.tolist()
    assert got.start.tolist() == (np.cumsum(sizes) - sizes).tolist() and got.ids_crc32.tolist() == list(map(crc, ids))


def test_token_shard_is_equal_rows_and_views(tmp_path):
    import pyarrow as pa

    ids = np.arange(1000, dtype=np.int32)
    writer = token_files.ShardWriter(str(tmp_path), "s", pa.uint16(), 64, 4)
    writer.add(pa.array([7, 8]), ids[:300], np.array([0, 100, 300]))
    writer.add(pa.array([9]), ids[300:], np.array([0, 700]))
    writer.close()
    shard = token_files.TokenShard(str(tmp_path), "s")
    assert shard.sequence(3).tolist() == ids[192:256].tolist() and not shard.sequence(3).flags.owndata
    assert shard.sequence(15).tolist() == [*range(960, 1000), *[0] * 24] and shard.mask(15).to_pylist() == [True] * 40 + [False] * 24
    assert np.concatenate(list(shard.parts(250, 600))).tolist() == list(range(250, 850))


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="needs the test tables")
def test_quality_tells_clean_text_from_junk(spark):
    got = quality.op7_quality(spark, LARGER).toPandas()
    both = got.merge(pd.read_parquet(f"{LARGER}/labels.parquet"), on="doc_id")
    assert len(got) == 1000 and both[both.quality == 1].kept.mean() > 0.97 and both[both.quality == 0].kept.mean() < 0.3


def test_kneser_ney_equals_plain_counts(spark):
    """Probabilities of a small text against the formula worked out by hand-written loops."""
    text = "abracadabra abrakadabra cabra"
    k = 9
    code = {c: i + 1 for i, c in enumerate(sorted(set("\n" + text)))}
    padded = [code["\n"]] * 3 + [code[c] for c in text]
    grams = Counter(tuple(padded[i : i + 4]) for i in range(len(padded) - 3))
    levels = [grams]
    for _ in range(3):
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    number = lambda g: sum(x * k ** (len(g) - 1 - i) for i, x in enumerate(g))
    rows = spark.createDataFrame([(number(g), n) for g, n in grams.items()], "gram long, n long")
    below = {(): 1 / k}
    for level, found in zip(levels, quality.orders(rows, k)):
        n = [sum(c == i for c in level.values()) for i in range(1, 5)]
        if n[0] and n[1]:
            y = n[0] / (n[0] + 2 * n[1])
            raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.0]
            d = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(raw)]
        else:
            d = [0.5, 0.75, 0.75]
        share = {}
        for g, c in level.items():
            same = [x for h, x in level.items() if h[:-1] == g[:-1]]
            left = sum(d[min(x, 3) - 1] for x in same) / sum(same)
            share[g] = (c - d[min(c, 3) - 1]) / sum(same) + left * (below[()] if len(g) == 1 else below[g[1:]])
        got = {r.gram: r.share for r in found.collect()}
        assert got == {number(g): pytest.approx(p) for g, p in share.items()}
        below = share


def test_packing(spark, docs):
    got = packing.op8_packing(spark, DATA).toPandas()
    want = {(i, p // 2048, p, len(e[p : p + 2048]), crc(e[p : p + 2048])) for i, e in zip(docs.doc_id, encoded(docs, 0)) for p in range(0, len(e), 2048)}
    assert set(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want and len(got) == len(want)
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == (rows.length.cumsum() - rows.length).tolist() and rows.length.sum() <= 2048
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 2048) + 1


def test_packed_sequences_hold_the_ids(spark, docs):
    few = spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id % 20 = 0")
    packed = packing.pack_documents(few, with_ids=True)
    ids = dict(zip(docs.doc_id, encoded(docs, 0)))
    total = 0
    for row in packing.sequences(packed).collect():
        own = np.frombuffer(row.ids, "<u4")
        total += len(own)
        begin = row.starts[0]
        end = row.starts[1] if len(row.starts) > 1 else len(own)
        part = own[begin:end].tolist()
        assert str(part)[1:-1] in str(ids[row.doc_ids[0]])
    assert total == sum(len(ids[i]) for i in docs.doc_id if i % 20 == 0)


def test_nearest_neighbours(spark):
    table = pd.read_parquet(f"{DATA}/embeddings.parquet")
    ids, vectors = table.vec_id.to_numpy(), np.stack(table.embedding).astype(float)
    got = hnsw.op9_hnsw(spark, DATA).toPandas()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        apart = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, apart)) if ids[i] != q][:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own.score, [apart[ids == v][0] for v in own.vec_id], rtol=1e-12)
        hits, total = hits + len({ids[i] for i in order} & set(own.vec_id)), total + 10
    assert hits / total >= 0.9


def test_schedule_is_close_to_the_targets_everywhere(spark):
    sizes = spark.createDataFrame([("a", 5000), ("b", 9000), (None, 3000)], "source string, size long")
    targets = mixing.source_targets(sizes)
    rows = mixing.ranked(mixing.schedule(targets, 10), 100).orderBy("slot").toPandas()
    share = {r.source: r.target / 17000 for r in targets.collect()}
    seen = defaultdict(int)
    for n, (source, rank) in enumerate(zip(rows.source, rows["rank"]), 1):
        source = source if isinstance(source, str) else None
        assert rank == seen[source]
        seen[source] += 1
        assert all(abs(seen[s] - n * share[s]) < 4 for s in share)
