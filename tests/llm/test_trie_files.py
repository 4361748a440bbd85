"""Shards of the trie lie together in files: as many shards as the texts need, a bounded number of files to ask."""

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import elias_fano, trie_lm

WORDS = [a + b + c for a in "abcdefgh" for b in "klmnop" for c in "stuvwx"]


def _texts(n, seed=5):
    random_ = np.random.default_rng(seed)
    return [" ".join(random_.choice(WORDS[: 20 + i % 200], 40)) for i in range(n)]


def test_many_shards_are_asked_by_few_files(spark, tmp_path, monkeypatch):
    texts = _texts(300)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    one = trie_lm.train(docs, str(tmp_path / "one"))
    many = trie_lm.train(docs, str(tmp_path / "many"), shard_words=40)  # some 200 shards, of which some have no words
    opened = []
    monkeypatch.setattr(trie_lm, "map_arrays", lambda folder, name, f=trie_lm.map_arrays: opened.append(name) or f(folder, name))
    asked = pa.array([*texts[:50], "unknown words only", None, *_texts(20, 6)])
    want = one.score(asked)
    opened.clear()
    got = many.score(asked)
    assert len(opened) == len(set(opened)) <= 2 * 64
    assert (got["n_known"] == want["n_known"]).all() and got["n_known"].sum() > 2000
    assert got["base_score"] == pytest.approx(want["base_score"])
    assert (np.abs(got["score"] - want["score"]) < 0.02 * want["n_tokens"]).all()  # steps of the logarithm are a shard's own


@pytest.mark.parametrize("n", [1, 2, 20, 127])
def test_few_numbers_far_apart(n):
    values = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1))
    coded = elias_fano.EliasFano(*elias_fano.EliasFano.encode(values))
    place, same = coded.successor(values)
    assert same.all() and (place == np.arange(len(values))).all() and (coded.access(place) == values).all()


def test_pieces_of_a_file(tmp_path):
    random_ = np.random.default_rng(2)
    pieces = [np.unique(random_.integers(0, top, n, np.uint64)) for n, top in ((0, 1), (50, 1 << 63), (3000, 5000), (0, 1), (7, 7), (900, 1 << 40), (1, 1))]
    file = elias_fano.Growing()
    for x in pieces:
        file.sequence("numbers", x)
    file.write(str(tmp_path), "file", {})
    coded = elias_fano.get(*elias_fano.map_arrays(str(tmp_path), "file"), "numbers")
    starts = np.cumsum([0, *map(len, pieces)])
    assert (coded.access(np.arange(coded.n)) == np.concatenate(pieces)).all()
    for i in random_.permutation(len(pieces)):
        asked = np.concatenate([pieces[i], pieces[i] + np.uint64(1), random_.integers(0, 1 << 62, 50, np.uint64)])
        place, same = coded.successor(asked, np.full(len(asked), i))
        assert (place == starts[i] + np.searchsorted(pieces[i], asked)).all() and (same == np.isin(asked, pieces[i])).all()
