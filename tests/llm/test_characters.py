"""The quality model knows every character, however many there are."""

import random

import numpy as np

from tidewatch.llm import quality


def test_signs_beyond_the_most_frequent_are_told_apart(spark):
    draw = random.Random(5)
    latin = [a + b for a in "bcdfghjklmnprstvwz" for b in "aeiouáéíóúàèìòùâêîôûäëïöü"]
    signs = [chr(0x4E00 + i) for i in draw.sample(range(20000), 300)] + [chr(0x20000 + i) for i in range(100)]
    words = ["".join(draw.choice(signs) for _ in range(3)) for _ in range(150)]
    prose = lambda pool, n: "".join(draw.choice(pool) for _ in range(n))
    rows = [(i, prose(latin, 2000), "xa") for i in range(60)] + [(100 + i, prose(words, 60), "ya") for i in range(200)]
    junk = [(1000 + i, prose(signs, 180), "ya") for i in range(20)]
    docs = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i, *_ in rows], "doc_id long")
    got = quality.judge(docs, trusted).toPandas().set_index("doc_id")
    assert got.loc[[i for i, *_ in rows], "kept"].mean() > 0.97
    assert not got.loc[[i for i, *_ in junk], "kept"].any()


def test_scores_equal_the_joined_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "SHARD_GRAMS", 40)
    texts = ["the old mill by the sea", "\U00020000水 the water", "abracadabra cabra"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    model = quality.train(df, df, str(tmp_path))
    assert all(len(f) > 1 for order, f in model.firsts.items() if order > 2)
    counts = [np.unique(quality._codes(texts, model.alphabet)[0], return_counts=True)]
    rows = spark.createDataFrame([(int(g), int(n)) for g, n in zip(*counts[0])], "gram long, n long")
    for order, level in enumerate(quality.orders(rows, model.alphabet.size), 1):
        level = level.toPandas()
        assert np.allclose(model.shares(level.gram.to_numpy(), order), level.share)
    # all symbols after a context, seen or not, add up to one
    k = model.alphabet.size
    for context in (int(counts[0][0][0]) // k, 7 * k * k + 8 * k + 9):
        assert abs(model.shares(context * k + np.arange(k)).sum() - 1) < 1e-9


def test_rare_characters_are_two_symbols():
    few = quality.Alphabet(np.array([0x0A, ord("a"), ord("b"), ord("c"), ord("d"), ord("e"), ord("f")]), direct=3, second=2)
    texts = ["abc", "", "fed"]
    s, begins = few.codes(*quality.symbols(texts))
    assert few.size == 1 + 3 + 2 + 2 and begins.tolist() == [0, 7, 10, 19]
    assert s[3:7].tolist() == [2, 3, 4, 6] and s[13:].tolist() == [5, 7, 5, 6, 4, 7]
    assert len(quality._codes(texts, few)[0]) == 4 + 6
