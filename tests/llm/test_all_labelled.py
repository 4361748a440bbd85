"""Everything but the landmarks is learnt from every labelled text."""

import random

import numpy as np

from tidewatch.llm import language


def _model(spark, rows):
    return language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5), landmarks=4)


def test_counts_weights_and_floors_are_of_all_texts(spark):
    draw = random.Random(2)
    pools = {"xa": ["ba", "bo", "ka", "lu", "mi"], "xb": ["ba", "te", "so", "ni", "lu"]}
    rows = [(i, " ".join("".join(draw.choice(pools[lang]) for _ in range(3)) for _ in range(20)), lang) for i in range(700) for lang in ["xa" if i % 4 else "xb"]]
    model = _model(spark, rows)
    sets = [language._grams(language._symbols(t)) for _, t, _ in rows]
    for at, lang in enumerate(model.languages):
        of = [g for (g, _), (*_, own) in zip(sets, rows) if own == lang]
        assert model.texts[at] == len(of) and model.marks[at] == 4
        assert model.having[:, at].tolist() == [sum(x in s for s in map(set, of)) for x in model.grams]
        usual = sorted(model.usual(g, n, at, True) for (g, n), (*_, own) in zip((language._grams(language._symbols(t)[:64]) for _, t, _ in rows), rows) if own == lang)
        low, mid = (usual[int(np.ceil(q * len(usual))) - 1] for q in (language.FLOOR, 0.5))
        assert np.isclose(model.floors[at, 3], low - (mid - low) * language.FEW / len(usual))
    # ridge regression on all texts, by its normal equations
    marks, norm = _marks(spark, rows), np.sqrt([len(g) for g, _ in sets])
    inside = np.array([[len(np.intersect1d(g, sets[i][0])) for i in marks] for g, _ in sets]) / norm[:, None] / norm[marks]
    values, vectors = np.linalg.eigh(inside[marks])
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    features = np.column_stack([inside @ root, np.ones(len(rows))])
    target = np.array([[1.0 if lang == own else -1.0 for lang in model.languages] for *_, own in rows])
    share = np.array([1 / sum(o == own for *_, o in rows) for *_, own in rows])
    penalty = np.diag([language.RIDGE] * (features.shape[1] - 1) + [0])
    want = features @ np.linalg.solve(features.T @ (features * share[:, None]) + penalty, features.T @ (target * share[:, None]))
    got = model.predict([t for _, t, _ in rows])
    assert np.allclose(got[1], np.clip((1 + want.max(1)) / 2, 0, 1), atol=1e-4)


def _marks(spark, rows):
    """Places of the landmarks: the first of each language by the hash as an unsigned number."""
    hashed = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("doc_id", "lang", "xxhash64(doc_id) AS h").collect()
    return [r.doc_id for lang in ("xa", "xb") for r in sorted((r for r in hashed if r.lang == lang), key=lambda r: r.h % 2**64)[:4]]
