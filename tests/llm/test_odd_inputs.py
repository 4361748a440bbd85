"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names have the results that the docstrings state."""

import numpy as np

import corpus_pipeline
from tidewatch.llm import hnsw, jaccard, language, line_rules, mixing, packing, quality, token_files, trie_lm, url_templates

DOCUMENTS = [language.op2_language, jaccard.op3_jaccard, trie_lm.op4_trie_lm, line_rules.op5_line_rules, token_files.op6_token_files, packing.op8_packing, mixing.op10_mixing]


def test_every_row_of_odd_documents_has_a_result(spark, odd_documents, folder):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (7, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    path = folder(documents=odd_documents, labels=labels)
    for query in DOCUMENTS:
        rows = query(spark, path).toPandas()
        assert rows.doc_id.isna().sum() == 2 and set(rows.doc_id.dropna()) == set(range(1, 11)), query
        if query is not packing.op8_packing:
            assert len(rows) == 13, query
    by = lambda query: query(spark, path).toPandas().set_index("doc_id")
    found = by(language.op2_language)
    assert (found.loc[[3, 4, 5, 6], "lang_pred"] == "und").all() and (found.loc[[3, 4, 5, 6], "score"] == 0).all()
    assert found.loc[7, "lang_pred"] == "de" and (found.loc[1, "lang_pred"] == "en").all()
    found = by(jaccard.op3_jaccard)
    assert (found.loc[[1, 2], "class_id"] == 1).all() and (found.loc[[1, 2], "n_links"] == 2).all() and (found.loc[[3, 4, 5], "n_links"] == 0).all()
    found = by(trie_lm.op4_trie_lm)
    assert (found.loc[[3, 4, 5], "n_tokens"] == 1).all() and found.score.notna().all()
    found = by(line_rules.op5_line_rules)
    assert found.loc[8, "n_words"] == 120_001 and found.loc[[3, 4, 5], "base_failed"].all()
    found = by(token_files.op6_token_files)
    assert (found.loc[[3, 4, 5], "n_tokens"] == 1).all()
    found = by(mixing.op10_mixing)
    assert (found.loc[[3, 4, 5], "taken"] == 0).all() and (found.taken <= 3 * found["size"]).all()
    found = by(quality.op7_quality)
    assert len(found) == 13 and found.loc[[3, 4], "perplexity"].isna().all() and not found.loc[[3, 4], "kept"].any() and found.loc[1, "kept"].all()


def test_stages_keep_the_columns_of_odd_documents(spark, odd_documents, folder):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    path = folder(documents=odd_documents, labels=labels)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, odd_documents, path)
        assert rows.columns == odd_documents.columns, name
        ids = [r.doc_id for r in rows.collect()]
        if name == "language":
            assert not {3, 4, 5, 6} & set(ids) and {1, 2, 7} <= set(ids)
        if name == "near_duplicates":
            assert ids.count(1) + ids.count(2) == 1 and {3, 4, 5, 7, 8} <= set(ids)
        if name == "quality":
            assert ids.count(1) == 2 and 7 in ids and 3 not in ids
    assert corpus_pipeline.run(spark, path).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_empty_tables_give_no_rows(spark, no_documents, folder):
    path = folder(
        documents=no_documents, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"),
        pages=spark.createDataFrame([], "page_id long, url string, html string"), embeddings=spark.createDataFrame([], "vec_id long, embedding array<float>"),
    )
    for query in [*DOCUMENTS, quality.op7_quality, url_templates.op1_url_templates, hnsw.op9_hnsw, corpus_pipeline.run]:
        assert query(spark, path).count() == 0, query


def test_urls_and_rules(spark):
    urls = [
        (1, "https://X.Example.NET/en/a?q=://"), (2, "http://example.com/de/1"), (3, "http://a.org/fr/x#y"), (4, None), (5, "no scheme/net/"), (None, "http://badexample.net/en/"),
        (6, "http://example.net"), (7, "s://b://c/d"), (7, "s://b://c/d"),
    ]
    pages = spark.createDataFrame(urls, "page_id long, url string").selectExpr("*", "url AS host", "url AS path", "1 AS n", "1 AS good")
    labels = spark.createDataFrame([(2, 0), (2, None), (99, 1), (None, 1)], "page_id long, good int")
    rows = url_templates.judge_urls(pages, labels).collect()
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(urls) and got == {
        (1, "x.example.net", "/en/a", "example.net/en/", "allow"), (2, "example.com", "/de/1", "example.com/de/", "block"), (3, "a.org", "/fr/x", "org/fr/", "allow"),
        (4, "", "", None, "allow"), (5, "", "", None, "allow"), (None, "badexample.net", "/en/", "net/", "block"), (6, "example.net", "", None, "allow"), (7, "b:", "//c/d", None, "allow"),
    }


def test_templates_follow_the_labels(spark):
    pages = spark.range(400).selectExpr("id AS page_id", "concat('http://h.example/', if(id % 2 = 0, 'good', 'spam'), '/', id, '.html') AS url")
    labels = spark.range(400).selectExpr("id AS page_id", "int(id % 2 = 0) AS good")
    got = {(r.template, r.verdict) for r in url_templates.judge_urls(pages, labels).collect()}
    assert got == {("/good/*", "allow"), ("/spam/*", "block")}


def test_odd_vectors(spark):
    draw = np.random.default_rng(2).standard_normal((60, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(draw)]
    rows += [(100, [1.0, 0.0, 0.0, 0.0]), (200, [1.0, 0.0, 0.0, 0.0]), (200, [1.0, 0.0, 0.0, 0.0]), (300, None), (400, [0.0] * 4), (500, [float("nan"), 1.0, 1.0, 1.0]), (600, [None, 1.0, 1.0, 1.0]), (700, [1.0, 2.0]), (800, []), (None, [1.0] * 4)]
    rows += [(1000 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(1, 40)]
    vectors = hnsw.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    index, members = hnsw.build_index(vectors)
    got = hnsw.search(index, members, vectors.filter("vec_id % 100 = 0")).toPandas()
    assert set(got.query_id) == {0, 100, 200}
    same = got[got.query_id == 100].sort_values("rank")
    assert same.vec_id.tolist()[:3] == [200, 200, 1001] and (same.score == 0).all() and len(same) == 10
    assert got[got.query_id == 0]["rank"].tolist() and 0 not in set(got[got.query_id == 0].vec_id)


def test_targets_stop_at_the_limit(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 10), ("d", 0), (None, 1000)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # weights 1, 2, 3, 1, 2: b, c and d stop at three times their size, a and null share the rest as 1 to 2 and a stops too
    assert got == {"a": 300.0, "b": 30.0, "c": 30.0, "d": 0.0, None: 760.0}


def test_one_large_group_of_copies(spark):
    words = "w%d " * 60 % tuple(range(60))
    rows = [(i, words) for i in range(300)] + [(1000 + i, words.replace(f"w{i % 50} ", f"q{i} ", 1)) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = jaccard.similar(docs).toPandas().set_index("doc_id").sort_index()
    assert (got.class_id == 0).all() and (got.loc[0:299, "n_links"] == 1499).all()
