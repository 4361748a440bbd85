"""URL templates of hosts with many sections and of deep paths."""

from tidewatch.llm import url_templates


def _verdicts(spark, url: str, n: int, good: str) -> dict:
    pages = spark.range(n).selectExpr("id AS page_id", f"{url} AS url")
    labels = spark.range(n).selectExpr("id AS page_id", f"int({good}) AS good")
    rows = url_templates.judge_urls(pages, labels).join(labels, "page_id").groupBy("template", "verdict").agg({"good": "avg"}).collect()
    return {r[0]: (r[1], r[2]) for r in rows}


def test_one_bad_section_of_a_hundred_is_blocked(spark):
    name = "concat('s', chr(97 + int(id % 100 / 10)), chr(97 + id % 10))"
    got = _verdicts(spark, f"concat('http://h.example/', {name}, '/', id)", 6000, "id % 100 <> 37")
    assert got == {"/sdh/*": ("block", 0.0), "/*/*": ("allow", 1.0)}


def test_clean_sections_of_a_bad_host_are_allowed(spark):
    name = "concat('s', chr(97 + int(id % 100 / 10)), chr(97 + id % 10))"
    got = _verdicts(spark, f"concat('http://h.example/', {name}, '/', id)", 20000, "id % 100 in (3, 4)")
    assert got == {"/sad/*": ("allow", 1.0), "/sae/*": ("allow", 1.0), "/*/*": ("block", 0.0)}


def test_a_bad_section_far_down_is_seen(spark):
    got = _verdicts(spark, "concat('http://h.example/a/b/c/d/e/f/', if(id % 3 = 0, 'spam', 'news'), '/', id)", 600, "id % 3 <> 0")
    assert got == {"/*/*/*/*/*/*/spam/*": ("block", 0.0), "/*/*/*/*/*/*/news/*": ("allow", 1.0)}
