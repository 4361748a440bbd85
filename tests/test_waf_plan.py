"""Lines of WAF transactions are cut once, silent ones are not moved, and groups need no object aggregation."""

from tidewatch.parsers import stateful

DDL = "raw string, file string, server string, line_no long, log_type string"


def _events(spark, text):
    lines = spark.createDataFrame([(raw, "f", "s", i, "modsec") for i, raw in enumerate(text)], DDL)
    return stateful.assemble_waf_transactions(lines)


def test_words_of_a_line_are_cut_once(spark):
    query = _events(spark, ["x"]).select("extra")._jdf.queryExecution()
    assert query.optimizedPlan().toString().count("\\s+") <= 2
    assert "ObjectHashAggregate" not in query.sparkPlan().toString()


def test_silent_lines_and_interleaved_transactions(spark):
    got = _events(spark, [
        "lost", "--aa-A--", "[01/Jan/2024:00:00:01 +0000] id 44.1.1.1 1 2", "--bb-A--", "[01/Jan/2024:00:00:02 +0000] id 44.1.1.2 1 2", "silent",
        "--aa-B--", "get /a HTTP/1.1", "Host: a.example", "Cookie: x y", "GET /later HTTP/1.1", "--aa-C--", "GET /body HTTP/1.1",
        "--bb-F--", "HTTP/1.1 404 Not Found", "HTTP/1.1 40 Short", "--aa-7--", "--bb-H--", "silent", "--aa-Z--", "silent", "Host: late.example", "--aa-Z--",
    ]).orderBy("line_no").collect()
    assert [(e.line_no, e.raw, e.ip_client, e.domain) for e in got] == [(17, "--bb-H--", "44.1.1.2", None), (19, "--aa-Z--", "44.1.1.1", "a.example")]
    waf = [e.extra.waf for e in got]
    assert [w.seen_sections for w in waf] == [["A", "F", "H"], ["A", "B", "C", "Z"]]
    assert [(w.http.method, w.http.url, w.http.status_code) for w in waf] == [(None, None, 404), ("GET", "/later", None)]
