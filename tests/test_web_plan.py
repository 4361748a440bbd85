"""Values of a web error line are worked out once, not in every place that names them."""

import pytest

from tidewatch.parsers import web


@pytest.mark.parametrize("parse, most", [(web.parse_http_error, 60), (web.parse_wp_error, 60)])
def test_searches_of_a_line_do_not_multiply(spark, parse, most):
    lines = spark.createDataFrame([("x", "f", "s", 1, "t")], "raw string, file string, server string, line_no long, log_type string")
    plan = parse(lines).select("message", "extra")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("instr(") < most
