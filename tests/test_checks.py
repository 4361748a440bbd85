"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tidewatch.checks import load

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = load()
# one of each shape; the driver compares all of them
SAMPLE = [
    "p1_http_access", "p6_mail_flow", "p11_panel_access", "p13_firewall", "p15_waf_transactions", "p16_sar", "p18_to_utc", "s5_ingest_stats",
    "w1_sliding_window", "a2_top_subnet24_hits", "w3_cooldown", "w7_carry_forward", "f1_rule_match", "f4_is_trusted", "r1_rule_condition", "r3_build_alerts",
    "n2_infer_domain", "n7_enrich_geo", "n13_dedupe_events", "n15_raw_retention", "j3_range_join_shuffled", "w5_incident_cooldown", "u3_upsert_incidents",
    "a11_entity_score", "a12_entity_ledger", "f7_filter_alerts", "a5_dashboard_kpis", "a7_fill_missing_days", "j6_incident_detail", "j10_notify_owner",
    "u6_close_incident_cascade", "r6_route_notifications", "det_w2", "det_a7", "det_ms3", "det_ms5", "t1_stream_alerts",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is not None, str(v)) for v in row)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=_key)
    res = duck.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in at) for r in res.fetchall()), key=_key)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
