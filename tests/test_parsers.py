from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.times import to_utc
from tidewatch.operators.retention import raw_retention
from tidewatch.parsers.dispatch import parse_all

NOW = datetime(2024, 6, 1)
LINES = {
    "apache_access": ['44.1.2.3 - - [05/Jan/2024:10:00:00 +0000] "GET /p/7 HTTP/1.1" 404 512 "-" "curl/8.0"',
                      '44.1.2.3 - - [05/Jan/2024:10:00:00 +0000] "GET /p/7 HTTP/1.1" 404 - "-" "curl/8.0"', "random text"],
    "apache_error": ["[Fri Jan 05 10:00:00.123456 2024] [core:error] [client 44.1.2.3:5050] File missing, referer: https://shop.example.com/x"],
    "wp_error_log": ["[05-Jan-2024 10:00:00] PHP Fatal error: Failed opening required '/home/u/wp-load.php'"],
    "secure": ["Jan  5 10:00:00 h1 sshd[9]: Failed password for invalid user bob from 44.1.2.3 port 2222 ssh2"],
    "maillog": ["Jan  5 10:00:00 h1 dovecot[9]: imap-login: Logged in: user=<a@example.com>, rip=44.1.2.3,"],
    "exim_mainlog": ['2024-01-05 10:00:00 1ab => x@example.net R=r T=t H=mx.example.net [44.9.9.9] C="450 later"'],
    "lfd": ["Jan  5 10:00:00 h1 lfd[9]: (CT) IP 44.1.2.3 (x) found to have 71 connections - *Blocked in csf* for 1800 secs [CT_LIMIT]",
            "Jan  5 10:00:00 h1 lfd[9]: (CT) nothing to see"],
    "cpanel_access": ['44.1.2.3 - bob [01/05/2024:10:00:00 -0000] "POST /execute/Fileman/upload_files?dir=%2Fa HTTP/1.1" 200'],
    "modsec": ["--ab12-A--", "[05/Jan/2024:10:00:00 +0000] id 44.1.2.3 1 2 3", "--ab12-B--", "GET /x HTTP/1.1", "Host: h.example.com", "--ab12-F--",
               "HTTP/1.1 403 Forbidden", "--ab12-Z--", "--cd34-A--", "[05/Jan/2024:10:00:01 +0000] id 44.1.2.4 1 2 3", "--cd34-B--", "GET /y HTTP/1.1"],
    "sar": ["10:00:00 1 2 3.0 2.0 1.0 0", "SAR_DATE=2024-01-05", "SAR_MODE=-q", "Linux x (4 CPU)", "10:00:01 AM 1 200 8.00 7.50 7.00 0",
            "12:00:01 AM 1 200 1.00 1.50 1.00 0", "SAR_MODE=-r", "10:00:01 PM 100 200 300 93.5 1", "Average: 1 2 3 4"],
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(t, s, i + 1, "srv", f"f.{t}") for t, ls in LINES.items() for i, s in enumerate(ls)]
    df = spark.createDataFrame(rows, "log_type string, raw string, line_no long, server string, file string")
    ev = parse_all(df, NOW, list(LINES))
    out = ev.withColumn("keep", raw_retention(ev)).collect()
    return {t: [r for r in out if r["log_type"] == t] for t in LINES}


def test_web(parsed):
    a, b = sorted(parsed["apache_access"], key=lambda r: r["line_no"])
    assert (a["ip_client"], a["extra"]["http"]["path"], a["extra"]["http"]["status"], a["extra"]["http"]["bytes"], a["keep"]) == ("44.1.2.3", "/p/7", 404, 512, True)
    assert b["extra"]["http"]["bytes"] is None
    (e,) = parsed["apache_error"]
    assert e["timestamp_utc"] == datetime(2024, 1, 5, 16, 0, 0, 123456) and e["extra"]["referer_host"] == "shop.example.com"
    (w,) = parsed["wp_error_log"]
    assert w["extra"]["wp"]["kind"] == "missing_file" and w["extra"]["wp"]["missing_file"] == "/home/u/wp-load.php"
    assert e["extra"]["wp"] is None and e["extra"]["http"] is None


def test_logins_and_mail(parsed):
    (s,) = parsed["secure"]
    assert (s["username"], s["extra"]["action"], s["extra"]["port"]) == ("bob", "fail", 2222)
    (m,) = parsed["maillog"]
    assert (m["domain"], m["extra"]["auth_success"]) == ("example.com", True)
    (x,) = parsed["exim_mainlog"]
    assert (x["extra"]["action"], x["extra"]["kind"], x["ip_client"]) == ("defer", "temporary_failure", "44.9.9.9")


def test_firewall_and_panel(parsed):
    (f,) = parsed["lfd"]
    x = f["extra"]
    assert (x["action"], x["reason"], x["block_seconds"], x["lfd_tag"]) == ("blocked", "ct", 1800, "CT_LIMIT")
    (p,) = parsed["cpanel_access"]
    assert (p["extra"]["event_type"], p["extra"]["file"]["action"], p["extra"]["file"]["dir"]) == ("file_action", "upload_files", "/a")
    assert p["timestamp_utc"] is None and p["time_parsed"] is False


def test_multi_line(parsed):
    (t,) = parsed["modsec"]
    assert t["extra"]["waf"]["seen_sections"] == ["A", "B", "F", "Z"] and t["extra"]["waf"]["http"]["status_code"] == 403
    rows = sorted(parsed["sar"], key=lambda r: r["line_no"])
    assert [r["timestamp_utc"].hour for r in rows] == [10, 0, 22]
    assert rows[0]["extra"]["metric"]["ldavg_1_per_cpu"] == 2.0 and rows[0]["keep"] and not rows[1]["keep"] and rows[2]["keep"]


def test_times(spark):
    cases = {
        "Dec 11 11:26:23": datetime(2023, 12, 11, 17, 26, 23), "May 31 10:00:00": datetime(2024, 5, 31, 16, 0), "[10/Dec/2023:14:23:00 -0600]": datetime(2023, 12, 10, 20, 23),
        "2024-01-05 10:00:00Z": datetime(2024, 1, 5, 10), "99/Jan/2024:10:00:00 +0000": None, "yesterday": None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["u"] for r in df.select("t", to_utc(F.col("t"), NOW).alias("u")).collect()}
    assert got == cases
    lenient = {"26/Dec/2023:00:01:37.221839 --0600": datetime(2023, 12, 26, 6, 1, 37, 221839), "05/01/2024:10:00:00 -0000": datetime(2024, 1, 5, 10)}
    df = spark.createDataFrame([(k,) for k in lenient], "t string")
    assert {r["t"]: r["u"] for r in df.select("t", to_utc(F.col("t"), NOW, lenient=True).alias("u")).collect()} == lenient
    assert all(r["u"] is None for r in df.select(to_utc(F.col("t"), NOW).alias("u")).collect())
