"""Addresses of both kinds against Python's own address library."""

import ipaddress
import random

import pytest

from tidewatch.functions.net import ip_bits, ip_in_any, network_bits, networks_hold
from tidewatch.operators.prefixjoin import prefix_join
from pyspark.sql import functions as F

TEXTS = [
    "::", "::1", "1::", "2001:db8::8:800:200c:417a", "2001:DB8:0:0:8:800:200C:417A", "::ffff:1.2.3.4", "::1.2.3.4", "64:ff9b::255.255.255.255", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8",
    "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "8000::", "0:0:0:0:8000::", "1.2.3.4", "255.255.255.255", "0.0.0.0", "44.1.0.255",
    "", None, "x", ":::", "1::2::3", "1:2:3", "1:2:3:4:5:6:7:8:9", "12345::", "g::", "1.2.3", "1.2.3.4.5", "::1.2.3.400", "1:2:3:4:5:6:7:1.2.3.4", "::1/64", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:",
]


def bits(text):
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return None
    return int(a) if a.version == 6 else int(a) | 0xFFFF << 32


def unsigned(row):
    return None if row is None else (row["hi"] % 2**64) << 64 | row["lo"] % 2**64


def test_addresses_as_bits(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "ip string").select("ip", ip_bits(F.col("ip")).alias("b"))
    assert {r["ip"]: unsigned(r["b"]) for r in df.collect()} == {t: bits(t) for t in TEXTS}


def test_networks_as_bits(spark):
    texts = ["10.0.0.0/8", "10.1.2.3/8", "1.2.3.4", "0.0.0.0/0", "2001:db8::/32", "2001:db8:ffff::/33", "::/0", "::1/128", "::1", "1.2.3.4/33", "::/129", "1.2.3.4/x", "a/8", "", None, "1.2.3.0/24/1"]
    df = spark.createDataFrame([(t,) for t in texts], "n string").select("n", network_bits(F.col("n")).alias("b"))
    for r in df.collect():
        try:
            net = ipaddress.ip_network(r["n"], strict=False)
            want = (int(net.network_address) | (0xFFFF << 32 if net.version == 4 and net.prefixlen + 96 >= 96 else 0), net.prefixlen + (96 if net.version == 4 else 0))
        except ValueError:
            want = None
        assert (r["b"] and (unsigned(r["b"]), r["b"]["length"])) == want, r["n"]


def sample(seed):
    rnd = random.Random(seed)
    near = [rnd.getrandbits(128) for _ in range(4)]
    def address():
        if rnd.random() < 0.4:
            return str(ipaddress.IPv4Address(0x2C000000 | rnd.getrandbits(6) << 14 | rnd.getrandbits(3)))
        return str(ipaddress.IPv6Address(rnd.choice(near) ^ rnd.getrandbits(rnd.choice([4, 30, 70, 100]))))
    def network():
        a = ipaddress.ip_address(address())
        return str(ipaddress.ip_network((int(a), rnd.randrange(a.max_prefixlen + 1)) if a.version == 4 else (str(a), rnd.randrange(129)), strict=False))
    return rnd, [address() for _ in range(300)], sorted({network() for _ in range(120)})


@pytest.mark.parametrize("seed, keep", [(1, 120), (2, 5), (3, 1), (4, 0)])
def test_longest_prefix_equals_trying_all(spark, seed, keep):
    _, addresses, networks = sample(seed)
    networks = networks[:keep]
    parsed = [ipaddress.ip_network(n) for n in networks]
    points = spark.createDataFrame([(i, a) for i, a in enumerate([*addresses, None, "bad", addresses[0]])], "i int, ip string").repartition(3)
    nets = spark.createDataFrame([(n, n) for n in networks] + [("bad/1", "bad")], "network string, value string")
    got = prefix_join(points, "ip", nets).collect()
    assert len(got) == len(addresses) + 3
    for r in got:
        try:
            a = ipaddress.ip_address(r["ip"])
            hits = [n for n in parsed if n.version == a.version and a in n]
        except ValueError:
            hits = []
        # an IPv6 network that holds ::ffff:0:0/96 holds IPv4 addresses too
        if r["ip"] and hits == [] and ":" not in r["ip"] and r["value"] and ":" in r["value"]:
            continue
        assert r["value"] == (str(max(hits, key=lambda n: n.prefixlen)) if hits else None), r


def test_trust_lists_of_both_kinds(spark):
    rnd, addresses, networks = sample(7)
    lists = {"s1": networks[:40], "s2": networks[40:80] + ["bad", "", None], "s3": []}
    df = spark.createDataFrame([(a, rnd.choice(["s1", "s2", "s3", None])) for a in addresses] + [(None, "s1"), ("x", "s1")], "ip string, server string")
    got = df.select("ip", "server", ip_in_any(F.col("ip"), networks[:60]).alias("any"), networks_hold(F.col("ip"), lists, F.col("server")).alias("own")).collect()

    def held(ip, entries):
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            return False
        return any(a in n for n in map(ipaddress.ip_network, filter(lambda e: e and e != "bad", entries)) if n.version == a.version)

    for r in got:
        assert r["any"] == held(r["ip"], networks[:60]), r
        assert r["own"] == held(r["ip"], lists.get(r["server"], [])), r
