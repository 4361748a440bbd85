"""IPv4 arithmetic and address classes as plain Column expressions."""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# IPv4 blocks that are private or otherwise not globally routable
# (IANA special-purpose registry), and the two single addresses inside them that are global.
PRIVATE_BLOCKS = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
]
PRIVATE_EXCEPTIONS = ["192.0.0.9/32", "192.0.0.10/32"]
SHARED_BLOCK = "100.64.0.0/10"
MULTICAST_BLOCK = "224.0.0.0/4"
# Textual prefixes of loopback, unspecified, unique-local, link-local,
# multicast, documentation and discard-only IPv6 addresses.
PRIVATE_IPV6 = r"^(::1?$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|2001:0?db8:|100::)"
MULTICAST_IPV6 = r"^ff[0-9a-f]{2}:"

IPV4_STRICT = (
    r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
)


def ip_to_long(ip: Column) -> Column:
    """Numeric IPv4 value; null for IPv6, invalid or missing text."""
    part = F.split(ip, r"\.")
    octet = [F.try_element_at(part, F.lit(i)).try_cast("bigint") for i in (1, 2, 3, 4)]
    value = octet[0] * 16777216 + octet[1] * 65536 + octet[2] * 256 + octet[3]
    return F.when(ip.rlike(IPV4_STRICT), value)


def long_to_ip(value: Column) -> Column:
    octets = [F.shiftright(value, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *octets)


def ip_subnet(ip: Column, prefix: int = 24) -> Column:
    """Network text such as 44.1.2.0/24 (prefix 8, 16 or 24); null when `ip` is not IPv4."""
    kept = prefix // 8
    head = F.substring_index(ip, ".", kept)
    return F.when(ip.rlike(IPV4_STRICT), F.concat(head, F.lit(".0" * (4 - kept) + f"/{prefix}")))


def _in_block(n: Column, block: str) -> Column:
    net = ipaddress.ip_network(block, strict=False)
    return n.between(int(net.network_address), int(net.broadcast_address))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _is_private(ip: Column, n: Column) -> Column:
    v4 = _any([_in_block(n, b) for b in PRIVATE_BLOCKS]) & ~_any(
        [_in_block(n, b) for b in PRIVATE_EXCEPTIONS]
    )
    return F.coalesce(v4, F.lit(False)) | F.coalesce(F.lower(ip).rlike(PRIVATE_IPV6), F.lit(False))


# The tests below use the numeric address many times: callers that evaluate several of them on large
# data compute `ip_to_long` once as a column of its own and pass it as `n`.


def is_private_like(ip: Column, n: Column | None = None) -> Column:
    """Private, loopback, link-local, reserved or multicast address."""
    n = ip_to_long(ip) if n is None else n
    return (
        _is_private(ip, n)
        | F.coalesce(_in_block(n, MULTICAST_BLOCK), F.lit(False))
        | F.coalesce(F.lower(ip).rlike(MULTICAST_IPV6), F.lit(False))
    )


def is_non_global(ip: Column, n: Column | None = None) -> Column:
    """Address that is not globally routable; false for missing or invalid text."""
    n = ip_to_long(ip) if n is None else n
    return _is_private(ip, n) | F.coalesce(_in_block(n, SHARED_BLOCK), F.lit(False))


def _once(value: Column, body) -> Column:
    """`body` of a value that is worked out once, whatever number of times the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _groups(plain: Column, halves: Column) -> Column:
    """The eight groups of an IPv6 text; `::` stands for as many zeros as are missing."""
    side = lambda i: F.filter(F.split(F.get(halves, F.lit(i)), ":"), lambda g: F.get(halves, F.lit(i)) != "")
    both = lambda l, r: F.when(F.size(l) + F.size(r) < 8, F.concat(l, F.array_repeat(F.lit("0"), F.lit(8) - F.size(l) - F.size(r)), r))  # noqa: E731, E741
    return F.when(F.size(halves) == 1, F.split(plain, ":")).when(F.size(halves) == 2, _once(side(0), lambda l: _once(side(1), lambda r: both(l, r))))  # noqa: E741


def _joined(groups: Column) -> Column:
    """Eight groups of one to four hexadecimal digits as two numbers; null for anything else."""
    good = F.forall(groups, lambda g: F.length(g).between(1, 4) & (F.translate(g, "0123456789abcdef", "") == ""))
    number = lambda i: F.conv(F.get(groups, F.lit(i)), 16, 10).cast("bigint")
    half = lambda i: F.shiftleft(number(i), 48).bitwiseOR(F.shiftleft(number(i + 1), 32)).bitwiseOR(F.shiftleft(number(i + 2), 16)).bitwiseOR(number(i + 3))
    return F.when(F.coalesce((F.size(groups) == 8) & good, F.lit(False)), F.struct(half(0).alias("hi"), half(4).alias("lo")))


def ip_bits(ip: Column) -> Column:
    """Address of either kind as 128 bits (hi, lo); IPv4 stands in ::ffff:0:0/96. Null for anything else."""

    def of(low: Column, v4: Column) -> Column:
        # an IPv4 tail becomes two groups
        pair = F.concat_ws(":", F.lower(F.hex(F.shiftright(v4, 16))), F.lower(F.hex(v4.bitwiseAND(65535))))
        head = low.substr(F.lit(1), F.length(low) - F.length(F.substring_index(low, ":", -1)))
        plain = F.when(v4.isNotNull(), F.concat(head, pair)).otherwise(low)
        v6 = _once(plain, lambda p: _once(F.split(p, "::"), lambda h: _once(_groups(p, h), _joined)))
        return F.when(low.contains(":"), v6).when(v4.isNotNull(), F.struct(F.lit(0).cast("bigint").alias("hi"), v4.bitwiseOR(F.lit(MAPPED)).alias("lo")))

    return _once(F.lower(F.trim(ip)), lambda low: _once(_once(F.substring_index(low, ":", -1), ip_to_long), lambda v4: of(low, v4)))


#: Bits 32 to 47 of an IPv4 address among 128-bit ones.
MAPPED = 0xFFFF << 32


def masked_bits(hi: Column, lo: Column, length: Column) -> Column:
    """The first `length` of 128 bits; null for a null length."""
    ones = F.lit(-1).cast("bigint")
    top = F.when(length >= 64, hi).when(length <= 0, F.lit(0).cast("bigint")).otherwise(hi.bitwiseAND(F.call_function("shiftleft", ones, F.lit(64) - length)))
    low = F.when(length >= 128, lo).when(length <= 64, F.lit(0).cast("bigint")).otherwise(lo.bitwiseAND(F.call_function("shiftleft", ones, F.lit(128) - length)))
    return F.when(length.isNotNull(), F.struct(top.alias("hi"), low.alias("lo")))


def network_bits(network: Column) -> Column:
    """Network or address text as (hi, lo, length) of 128 bits, cut to its length; null for anything else."""
    parts = F.split(F.trim(network), "/")
    address, given = ip_bits(F.get(parts, F.lit(0))), F.get(parts, F.lit(1)).try_cast("int")
    short = ~F.get(parts, F.lit(0)).contains(":")
    length = F.when(F.size(parts) == 1, F.lit(128)).when(short & given.between(0, 32), given + 96).when(~short & given.between(0, 128), given)
    whole = lambda a, n: _once(masked_bits(a["hi"], a["lo"], n), lambda m: F.when(a.isNotNull() & n.isNotNull() & (F.size(parts) <= 2), F.struct(m["hi"].alias("hi"), m["lo"].alias("lo"), n.alias("length"))))
    return _once(address, lambda a: _once(length, lambda n: whole(a, n)))


def _networks(entries: list[str]) -> list[ipaddress.IPv4Network | ipaddress.IPv6Network]:
    """Networks and addresses of a list; bad entries are left out."""
    out = []
    for entry in entries:
        try:
            out.append(ipaddress.ip_network((entry or "").strip(), strict=False))
        except ValueError:
            continue
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def ip_in_any(ip: Column, entries: list[str], n: Column | None = None, bits: Column | None = None) -> Column:
    """True when `ip` is an address, or falls in a network, of `entries`; bad entries are ignored.

    One look-up in a set for each prefix length that occurs, however many entries there are.
    """
    return networks_hold(ip, {None: entries}, None, n, bits)


def networks_hold(ip: Column, lists: dict[str | None, list[str]], owner: Column | None = None, n: Column | None = None, bits: Column | None = None) -> Column:
    """As `ip_in_any`, with a list for each owner: an address counts if it is in the list of the row's own owner."""
    n, v4, v6 = (ip_to_long(ip) if n is None else n), {}, {}
    for name, entries in lists.items():
        for net in _networks(entries):
            first = int(net.network_address)
            if net.version == 4:
                v4.setdefault(net.prefixlen, set()).add((name, str(first)))
            else:
                v6.setdefault(net.prefixlen, set()).add((name, f"{_signed(first >> 64)}:{_signed(first & (1 << 64) - 1)}"))
    tests = []
    for length, found in sorted(v4.items()):
        key = n.bitwiseAND(F.lit((0xFFFFFFFF << (32 - length)) & 0xFFFFFFFF).cast("bigint"))
        tests.append(key.isin([int(v) for _, v in sorted(found, key=str)]) if owner is None else F.concat_ws("|", owner, key.cast("string")).isin([f"{o}|{v}" for o, v in sorted(found, key=str)]) & key.isNotNull())
    if v6:
        tests.append(_once(ip_bits(ip) if bits is None else bits, lambda b: _any([_in_networks(b, length, found, owner) for length, found in sorted(v6.items())]) & b.isNotNull()))
    return F.coalesce(_any([F.coalesce(t, F.lit(False)) for t in tests]), F.lit(False)) if tests else F.lit(False)


def _in_networks(bits: Column, length: int, found: set[tuple[str | None, str]], owner: Column | None) -> Column:
    cut = masked_bits(bits["hi"], bits["lo"], F.lit(length))
    key = F.concat_ws(":", cut["hi"], cut["lo"])
    if owner is None:
        return key.isin([v for _, v in sorted(found, key=str)])
    return F.coalesce(F.concat_ws("|", owner, key).isin([f"{o}|{v}" for o, v in sorted(found, key=str)]), F.lit(False))


def first_ipv4(text: Column) -> Column:
    """First dotted quad in a text, or null."""
    return F.nullif(F.regexp_extract(text, r"\b((?:\d{1,3}\.){3}\d{1,3})\b", 1), F.lit(""))


def network_bounds(entry: str) -> tuple[int, int] | None:
    """Numeric first and last address of an IPv4 address or network text."""
    if not re.match(r"^\s*\d", entry or ""):
        return None
    try:
        net = ipaddress.ip_network(entry.strip(), strict=False)
    except ValueError:
        return None
    return (int(net.network_address), int(net.broadcast_address)) if net.version == 4 else None
