"""Address and protocol functions as plain expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Protocol numbers with a name.
PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP", 41: "IPv6", 47: "GRE", 50: "ESP", 51: "AH", 58: "ICMPv6", 89: "OSPF", 132: "SCTP"}
# Registered private IPv4 blocks and the two public addresses inside them.
PRIVATE_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4),
)
PUBLIC_V4 = ("192.0.0.9", "192.0.0.10")
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4_PATTERN = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_HEX = "[0-9a-fA-F]{1,4}"
V6_FULL = f"^{_HEX}(:{_HEX}){{7}}$"
V6_SHORT = f"^({_HEX}(:{_HEX})*)?::({_HEX}(:{_HEX})*)?$"


def protocol_name(number: Column) -> Column:
    """Name of a protocol number, else ``Proto-n``."""
    table = F.create_map(*[F.lit(x) for kv in PROTOCOLS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, number), F.concat(F.lit("Proto-"), number.cast("string")))


def is_ipv4(ip: Column) -> Column:
    """Dotted quad without leading zeros; shorthands such as ``127.1`` are refused."""
    return F.coalesce(ip.rlike(V4_PATTERN), F.lit(False))


def _v6_plain(ip: Column) -> Column:
    """The address with a dotted-quad tail replaced by its two groups."""
    tail = F.regexp_extract(ip, r"([0-9.]+)$", 1)
    quad = F.split(tail, r"\.")
    part = [F.coalesce(F.get(quad, F.lit(i)).try_cast("int"), F.lit(0)) for i in range(4)]
    groups = F.concat(F.lower(F.hex(part[0] * 256 + part[1])), F.lit(":"), F.lower(F.hex(part[2] * 256 + part[3])))
    head = F.substring(ip, F.lit(1), F.length(ip) - F.length(tail))
    return F.when(tail.rlike(V4_PATTERN), F.concat(head, groups)).otherwise(ip)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``body`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _v6_valid(plain: Column) -> Column:
    groups = F.regexp_count(plain, F.lit("[0-9a-fA-F]+"))
    return F.coalesce(plain.rlike(V6_FULL) | (plain.rlike(V6_SHORT) & (groups <= 7)), F.lit(False))


def is_ipv6(ip: Column) -> Column:
    """Eight groups, or fewer around one ``::``; a dotted-quad tail stands for two groups."""
    return _let(_v6_plain(ip), _v6_valid)


def is_ip(ip: Column) -> Column:
    """Valid IPv4 or IPv6 address."""
    return is_ipv4(ip) | is_ipv6(ip)


def ipv4_to_long(ip: Column) -> Column:
    """Address as an integer, null when it is no dotted quad."""
    parts = F.split(ip, r"\.")
    total = None
    for i in range(4):
        octet = F.get(parts, F.lit(i)).try_cast("long") * F.lit(256 ** (3 - i))
        total = octet if total is None else total + octet
    return F.when(is_ipv4(ip), total)


def _as_long(ip: str) -> int:
    a, b, c, d = (int(x) for x in ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def _private_number(n: Column) -> Column:
    hit = F.lit(False)
    for net, bits in PRIVATE_V4:
        low = _as_long(net)
        hit = hit | n.between(low, low + 2 ** (32 - bits) - 1)
    return F.coalesce(hit & ~n.isin(*[_as_long(a) for a in PUBLIC_V4]), F.lit(False))


def is_private_ipv4(ip: Column) -> Column:
    """Is the address in a registered private block? Not an address counts as no."""
    return _let(ipv4_to_long(ip), _private_number)


def ipv6_groups(ip: Column) -> Column:
    """The eight groups of a valid IPv6 address as integers, else null."""

    def numbers(text: Column) -> Column:
        words = F.filter(F.split(F.coalesce(text, F.lit("")), ":"), lambda g: g != "")
        return F.transform(words, lambda g: F.conv(g, 16, 10).try_cast("int"))

    def expand(plain: Column) -> Column:
        sides = F.split(plain, "::")
        left, right = numbers(F.get(sides, F.lit(0))), numbers(F.get(sides, F.lit(1)))
        gap = F.array_repeat(F.lit(0), F.lit(8) - F.size(left) - F.size(right))
        return F.when(_v6_valid(plain), F.concat(left, gap, right))

    return _let(_v6_plain(ip), expand)


def ipv4_key(number: Column) -> Column:
    """An IPv4 number as the text ``4`` and eight hex digits, else null; texts sort as the numbers do."""
    n = number.cast("long")
    return F.when(n.between(0, 2**32 - 1), F.concat(F.lit("4"), F.lpad(F.lower(F.hex(n)), 8, "0")))


def address_key(ip: Column) -> Column:
    """An address as ``4`` and 8 or ``6`` and 32 hex digits, else null; texts of a family sort as its numbers do."""

    def spelled(groups: Column) -> Column:
        digits = F.transform(groups, lambda g: F.lpad(F.lower(F.hex(g)), 4, "0"))
        return F.when(groups.isNotNull(), F.concat(F.lit("6"), F.array_join(digits, "")))

    return F.coalesce(ipv4_key(ipv4_to_long(ip)), _let(ipv6_groups(ip), spelled))


def _private_groups(g: Column) -> Column:
    at = [F.get(g, F.lit(i)) for i in range(8)]
    zero = [a == 0 for a in at]

    def all_of(conds):
        out = conds[0]
        for c in conds[1:]:
            out = out & c
        return out

    loop = all_of(zero[:7]) & (at[7] <= 1)
    mapped = all_of(zero[:5]) & (at[5] == 0xFFFF)
    fixed = (
        at[0].between(0xFC00, 0xFDFF)
        | at[0].between(0xFE80, 0xFEBF)
        | ((at[0] == 0x2001) & (at[1] == 0xDB8))
        | (at[0] == 0x2002)
        | ((at[0] == 0x64) & (at[1] == 0xFF9B) & (at[2] == 1))
        | all_of([at[0] == 0x100, *zero[1:4]])
    )
    # 2001::/23 is private but for a few assigned blocks.
    low = (at[0] == 0x2001) & (at[1] < 0x200)
    assigned = (
        all_of([at[1] == 1, *zero[2:7]]) & at[7].isin(1, 2)
        | (at[1] == 3)
        | ((at[1] == 4) & (at[2] == 0x112))
        | at[1].between(0x20, 0x3F)
    )
    v4 = at[6].cast("long") * 65536 + at[7]
    return F.coalesce(F.when(mapped, _private_number(v4)).otherwise(loop | fixed | (low & ~assigned)), F.lit(False))


def is_private_ipv6(ip: Column) -> Column:
    """Is the address in a registered private IPv6 block (or maps a private IPv4 address)?"""
    return _let(ipv6_groups(ip), _private_groups)


def is_private_ip(ip: Column) -> Column:
    """Private IPv4 or IPv6 address."""
    return is_private_ipv4(ip) | is_private_ipv6(ip)
