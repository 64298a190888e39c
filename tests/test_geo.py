import ipaddress
import random

from pyspark.sql import functions as F

from flowloom.operators import geo


def _brute(ip, ranges):
    """Latest start, then earliest end, then largest name among the ranges that hold the address."""
    try:
        a = ipaddress.ip_address(ip)
    except (ValueError, TypeError):
        return None
    hits = []
    for s, e, name in ranges:
        try:
            s, e = ipaddress.ip_address(s), ipaddress.ip_address(e)
        except ValueError:
            continue
        if s.version == e.version == a.version and s <= a <= e:
            hits.append((int(s), -int(e), name))
    return max(hits)[2] if hits else None


def test_nested_overlapping_ranges_of_both_families(spark):
    rng = random.Random(5)
    ranges, ips = [], ["nonsense", "", None, "::ffff:10.0.0.1", "0.0.0.0", "255.255.255.255", "::", "ffff:" * 7 + "ffff"]
    for bits, make, base in ((32, ipaddress.IPv4Address, 10 << 24), (128, ipaddress.IPv6Address, 0x20010DB8 << 96)):
        top = 2**bits - 1
        for i in range(60):
            s = base + rng.getrandbits(rng.choice([4, 12, 17, 20, bits - 8 if bits == 32 else 90]))
            e = min(top, s + rng.getrandbits(rng.randint(1, 22 if bits == 32 else 100)))
            ranges.append((str(make(s)), str(make(e)), f"r{bits}_{i % 50}"))
            ips += [str(make(min(top, max(0, x)))) for x in (s - 1, s, s + 1, (s + e) // 2, e - 1, e, e + 1)]
        ranges.append((str(make(0)), str(make(top)), "all") if bits == 128 else (str(make(base)), str(make(base + 2**24 - 1)), "ten"))
    ranges += [("10.0.0.9", "10.0.0.3", "reversed"), ("10.0.0.1", "::5", "mixed"), ("x", "10.0.0.3", "broken"), ranges[0], (None, "10.0.0.3", "open")]
    table = spark.createDataFrame(ranges, "start_ip string, end_ip string, country string")
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    got = {r["ip"]: r["country"] for r in geo.locate(df, "ip", table).collect()}
    whole = [r for r in ranges if r[0]]
    assert got == {i: _brute(i, whole) for i in ips}


def test_numbers_empty_tables_and_rows(spark):
    table = spark.createDataFrame([(167772160, 167772415, "a", 1), (167772170, 167772180, "b", 2), (None, 5, "c", 3), (5, 2**40, "d", 4)],
                                  "start_ip long, end_ip long, country string, zone int")
    df = spark.createDataFrame([("10.0.0.1",), ("10.0.0.12",), ("10.0.1.0",), ("::1",), (None,), ("10.0.0.1",)], "ip string")
    got = {r["ip"]: (r["country"], r["zone"]) for r in geo.locate(df, "ip", table, ["country", "zone"]).collect()}
    assert got == {"10.0.0.1": ("a", 1), "10.0.0.12": ("b", 2), "10.0.1.0": (None, None), "::1": (None, None), None: (None, None)}
    assert geo.with_location(df, "ip", table).count() == 6
    assert geo.locate(df, "ip", table.where("false")).where(F.col("country").isNotNull()).count() == 0
    assert geo.locate(df.where("false"), "ip", table).count() == 0
