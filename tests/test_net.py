import ipaddress
import random

from pyspark.sql import functions as F

from flowloom.functions import net
from flowloom.plans.catalog import QUERIES

FIXED = """1.2.3.4 256.1.1.1 01.2.3.4 127.1 :: ::1 1:: fe80::1 ::ffff:10.0.0.1 ::ffff:8.8.8.8 2001:db8::5 2001:1::1 2001:1::2
2001:1::3 2001:20::5 3fff::1 3fff:1000:: 64:ff9b:1::9 100::3 100:0:0:1::3 1:2:3:4:5:6:7:8 1:2:3:4:5:6:7 1::2::3 12345::
1:2:3:4:5:6:1.2.3.4 ::1.2.3 192.0.0.9 192.0.0.8 172.31.255.255 172.32.0.0 1:2:3:4:5:6:7:: ::2:3:4:5:6:7:8 1::2:3:4:5:6:7:8
fdff:: fe00:: 2001:200:: 2001:1ff:: :1::2 1:::2 2002::1 240.0.0.1 255.255.255.255 100.64.0.1 nonsense 1.2.3.4.5""".split()


def test_addresses_agree_with_the_standard_rules(spark):
    rng = random.Random(1)
    ips = [*FIXED, ""]
    ips += [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(200)]
    bits = lambda: rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128)
    ips += [str(ipaddress.IPv6Address(bits())) for _ in range(200)]
    ip = F.col("ip")
    rows = spark.createDataFrame([(i,) for i in ips], "ip string").select(
        ip, net.is_ip(ip).alias("valid"), net.is_private_ip(ip).alias("private"))
    for r in rows.collect():
        try:
            want = (True, ipaddress.ip_address(r.ip).is_private)
        except ValueError:
            want = (False, False)
        assert (r.valid, r.private) == want, r.ip


def test_ipv4_to_long(spark):
    rows = spark.createDataFrame([("1.2.3.4",), ("255.255.255.255",), ("1.2.3",)], "ip string")
    got = [r[0] for r in rows.select(net.ipv4_to_long(F.col("ip"))).collect()]
    assert got == [16909060, 4294967295, None]


def test_numbers_beyond_a_long(spark, tmp_path):
    ids = [0, -5, 1_096_000, 1_100_000, 36_000_000, None]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.event_id: r.n for r in QUERIES["f12_thousands"](spark, str(tmp_path)).collect()} == {
        i: None if i is None else f"{i**3 * 7:,}" for i in ids}
    sizes = {r.event_id: r["size"] for r in QUERIES["f2_format_bytes"](spark, str(tmp_path)).collect()}
    assert sizes[36_000_000] == f"{36_000_000**3 * 7 / 1024**5:.1f} PB" and sizes[0] == "0.3 B"
