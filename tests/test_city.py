"""City databases and longest-match joins of addresses with blocks."""

import ipaddress
import random
import struct

import pytest
from pyspark.sql import functions as F

from sentrymill.functions.net import address_hex
from sentrymill.operators import blocks as B
from sentrymill.sources import mmdb


def packed(value):
    """A value in the format's own encoding; only what the tests need."""
    if isinstance(value, dict):
        return head(7, len(value)) + b"".join(packed(k) + packed(v) for k, v in value.items())
    if isinstance(value, list):
        return head(11, len(value)) + b"".join(map(packed, value))
    if isinstance(value, str):
        raw = value.encode()
        return head(2, len(raw)) + raw
    if isinstance(value, float):
        return head(3, 8) + struct.pack(">d", value)
    if isinstance(value, bool):
        return head(14, int(value))
    raw = value.to_bytes((value.bit_length() + 7) // 8, "big")
    return head(6 if value < 2**32 else 9, len(raw)) + raw


def head(kind, size):
    low, more = (size, b"") if size < 29 else (29, bytes([size - 29])) if size < 285 else (30, (size - 285).to_bytes(2, "big"))
    return (bytes([kind << 5 | low]) if kind < 8 else bytes([low, kind - 7])) + more


def database(nets, version=6, size=28, alias=False):
    """A small city database of disjoint networks and their records."""
    nodes, data, depth = [[None, None]], b"", 128 if version == 6 else 32
    for net, record in nets:
        net = ipaddress.ip_network(net)
        bits = net.prefixlen + (96 if version == 6 and net.version == 4 else 0)
        path, at, node = int(net.network_address), len(data), 0
        data += packed(record)
        for i in range(bits):
            bit = path >> (depth - 1 - i) & 1 if i < depth else 0
            if i == bits - 1:
                nodes[node][bit] = ("data", at)
            else:
                if nodes[node][bit] is None:
                    nodes.append([None, None])
                    nodes[node][bit] = len(nodes) - 1
                node = nodes[node][bit]
    value = lambda x: len(nodes) if x is None else x if isinstance(x, int) else len(nodes) + 16 + x[1]
    tree = b""
    for left, right in nodes:
        a, b = value(left), value(right)
        if size == 28:
            tree += (a & 0xFFFFFF).to_bytes(3, "big") + bytes([(a >> 24) << 4 | b >> 24]) + (b & 0xFFFFFF).to_bytes(3, "big")
        else:
            tree += a.to_bytes(size // 8, "big") + b.to_bytes(size // 8, "big")
    return tree + bytes(16) + data + mmdb.MARK + packed({"node_count": len(nodes), "record_size": size, "ip_version": version, "languages": ["en"]})


def place(cc, city, lat, lon):
    return {"city": {"names": {"de": "x", "en": city}}, "country": {"iso_code": cc, "names": {"en": "Land of " + cc}}, "location": {"latitude": lat, "longitude": lon, "accuracy_radius": 7}, "long": "y" * 300, "flags": [True, False]}


NETS = [
    ("45.67.0.0/17", place("AA", "North", 1.5, -2.5)), ("45.67.128.0/25", place("BB", "South", -3.0, 4.0)), ("45.67.128.128/32", place("CC", "One", 0.0, 5.0)),
    ("81.0.0.0/8", {"location": {"latitude": 0.0, "longitude": 0.0}}), ("82.0.0.0/8", place("DD", "", 0.0, 0.0)), ("2a00:10::/33", place("EE", "Six", 6.0, 6.0)), ("2a00:10:8000::1/128", place("FF", "Host", 7.0, 7.0)),
]
FIELDS = ["cc", "country", "city", "lat", "lon"]


@pytest.mark.parametrize("version,size,spread", [(6, 28, 8), (6, 24, 3), (6, 32, 20), (4, 28, 8)])
def test_reader_and_lookup(spark, tmp_path, version, size, spread):
    nets = [n for n in NETS if version == 6 or ":" not in n[0]]
    path = tmp_path / "city.mmdb"
    path.write_bytes(database(nets, version, size))
    table = mmdb.blocks(spark, str(path), spread)
    assert table.count() == len(nets)
    asked = ["45.67.0.1", "45.67.127.255", "45.67.128.127", "45.67.128.128", "45.67.128.129", "81.2.3.4", "82.9.9.9", "::ffff:45.67.0.1", "2a00:10:7fff::", "2a00:10:8000::1", "2A00:0010:8000:0::2", "8.8.8.8", "not-an-ip", "", "45.67.0.1%eth0", None]
    got = {r["ip"]: r for r in B.lookup(spark.createDataFrame([(a,) for a in asked * 3], "ip string"), "ip", table, FIELDS).collect()}
    assert len(got) == len(asked) - 1
    for a in asked[:-1]:
        try:
            ip = ipaddress.ip_address(a)
            ip = getattr(ip, "ipv4_mapped", None) or ip
        except ValueError:
            ip = None
        rec = next((r for n, r in nets if ip is not None and ip in ipaddress.ip_network(n)), None)
        miss = rec is None or "country" not in rec
        assert (got[a]["cc"], got[a]["city"], got[a]["lat"]) == ((None, None, None) if miss else (rec["country"]["iso_code"], rec["city"]["names"]["en"], rec["location"]["latitude"])), a


def test_a_file_that_is_none(spark, tmp_path):
    (tmp_path / "x.mmdb").write_bytes(b"no database")
    with pytest.raises(ValueError):
        mmdb.blocks(spark, str(tmp_path / "x.mmdb"))


@pytest.mark.parametrize("few", [0, 10_000])
def test_longest_match_of_nested_blocks(spark, monkeypatch, few):
    monkeypatch.setattr(B, "FEW", few)
    rng = random.Random(4)
    nets = {str(ipaddress.ip_network((rng.getrandbits(32), rng.choice([0, 1, 5, 8, 9, 15, 16, 20, 24, 27, 31, 32])), strict=False)) for _ in range(150)} | {str(ipaddress.ip_network((0x2A << 120 | rng.getrandbits(24) << 90, rng.choice([7, 8, 30, 47, 64, 127])), strict=False)) for _ in range(60)}
    nets, seen = sorted(nets), []
    for n in nets:
        net = ipaddress.ip_network(n)
        seen += [str(net.network_address), str(net.broadcast_address), str(net.broadcast_address + 1) if int(net.broadcast_address) + 1 < 2**net.max_prefixlen else "ffff::"]
    table = spark.createDataFrame([(n,) for n in nets], "network string")
    table = table.select("network", B.from_cidr(F.col("network")).alias("b")).select("network", "b.*")
    got = {r["ip"]: r["network"] for r in B.lookup(spark.createDataFrame([(a,) for a in seen], "ip string"), "ip", table, ["network"]).collect()}
    parsed = [ipaddress.ip_network(n) for n in nets]
    for a in seen:
        ip = ipaddress.ip_address(a)
        best = max((n for n in parsed if ip in n), key=lambda n: n.prefixlen, default=None)
        assert got[a] == (str(best) if best else None), a


def test_address_texts(spark):
    texts = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::8", "::ffff:1.2.3.4", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "ABCD::", "0.0.0.0", "255.255.255.255",
             "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::8", "1::2::3", ":1::", "1:::2", "12345::", "g::", "1.2.3.256", "01.2.3.4", "1.2.3", "::1.2.3", "fe80::1%eth0", "", ":", ":::", "1:2", "::1\n"]
    got = {r["t"]: r["k"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", address_hex(F.col("t")).alias("k")).collect()}
    for t in texts:
        try:
            ip = ipaddress.ip_address(t)
            want = f"{int(getattr(ip, 'ipv4_mapped', None) or ip):032x}"
        except ValueError:
            want = None
        if t == "1:2:3:4:5:6:7::8" or "%" in t:  # two colons must stand for a group at least; zones are refused
            want = None
        assert got[t] == want, t


def test_addresses_are_worked_out_once(spark, monkeypatch):
    monkeypatch.setattr(B, "FEW", 1)  # one level is broadcast, one shuffled
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    ips = spark.createDataFrame([("10.0.0.1",), ("11.2.0.9",)], "ip string").mapInArrow(counted, "ip string")
    table = spark.createDataFrame([("10.0.0.0/8",), ("11.0.0.0/8",), ("11.2.0.0/16",)], "network string").select("network", B.from_cidr(F.col("network")).alias("b")).select("network", "b.*")
    got = {r["ip"]: r["network"] for r in B.lookup(ips, "ip", table, ["network"]).collect()}
    assert got == {"10.0.0.1": "10.0.0.0/8", "11.2.0.9": "11.2.0.0/16"} and seen.value == 2
