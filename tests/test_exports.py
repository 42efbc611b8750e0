"""The bundle: order, ids that follow from the content, the document itself, cut samples."""

import hashlib
import json
import uuid

from pyspark.sql import functions as F

from sentrymill.sources import exports

SCHEMA = "kind string, value string, hits long, a timestamp, b timestamp, sources string, sample string"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, n, None, None, s, x) for k, v, n, s, x in rows], SCHEMA).withColumns({"a": F.lit("2024-01-02 03:04:05").cast("timestamp"), "b": F.lit("2024-01-03 03:04:05").cast("timestamp")})


ROWS = [("ip", "1.2.3.4", 5, "cowrie|journal", "x"), ("ip", "2001:db8::1", 5, "cowrie", None), ("user", "o'neil\\", 9, "", ""), ("hash", "AB", 1, "cowrie", "é" * 200), ("tunnel", "[2001:db8::2]:443", 2, "cowrie", ""), ("tunnel", "host.example:25", 2, "cowrie", ""), ("odd", "x", 99, "", "")]


def five(seed):
    d = bytearray(hashlib.sha1(seed.encode()).digest()[:16])
    d[6], d[8] = d[6] & 0x0F | 0x50, d[8] & 0x3F | 0x80
    return str(uuid.UUID(bytes=bytes(d)))


def test_document(spark, tmp_path):
    placed = exports.objects(frame(spark, ROWS).repartition(4))
    exports.write_bundle(placed, str(tmp_path / "b"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "b").glob("part-*")))
    doc = json.loads(text)
    names = [o["name"] for o in doc["objects"][1:]]
    assert names == ["user:o'neil\\", "ip:1.2.3.4", "ip:2001:db8::1", "tunnel:[2001:db8::2]:443", "tunnel:host.example:25", "hash:AB"]
    ids = ["indicator--" + five(n.replace(":", "|", 1)) for n in names]
    assert [o["id"] for o in doc["objects"][1:]] == ids and doc["id"] == "bundle--" + five("sentrymill-bundle-" + "".join(i + "|" for i in ids))
    by = {o["name"]: o for o in doc["objects"][1:]}
    assert by["user:o'neil\\"]["pattern"] == "[user-account:account_login = 'o\\'neil\\\\']" and by["user:o'neil\\"]["labels"] == ["credential-attempt"]
    assert by["tunnel:[2001:db8::2]:443"]["pattern"] == "[network-traffic:dst_ref.type = 'ipv6-addr' AND network-traffic:dst_ref.value = '2001:db8::2' AND network-traffic:dst_port = 443]"
    assert "'domain-name'" in by["tunnel:host.example:25"]["pattern"] and by["ip:2001:db8::1"]["pattern"] == "[ipv6-addr:value = '2001:db8::1']"
    assert by["ip:1.2.3.4"]["description"] == "Observed ip '1.2.3.4' across cowrie,journal sources from 2024-01-02T03:04:05Z to 2024-01-03T03:04:05Z. Count: 5. Sample: x" and " across no sources" in by["user:o'neil\\"]["description"]
    assert by["hash:AB"]["description"].endswith("Sample: " + "é" * 128 + "…")
    exports.write_bundle(exports.objects(frame(spark, ROWS[::-1]).repartition(2)), str(tmp_path / "c"))  # other order, other partitions, the same bytes
    assert "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part-*"))) == text
    assert {r["id"] for r in exports.read_back(spark, str(tmp_path / "b")).collect()} == set(ids)


def test_nothing_to_export(spark):
    placed = exports.objects(frame(spark, ROWS[-1:]))
    assert placed.count() == 0 and exports.bundle_id(placed) == "bundle--" + five("sentrymill-bundle-")
    assert json.loads("".join(r["line"] for r in exports.bundle_lines(placed).orderBy("place").collect()))["objects"][0]["type"] == "identity"
