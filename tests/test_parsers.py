"""Journal lines, sensor logs, side records, identity dedup and the incremental path."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sentrymill.functions import net
from sentrymill.operators import aggregates as A
from sentrymill.sources import logs
from sentrymill.streaming.live import journal_counts, start
from sentrymill.streaming.store import Store

JOURNAL = """2025-03-02T18:44:51+00:00 gate sshd[411]: Invalid user marta from 203.0.113.61 port 50112
2025-03-02T18:45:02+00:00 gate sshd[412]: Invalid user builds from 203.0.113.61 port 50230
2025-03-02T18:51:40+00:00 gate sshd[430]: Invalid user wiki from 198.51.100.88 port 39007
2025-03-02T18:52:19+00:00 gate sshd[431]: Accepted publickey for ops from 192.0.2.14 port 60001 ssh2: ED25519 SHA256:k3y
2025-03-02T23:30:00+0530 gate sshd[502]: Failed publickey for invalid user a%b from 2001:db8:5::1f port 41414
2025-03-02T23:30:00+0530 gate sshd[502]: Failed password for backup from 198.51.100.9 port 41415 ssh2
2025-03-02T18:30:00+00:00 gate sshd[502]: Connection closed by 198.51.100.9
nothing of interest
sometime gate sshd[9]: Invalid user z from 192.0.2.1 port 2""".split("\n")


def record(eventid, at="2025-03-04T05:06:07Z", ip="198.51.100.20", session="q7", **more):
    return json.dumps({"eventid": f"cowrie.{eventid}", "timestamp": at, "src_ip": ip, "session": session, **more})


SENSOR = [
    record("login.failed", username="guest", password="pw"),
    record("command.input", input="hostname"),
    record("client.kex", hassh="f00d"),
    record("client.kex", at="2025-03-04T05:09:00Z", hassh="beef"),
    record("session.file_download", url="http://files.test/one", shasum="0c"),
    record("direct-tcpip.request", dst_ip="192.0.2.200", dst_port=8443),
    record("session.closed", session="q8", duration_ms=1850),
    record("session.params", session="q8", arch="arm-32"),
    '{"eventid":',
    '{"eventid":7,"timestamp":{},"src_ip":[],"session":null}',
    record("login.failed", at="yesterday", ip="nowhere", username="n"),
    record("command.input", input="first")[:-1] + ', "input": "second"}',
]


def lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_journal(spark):
    got = logs.journal(lines(spark, JOURNAL)).collect()
    events = [(r["kind"], r["username"], r["src_ip"], r["src_port"], str(r["ts"])) for r in got if r["kind"]]
    assert ("invalid_user", "marta", "203.0.113.61", 50112, "2025-03-02 18:44:51") in events
    assert ("failed_publickey", "a?b", "2001:db8:5::1f", 41414, "2025-03-02 18:00:00") in events
    assert len(events) == 6 and sum(r["skipped"] for r in got) == 2


def test_user_names(spark):
    df = spark.createDataFrame([("a b",), ("é",), ("x" * 40,), ("",)], "u string")
    assert [r[0] for r in df.select(logs.safe_user(F.col("u"))).collect()] == ["a?b", "?", "x" * 32, "?"]


def test_sensor(spark):
    df = lines(spark, SENSOR)
    got = logs.sensor(df).collect()
    assert sorted((r["kind"], r["command"]) for r in got) == [("command", "hostname"), ("command", "second"), ("failed_password", ""), ("file_download", "http://files.test/one"), ("tunnel", "")]
    assert [(r["dst_ip"], r["dst_port"]) for r in got if r["kind"] == "tunnel"] == [("192.0.2.200", 8443)]
    b = {r["session_id"]: r for r in logs.bindings(df).collect()}
    assert b["q7"]["hassh"] == "f00d" and b["q8"]["duration_ms"] == 1850 and b["q8"]["arch"] == "arm-32"


def test_late_fingerprint_and_replays(spark, tmp_path):
    one = {"eventid": "cowrie.session.connect", "timestamp": "2026-08-10T12:00:00Z", "src_ip": "9.9.9.9", "session": "z"}
    late = {"eventid": "cowrie.client.kex", "timestamp": "2026-08-10T12:00:01Z", "src_ip": "9.9.9.9", "hassh": "hh", "session": "z"}
    log, s, seen = tmp_path / "sensor.json", Store(spark, str(tmp_path / "t"), 2), []
    for i, rows in enumerate(([one], [one, late])):  # the second time the first event is repeated
        with log.open("a") as f:
            f.write("\n".join(map(json.dumps, rows)) + "\n")
        start(spark, str(log), s, str(tmp_path / "cp"), report=seen.append).awaitTermination()
        assert [r["actor_id"] for r in s.events().collect()] == [("cowrie:9.9.9.9", "cowrie:hh")[i]]
        assert [(r["actor_id"], r["event_count"], r["hassh"]) for r in s.actors().collect()] == [(("cowrie:9.9.9.9", "cowrie:hh")[i], 1, ("", "hh")[i])]
    assert [(x["lines"], x["events"], x["skipped"]) for x in seen] == [(1, 1, 0), (2, 1, 1)]
    s.purge("2026-08-11")
    assert s.events().count() == 0 and s.actors().count() == 1 and s.tables.read("bindings").count() == 0


def test_types_and_clips(spark):
    good = {"eventid": "cowrie.login.failed", "timestamp": "2026-08-10T12:00:00.5Z", "src_ip": "9.9.9.9", "session": "s"}
    cases = [good, {**good, "session": 7}, {**good, "username": ["x"]}, {**good, "username": None}, {**good, "src_port": "22"}, {**good, "src_port": {"a": 1}}, {**good, "other": {"session": 7}}, {**good, "input": '"session": 7'}, {**good, "timestamp": "2026-08-10"}, {**good, "eventid": "cowrie.unknown"}]
    got = logs.sensor_records(lines(spark, [json.dumps(c) for c in cases] + ["", "  ", "[1]", "{", "null", json.dumps({**good, "password": "p" * (3 << 20)})])).collect()
    assert [r["event"] for r in got] == [True, False, False, True, True, True, True, True, False, False] + [False] * 6
    assert [r["skipped"] for r in got] == [False, True, True, False, False, False, False, False, True, True] + [False, False, True, True, True, True]
    texts = ["abc", "é" * 10, "aé" * 10, "日" * 10, "x日" * 10, "😀" * 10, ""]
    for cap in (3, 4, 5, 6, 7):
        got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(logs.clipped(F.col("t"), cap)).collect()]
        assert got == [t.encode()[:cap].decode("utf-8", "ignore") for t in texts]


def test_journal_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("\n".join(JOURNAL + JOURNAL) + "\n")
    q = journal_counts(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("jc").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("jc").agg(F.sum("attempts")).collect()[0][0] == 6


def test_upsert_and_dedup(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 1, 20)], "k string, ts int, v int")
    new = spark.createDataFrame([("a", 0, 99), ("b", 1, 21), ("c", 5, 30)], "k string, ts int, v int")
    assert sorted(tuple(r) for r in A.upsert(old, new, ["k"], "ts").collect()) == [("a", 1, 10), ("b", 1, 21), ("c", 5, 30)]


def test_addresses(spark):
    cases = {"8.8.8.8": True, "10.1.2.3": False, "100.64.0.1": False, "192.0.2.9": False, "203.0.113.9": False, "224.0.0.1": False, "1.2.3": False, "2606:4700::1111": True, "::1": False, "2001:db8::1": False, "::ffff:10.0.0.1": False, "64:ff9b::1": False, "2002::1": False, "fe80::1": False, "x": False}
    df = spark.createDataFrame([(k,) for k in cases], "ip string")
    assert {r[0]: r[1] for r in df.select("ip", net.is_public(F.col("ip"))).collect()} == cases
    df = spark.createDataFrame([("100.64.3.4",), ("9.9.9.9",), ("name",), ("1.1.1.1",)], "ip string")
    assert [r[0] for r in df.select(net.in_set(F.col("ip"), ("100.64.0.0/10", "name", "1.1.1.1"))).collect()] == [True, False, True, True]
    hosts = {"a.example.net": "domain", "localhost": "private name", "127.0.0.1.": "private or reserved address", "2130706433": "numeric host", "bit.ly": "link shortener", "8.8.4.4": "ip", "x" * 300: "host too long", "printer.local": "private name"}
    df = spark.createDataFrame([(k,) for k in hosts], "h string")
    assert {r[0]: r[1] for r in df.select("h", net.host_verdict(F.col("h"))).collect()} == hosts
