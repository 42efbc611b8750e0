"""Folder plans and the submission budget, case by case."""

import hashlib
import os

from pyspark.sql import functions as F

from sentrymill.operators.budget import share_plan
from sentrymill.sources import folders

ART = "url string, status string, ts timestamp, session_id string"


def plan(df):
    return {r["url"]: r.asDict() for r in df.collect()}


def test_downloads(spark, tmp_path):
    for name, content in {"new": b"abc", "none": b"", "big": b"x" * 50, "old": b"same", "gone": b"", "a b%20c+": b"odd"}.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "folder").mkdir()
    known = spark.createDataFrame([("cowrie-download:old", "fetched", None, ""), ("cowrie-download:gone", "empty", None, "")], ART).withColumn("ts", F.lit("2020-01-01").cast("timestamp"))
    got = plan(folders.downloads(folders.listed(spark, str(tmp_path)), known, "/e/", cap=40))
    assert {u.split(":")[1]: (r["action"], r["status"]) for u, r in got.items()} == {"new": ("record", "fetched"), "none": ("record", "empty"), "big": ("skip", "oversized"), "old": ("touch", "fetched"), "gone": ("touch", "empty"), "a b%20c+": ("record", "fetched")}
    assert got["cowrie-download:new"]["sha256"] == hashlib.sha256(b"abc").hexdigest() and got["cowrie-download:new"]["local_path"] == "/e/new" and got["cowrie-download:none"]["local_path"] == ""
    future = known.withColumn("ts", F.lit("2999-01-01").cast("timestamp"))  # an older file does not move the time back
    assert "cowrie-download:old" not in plan(folders.downloads(folders.listed(spark, str(tmp_path)), future, "/e"))
    assert plan(folders.downloads(folders.listed(spark, str(tmp_path)), known, "/e", cap=0))["cowrie-download:big"]["status"] == "fetched"
    assert folders.downloads(folders.listed(spark, str(tmp_path / "missing")), known, "/e").count() == 0
    assert folders.listed(spark, str(tmp_path), since="2999-01-01").count() == 0


def test_unopened_files(spark, tmp_path):
    (tmp_path / "big").write_bytes(b"x" * 100)
    text = folders.digested(folders.listed(spark, str(tmp_path)), 10)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,10)" in text  # the bound reaches the reader


def test_event_paths_are_base_names(spark, tmp_path):
    (tmp_path / "passwd").write_bytes(b"harmless")
    events = spark.createDataFrame([(1, "file_download", "/etc/passwd", "", "", "1.1.1.1"), (2, "file_download", "../../passwd", "http://u", "ab" * 32, "1.1.1.1"), (3, "file_download", "absent", "http://v", "", "1.1.1.1"), (4, "file_upload", "passwd", "http://w", "", "1.1.1.1")], "id long, kind string, filename string, command string, sha256 string, src_ip string")
    events = events.withColumns({"ts": F.lit("2024-02-02").cast("timestamp"), "session_id": F.lit("s"), "actor_id": F.lit("a")})
    got = plan(folders.download_events(events, folders.listed(spark, str(tmp_path)), spark.createDataFrame([], ART), "/e"))
    assert set(got) == {"cowrie-event:1", "http://u"} and got["http://u"]["local_path"] == "/e/" + "ab" * 32 and got["cowrie-event:1"]["local_path"] == "/e/passwd"


def test_recordings_bind_late_and_once(spark, tmp_path):
    names = {c: hashlib.sha256(c.encode()).hexdigest() for c in "abcd"}
    for c in "abcd":
        (tmp_path / names[c]).write_bytes(b"" if c == "d" else b"\x03\0\0\0\0\0\0\0\x03\0\0\0\x01\0\0\0\0\0\0\0\0\0\0\0ls\n")
    (tmp_path / "20240101-in-progress.log").write_bytes(b"x")
    lines = spark.createDataFrame([('{"eventid":"cowrie.log.closed","shasum":"%s","session":"s-%s","timestamp":"2024-01-0%dT00:00:00Z"}' % (names[c].upper(), c, i + 1),) for i, c in enumerate("aabc")] + [("cowrie.log.closed {",), ('{"eventid":"cowrie.log.closed","shasum":"","session":"x"}',)], "value string")
    known = spark.createDataFrame([("cowrie-tty:" + names["b"], "fetched", None, ""), ("cowrie-tty:" + names["c"], "fetched", None, "kept")], ART)
    got = plan(folders.recordings(folders.listed(spark, str(tmp_path)), known, folders.recording_index(lines), "/e"))
    short = {next(c for c in "abcd" if names[c] in u): (r["action"], r["status"], r["session_id"], r["transcript"]) for u, r in got.items()}
    assert short == {"a": ("record", "fetched", "s-a", "ls\n"), "b": ("bind", "fetched", "s-b", ""), "d": ("record", "empty", "", "")}


def test_retention_of_source_files(spark, tmp_path):
    for name, age in (("old", 10), ("older odd %41", 20), ("new", 0)):
        (tmp_path / name).write_bytes(b"x")
        os.utime(tmp_path / name, (1.7e9 - age * 86400,) * 2)
    files = folders.expired(folders.listed(spark, str(tmp_path)), str(__import__("datetime").datetime.fromtimestamp(1.7e9 - 5 * 86400)))
    assert {r["name"] for r in files.collect()} == {"old", "older odd %41"}
    assert folders.remove(spark, files) == 2 and [p.name for p in tmp_path.iterdir()] == ["new"]


def test_the_budget_bounds_submissions_not_candidates(spark):
    candidates = spark.createDataFrame([(f"c{i:02d}", i not in (1, 4), "refused", i) for i in range(12)], "k string, ok boolean, reason string, place int")
    indicators = spark.createDataFrame([(f"c{i:02d}", f"v{j}") for i in range(12) for j in (i, i + 1)] + [("c00", "v0")], "k string, value string")
    ledger = spark.createDataFrame([("v2",), ("v3",), ("v3",)], "value string")
    run = lambda n: [tuple(r) for r in share_plan(candidates, indicators, ledger, "k", [F.col("place")], n).orderBy("k").collect()]
    got = run(3)
    assert [r[1] for r in got] == ["submit", "skip", "skip", "submit", "skip", "submit"] + ["unexamined"] * 6
    assert [r[2] for r in got[:6]] == ["", "refused", "all indicators already submitted", "", "refused", ""] and [r[4] for r in got if r[4]] == [1, 2, 3] and got[0][3] == 2 and got[3][3] == 1
    assert [r[1] for r in run(0)].count("submit") == 9 and "unexamined" not in [r[1] for r in run(9)[:12] if r[1] != "skip"]
    assert share_plan(candidates.limit(0), indicators, ledger, "k", [F.col("place")], 3).count() == 0
