"""The capture queue: claims that do not overlap, lost claims, late results and back-off; cached verdicts by case."""

import pytest
from pyspark.sql import functions as F

from sentrymill.functions import caches
from sentrymill.streaming.queue import Queue

RESULT = "url string, attempt int, ok boolean, detail string, local_path string, sha256 string, size_bytes long"


@pytest.fixture
def queue(spark, tmp_path):
    q = Queue(spark, str(tmp_path / "q"), 2)
    urls = spark.createDataFrame([(f"u{i}", f"2024-01-01 00:00:0{i}") for i in (3, 1, 2, 0)] + [("u1", "2024-01-01 00:00:09")], "url string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    q.add(urls)
    q.add(urls)
    return q


def claimed(df):
    return sorted(r["url"] for r in df.collect())


def row(queue, url):
    return queue.rows().where(F.col("url") == url).first()


def test_claims_do_not_overlap_and_come_back(spark, queue):
    assert queue.rows().count() == 4
    assert claimed(queue.claim("a", "2024-01-02 00:00:00", 60, 2)) == ["u0", "u1"]
    assert claimed(queue.claim("b", "2024-01-02 00:00:30", 60, 9)) == ["u2", "u3"]
    version = queue.tables.state()[0]
    assert claimed(queue.claim("c", "2024-01-02 00:00:59", 60, 9)) == [] and queue.tables.state()[0] == version
    assert claimed(queue.claim("c", "2024-01-02 00:01:00", 60, 9)) == ["u0", "u1"]


def test_late_results_change_nothing_and_failures_wait_longer(spark, queue):
    at = "2024-01-02 00:00:00"
    for attempt, wait in enumerate((30, 60, 120, 240), 1):
        got = queue.claim("a", at, 60, 1).first()
        assert (got["url"], got["attempt"]) == ("u0", attempt)
        result = spark.createDataFrame([("u0", attempt, False, "no", "", "", 0)], RESULT)
        assert queue.complete(result, at) == 0 and queue.complete(result, at) == 1
        r = row(queue, "u0")
        assert (r["status"], r["attempt_count"]) == ("failed", attempt) and int((r["next_attempt_at"] - r["created_at"]).total_seconds()) - wait == int(spark.range(1).select(F.unix_timestamp(F.lit(at).cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))).first()[0])
        at = str(r["next_attempt_at"])
    queue.claim("a", at, 60, 1)
    assert queue.complete(spark.createDataFrame([("u0", 5, False, "no", "", "", 0)], RESULT), at) == 0
    assert row(queue, "u0")["next_attempt_at"] is None and "u0" not in claimed(queue.due("2030-01-01 00:00:00"))


def test_done_and_unknown(spark, queue):
    queue.claim("a", "2024-01-02 00:00:00", 60, 1)
    assert queue.complete(spark.createDataFrame([("u0", 1, True, "", "/q/u0", "ab", 7), ("other", 1, True, "", "", "", 0)], RESULT), "2024-01-02 00:00:10") == 1
    r = row(queue, "u0")
    assert (r["status"], r["attempt_count"], r["local_path"], r["size_bytes"], r["next_attempt_at"]) == ("fetched", 1, "/q/u0", 7, None)
    assert queue.rows().count() == 4 and "u0" not in claimed(queue.due("2030-01-01 00:00:00"))


def test_cached_verdicts(spark):
    sha = "AB" * 32
    row = lambda payload, at="2024-01-30 00:00:00": [(sha, payload, at)]
    cases = [
        ([], ("none", True, None)), (row("{"), ("none", True, None)), (row('{"cacheVersion":2,"found":true}'), ("none", True, None)), (row('{"found":true}'), ("none", True, None)),
        (row('{"cacheVersion":1,"found":true,"verdict":"malicious"}'), ("fresh", False, True)), (row('{"cacheVersion":1,"found":true,"fetchedAt":"2023-12-01T00:00:00Z"}'), ("stale", True, True)),
        (row('{"cacheVersion":1,"found":false}', "2024-01-25 00:00:00"), ("fresh", False, False)), (row('{"cacheVersion":1,"found":false}', "2024-01-20 00:00:00"), ("stale", True, False)),
        (row('{"cacheVersion":1,"found":true}', "2024-01-01 00:00:00") + row('{"cacheVersion":9}', "2024-01-02 00:00:00"), ("none", True, None)),
    ]
    for cache, want in cases:
        df = spark.createDataFrame(cache, "sha256 string, payload string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
        r = caches.verdicts(spark.createDataFrame([(sha.lower(),), (" " + sha,), ("x",), (None,)], "sha256 string"), df, "2024-01-31 00:00:00").collect()
        assert len(r) == 1 and (r[0]["state"], r[0]["ask"], r[0]["found"]) == want
