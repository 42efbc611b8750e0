"""The store: batches that touch only their own partitions, replays, conflicts, late fingerprints, replacement and purge."""

import pytest
from pyspark.sql import functions as F

from sentrymill.operators import aggregates as A
from sentrymill.sources import projection
from sentrymill.sources.versions import Conflict, Versions
from sentrymill.streaming.store import Store

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def events(spark):
    return projection.events(spark, SF).drop("actor_id").withColumn("hassh", F.lit("")).cache()


def actors(store):
    return rows(store.actors())


def full(spark, tmp_path, events, name="full", bindings=None):
    s = Store(spark, str(tmp_path / name), 2)
    s.ingest(events, bindings)
    return s


def test_a_batch_reads_no_stored_event_but_digests_of_its_days(spark, tmp_path, events, monkeypatch):
    s, seen = Store(spark, str(tmp_path / "s"), 4), []
    cut = F.lit("2024-01-20").cast("timestamp")
    s.ingest(events.where(F.col("ts") < cut), stream="log", batch=0)
    before = s.tables.state()[1]
    read = Versions.read
    monkeypatch.setattr(Versions, "read", lambda self, table, keys=None, state=None: (seen.append((table, keys)), read(self, table, keys, state))[1])
    batch = events.where(F.col("ts") >= cut).limit(40).cache()
    assert s.ingest(batch, stream="log", batch=1)
    days = {str(r[0]) for r in batch.select(F.to_date("ts")).distinct().collect()}
    for table, keys in seen:
        assert keys is not None and (table != "events" or {k.rsplit("=", 1)[1] for k in keys} == days)
    after = s.tables.state()[1]
    ids = {r[0] for r in batch.select(F.concat("source", F.lit(":"), "src_ip")).distinct().collect()}
    buckets = {(r["source"], r["bucket"]) for r in s.tables.read("actors").where(F.col("actor_id").isin(*ids)).select("source", "bucket").distinct().collect()}
    changed = {k for k in after["tables"]["actors"] if after["tables"]["actors"][k] != before["tables"]["actors"].get(k)}
    assert changed == {s.tables.key("actors", *b) for b in buckets}
    monkeypatch.undo()
    assert actors(s) == actors(full(spark, tmp_path, events.where(F.col("ts") < cut).unionByName(batch)))


def test_replays_change_nothing(spark, tmp_path, events):
    s = full(spark, tmp_path, events, "s")
    state = actors(s), rows(s.events())
    assert s.ingest(events, stream="log", batch=3) and not s.ingest(events, stream="log", batch=3) and not s.ingest(events.limit(3), stream="log", batch=2)
    s.ingest(events.limit(200).unionByName(events.limit(100)))
    assert (actors(s), rows(s.events())) == state
    assert s.tables.compact("events", 1) > 0 and rows(s.events()) == state[1]
    assert s.tables.vacuum(1) > 0 and (actors(s), rows(s.events())) == state


def test_late_fingerprints_move_events_and_actors(spark, tmp_path, events):
    sessions = [r[0] for r in events.where("source = 'cowrie'").select("session_id").distinct().orderBy("session_id").limit(25).collect()]
    bound = spark.createDataFrame([(x, f"h{i % 3}", None, None) for i, x in enumerate(sessions)], "session_id string, hassh string, duration_ms long, arch string").withColumn("observed_at", F.lit("2024-01-05").cast("timestamp"))
    s = full(spark, tmp_path, events, "s")
    assert s.events().where("hassh <> ''").count() == 0
    s.ingest(events.limit(0), bound)
    other = full(spark, tmp_path, events, "o", bound)
    assert actors(s) == actors(other) and rows(s.events()) == rows(other.events()) and s.events().where("hassh <> ''").count() > 0
    for t in ("actor_users", "actor_ips", "unbound"):
        assert rows(s.tables.read(t)) == rows(other.tables.read(t))
    s.ingest(events.limit(0), bound.withColumn("hassh", F.lit("other")).withColumn("arch", F.lit("x86")))  # the first fingerprint stays
    assert actors(s) == actors(other) and s.tables.read("bindings").where("arch = 'x86'").count() == len(sessions)


def test_conflicting_writers(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"), {"t": ("k string, n int", ["k"])})
    number, state = v.state()
    a, b = (v.write("t", spark.createDataFrame([(k, 1)], "k string, n int")) for k in "ab")
    v.change(number, state, added={"t": a})
    with pytest.raises(Conflict):
        v.change(number, state, added={"t": b})
    assert rows(v.read("t")) == [("a", 1)]
    v.change(*v.state(), replaced={"t": b})
    assert rows(v.read("t")) == [("a", 1), ("b", 1)] and rows(v.read("t", [v.key("t", "b")])) == [("b", 1)]
    v.change(*v.state(), gone={"t": [v.key("t", "a")]})
    assert rows(v.read("t")) == [("b", 1)] and len(v.numbers()) == 3


def test_replace_rebuild_and_purge(spark, tmp_path, events):
    s = full(spark, tmp_path, events, "s")
    some = events.where("source = 'journal' and id % 2 = 0")
    s.replace("journal", some)
    want = actors(full(spark, tmp_path, events.where("source = 'cowrie'").unionByName(some), "o"))
    assert actors(s) == want
    s.rebuild("journal")
    assert actors(s) == want
    s.rebuild("journal", events)
    assert actors(s) == actors(full(spark, tmp_path, events, "p"))
    s.cache(spark.createDataFrame([("1.1.1.1", "geo", "a")], "ip string, provider string, payload string").withColumn("fetched_at", F.lit("2024-01-02").cast("timestamp")))
    s.cache(spark.createDataFrame([("1.1.1.1", "geo", "b"), ("1.1.1.1", "vt", "c")], "ip string, provider string, payload string").withColumn("fetched_at", F.lit("2024-01-20").cast("timestamp")))
    n = s.actors().count()
    s.purge("2024-01-15 10:00:00")
    assert rows(s.events().select("id")) == rows(events.where("ts >= timestamp'2024-01-15 10:00:00'").select("id"))
    assert s.actors().count() == n and rows(s.tables.read("caches").select("provider", "payload")) == [("b", "geo"), ("c", "vt")]
    s.purge("2025-01-01")
    assert s.events().count() == 0 and s.tables.read("caches").count() == 0 and s.actors().count() == n


def test_administrators(spark, tmp_path, events):
    admin = events.where("source = 'journal'").first()["src_ip"]
    s = Store(spark, str(tmp_path / "s"), 2, (admin,))
    s.ingest(events)
    assert s.actors().where(F.col("primary_ip") == admin).where("source = 'journal'").count() == 0
    assert s.events().where(F.col("src_ip") == admin).where("source = 'journal' and kind = 'accepted'").count() == 0
    assert s.events().where(F.col("src_ip") == admin).where("actor_id <> ''").count() == 0


def test_an_empty_store(spark, tmp_path, events):
    s = Store(spark, str(tmp_path / "none"))
    assert s.events().count() == 0 and s.actors().count() == 0
    s.purge("2025-01-01")
    assert s.ingest(events.limit(0)) and s.actors().count() == 0 and A.fold(s.tables.read("actors")).count() == 0


def test_no_join_gathers_stored_rows_in_the_driver(spark, tmp_path, events, monkeypatch):
    """Files are small beside the rows they hold: what grows with the events is joined by merging, however little there is."""
    s, plans, write = Store(spark, str(tmp_path / "s"), 2), [], Versions.write
    monkeypatch.setattr(Versions, "write", lambda self, table, rows: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), write(self, table, rows))[1])
    bound = events.where("session_id <> ''").select("session_id", F.lit("h").alias("hassh"), F.lit(None).cast("long").alias("duration_ms"), F.lit("").alias("arch"), F.col("ts").alias("observed_at")).dropDuplicates(["session_id"])
    s.ingest(events.where("id % 2 = 0"))
    s.ingest(events.where("id % 2 = 1"), bound)
    s.replace("journal", events)
    plans.append(s.actors()._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not any("BroadcastHashJoin" in p for p in plans)
