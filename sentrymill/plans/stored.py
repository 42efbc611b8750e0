"""Queries that write the store of telemetry, change it and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import scratch
from ..streaming import journal_state, live
from ..streaming.store import Store, sorted_side
from .base import D3, D7, query
from .intel import ACTORS, journal_lines, sensor_log

#: Sessions whose fingerprint only comes with the last batch.
LATE = "length(session_id) % 2 = 0"


def store(spark: SparkSession, buckets: int = 8) -> Store:
    return Store(spark, f"{scratch.shared_dir(spark)}/store-{uuid.uuid4().hex}", buckets)


def at(e: DataFrame, text: str):
    return F.lit(text).cast(e.schema["ts"].dataType)


def bindings(e: DataFrame) -> DataFrame:
    """What side records say of the events' sessions."""
    got = e.where("session_id <> '' and hassh <> ''").groupBy("session_id").agg(F.min_by("hassh", F.struct("ts", "id")).alias("hassh"), F.min("ts").cast("timestamp").alias("observed_at"))
    return got.select("session_id", "hassh", F.lit(None).cast("long").alias("duration_ms"), F.lit(None).cast("string").alias("arch"), "observed_at")


def filled(spark: SparkSession, e: DataFrame) -> Store:
    """A store that took the events in three batches, the second one twice, with some fingerprints coming last."""
    s = store(spark)
    bare, bound = e.withColumn("hassh", F.lit("")).drop("actor_id"), bindings(e)
    parts = [bare.where(F.col("ts") < at(e, D7)), bare.where((F.col("ts") >= at(e, D7)) & (F.col("ts") < at(e, D3))), bare.where(F.col("ts") >= at(e, D3))]
    early, late = bound.where(f"not ({LATE})"), bound.where(LATE)
    s.ingest(parts[0], early, "log", 0)
    s.ingest(parts[1], None, "log", 1)
    s.ingest(parts[1], None, "log", 1)
    s.ingest(parts[1].unionByName(parts[2]), late, "log", 2)
    return s


#: Events as the store holds them: stamped by session, and known by the columns that make two events the same.
STAMPED = """bound AS (SELECT session_id, arg_min(hassh, (ts, id)) AS h FROM hp WHERE session_id <> '' AND hassh <> '' GROUP BY 1),
ranked AS (SELECT hp.*, coalesce(h, '') AS h, row_number() OVER (PARTITION BY ts, source, kind, src_ip, username, command, CASE WHEN source = 'journal' THEN CAST(src_port AS STRING) ELSE session_id END ORDER BY id) AS copy FROM hp LEFT JOIN bound USING (session_id)),
kept AS (SELECT * REPLACE (h AS hassh, concat(source, ':', CASE WHEN source = 'cowrie' AND h <> '' THEN h ELSE src_ip END) AS actor_id) FROM ranked WHERE copy = 1)"""
STORED_ACTORS = STAMPED + ", " + ACTORS.replace("FROM hp", "FROM kept")


@query("stored_actors", "SELECT actor_id, primary_ip, strftime(a, {stamp}) AS first_seen, strftime(b, {stamp}) AS last_seen, event_count, unique_users, hassh, playbook, intent, probe_score, confidence, flags, username_hash FROM actors", STORED_ACTORS)
def stored_actors(spark, e, d):
    """Actors as the store holds them after its batches equal those built from all events at once."""
    return filled(spark, e).actors().select("actor_id", "primary_ip", A.stamp("first_seen").alias("first_seen"), A.stamp("last_seen").alias("last_seen"), "event_count", "unique_users", "hassh", "playbook", "intent", "probe_score", "confidence", "flags", "username_hash")


@query(
    "stored_maps",
    "SELECT actor_id, 'user' AS what, username AS value, count(*) AS n, '' AS first_seen FROM kept WHERE username NOT IN ('', '?') GROUP BY 1, 3 UNION ALL SELECT actor_id, 'ip', src_ip, count(*), strftime(min(ts), {stamp}) FROM kept WHERE src_ip <> '' GROUP BY 1, 3",
    STAMPED,
)
def stored_maps(spark, e, d):
    """The user and address maps of stored actors."""
    t = filled(spark, e).tables
    users = t.read("actor_users").select("actor_id", F.lit("user").alias("what"), F.col("username").alias("value"), "n", F.lit("").alias("first_seen"))
    return users.unionByName(t.read("actor_ips").select("actor_id", F.lit("ip").alias("what"), F.col("ip").alias("value"), "n", A.stamp("first_seen").alias("first_seen")))


@query("stored_events", "SELECT id, source, kind, session_id, hassh, actor_id FROM kept", STAMPED)
def stored_events(spark, e, d):
    """Stored events: each identity once, late fingerprints in place."""
    return filled(spark, e).events().select("id", "source", "kind", "session_id", "hassh", "actor_id")


_REPLACED = STAMPED.replace("kept AS (", "whole AS (") + ", kept AS (SELECT * FROM whole WHERE source <> 'journal' OR ts >= {d3})"


@query("stored_replace", "SELECT k.actor_id, any_value(k.source) AS source, count(*) AS n, strftime(min(ts), {stamp}) AS first_ts FROM kept k GROUP BY 1", _REPLACED)
def stored_replace(spark, e, d):
    """One source replaced whole, events and actors; the other stays."""
    s = filled(spark, e)
    s.replace("journal", A.since(e, D3).where("source = 'journal'"))
    events = s.events().groupBy("actor_id").agg(F.first("source").alias("source"), F.count("*").alias("n"), A.stamp(F.min("ts")).alias("first_ts"))
    return events.join(sorted_side(s.tables.read("actors").select("actor_id", F.col("event_count").alias("n"))), ["actor_id", "n"]).select("actor_id", "source", "n", "first_ts")


@query(
    "stored_purge",
    "SELECT 'event' AS what, CAST(id AS STRING) AS value FROM kept WHERE ts >= {d7} + INTERVAL 7 HOUR UNION ALL SELECT 'binding', session_id FROM (SELECT session_id, min(ts) AS seen FROM hp WHERE session_id <> '' AND hassh <> '' GROUP BY 1) WHERE seen >= {d7} + INTERVAL 7 HOUR UNION ALL SELECT 'cache', src_ip FROM (SELECT src_ip, max(ts) AS seen FROM hp GROUP BY 1) WHERE seen >= {d7} + INTERVAL 7 HOUR UNION ALL SELECT DISTINCT 'actor', actor_id FROM kept",
    STAMPED,
)
def stored_purge(spark, e, d):
    """What a purge leaves: events, bindings and cached lookups from the moment on, and all actors."""
    s = filled(spark, e)
    s.cache(e.groupBy(F.col("src_ip").alias("ip")).agg(F.max("ts").cast("timestamp").alias("fetched_at")).withColumn("provider", F.lit("geo")).withColumn("payload", F.lit("{}")))
    s.purge(D7.replace(" 00:", " 07:"))
    t, of = s.tables, lambda df, what, c: df.select(F.lit(what).alias("what"), F.col(c).cast("string").alias("value"))
    return of(t.read("events"), "event", "id").unionByName(of(t.read("bindings"), "binding", "session_id")).unionByName(of(t.read("caches"), "cache", "ip")).unionByName(of(t.read("actors"), "actor", "actor_id"))


@query(
    "followed_logs",
    "SELECT actor_id, source, count(*) AS n, strftime(min(ts), {stamp}) AS first_seen, strftime(max(ts), {stamp}) AS last_seen FROM (SELECT * REPLACE (CASE WHEN source = 'journal' THEN date_trunc('second', ts) ELSE ts END AS ts, concat(source, ':', CASE WHEN source = 'cowrie' AND hassh <> '' THEN hassh ELSE src_ip END) AS actor_id) FROM hp) GROUP BY 1, 2",
)
def followed_logs(spark, e, d):
    """Actors of a store that followed a folder of sensor logs and one of journals, in turn."""
    folder, s = f"{scratch.shared_dir(spark).removeprefix('file://')}/logs-{uuid.uuid4().hex}", store(spark)
    for source, lines in (("cowrie", sensor_log(e)), ("journal", journal_lines(e))):
        lines.write.text(f"{folder}/{source}")
        live.start(spark, f"{folder}/{source}/part-*", s, f"{folder}/state-{source}", source=source, fit=True).awaitTermination()
    return s.actors().select("actor_id", "source", F.col("event_count").alias("n"), A.stamp("first_seen").alias("first_seen"), A.stamp("last_seen").alias("last_seen"))


@query(
    "skipped_lines",
    "SELECT source, 2 * count(*) + 1 AS lines, count(*) AS events, count(*) AS skipped FROM hp GROUP BY 1",
)
def skipped_lines(spark, e, d):
    """How many lines a pass over a log saw, kept and skipped: each event's line, the same line spoilt, and a blank one. Counted while the lines are stored."""
    out = []
    for source, lines, spoilt in (("cowrie", sensor_log(e), F.concat(F.lit("["), "value")), ("journal", journal_lines(e), F.regexp_replace("value", "from [0-9.]+", "from nowhere"))):
        both = lines.unionByName(lines.select(spoilt.alias("value"))).unionByName(spark.createDataFrame([("",)], "value string"))
        got = live.take(store(spark), both, source=source, fit=True)
        out.append((source, got["lines"], got["events"], got["skipped"]))
    return spark.createDataFrame(out, "source string, lines long, events long, skipped long")


@query(
    "live_journal",
    "SELECT src_ip, '' AS username, count(*) AS n, strftime(min(ts), {stamp}) AS first_seen, strftime(max(ts), {stamp}) AS last_seen FROM hp WHERE source = 'journal' GROUP BY 1 UNION ALL SELECT src_ip, username, count(*), '', '' FROM hp WHERE source = 'journal' AND username NOT IN ('', '?') GROUP BY 1, 2",
)
def live_journal(spark, e, d):
    """Totals and names of journal addresses, rolled up by a stream that stopped and went on, with some events coming twice."""
    folder = f"{scratch.shared_dir(spark)}/live-{uuid.uuid4().hex}"
    live = journal_state.Live(spark, f"{folder}/tables", 4)
    rows = e.where("source = 'journal'").select(F.col("ts").cast("timestamp").alias("ts"), "kind", "src_ip", "src_port", "username", F.col("id").cast("string").alias("raw"))
    cut = F.lit(D7).cast("timestamp")
    for part in (rows.where(F.col("ts") < cut), rows.where((F.col("ts") >= cut) | (F.col("username") == "root"))):
        part.write.mode("append").parquet(f"{folder}/in")
        live.start(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), f"{folder}/state").awaitTermination()
    totals = live.totals().select("src_ip", F.lit("").alias("username"), F.col("event_count").alias("n"), A.stamp("first_seen").alias("first_seen"), A.stamp("last_seen").alias("last_seen"))
    return totals.unionByName(live.users().select("src_ip", "username", "n", F.lit("").alias("first_seen"), F.lit("").alias("last_seen")))
