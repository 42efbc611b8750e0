"""Live roll-up of a journal's addresses as keyed state, bounded an address and in time.

Each address keeps its count, first and last time and at most ``users`` names with their counts; further names go to one
overflow counter. An exact repeat of an event within ``repeats`` does not advance anything. State of an address that was idle
for ``idle`` expires; if the address returns it starts a new generation, and what is stored is the sum over generations, so
nothing is lost. A query without a checkpoint can start from what is stored: totals and the most counted names are taken up
again, the other names go to the overflow counter. Rows of one address within a micro-batch are worked on in turn and cost one
state access for each name among them.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators import aggregates as A
from ..sources.versions import Versions

#: Times are microseconds within the state.
TIMES = ("generation", "first_seen", "last_seen")
OUT = "src_ip string, generation long, event_count long, first_seen long, last_seen long, n_users long, overflow long, users map<string, long>"
TABLES = {
    "totals": ("src_ip string, generation timestamp, event_count long, first_seen timestamp, last_seen timestamp, n_users long, overflow long, bucket int", ["bucket"]),
    "users": ("src_ip string, generation timestamp, username string, n long, bucket int", ["bucket"]),
}
_FIELDS = lambda *pairs: T.StructType([T.StructField(n, t) for n, t in pairs])
_TOTALS = _FIELDS(("generation", T.LongType()), ("event_count", T.LongType()), ("first_seen", T.LongType()), ("last_seen", T.LongType()), ("n_users", T.LongType()), ("overflow", T.LongType()))
_NAME, _COUNT, _DIGEST, _AT = _FIELDS(("username", T.StringType())), _FIELDS(("n", T.LongType())), _FIELDS(("digest", T.StringType())), _FIELDS(("at", T.LongType()))
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Addresses(StatefulProcessor):
    def __init__(self, users: int, idle_ms: int, repeats_ms: int):
        self.most, self.idle, self.repeats = users, idle_ms, repeats_ms

    def init(self, handle) -> None:
        self.totals = handle.getValueState("totals", _TOTALS, self.idle)
        self.users = handle.getMapState("users", _NAME, _COUNT, self.idle)
        self.seen = handle.getMapState("seen", _DIGEST, _AT, self.repeats)

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        fresh, names = 0, Counter()
        first = last = None
        for r in rows:
            digest = hashlib.md5("\x01".join(map(str, (r.at, r.kind, r.src_port, r.username, r.raw))).encode()).hexdigest()
            if self.seen.containsKey((digest,)):
                continue
            self.seen.updateValue((digest,), (r.at,))
            fresh += 1
            first, last = r.at if first is None else min(first, r.at), r.at if last is None else max(last, r.at)
            if r.username and r.username != "?":
                names[r.username] += 1
        if not fresh:
            return
        was = self.totals.get() if self.totals.exists() else (first, 0, first, last, 0, 0)
        generation, count, was_first, was_last, n, overflow = was
        changed = {}
        for name in sorted(names):
            if self.users.containsKey((name,)):
                changed[name] = self.users.getValue((name,))[0] + names[name]
            elif n < self.most:
                n, changed[name] = n + 1, names[name]
            else:
                overflow += names[name]
                continue
            self.users.updateValue((name,), (changed[name],))
        now = (generation, count + fresh, min(was_first, first), max(was_last, last), n, overflow)
        self.totals.update(now)
        yield Row(src_ip=key[0], **dict(zip(_TOTALS.names, now)), users=changed)

    def handleInitialState(self, key, stored: Row, timers) -> None:
        counted = dict(stored.users or [])
        top = sorted(counted.items(), key=lambda kv: (-kv[1], kv[0]))[: self.most]
        rest = sum(counted.values()) - sum(n for _, n in top)
        for name, n in top:
            self.users.updateValue((name,), (n,))
        self.totals.update((stored.generation, stored.event_count, stored.first_seen, stored.last_seen, len(top), stored.overflow + rest))

    def close(self) -> None:
        pass


def milliseconds(spark: SparkSession, text: str) -> int:
    return int(spark.range(1).select(F.expr(f"unix_millis(timestamp'2000-01-01' + interval {text}) - unix_millis(timestamp'2000-01-01')")).first()[0])


class Live:
    """Stored totals and names of journal addresses, kept by a stream."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16, users: int = 256, idle: str = "6 hours", repeats: str = "1 hour"):
        self.spark, self.buckets = spark, buckets
        self.tables = Versions(spark, root, TABLES)
        self.most, self.idle, self.repeats = users, milliseconds(spark, idle), milliseconds(spark, repeats)

    def rolled(self, events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
        """The stream of changed addresses for a stream of journal events (ts, kind, src_ip, src_port, username, raw)."""
        keyed = events.where("coalesce(src_ip, '') <> ''").select("src_ip", F.unix_micros("ts").alias("at"), "kind", "src_port", "username", "raw").groupBy("src_ip")
        start = None if stored is None else stored.withColumns({c: F.unix_micros(c) for c in TIMES}).groupBy("src_ip")
        got = keyed.transformWithState(Addresses(self.most, self.idle, self.repeats), OUT, "Update", "ProcessingTime", initialState=start)
        return got.withColumns({c: F.timestamp_micros(c) for c in TIMES})

    def stored_state(self) -> DataFrame:
        """What a new query starts from: an address's latest generation."""
        latest = self.tables.read("totals").groupBy("src_ip").agg(F.max_by(F.struct("generation", "event_count", "first_seen", "last_seen", "overflow"), "generation").alias("t")).select("src_ip", "t.*")
        users = self.tables.read("users").groupBy("src_ip", "generation").agg(F.map_from_entries(F.collect_list(F.struct("username", "n"))).alias("users"))
        return latest.join(users, ["src_ip", "generation"], "left")

    def upsert(self, changed: DataFrame, batch: int, stream: str) -> None:
        """Takes the stream's rows of a batch over into the buckets of their addresses; a batch that runs again changes nothing."""
        number, state = self.tables.state()
        if state["done"].get(stream, -1) >= batch:
            return
        rows = changed.withColumn("bucket", F.pmod(F.xxhash64("src_ip"), F.lit(self.buckets)).cast("int")).persist()
        new = {"totals": rows.drop("users"), "users": rows.select("src_ip", "generation", F.explode("users").alias("username", "n"), "bucket")}
        replaced = {}
        for t, part in new.items():
            keys = [self.tables.key(t, r[0]) for r in part.select("bucket").distinct().collect()]
            stored = self.tables.read(t, keys, state)
            by = ["src_ip", "generation"] + (["username"] if t == "users" else [])
            # counts only grow, so the larger one is the newer
            replaced[t] = self.tables.write(t, A.upsert(stored, part.select(*stored.columns), by, "n" if t == "users" else "event_count"))
        self.tables.change(number, state, replaced, done={stream: batch})
        rows.unpersist()

    def start(self, events: DataFrame, checkpoint: str, stream: str = "journal", stored: DataFrame | None = None, seconds: int | None = None) -> StreamingQuery:
        """Runs the roll-up; ``seconds`` None takes what is there and ends."""
        with settings(self.spark, {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}):
            w = self.rolled(events, stored).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: self.upsert(df, i, stream))
            return (w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)).start()

    def totals(self) -> DataFrame:
        """(src_ip, event_count, first_seen, last_seen, overflow) over all generations."""
        return self.tables.read("totals").groupBy("src_ip").agg(F.sum("event_count").alias("event_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("overflow").alias("overflow"))

    def users(self) -> DataFrame:
        return self.tables.read("users").groupBy("src_ip", "username").agg(F.sum("n").alias("n"))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that hold while a query starts, which copies them."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
