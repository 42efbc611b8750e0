"""The stored telemetry: events, session bindings, actors with their user and address maps, and cached lookups.

A batch of events changes what it touches and nothing else: identities are compared with the digests of the batch's days,
bindings and actors are folded into the buckets of the batch's sessions and actors, and one version makes all of it visible
together (see ``sources.versions``). A batch that is run again changes nothing. No stored event is read for the fold; only
when a fingerprint arrives after events of its session were stored are the two actors concerned rebuilt from their events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..sources.logs import without_admins
from ..sources.versions import Versions

EVENTS = "id long, ts timestamp, source string, kind string, src_ip string, src_port int, username string, password string, session_id string, hassh string, ssh_client string, command string, sha256 string, filename string, dst_ip string, dst_port int, actor_id string, digest binary, dt date"
ACTORS = "actor_id string, source string, first_seen timestamp, last_seen timestamp, event_count long, mask int, hassh string, first struct<ts:timestamp,id:long,src_ip:string>, client struct<ts:timestamp,id:long,ssh_client:string>, bucket int"
TABLES = {
    "events": (EVENTS, ["source", "dt"]),
    "bindings": ("session_id string, hassh string, duration_ms long, arch string, observed_at timestamp, bucket int", ["bucket"]),
    # partitions of events that hold a session without its fingerprint, and the actor that the session counts for until then
    "unbound": ("session_id string, actor_id string, dt date, bucket int", ["bucket"]),
    "actors": (ACTORS, ["source", "bucket"]),
    "actor_users": ("actor_id string, source string, username string, n long, bucket int", ["source", "bucket"]),
    "actor_ips": ("actor_id string, source string, ip string, n long, first_seen timestamp, last_seen timestamp, bucket int", ["source", "bucket"]),
    "caches": ("ip string, provider string, payload string, fetched_at timestamp, bucket int", ["bucket"]),
}
#: What makes two events the same, by source.
IDENTITY = {"cowrie": ["ts", "kind", "src_ip", "session_id", "username", "command"], "journal": ["ts", "kind", "src_ip", "src_port", "username", "command"]}


def digest() -> Column:
    """128 bits of an event's identity."""
    of = lambda cols: F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in cols])
    text = F.when(F.col("source") == "journal", of(IDENTITY["journal"])).otherwise(of(IDENTITY["cowrie"]))
    return F.substring(F.unhex(F.sha2(F.concat("source", F.lit("\x01"), text).cast("binary"), 256)), 1, 16)


def actor_of(hassh: Column) -> Column:
    return F.concat("source", F.lit(":"), F.when((F.col("source") == "cowrie") & (hassh != ""), hassh).otherwise(F.col("src_ip")))


def sorted_side(rows: DataFrame) -> DataFrame:
    """Rows that grow with the events, for a merge join at every size: files so small that Spark would gather them in the driver
    hold many times as much once they are read."""
    return rows.hint("merge")


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, admins: tuple[str, ...] = (), fit: bool = False):
        self.spark, self.buckets, self.admins, self.fit = spark, buckets, admins, fit
        self.tables = Versions(spark, root, TABLES)

    def bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int").alias("bucket")

    def shaped(self, events: DataFrame) -> DataFrame:
        """Events in the store's columns, the first of each identity; missing columns are empty, a missing id follows from the digest."""
        got = events
        for c, t in ((f.split() for f in EVENTS.split(", "))):
            if c not in got.columns:
                got = got.withColumn(c, F.lit(None if t in ("long", "binary", "date", "timestamp") else 0 if t == "int" else "").cast(t))
        got = got.withColumn("digest", digest()).withColumn("dt", F.to_date("ts")).withColumn("id", F.coalesce("id", F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")))
        rest = [f.split()[0] for f in EVENTS.split(", ") if f.split()[0] != "digest"]
        return got.groupBy("digest").agg(F.min_by(F.struct(*rest), "id").alias("_e")).select("_e.*", "digest").select(*[f.split()[0] for f in EVENTS.split(", ")])

    # -- what a set of events adds to actors

    def deltas(self, events: DataFrame) -> dict[str, DataFrame]:
        """Mergeable rows of the events' actors, each added up before it is dealt."""
        known, source = events.where("actor_id <> ''"), F.first("source").alias("source")
        base = A.actor_state(known).withColumn("bucket", self.bucket("actor_id"))
        users = known.where("username not in ('', '?')").groupBy("actor_id", "username").agg(source, F.count("*").alias("n")).withColumn("bucket", self.bucket("actor_id"))
        ips = known.where("src_ip <> ''").groupBy("actor_id", F.col("src_ip").alias("ip")).agg(source, F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")).withColumn("bucket", self.bucket("actor_id"))
        return {"actors": base, "actor_users": users, "actor_ips": ips}

    @staticmethod
    def merged(table: str, rows: DataFrame) -> DataFrame:
        if table == "actors":
            return A.fold(rows, keep=["bucket"])
        if table == "actor_users":
            return rows.groupBy("actor_id", "username").agg(F.first("source").alias("source"), F.sum("n").alias("n"), F.first("bucket").alias("bucket"))
        return rows.groupBy("actor_id", "ip").agg(F.first("source").alias("source"), F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.first("bucket").alias("bucket"))

    def touched(self, table: str, rows: DataFrame) -> list[str]:
        """The partitions that rows go to: sources times buckets at most."""
        by = TABLES[table][1]
        return [self.tables.key(table, *r) for r in rows.select(*[F.col(c).cast("string") for c in by]).distinct().collect()]

    def folded(self, state: dict, events: DataFrame, rebuilt: DataFrame | None = None, again: DataFrame | None = None) -> dict[str, dict[str, list[str]]]:
        """New folders of all partitions whose actors the events touch. Actors in ``rebuilt`` (actor_id) are not merged with what
        is stored but made anew from ``again``, which has all their events."""
        out = {}
        for table, delta in self.deltas(events).items():
            keys = self.touched(table, delta if rebuilt is None else delta.select("source", "bucket").unionByName(rebuilt.select(F.split("actor_id", ":")[0].alias("source"), self.bucket("actor_id"))))
            stored = self.tables.read(table, keys, state)
            if rebuilt is not None:
                stored, delta = stored.join(sorted_side(rebuilt), "actor_id", "left_anti"), delta.join(sorted_side(rebuilt), "actor_id", "left_anti").unionByName(self.deltas(again)[table])
            # a partition that loses its last row gets no folder, so every touched key is named
            out[table] = {k: [] for k in keys} | self.tables.write(table, self.merged(table, stored.unionByName(delta.select(*stored.columns))))
        return out

    # -- changes

    def ingest(self, events: DataFrame, bindings: DataFrame | None = None, stream: str = "", batch: int = 0) -> bool:
        """Appends a batch of events and folds them into their actors; False if the stream's batch was taken before.

        ``bindings``: (session_id, hassh, duration_ms, arch, observed_at) of side records; of a session's fingerprints, durations
        and architectures the first seen stays."""
        number, state = self.tables.state()
        if stream and state["done"].get(stream, -1) >= batch:
            return False
        replaced, added = {}, {}
        bound, late = self.bind(state, bindings, replaced) if bindings is not None else (None, None)

        fresh = self.shaped(events)
        days = [self.tables.key("events", *r) for r in fresh.select("source", "dt").distinct().collect()]
        fresh = fresh.join(sorted_side(self.tables.read("events", days, state).select("digest")), "digest", "left_anti")
        # bindings of the batch's sessions: the buckets just merged, and others as they are stored
        sessions = [self.tables.key("bindings", r[0]) for r in fresh.where("session_id <> ''").select(self.bucket("session_id")).distinct().collect()]
        rest = self.tables.read("bindings", [k for k in sessions if k not in replaced.get("bindings", {})], state)
        bound = rest if bound is None else bound.unionByName(rest)
        fresh = self.stamped(fresh, bound)
        staged = self.tables.write("events", fresh)
        fresh = self.spark.read.schema(EVENTS).parquet(*[f"{self.tables.root}/{p}" for ps in staged.values() for p in ps]) if staged else fresh.limit(0)
        added["events"] = staged
        open_ = fresh.where("source = 'cowrie' and session_id <> '' and hassh = ''").select("session_id", "actor_id", "dt", self.bucket("session_id")).distinct()
        added["unbound"] = self.tables.write("unbound", open_)

        moved = self.late(state, late, replaced) if late is not None else None
        if moved is None:
            replaced |= self.folded(state, fresh)
        else:
            rebuilt, again = moved
            replaced |= self.folded(state, fresh, rebuilt, again.unionByName(fresh.join(sorted_side(rebuilt), "actor_id", "left_semi")))
        self.tables.change(number, state, replaced, added, done={stream: batch} if stream else None)
        return True

    def bind(self, state: dict, bindings: DataFrame, replaced: dict) -> tuple[DataFrame, DataFrame]:
        """(merged bindings of the batch's sessions, sessions that get their fingerprint now)."""
        new = bindings.where("session_id <> ''").withColumn("bucket", self.bucket("session_id"))
        keys = self.touched("bindings", new)
        stored = self.tables.read("bindings", keys, state)
        first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("_new", "observed_at"))).alias(c)
        merged = stored.withColumn("_new", F.lit(0)).unionByName(new.select(*stored.columns, F.lit(1).alias("_new"))).groupBy("session_id").agg(first("hassh"), first("duration_ms"), first("arch"), F.min("observed_at").alias("observed_at"), F.first("bucket").alias("bucket"))
        replaced["bindings"] = self.tables.write("bindings", merged)
        paths = [f"{self.tables.root}/{p}" for ps in replaced["bindings"].values() for p in ps]
        merged = self.spark.read.schema(TABLES["bindings"][0]).parquet(*paths) if paths else stored
        late = merged.where("coalesce(hassh, '') <> ''").join(sorted_side(stored.where("coalesce(hassh, '') <> ''").select("session_id")), "session_id", "left_anti")
        return merged, late.select("session_id", F.col("hassh").alias("_late"), "bucket")

    def stamped(self, events: DataFrame, bound: DataFrame) -> DataFrame:
        """Events with their session's fingerprint, unless they have one, and their actor; administrators' logins go."""
        got = events.join(sorted_side(bound.where("coalesce(hassh, '') <> '' and session_id <> ''").select("session_id", F.col("hassh").alias("_h"))), "session_id", "left")
        got = got.withColumn("hassh", F.coalesce(F.nullif("hassh", F.lit("")), "_h", F.lit(""))).drop("_h")
        got = got.withColumn("actor_id", F.when(F.col("src_ip") == "", "").otherwise(actor_of(F.col("hassh"))))
        return (without_admins(got, self.admins, self.fit) if self.admins else got).select(*events.columns)

    def late(self, state: dict, late: DataFrame, replaced: dict) -> tuple[DataFrame, DataFrame] | None:
        """Moves stored events of sessions whose fingerprint comes late; (actors to rebuild, all their stored events), None if none moved."""
        keys = self.touched("unbound", late)
        waiting = self.tables.read("unbound", keys, state)
        moved = waiting.join(sorted_side(late.drop("bucket")), "session_id")
        days = [self.tables.key("events", "cowrie", r[0]) for r in moved.select(F.col("dt").cast("string")).distinct().collect()]
        if not days:
            return None
        stored = self.tables.read("events", days, state)
        with_late = stored.join(sorted_side(late.drop("bucket")), "session_id", "left")
        hassh = F.coalesce(F.nullif("hassh", F.lit("")), "_late", F.lit(""))
        with_late = with_late.withColumn("hassh", hassh).withColumn("actor_id", F.when(F.col("actor_id") == "", "").otherwise(actor_of(F.col("hassh")))).select(*stored.columns)
        replaced["events"] = self.tables.write("events", with_late)
        replaced["unbound"] = {k: [] for k in keys} | self.tables.write("unbound", waiting.join(sorted_side(late.select("session_id")), "session_id", "left_anti"))
        ids = moved.select("actor_id").unionByName(moved.select(F.concat(F.lit("cowrie:"), "_late").alias("actor_id"))).where("actor_id <> ''").distinct()
        now = {"tables": {**state["tables"], "events": {**state["tables"]["events"], **replaced["events"]}}}
        rest = self.tables.read("events", lambda k: k.startswith("_source=cowrie/"), now)
        return ids, rest.join(sorted_side(ids), "actor_id", "left_semi")

    def replace(self, source: str, events: DataFrame) -> None:
        """The events of one source and its actors, replaced whole; other sources stay as they are."""
        number, state = self.tables.state()
        own = lambda t: [k for k in state["tables"].get(t, {}) if k.startswith(f"_source={source}/")]
        bound = self.tables.read("bindings", None, state)
        staged = self.tables.write("events", self.stamped(self.shaped(events.where(F.col("source") == source)), bound))
        rows = self.spark.read.schema(EVENTS).parquet(*[f"{self.tables.root}/{p}" for ps in staged.values() for p in ps]) if staged else self.spark.createDataFrame([], EVENTS)
        parts = {t: self.tables.write(t, d) for t, d in self.deltas(rows).items()} | {"events": staged}
        if source == "cowrie":
            parts["unbound"] = self.tables.write("unbound", rows.where("session_id <> '' and hassh = ''").select("session_id", "actor_id", "dt", self.bucket("session_id")).distinct())
        gone = {t: own(t) for t in ("events", "actors", "actor_users", "actor_ips")} | ({"unbound": list(state["tables"].get("unbound", {}))} if source == "cowrie" else {})
        self.tables.change(number, state, parts, gone=gone)

    def rebuild(self, source: str, fresh: DataFrame | None = None) -> None:
        """Appends events of one source, if there are any, and makes all its actors anew from its events."""
        if fresh is not None:
            self.ingest(fresh.where(F.col("source") == source))
        number, state = self.tables.state()
        own = lambda k: k.startswith(f"_source={source}/")
        parts = {t: self.tables.write(t, d) for t, d in self.deltas(self.tables.read("events", own, state)).items()}
        self.tables.change(number, state, parts, gone={t: [k for k in state["tables"].get(t, {}) if own(k)] for t in parts})

    def cache(self, lookups: DataFrame) -> None:
        """Upserts cached lookups (ip, provider, payload, fetched_at): of one key the latest stays, new ones on ties."""
        number, state = self.tables.state()
        new = lookups.withColumn("bucket", self.bucket("ip"))
        stored = self.tables.read("caches", self.touched("caches", new), state)
        rows = A.upsert(stored, new.select(*stored.columns), ["ip", "provider"], "fetched_at")
        self.tables.change(number, state, {"caches": self.tables.write("caches", rows)})

    def purge(self, before: str) -> None:
        """Drops events, bindings and cached lookups from before a moment; actors and what was reported stay.

        Whole days go without being read, the moment's own day is written anew."""
        number, state = self.tables.state()
        at = F.lit(before).cast("timestamp")
        day = self.spark.range(1).select(F.to_date(at).cast("string")).first()[0]
        old = [k for k in state["tables"]["events"] if k.rsplit("=", 1)[1] <= day]
        replaced = {"events": self.tables.write("events", self.tables.read("events", [k for k in old if k.endswith(day)], state).where(F.col("ts") >= at))}
        for t, column, limit in (("bindings", "observed_at", at), ("caches", "fetched_at", at), ("unbound", "dt", F.to_date(at))):
            rows = self.tables.read(t, None, state)
            replaced[t] = self.tables.write(t, rows.where(F.col(column).isNull() | (F.col(column) >= limit)))
        self.tables.change(number, state, replaced, gone={"events": old} | {t: list(state["tables"].get(t, {})) for t in ("bindings", "caches", "unbound")})

    # -- reads

    def events(self) -> DataFrame:
        return self.tables.read("events")

    def actors(self) -> DataFrame:
        """Stored actors, labelled and scored."""
        users = self.tables.read("actor_users").groupBy("actor_id").agg(F.array_sort(F.collect_list("username")).alias("users"))
        state = self.tables.read("actors").drop("bucket").join(sorted_side(users), "actor_id", "left").withColumn("users", F.coalesce("users", F.array().cast("array<string>")))
        state = state.withColumn("hassh", F.coalesce("hassh", F.lit("")))
        return A.label(state.withColumn("primary_ip", F.col("first.src_ip")).withColumn("ssh_client", F.coalesce("client.ssh_client", F.lit(""))).drop("first", "client"))
