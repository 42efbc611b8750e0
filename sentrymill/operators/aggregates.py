"""Aggregates, top-N lists and roll-ups over events, actors and artifacts.

All windows are ``ts >= since`` with ``since`` passed in; nothing is capped or sampled unless the limit is the feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import classify as C


def stamp(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def since(events: DataFrame, start: str) -> DataFrame:
    return events.where(F.col("ts") >= F.lit(start).cast(events.schema["ts"].dataType))


def top_counts(events: DataFrame, column: str, limit: int) -> DataFrame:
    keep = (F.col(column) != "") & ((F.col(column) != "?") if column == "username" else F.lit(True))
    return events.where(keep).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "value").limit(limit)


def hourly(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return events.groupBy(F.date_trunc("hour", "ts").alias("bucket"), *by).agg(F.count("*").alias("hits"))


def recent_rates(events: DataFrame, start: str, hours: int) -> DataFrame:
    return since(events, start).where("actor_id <> ''").groupBy("actor_id").agg((F.count("*") / F.lit(float(hours))).alias("rate"))


def sessions(events: DataFrame) -> DataFrame:
    """One row a sensor session with its counts, span, and what is known of its peer."""
    return (
        events.where("source = 'cowrie' and session_id <> ''")
        .groupBy("session_id")
        .agg(
            F.max("src_ip").alias("src_ip"), F.max("hassh").alias("hassh"), F.max("ssh_client").alias("ssh_client"), F.max("actor_id").alias("actor_id"),
            F.coalesce(F.max(F.when(F.col("username") != "", F.col("username"))), F.lit("")).alias("username"),
            F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n"),
            F.count(F.when(F.col("command") != "", 1)).alias("n_cmd"), F.count(F.when(F.col("kind") == "command", 1)).alias("n_shell"),
            F.min_by("command", F.when((F.col("kind") == "command") & (F.col("command") != ""), F.struct("ts", "id"))).alias("first_command"),
        )
    )


def session_usernames(events: DataFrame) -> DataFrame:
    """The name that a session logged in with, else any it tried."""
    named = events.where("session_id <> '' and username <> ''")
    return named.groupBy("session_id").agg(F.coalesce(F.max(F.when(F.col("kind") == "accepted", F.col("username"))), F.max("username")).alias("session_user"))


def actors(events: DataFrame) -> DataFrame:
    """Events clustered into actors, labelled and scored. Two aggregations with partial sums; names are
    counted before they are gathered, so an actor's event volume never meets in one buffer."""
    known = events.where("actor_id <> ''")
    order = F.struct("ts", "id")
    base = known.groupBy("actor_id").agg(
        F.first("source").alias("source"), F.min_by("src_ip", order).alias("primary_ip"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("event_count"),
        F.max("hassh").alias("hassh"), F.coalesce(F.min_by("ssh_client", F.when(F.col("ssh_client") != "", order)), F.lit("")).alias("ssh_client"),
        F.bit_or(C.flags(F.col("kind"), F.col("sha256"), F.col("command"))).alias("mask"),
    )
    names = known.where("username <> '' and username <> '?'").groupBy("actor_id", "username").agg(F.count("*").alias("n"))
    users = names.groupBy("actor_id").agg(F.array_sort(F.collect_list("username")).alias("users"))
    return label(base.join(users, "actor_id", "left").withColumn("users", F.coalesce("users", F.lit([]).cast("array<string>"))))


def label(state: DataFrame) -> DataFrame:
    """Playbook, intent, scores and tier from an actor's mergeable state."""
    sensor = F.col("source") == "cowrie"
    span = C.span_hours(F.col("first_seen"), F.col("last_seen"))
    out = state.withColumn("attempts_per_hour", F.col("event_count") / F.greatest(span, F.lit(0.25))).withColumn("flags", F.when(sensor, F.col("mask")).otherwise(0))
    rate, users, mask = F.col("attempts_per_hour"), F.col("users"), F.col("mask")
    return (
        out.withColumn("unique_users", F.size("users").cast("long"))
        .withColumn("playbook", F.when(sensor, C.sensor_playbook(users, rate, F.col("ssh_client"), mask)).otherwise(C.playbook(users, rate)))
        .withColumn("intent", F.when(sensor, C.intent(mask)).otherwise("unknown"))
        .withColumn("probe_score", F.when(sensor, C.sensor_score(mask, rate)).otherwise(C.journal_score(F.col("event_count"), rate, F.size("users"))))
        .withColumn("confidence", F.when(sensor, F.when(C.has(mask, C.PAYLOAD) | C.has(mask, C.DEPLOY_CMD), 84).otherwise(72)).otherwise(F.when((span >= 0.25) & (rate > 100), 70).otherwise(55)))
        .withColumn("tier", C.tier(F.col("confidence")))
        .withColumn("username_hash", C.user_set_hash(users))
        .drop("mask")
    )


def actor_state(events: DataFrame) -> DataFrame:
    """The part of an actor that merges: counts, bounds, signal bits, first address and banner with their places."""
    known = events.where("actor_id <> ''")
    order = F.struct("ts", "id")
    return known.groupBy("actor_id").agg(
        F.first("source").alias("source"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("event_count"),
        F.bit_or(C.flags(F.col("kind"), F.col("sha256"), F.col("command"))).alias("mask"), F.max("hassh").alias("hassh"),
        F.min(F.struct("ts", "id", "src_ip")).alias("first"), F.min(F.when(F.col("ssh_client") != "", F.struct("ts", "id", "ssh_client"))).alias("client"),
    )


def fold(rows: DataFrame, delta: DataFrame | None = None, keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Merges stored states with those of new events; equal to rebuilding from all events. Columns in ``keep`` are the same in all rows of an actor."""
    both = rows if delta is None else rows.unionByName(delta)
    return both.groupBy("actor_id").agg(
        F.first("source").alias("source"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("event_count").alias("event_count"),
        F.bit_or("mask").alias("mask"), F.max("hassh").alias("hassh"), F.min("first").alias("first"), F.min("client").alias("client"), *[F.first(c).alias(c) for c in keep],
    )


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps only k a group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def artifact_groups(artifacts: DataFrame, shareable: tuple[str, ...]) -> DataFrame:
    """One row a payload: spread, extremes, and the attributes of its latest sighting."""
    distinct = lambda c: F.count_distinct(F.when(F.col(c) != "", F.col(c)))
    return artifacts.where("sha256 <> ''").groupBy("sha256").agg(
        F.max("size_bytes").alias("size_bytes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("occurrences"),
        distinct("url").alias("urls"), distinct("src_ip").alias("ips"), distinct("actor_id").alias("actors"), distinct("session_id").alias("sessions"),
        F.max(F.when(F.col("local_path") != "", 1).otherwise(0)).alias("has_local"), F.max(F.when(F.col("origin").isin(*shareable), 1).otherwise(0)).alias("shareable"),
        F.max_by(F.struct("origin", "status", "url"), F.struct(F.coalesce("ts", "created_at"), "id")).alias("latest"),
    )


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Natural-key upsert on plain files: of equal keys the row with the largest ``order`` wins, new rows on ties."""
    tagged = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in table.columns if c not in keys]
    got = tagged.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, "_new")).alias("_row"))
    return got.select(*keys, "_row.*")


def dedup(events: DataFrame, existing: DataFrame | None, keys: list[str]) -> DataFrame:
    """Events not stored yet, the first of each identity in the batch."""
    fresh = events.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in events.columns if c not in keys]), F.col("id")).alias("_row")).select(*keys, "_row.*")
    return fresh if existing is None else fresh.join(existing.select(*keys).distinct(), keys, "left_anti")


def replace_source(table: DataFrame, rows: DataFrame, source: str) -> DataFrame:
    """The table with all rows of one source replaced."""
    return table.where(F.col("source") != source).unionByName(rows.where(F.col("source") == source))


def long(c: Column) -> Column:
    return c.cast(T.LongType())
