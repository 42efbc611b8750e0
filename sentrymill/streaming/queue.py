"""A queue of captures that several workers share: claims are compare-and-set on the version of the stored table.

A worker claims rows for a time; rows whose claim ran out are due again. A result counts only for the attempt that it was
claimed for, so a worker that comes back late changes nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Conflict, Versions

SCHEMA = "url string, status string, attempt_count int, next_attempt_at timestamp, created_at timestamp, claimed_by string, detail string, local_path string, sha256 string, size_bytes long, bucket int"
MOST_ATTEMPTS = 5


def wait_seconds(attempt: Column) -> Column:
    """How long to wait after a failure that ``attempt`` others went before."""
    return F.least(F.lit(3600), 30 * F.pow(F.lit(2), attempt)).cast("long")


def later(at: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(at) + seconds.cast("long") * 1_000_000)


class Queue:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 16, tries: int = 20):
        self.spark, self.buckets, self.tries = spark, buckets, tries
        self.tables = Versions(spark, root, {"captures": (SCHEMA, ["bucket"])})

    def _change(self, change) -> DataFrame:
        """Applies ``change`` of (state) to (new rows of touched keys, answer) until no other writer was faster."""
        for _ in range(self.tries):
            number, state = self.tables.state()
            keys, rows, answer = change(state)
            if not keys:
                return answer
            try:
                self.tables.change(number, state, {"captures": {k: [] for k in keys} | self.tables.write("captures", rows)})
                return answer
            except Conflict:
                continue
        raise Conflict(f"other writers were faster {self.tries} times")

    def _keys(self, rows: DataFrame) -> list[str]:
        return [self.tables.key("captures", r[0]) for r in rows.select("bucket").distinct().collect()]

    def add(self, captures: DataFrame) -> None:
        """Queues (url, created_at) that are not in the queue yet; of equal ones the earliest."""
        new = captures.groupBy("url").agg(F.min("created_at").alias("created_at")).withColumn("bucket", F.pmod(F.xxhash64("url"), F.lit(self.buckets)).cast("int"))

        def change(state):
            keys = self._keys(new)
            have = self.tables.read("captures", keys, state)
            fresh = new.join(have.select("url"), "url", "left_anti").select("url", F.lit("capturing").alias("status"), F.lit(0).alias("attempt_count"), F.lit(None).cast("timestamp").alias("next_attempt_at"), F.col("created_at").cast("timestamp").alias("created_at"), *[F.lit("").alias(c) for c in ("claimed_by", "detail", "local_path", "sha256")], F.lit(0).cast("long").alias("size_bytes"), "bucket")
            return keys, have.unionByName(fresh), None

        self._change(change)

    def rows(self, state: dict | None = None) -> DataFrame:
        return self.tables.read("captures", None, state)

    def due(self, now: str, state: dict | None = None) -> DataFrame:
        at = F.lit(now).cast("timestamp")
        return self.rows(state).where(F.col("status").isin("capturing", "failed") & (F.col("attempt_count") < MOST_ATTEMPTS) & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= at)))

    def claim(self, worker: str, now: str, seconds: int, limit: int) -> DataFrame:
        """Up to ``limit`` due rows, oldest first, that nobody else gets for ``seconds``: (url, attempt)."""
        name = f"{worker}/{uuid.uuid4().hex}"

        def change(state):
            mine = self.due(now, state).orderBy("created_at", "url").limit(limit).select("url", "bucket").persist()  # at most ``limit`` rows
            keys = self._keys(mine)
            until = later(F.lit(now).cast("timestamp"), F.lit(seconds))
            took = self.tables.read("captures", keys, state).join(F.broadcast(mine.select("url", F.lit(1).alias("_mine"))), "url", "left").withColumns({"status": F.when(F.col("_mine") == 1, "capturing").otherwise(F.col("status")), "claimed_by": F.when(F.col("_mine") == 1, name).otherwise(F.col("claimed_by")), "next_attempt_at": F.when(F.col("_mine") == 1, until).otherwise(F.col("next_attempt_at"))})
            return keys, took.drop("_mine"), None

        self._change(change)
        return self.rows().where(F.col("claimed_by") == name).select("url", (F.col("attempt_count") + 1).alias("attempt"))

    def complete(self, results: DataFrame, now: str) -> int:
        """Takes over results (url, attempt, ok, detail, local_path, sha256, size_bytes); gives how many came too late.

        A failure waits longer with each attempt; after the last attempt it stays failed."""
        total = results.count()

        def change(state):
            of = results.withColumn("bucket", F.pmod(F.xxhash64("url"), F.lit(self.buckets)).cast("int"))
            keys = self._keys(of)
            have = self.tables.read("captures", keys, state)
            r = of.select("url", *[F.col(c).alias(f"_{c}") for c in ("attempt", "ok", "detail", "local_path", "sha256", "size_bytes")])
            both = have.join(r, "url", "left").withColumn("_now", (F.col("status") == "capturing") & (F.col("_attempt") == F.col("attempt_count") + 1))
            hit, won = F.coalesce("_now", F.lit(False)), F.coalesce(F.col("_now") & F.col("_ok"), F.lit(False))
            wait = F.when(F.col("_attempt") < MOST_ATTEMPTS, later(F.lit(now).cast("timestamp"), wait_seconds(F.col("_attempt") - 1)))
            new = both.withColumns({
                "status": F.when(won, "fetched").when(hit, "failed").otherwise(F.col("status")), "next_attempt_at": F.when(won, F.lit(None).cast("timestamp")).when(hit, wait).otherwise(F.col("next_attempt_at")),
                "attempt_count": F.when(hit, F.col("_attempt")).otherwise(F.col("attempt_count")), "detail": F.when(hit, F.col("_detail")).otherwise(F.col("detail")), "claimed_by": F.when(hit, "").otherwise(F.col("claimed_by")),
                **{c: F.when(won, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("local_path", "sha256", "size_bytes")},
            })
            return keys, new.select(*have.columns), total - both.where("_now").count()

        return self._change(change)
