"""Answers out of caches: what is known of an address or a payload, how old it is, and whom to ask again. No request is made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import providers
from .net import askable, fitted
from .vetting import is_sha256

#: The layout of payload verdicts that is read; rows of any other count as none.
VERSION = 1
FOUND_DAYS, MISSED_DAYS = 30, 7
VERDICT = "cacheVersion int, sha256 string, found boolean, verdict string, malicious int, suspicious int, harmless int, undetected int, family string, fetchedAt string"


def _before(now: str, hours: int) -> Column:
    return F.lit(now).cast("timestamp") - F.expr(f"make_interval(0, 0, 0, 0, {hours})")


def answers(asked: DataFrame, cache: DataFrame, now: str, hours: int = providers.FRESH_HOURS, fit: bool = False) -> DataFrame:
    """One row for each distinct address of ``asked`` (ip) and provider, in the providers' order: (ip, place, source, state, ask, ...).

    ``state``: ``fresh`` within ``hours``, ``stale`` beyond, ``none`` without a cached answer that parses, ``refused`` for texts
    that no provider may be asked about. ``ask``: whether a request is due; until it is answered a stale answer stands.
    With ``fit`` numbers in addresses that outgrew their place are cut before an address is judged."""
    ips = asked.select("ip").where("ip is not null").distinct().withColumn("_may", askable(fitted(F.col("ip")) if fit else F.col("ip")))
    wanted = ips.select("ip", "_may", F.posexplode(F.array(*map(F.lit, providers.ORDER))).alias("_place", "source"))
    known = providers.resolved(cache, now, hours).drop("place", "stale").withColumn("_fresh", F.col("fetched_at") > _before(now, hours))
    got = wanted.join(known, ["ip", "source"], "left")
    state = F.when(~F.col("_may"), "refused").when(F.col("_fresh"), "fresh").when(F.col("_fresh").isNotNull(), "stale").otherwise("none")
    rest = [c for c in known.columns if c not in ("ip", "source", "_fresh")]
    return got.withColumn("state", state).select("ip", F.col("_place").alias("place"), "source", "state", F.col("state").isin("stale", "none").alias("ask"), *[F.when(F.col("state") != "refused", F.col(c)).alias(c) for c in rest])


def verdicts(payloads: DataFrame, cache: DataFrame, now: str) -> DataFrame:
    """One row for each distinct digest of ``payloads`` (sha256): (sha256, state, ask, found, verdict, malicious, family, fetched_at).

    ``cache``: (sha256, payload, fetched_at), of one digest the latest row counts. A payload that does not parse or has another
    version is none. That nobody has seen a file is an answer too, but one that ages sooner. The time in the payload counts, the
    row's where it has none."""
    latest = cache.groupBy(F.lower(F.trim("sha256")).alias("sha256")).agg(F.max_by(F.struct("payload", "fetched_at"), "fetched_at").alias("c"))
    v = latest.select("sha256", F.from_json("c.payload", VERDICT).alias("v"), F.col("c.fetched_at").alias("_row")).where(F.col("v.cacheVersion") == VERSION)
    v = v.withColumn("fetched_at", F.coalesce(F.col("v.fetchedAt").try_cast("timestamp"), F.col("_row"))).withColumn("found", F.coalesce("v.found", F.lit(False)))
    limit = F.when(F.col("found"), _before(now, 24 * FOUND_DAYS)).otherwise(_before(now, 24 * MISSED_DAYS))
    v = v.select("sha256", (F.col("fetched_at") >= limit).alias("_fresh"), "found", "v.verdict", "v.malicious", "v.family", "fetched_at")
    asked = payloads.select(F.lower(F.trim("sha256")).alias("sha256")).where(is_sha256(F.col("sha256"))).distinct()
    state = F.when(F.col("_fresh"), "fresh").when(F.col("_fresh").isNotNull(), "stale").otherwise("none")
    return asked.join(v, "sha256", "left").withColumn("state", state).select("sha256", "state", (F.col("state") != "fresh").alias("ask"), "found", "verdict", "malicious", "family", "fetched_at")
