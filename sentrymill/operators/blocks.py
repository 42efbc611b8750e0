"""Joins of addresses with address blocks: longest match, without comparing every address with every block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import address_hex, let
from . import scratch

#: Levels with no more blocks than this meet the addresses by broadcast.
FEW = 10_000
STEP = 8


def _filled(start: Column, bits: Column, ones: bool) -> Column:
    """An address whose bits behind the first ``bits`` are all ones or all zeros."""
    full, rest = F.floor(bits / 4).cast("int"), bits % 4
    digit, step = F.conv(F.substr(start, full + 1, F.lit(1)), 16, 10).cast("int"), F.pow(F.lit(2), 4 - rest).cast("int")
    mixed = F.when(rest == 0, "").otherwise(F.lower(F.hex((digit - digit % step + (step - 1 if ones else 0)).cast("long"))))
    return F.rpad(F.concat(F.substr(start, F.lit(1), full), mixed), 32, "f" if ones else "0")


def from_cidr(network: Column) -> Column:
    """A struct (start, bits) of a block text, the start in 32 hex digits and the bits counted in 128; null if it is no block.
    Bits of the address beyond the prefix are dropped."""
    head, given = F.substring_index(network, "/", 1), F.regexp_extract(network, r"^[^/]+/([0-9]{1,3})$", 1).try_cast("int")
    bits = F.when(head.contains(":"), given).otherwise(given + 96)
    whole = lambda b: F.when((b["bits"] >= 0) & (b["bits"] <= 128) & b["key"].isNotNull(), F.struct(_filled(b["key"], b["bits"], False).alias("start"), b["bits"].alias("bits")))
    return let(F.struct(address_hex(head).alias("key"), bits.alias("bits")), whole)


def lookup(addresses: DataFrame, ip: str, blocks: DataFrame, fields: list[str]) -> DataFrame:
    """Each distinct text of column ``ip`` with the ``fields`` of the longest block (start, bits, ...) that holds it.

    Texts that are no address and addresses outside all blocks get nulls. A block belongs to the level of its prefix length
    rounded down to whole bytes and is known there by its first bytes, so an address meets it by an equi-join on one key a
    level that occurs (at most 17); a key holds fewer than 2 ** 8 prefixes. Levels of few blocks, which are the
    ones whose keys many addresses share, are broadcast after they are counted; the rest is shuffled."""
    level = F.col("bits") - F.col("bits") % STEP
    digits = (F.col("_level") / 4).cast("int")
    keyed = blocks.where("start is not null").withColumn("_level", level).withColumn("_key", F.substr("start", F.lit(1), digits)).withColumn("_to", _filled(F.col("start"), F.col("bits"), True))
    # read twice or more below: kept, so that what they are made from is worked out once
    keyed = scratch.cut(keyed.select("_level", "_key", "start", "_to", "bits", *fields))
    sizes = {r["_level"]: r["count"] for r in keyed.groupBy("_level").count().collect()}  # 17 rows at most
    few, many = ([k for k, n in sizes.items() if (n <= FEW) == small] for small in (True, False))
    asked = scratch.cut(addresses.select(F.col(ip).alias("_ip")).where("_ip is not null").distinct().withColumn("_hex", address_hex(F.col("_ip"))))
    found = None
    for levels, small in ((few, True), (many, False)):
        if not levels:
            continue
        keys = asked.where("_hex is not null").select("_ip", "_hex", F.explode(F.array(*map(F.lit, levels))).alias("_level")).withColumn("_key", F.substr("_hex", F.lit(1), digits))
        own = keyed.where(F.col("_level").isin(levels)).select("_level", "_key", "start", "_to", "bits", *fields)
        # each few hundred bytes, at most FEW a level
        hits = keys.join(F.broadcast(own) if small else own, ["_level", "_key"]).where("_hex >= start and _hex <= _to").select("_ip", "bits", F.struct(*fields).alias("_hit"))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return asked.select(F.col("_ip").alias(ip), *[F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in fields])
    best = found.groupBy("_ip").agg(F.max_by("_hit", "bits").alias("_hit"))
    return asked.select("_ip").join(best, "_ip", "left").select(F.col("_ip").alias(ip), *[F.col(f"_hit.{c}").alias(c) for c in fields])
