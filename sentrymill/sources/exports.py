"""Indicators as a threat-exchange bundle whose ids follow from its content.

The same indicators give the same bytes: objects are ordered by count, last sighting and value, ids are version 5 in form, and
the bundle's id is a digest over all object ids in order. Objects and the document are written by ranges of that order; the
digest reads ids in chunks that the ranges have joined (see ``operators.running``), so no task holds the bundle."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net
from ..operators.running import digested, numbered

#: What ids of an exporter are made from; another exporter passes its own.
SEED = "sentrymill"
SAMPLE_BYTES = 256
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def uuid_of(digest: Column) -> Column:
    """A version 5 id from the hex digits of a SHA-1."""
    variant = F.substring(F.lit("89ab"), (F.instr(F.lit("0123456789abcdef"), F.substring(digest, 17, 1)) - 1) % 4 + 1, F.lit(1))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def pattern_of(kind: Column, value: Column) -> Column:
    """The pattern of an indicator; values are escaped, addresses told apart by their form."""
    esc = lambda c: F.regexp_replace(c, r"([\\'])", r"\\$1")
    form = lambda c: F.when(c.rlike(net.V4), "ipv4-addr").when(c.contains(":"), "ipv6-addr")
    host = F.regexp_replace(F.regexp_replace(value, ":[0-9]+$", ""), r"[\[\]]", "")
    port = F.regexp_extract(value, ":([0-9]+)$", 1)
    with_port = F.when(port != "", F.concat(F.lit(" AND network-traffic:dst_port = "), port)).otherwise("")
    end = F.lit("]")
    quoted = lambda head, c, tail: F.concat(F.lit(f"{head} = '"), esc(c), F.lit("'"), tail)
    return (
        F.when(kind == "ip", F.concat(F.lit("["), F.coalesce(form(value), F.lit("ipv4-addr")), quoted(":value", value, end)))
        .when(kind == "url", quoted("[url:value", value, end))
        .when(kind == "hash", quoted("[file:hashes.'SHA-256'", F.lower(value), end))
        .when(kind == "user", quoted("[user-account:account_login", value, end))
        .otherwise(F.concat(F.lit("[network-traffic:dst_ref.type = '"), F.coalesce(form(host), F.lit("domain-name")), quoted("' AND network-traffic:dst_ref.value", host, with_port), end))
    )


def shortened(text: Column, most: int = SAMPLE_BYTES) -> Column:
    """At most ``most`` bytes of a text, and a sign that it was cut."""
    cut = F.make_valid_utf8(F.substring(text.cast("binary"), 1, most).cast("string"))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(cut, F.lit("…")))


def objects(indicators: DataFrame) -> DataFrame:
    """An object an indicator (kind, value, hits, a, b, sources joined by ``|``, sample), with its place in the bundle from 1."""
    when = lambda c: F.date_format(c, ISO)
    sources = F.when(F.coalesce("sources", F.lit("")) == "", "no").otherwise(F.translate("sources", "|", ","))
    said = F.concat(F.lit("Observed "), "kind", F.lit(" '"), "value", F.lit("' across "), sources, F.lit(" sources from "), when("a"), F.lit(" to "), when("b"), F.lit(". Count: "), F.col("hits").cast("string"), F.lit("."))
    sample = F.when(F.coalesce("sample", F.lit("")) != "", F.concat(F.lit(" Sample: "), shortened(F.col("sample")))).otherwise("")
    rows = indicators.where(F.col("kind").isin("ip", "hash", "url", "user", "tunnel")).select(
        "kind", "value", "hits", "b", F.concat(F.lit("indicator--"), uuid_of(F.sha1(F.concat("kind", F.lit("|"), "value").cast("binary")))).alias("id"), when("a").alias("created"), when(F.greatest("a", "b")).alias("modified"),
        F.concat("kind", F.lit(":"), "value").alias("name"), F.concat(said, sample).alias("description"), pattern_of(F.col("kind"), F.col("value")).alias("pattern"),
        F.when(F.col("kind") == "user", "credential-attempt").when(F.col("kind") == "tunnel", "proxy-pivot").otherwise("malicious-activity").alias("label"),
    )
    return numbered(rows, [], [F.desc("hits"), F.desc("b"), F.asc("value"), F.asc("kind")], "place").drop("hits", "b")


def bundle_id(placed: DataFrame, seed: str = SEED) -> str:
    """The id that follows from all object ids in their order."""
    head = f"{seed}-bundle-"
    got = digested(placed, [], "place", "id", "d", "|", head, "|", digest="sha1").collect()
    hexed = got[0]["d"] if got else hashlib.sha1(head.encode()).hexdigest()
    return "bundle--" + placed.sparkSession.range(1).select(uuid_of(F.lit(hexed))).first()[0]


def bundle_lines(placed: DataFrame, seed: str = SEED, identity: str = "Telemetry export", created: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(place, line) of the document: its head with the identity, an object a line, its end."""
    spark = placed.sparkSession
    owner = "identity--" + spark.range(1).select(uuid_of(F.sha1(F.lit(f"{seed}-identity").cast("binary")))).first()[0]
    one = F.to_json(F.struct(
        F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), "id", "created", "modified", "name", "description", "pattern", F.lit("stix").alias("pattern_type"), F.col("created").alias("valid_from"),
        F.array("label").alias("labels"), F.array(F.lit("malicious-activity")).alias("indicator_types"), F.lit(owner).alias("created_by_ref"),
    ))
    start = f'{{"type":"bundle","id":"{bundle_id(placed, seed)}","objects":[\n{{"type":"identity","spec_version":"2.1","id":"{owner}","created":"{created}","modified":"{created}","name":"{identity}","identity_class":"organization"}}'
    ends = spark.createDataFrame([(0, start), ((1 << 62), "]}")], "place long, line string")
    return ends.unionByName(placed.select("place", F.concat(F.lit(","), one).alias("line")))


def write_bundle(placed: DataFrame, path: str, **how) -> None:
    """Writes the document as part files that, one after the other, are the document."""
    lines = bundle_lines(placed, **how)
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(n, "place").sortWithinPartitions("place").select("line").write.text(path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """The objects of a bundle written by ``write_bundle``: (id, pattern, description)."""
    rows = spark.read.text(path).where(F.col("value").startswith(',{"type":"indicator"'))
    return rows.select(F.from_json(F.substring("value", 2, 1 << 30), "id string, pattern string, description string").alias("o")).select("o.*")
