"""Cached provider answers (JSON texts) brought to one shape; parsing and thresholds only, no request is ever made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of providers in a merged answer.
ORDER = ("abuseipdb", "virustotal", "greynoise", "shodan", "otx", "ipqualityscore", "ipinfo")
FRESH_HOURS = 24
# The fields that are read of each provider's answer.
SCHEMAS = {
    "abuseipdb": "data struct<abuseConfidenceScore:int,countryCode:string,isp:string,usageType:string,totalReports:int,hostnames:array<string>,lastReportedAt:string>",
    "greynoise": "noise boolean, riot boolean, classification string, name string, last_seen string, message string",
    "ipinfo": "org string, city string, region string, country string, asn struct<asn:string,name:string>, privacy struct<vpn:boolean,proxy:boolean,tor:boolean,relay:boolean,hosting:boolean>",
    "ipqualityscore": "success boolean, message string, fraud_score int, country_code string, ISP string, ASN int, proxy boolean, vpn boolean, tor boolean, is_crawler boolean, bot_status boolean, recent_abuse boolean",
    "otx": "pulse_info struct<count:int,pulses:array<struct<name:string,tags:array<string>>>>, asn string, country_code string",
    "shodan": "ports array<int>, tags array<string>, vulns array<string>",
    "virustotal": "data struct<attributes:struct<last_analysis_stats:struct<malicious:int,suspicious:int,harmless:int,undetected:int>,country:string,as_owner:string,asn:int,tags:array<string>>>",
}


def split_asn(text: Column) -> tuple[Column, Column]:
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.substring_index(t, " ", 1), F.when(t.contains(" "), F.trim(F.regexp_replace(t, r"^[^ ]* ", ""))).otherwise("")


def _marks(**flags: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), k.replace("_", "-")) for k, c in flags.items()]))


def _level(score: Column, high: int, mid: int) -> Column:
    return F.when(score >= high, "malicious").when(score >= mid, "suspicious").otherwise("benign")


def normalised(cache: DataFrame) -> DataFrame:
    """(ip, source, score, verdict, asn, as_owner, country, tags) from a cache of (ip, source, payload, fetched_at).

    A payload that does not parse has the verdict null."""
    none = F.lit(None)
    empty = F.array().cast("array<string>")
    out = []
    for name, schema in SCHEMAS.items():
        rows = cache.where(F.col("source") == name).withColumn("j", F.from_json("payload", schema))
        j = lambda path: F.col(f"j.{path}")
        if name == "abuseipdb":
            score = F.coalesce(j("data.abuseConfidenceScore"), F.lit(0))
            usage = F.lower(F.replace(F.coalesce(j("data.usageType"), F.lit("")), F.lit(" "), F.lit("-")))
            tags = F.filter(F.concat(F.array(usage), F.coalesce(j("data.hostnames"), empty)), lambda t: F.coalesce(t, F.lit("")) != "")
            cols = score, _level(score, 75, 25), none, j("data.isp"), j("data.countryCode"), tags
        elif name == "greynoise":
            verdict = F.when(j("classification").isin("malicious", "benign"), j("classification")).otherwise("unknown")
            tags = F.concat(_marks(internet_noise=j("noise"), riot=j("riot")), F.filter(F.array(j("name")), lambda t: F.coalesce(t, F.lit("")) != ""))
            cols = none, verdict, none, none, none, tags
        elif name == "ipinfo":
            number, owner = split_asn(j("org"))
            given = F.coalesce(j("asn.asn"), F.lit("")) != ""
            hidden = [F.coalesce(j(f"privacy.{k}"), F.lit(False)) for k in ("proxy", "vpn", "tor", "relay")]
            verdict = F.when(hidden[0] | hidden[1] | hidden[2] | hidden[3], "suspicious").otherwise("unknown")
            cols = none, verdict, F.when(given, j("asn.asn")).otherwise(number), F.when(given, j("asn.name")).otherwise(owner), j("country"), _marks(hosting=j("privacy.hosting"), proxy=hidden[0], vpn=hidden[1], tor=hidden[2], relay=hidden[3])
        elif name == "ipqualityscore":
            score = F.coalesce(j("fraud_score"), F.lit(0))
            tags = _marks(proxy=j("proxy"), vpn=j("vpn"), tor=j("tor"), crawler=j("is_crawler"), bot=j("bot_status"), recent_abuse=j("recent_abuse"))
            cols = score, F.when(j("success"), _level(score, 85, 50)), F.when(j("ASN") > 0, F.concat(F.lit("AS"), j("ASN").cast("string"))), j("ISP"), j("country_code"), tags
        elif name == "otx":
            count = F.coalesce(j("pulse_info.count"), F.lit(0))
            number, owner = split_asn(j("asn"))
            tags = F.array_sort(F.array_distinct(F.transform(F.filter(F.flatten(F.transform(F.coalesce(j("pulse_info.pulses"), F.array().cast("array<struct<name:string,tags:array<string>>>")), lambda p: F.coalesce(p["tags"], empty))), lambda t: t != ""), F.lower)))
            cols = F.least(F.lit(100), count * 20), _level(count, 5, 1), number, owner, j("country_code"), tags
        elif name == "shodan":
            ports = F.transform(F.coalesce(j("ports"), F.array().cast("array<int>")), lambda p: F.concat(F.lit("port:"), p.cast("string")))
            given = F.coalesce(j("tags"), empty)
            bad = (F.size(F.coalesce(j("vulns"), empty)) > 0) | F.arrays_overlap(given, F.array(F.lit("malware"), F.lit("compromised"), F.lit("malicious")))
            cols = none, F.when(bad, "suspicious").when(F.size(ports) > 0, "benign").otherwise("unknown"), none, none, none, F.concat(given, ports)
        else:
            s = lambda k: F.coalesce(j(f"data.attributes.last_analysis_stats.{k}"), F.lit(0))
            total = s("malicious") + s("suspicious") + s("harmless") + s("undetected")
            score = F.when(total > 0, F.floor(100 * s("malicious") / total).cast("int")).otherwise(0)
            verdict = F.when(s("malicious") >= 3, "malicious").when(s("malicious") + s("suspicious") >= 1, "suspicious").otherwise("benign")
            number = F.when(j("data.attributes.asn") > 0, F.concat(F.lit("AS"), j("data.attributes.asn").cast("string")))
            cols = score, verdict, number, j("data.attributes.as_owner"), j("data.attributes.country"), F.coalesce(j("data.attributes.tags"), empty)
        score, verdict, asn, owner, country, tags = cols
        ok = F.col("j").isNotNull() & F.try_parse_json("payload").isNotNull()
        out.append(rows.select("ip", "source", "fetched_at", score.cast("int").alias("score"), F.when(ok, verdict).alias("verdict"), asn.cast("string").alias("asn"), owner.cast("string").alias("as_owner"), country.cast("string").alias("country"), tags.alias("tags")))
    got = out[0]
    for o in out[1:]:
        got = got.unionByName(o)
    return got


def resolved(cache: DataFrame, now: str, hours: int = FRESH_HOURS) -> DataFrame:
    """The latest parsed answer of each (ip, provider), flagged stale beyond ``hours``."""
    ok = normalised(cache).where("verdict is not null")
    rest = [c for c in ok.columns if c not in ("ip", "source")]
    last = ok.groupBy("ip", "source").agg(F.max_by(F.struct(*rest), "fetched_at").alias("r")).select("ip", "source", "r.*")
    place = F.create_map(*[F.lit(x) for i, n in enumerate(ORDER) for x in (n, i)])
    return last.withColumn("stale", F.col("fetched_at") < F.lit(now).cast("timestamp") - F.expr(f"make_interval(0, 0, 0, 0, {hours})")).withColumn("place", place[F.col("source")])
