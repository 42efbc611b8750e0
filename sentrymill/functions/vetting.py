"""Which captured addresses and files could be shared, as reason columns: the first that applies, null if none does.

Only the selection is computed; nothing is ever sent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .net import host_verdict, let

# Floors, ages in days, kinds and origins that the vetting rules name.
MIN_BYTES, URL_DAYS, SAMPLE_DAYS = 64, 3, 10
FETCHED = ("quarantine_fetch",)
SAMPLE_ORIGINS = ("quarantine_fetch", "cowrie_download", "cowrie_file_download")
BENIGN = ("SSH key",)
MALWARE_TAGS = ("miner", "dropper", "botnet", "scanner", "proxyware", "ransomware", "rootkit")
# Report labels of families, which are compared without case.
LABELS = {"mirai": "elf.mirai", "gafgyt": "elf.bashlite", "redtail": "elf.redtail", "xmrig": "elf.xmrig", "mozi": "elf.mozi", "tsunami": "elf.tsunami"}


def sanitised(tags: Column) -> Column:
    """Tags of letters, digits, dots, hyphens and spaces: trimmed, distinct, sorted."""
    clean = F.transform(tags, lambda t: F.trim(F.regexp_replace(t, r"[^A-Za-z0-9.\- ]", "")))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda t: t != "")))


def is_sha256(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[0-9A-Fa-f]{64}\z"), F.lit(False))


def _age_days(at: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 8.64e10


def url_reason(url: Column, origin: Column, status: Column, sha256: Column, size: Column, kind: Column, fetched_at: Column, now: Column, days: int = URL_DAYS) -> Column:
    u = F.trim(url)
    scheme, host, user = (F.try_parse_url(u, F.lit(p)) for p in ("PROTOCOL", "HOST", "USERINFO"))
    port = F.regexp_extract(F.coalesce(F.try_parse_url(u, F.lit("AUTHORITY")), F.lit("")), r":([^:\]]*)\z", 1)
    age = _age_days(fetched_at, now)
    early = (
        F.when(~F.coalesce(F.lower(scheme).isin("http", "https"), F.lit(False)), "not an http(s) address")
        .when(F.coalesce(host, F.lit("")) == "", "no host")
        .when(user.isNotNull(), "credentials in the address")
        .when((port != "") & ~F.coalesce(port.try_cast("int").between(1, 65535), F.lit(False)), "invalid port")
        .when(~F.coalesce(origin.isin(*FETCHED), F.lit(False)), "not fetched by us")
        .when(~F.coalesce(status == "fetched", F.lit(False)), "fetch did not succeed")
        .when(F.coalesce(sha256, F.lit("")) == "", "no payload")
        .when(F.coalesce(size, F.lit(0)) < MIN_BYTES, "payload too small")
        .when(F.coalesce(kind.isin(*BENIGN), F.lit(False)), "benign content")
    )
    named = let(host, lambda h: let(host_verdict(h), lambda v: F.when(~v.isin("ip", "domain"), v)))
    late = F.when(fetched_at.isNull(), "unknown fetch time").when(age > min(days, URL_DAYS), "too old").when(age < -1 / 24, "fetched in the future")
    return F.coalesce(early, named, late)


def ioc_reason(reason: Column, sha256: Column, family: Column) -> Column:
    return F.when(reason.isNotNull(), reason).when(~is_sha256(sha256), "malformed digest").when(~F.coalesce(F.lower(F.trim(family)).isin(*LABELS), F.lit(False)), "no family label")


def iocs(url: Column, sha256: Column) -> Column:
    """What a vetted candidate offers: the address, its host, the digest."""
    host = F.try_parse_url(F.trim(url), F.lit("HOST"))
    port = F.regexp_extract(F.coalesce(F.try_parse_url(F.trim(url), F.lit("AUTHORITY")), F.lit("")), r":([0-9]+)\z", 1)
    number = F.when(port != "", port).when(F.lower(url).startswith("https"), "443").otherwise("80")
    one = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("value"))
    is_ip = host_verdict(host) == "ip"
    return F.array(one("url", F.trim(url)), F.when(is_ip, one("ip:port", F.concat(host, F.lit(":"), number))).otherwise(one("domain", host)), one("sha256", F.lower(sha256)))


def sample_reason(origin: Column, size: Column, kind: Column, family: Column, tags: Column, captured_at: Column, now: Column, days: int = SAMPLE_DAYS) -> Column:
    signal = (F.coalesce(family, F.lit("")) != "") | F.arrays_overlap(tags, F.array(*map(F.lit, MALWARE_TAGS))) | (F.coalesce(origin.isin(*SAMPLE_ORIGINS), F.lit(False)) & (kind != "unknown"))
    return (
        F.when(origin == "cowrie_tty", "terminal recording")
        .when(F.coalesce(size, F.lit(0)) < MIN_BYTES, "too small")
        .when(F.coalesce(kind.isin(*BENIGN), F.lit(False)), "key material")
        .when(captured_at.isNull() | (_age_days(captured_at, now) > min(days, SAMPLE_DAYS)), "too old")
        .when(~F.coalesce(signal, F.lit(False)), "nothing that marks it as malware")
    )
