"""What an actor is doing, as column expressions over its aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signal bits of an event and of the actor that it belongs to.
PROBE, TUNNEL, PAYLOAD, DEPLOY_CMD, AUTH, COMMAND = 1, 2, 4, 8, 16, 32
PROBE_KINDS = ("connect", "invalid_user", "failed_password", "failed_publickey")
AUTH_KINDS = ("accepted", "invalid_user", "failed_password", "failed_publickey")
PAYLOAD_KINDS = ("file_download", "file_upload")
# User names and client banners that mark a campaign, and the rates that separate playbooks.
SERVICE_USERS = ("oracle", "hadoop", "postgres", "mysql", "jenkins", "gitlab", "ftpuser", "redis")
CRYPTO_USERS = ("sol", "solana", "ethereum", "miner")
DEFAULT_USERS = ("admin", "root", "user", "test")
NAME_PREFIX = "^(zhang|chen|wang|li|liu|yang|huang|zhao|wu|zhou|xu|sun|ma|zhu|hu|guo|he|gao|lin|luo|zheng|liang|xie|song|tang|han|feng|yu|dong|wei|ye|shi|weiqq|yaojun|wenshuo)"
SCANNER = r"(?i)libssh|libssh2|nmap|zgrab|zmap|masscan|phpseclib|asyncssh|rawpasswordconnectonly|paramiko|openssh-for-windows|ssh-2\.0-go|recon-ng|hydra|medusa|ncrack"
FAST_SPRAY, SERVICE_MAX, DEFAULT_CRED, DICTIONARY, NAME_RATIO, CRYPTO_RATIO = 120.0, 80.0, 40.0, 60.0, 0.30, 0.15
CONFIDENCE = {"journal": 55, "journal_fast": 70, "cowrie": 72, "cowrie_payload": 84}


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def deploys(command: Column) -> Column:
    """A command that fetches and stages a payload, or runs one that was dropped."""
    c = F.lower(command)
    fetch = _any(c, ("curl ", "wget ", "wget;", "tftp "))
    sink = _any(c, ("|sh", "| sh", "|bash", "| bash", ">", "/tmp/"))
    run = c.rlike(r"(^ *|[;&|(`] *)\./")
    return F.coalesce((fetch & sink) | _any(c, ("chmod +x", "chmod 777")) | run | (c.contains("/tmp/") & _any(c, ("sh ", "bash ", "exec "))), F.lit(False))


def flags(kind: Column, sha256: Column, command: Column) -> Column:
    bit = lambda cond, v: F.when(cond, v).otherwise(0)
    return (
        bit(kind.isin(*PROBE_KINDS), PROBE)
        + bit(kind.isin(*AUTH_KINDS), AUTH)
        + bit(kind == "tunnel", TUNNEL)
        + bit(kind.isin(*PAYLOAD_KINDS) | (sha256 != ""), PAYLOAD)
        + bit(kind == "command", COMMAND)
        + bit((kind == "command") & deploys(command), DEPLOY_CMD)
    )


def has(mask: Column, bit: int) -> Column:
    return mask.bitwiseAND(F.lit(bit)) != 0


def rate(count: Column, first: Column, last: Column) -> Column:
    """Events an hour; spans under a quarter of an hour count as that."""
    return count / F.greatest(span_hours(first, last), F.lit(0.25))


def span_hours(first: Column, last: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(last) - micros(first)) / F.lit(3.6e9)


def playbook(users: Column, per_hour: Column) -> Column:
    """The campaign that distinct user names and a rate look like; rules apply in order."""
    count = lambda cond: F.size(F.filter(users, lambda u: cond(F.lower(u))))
    mostly_alpha = lambda u: (F.octet_length(u) >= 4) & (F.length(F.regexp_replace(u, "[^a-z_]", "")) / F.length(u) > 0.85)
    names = count(lambda u: u.rlike(NAME_PREFIX) | mostly_alpha(u))
    service, crypto = count(lambda u: u.isin(*SERVICE_USERS)), count(lambda u: u.isin(*CRYPTO_USERS))
    default, ops = count(lambda u: u.isin(*DEFAULT_USERS)), count(lambda u: u.contains("k8s") | u.isin("deploy", "ci"))
    n = F.size(users)
    return (
        F.when(n == 0, "unknown")
        .when((per_hour >= FAST_SPRAY) & (names / n > NAME_RATIO), "fast_dictionary_spray")
        .when((service >= 2) & (per_hour < SERVICE_MAX), "service_account_enum")
        .when((crypto >= 2) | ((crypto >= 1) & (crypto / n >= CRYPTO_RATIO)), "crypto_target")
        .when(ops >= 2, "ops_target")
        .when((default >= 2) & (per_hour >= DEFAULT_CRED), "default_credential_spray")
        .when(per_hour >= DICTIONARY, "dictionary_spray")
        .otherwise("opportunistic")
    )


def sensor_playbook(users: Column, per_hour: Column, client: Column, mask: Column) -> Column:
    """Actors that only shook hands are told apart by their client's banner."""
    acted = has(mask, AUTH) | has(mask, COMMAND) | has(mask, TUNNEL) | has(mask, PAYLOAD)
    return F.when(acted, playbook(users, per_hour)).when(client.rlike(SCANNER), "scanner_tool").otherwise("handshake_scan")


def intent(mask: Column) -> Column:
    staged = has(mask, PAYLOAD) | has(mask, DEPLOY_CMD)
    return (
        F.when(has(mask, TUNNEL) & staged, "mixed")
        .when(has(mask, PROBE) & ~staged, "probe")
        .when(has(mask, TUNNEL), "proxy")
        .when(staged, "deploy")
        .otherwise("unknown")
    )


def _tiers(per_hour: Column, high: int, mid: int, low: int) -> Column:
    return F.when(per_hour >= 120, high).when(per_hour >= 60, mid).when(per_hour >= 20, low).otherwise(0)


def sensor_score(mask: Column, per_hour: Column) -> Column:
    part = lambda bit, v: F.when(has(mask, bit), v).otherwise(0)
    return F.least(F.lit(100), part(PROBE, 40) + part(TUNNEL, 15) + part(PAYLOAD, 25) + part(DEPLOY_CMD, 25) + _tiers(per_hour, 20, 12, 6))


def journal_score(count: Column, per_hour: Column, users: Column) -> Column:
    wide = F.when(users >= 10, 20).when(users >= 3, 10).otherwise(0)
    return F.least(F.lit(100), F.lit(30) + _tiers(per_hour, 35, 22, 12) + wide + F.when(count >= 100, 10).otherwise(0))


def tier(confidence: Column) -> Column:
    return F.when(confidence >= 84, "CONFIRMED").when(confidence >= 72, "HIGH").when(confidence >= 70, "MEDIUM").otherwise("LOW")


def user_set_hash(users: Column) -> Column:
    """First 8 bytes, in hex, of the digest of the sorted names; empty for none."""
    return F.when(F.size(users) == 0, "").otherwise(F.substring(F.sha2(F.array_join(F.array_sort(users), ","), 256), 1, 16))
