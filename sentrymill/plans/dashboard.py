"""Counts, top lists, roll-ups and point reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..sources import projection
from .base import D1, D3, D7, query

for _name, _col, _n in (("top_source_ips", "src_ip", 25), ("top_usernames", "username", 20), ("top_commands", "command", 20)):
    query(_name, f"SELECT {_col} AS value, count(*) AS hits FROM hp WHERE {_col} <> ''{' AND username <> ' + chr(39) + '?' + chr(39) if _col == 'username' else ''} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {_n}")(
        lambda spark, e, d, c=_col, n=_n: A.top_counts(e, c, n)
    )


@query("unique_ip_count", "SELECT count(DISTINCT src_ip) AS n FROM hp WHERE src_ip <> ''")
def unique_ips(spark, e, d):
    return e.where("src_ip <> ''").agg(F.count_distinct("src_ip").alias("n"))


@query("hourly_event_counts", "SELECT strftime(date_trunc('hour', ts), {stamp}) AS bucket, count(*) AS hits FROM hp WHERE ts >= {d3} GROUP BY 1")
def hourly(spark, e, d):
    return A.hourly(A.since(e, D3)).select(A.stamp("bucket").alias("bucket"), "hits")


@query("hourly_by_kind", "SELECT strftime(date_trunc('hour', ts), {stamp}) AS bucket, kind, count(*) AS hits FROM hp WHERE ts >= {d3} GROUP BY 1, 2")
def hourly_by_kind(spark, e, d):
    return A.hourly(A.since(e, D3), ("kind",)).select(A.stamp("bucket").alias("bucket"), "kind", "hits")


for _col in ("kind", "source"):
    query(f"counts_by_{_col}", f"SELECT {_col} AS value, count(*) AS hits FROM hp GROUP BY 1")(lambda spark, e, d, c=_col: e.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("hits")))


@query("hassh_coverage", "SELECT count_if(hassh <> '') AS with_hassh, count(*) AS total FROM hp WHERE source = 'cowrie'")
def coverage(spark, e, d):
    return e.where("source = 'cowrie'").agg(F.count_if(F.col("hassh") != "").alias("with_hassh"), F.count("*").alias("total"))


@query("totals", "SELECT count(*) AS events, count(DISTINCT CASE WHEN actor_id <> '' THEN actor_id END) AS actors, strftime(max(ts), {stamp}) AS latest FROM hp")
def totals(spark, e, d):
    return e.agg(F.count("*").alias("events"), F.count_distinct(F.when(F.col("actor_id") != "", F.col("actor_id"))).alias("actors"), A.stamp(F.max("ts")).alias("latest"))


ACTIVITY = "SELECT count(*) AS events, count(DISTINCT src_ip) AS ips, count_if(kind = 'accepted') AS accepted, count_if(kind = 'command') AS commands, count_if(kind IN ('file_download', 'file_upload')) AS downloads FROM hp WHERE ts >= {d1}"


def activity(e):
    kind = F.col("kind")
    return A.since(e, D1).agg(F.count("*").alias("events"), F.count_distinct("src_ip").alias("ips"), F.count_if(kind == "accepted").alias("accepted"), F.count_if(kind == "command").alias("commands"), F.count_if(kind.isin("file_download", "file_upload")).alias("downloads"))


@query("window_activity", ACTIVITY)
def window_activity(spark, e, d):
    return activity(e)


def factor(v, floor: float, ceil: float):
    """0 to 25 on a logarithmic scale between a floor and a ceiling."""
    x = F.log10(F.greatest(v.cast("double"), F.lit(floor)) / floor) / F.log10(F.lit(ceil / floor))
    return F.when(v <= 0, 0.0).otherwise(25 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


# Floor and ceiling of each factor of the threat gauge, and its label bounds.
FACTORS = (("volume", "events", 300.0, 1e6), ("diversity", "ips", 5.0, 1e4), ("intrusion", "accepted", 5.0, 2e4), ("weaponization", "weapon", 5.0, 2e4))


def gauge(a):
    a = a.withColumn("weapon", F.col("commands") + 3 * F.col("downloads"))
    for name, col, lo, hi in FACTORS:
        a = a.withColumn(name, factor(F.col(col), lo, hi))
    total = sum((F.col(n) for n, *_ in FACTORS[1:]), F.col(FACTORS[0][0]))
    s = F.round(F.least(F.lit(100.0), total)).cast("int")
    a = a.withColumn("score", s)
    return a.select("score", F.when(s <= 20, "LOW").when(s <= 45, "MODERATE").when(s <= 70, "HIGH").otherwise("CRITICAL").alias("label"), *[F.round(n).cast("int").alias(n) for n, *_ in FACTORS])


def _factor_sql(c, lo, hi):
    return f"(CASE WHEN {c} <= 0 THEN 0.0 ELSE 25 * greatest(0.0, least(1.0, log10(greatest({c}::DOUBLE, {lo}) / {lo}) / log10({hi / lo}))) END)"


_F = [_factor_sql({"weapon": "(commands + 3 * downloads)"}.get(c, c), lo, hi) for _, c, lo, hi in FACTORS]
_S = f"CAST(round(least(100.0, {' + '.join(_F)})) AS INT)"


@query("threat_gauge", f"SELECT {_S} AS score, CASE WHEN {_S} <= 20 THEN 'LOW' WHEN {_S} <= 45 THEN 'MODERATE' WHEN {_S} <= 70 THEN 'HIGH' ELSE 'CRITICAL' END AS label, " + ", ".join(f"CAST(round({x}) AS INT) AS {n[0]}" for x, n in zip(_F, FACTORS)) + " FROM act", f"act AS ({ACTIVITY})")
def threat(spark, e, d):
    return gauge(activity(e))


@query("top_countries", "SELECT json_extract_string(payload, '$.cc') AS cc, max(json_extract_string(payload, '$.country')) AS country, CAST(sum(hits) AS BIGINT) AS hits FROM h JOIN geo USING (ip) WHERE json_extract_string(payload, '$.cc') <> '' GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 12", "h AS (SELECT src_ip AS ip, count(*) AS hits FROM hp WHERE src_ip <> '' GROUP BY 1)")
def top_countries(spark, e, d):
    hits = e.where("src_ip <> ''").groupBy(F.col("src_ip").alias("ip")).agg(F.count("*").alias("hits"))
    g = projection.geo(spark, e).select("ip", F.get_json_object("payload", "$.cc").alias("cc"), F.get_json_object("payload", "$.country").alias("country"))
    return hits.join(g, "ip").where("cc <> ''").groupBy("cc").agg(F.max("country").alias("country"), F.sum("hits").alias("hits")).orderBy(F.desc("hits"), "cc").limit(12)


@query("distinct_geo_countries", "SELECT count(DISTINCT json_extract_string(payload, '$.cc')) AS n FROM geo WHERE json_extract_string(payload, '$.ok') = 'true'")
def geo_countries(spark, e, d):
    return projection.geo(spark, e).where(F.get_json_object("payload", "$.ok") == "true").agg(F.count_distinct(F.get_json_object("payload", "$.cc")).alias("n"))


@query("recent_rates_by_actor", "SELECT actor_id, round(count(*) / 24.0, 6) AS rate FROM hp WHERE ts >= {d1} AND actor_id <> '' GROUP BY 1")
def recent_rates(spark, e, d):
    return A.recent_rates(e, D1, 24).select("actor_id", F.round("rate", 6).alias("rate"))


@query("top_actors_by_recent_rate", "SELECT actor_id, round(rate, 6) AS rate, n AS event_count FROM (SELECT actor_id, count(*) / 24.0 AS rate FROM hp WHERE ts >= {d1} AND actor_id <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8) JOIN (SELECT actor_id, count(*) AS n FROM hp GROUP BY 1) USING (actor_id)")
def top_recent(spark, e, d):
    top = A.recent_rates(e, D1, 24).orderBy(F.desc("rate"), "actor_id").limit(8)
    own = e.join(F.broadcast(top.select("actor_id")), "actor_id", "left_semi")  # eight rows; others are not counted
    return own.groupBy("actor_id").agg(F.count("*").alias("event_count")).join(F.broadcast(top), "actor_id").select("actor_id", F.round("rate", 6).alias("rate"), "event_count")


@query("count_sessions", "SELECT count(DISTINCT session_id) AS n FROM hp WHERE source = 'cowrie' AND session_id <> ''")
def count_sessions(spark, e, d):
    return e.where("source = 'cowrie' and session_id <> ''").agg(F.count_distinct("session_id").alias("n"))


SESSION = "s AS (SELECT session_id, max(src_ip) AS src_ip, max(hassh) AS hassh, max(ssh_client) AS ssh_client, max(actor_id) AS actor_id, coalesce(max(CASE WHEN username <> '' THEN username END), '') AS username, min(ts) AS a, max(ts) AS b, count(*) AS n, count_if(command <> '') AS n_cmd, count_if(kind = 'command') AS n_shell, arg_min(command, (ts, id)) FILTER (WHERE kind = 'command' AND command <> '') AS first_command FROM hp WHERE source = 'cowrie' AND session_id <> ''{w} GROUP BY 1)"


@query("count_sessions_since", "SELECT count(*) AS n FROM s WHERE n_cmd >= 1", SESSION.replace("{w}", " AND ts >= {d7}"))
def count_sessions_since(spark, e, d):
    return A.sessions(A.since(e, D7)).where("n_cmd >= 1").agg(F.count("*").alias("n"))


@query("list_sessions", "SELECT session_id, src_ip, hassh, ssh_client, actor_id, username, strftime(a, {stamp}) AS start_ts, strftime(b, {stamp}) AS end_ts, n, n_cmd, CAST((epoch_us(b) - epoch_us(a)) // 1000 AS BIGINT) AS duration_ms FROM s WHERE n_cmd >= 1 ORDER BY b DESC, session_id LIMIT 200", SESSION.replace("{w}", " AND ts >= {d7}"))
def list_sessions(spark, e, d):
    s = A.sessions(A.since(e, D7)).where("n_cmd >= 1").orderBy(F.desc("end_ts"), "session_id").limit(200)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return s.select("session_id", "src_ip", "hassh", "ssh_client", "actor_id", "username", A.stamp("start_ts").alias("start_ts"), A.stamp("end_ts").alias("end_ts"), "n", "n_cmd", F.expr("(unix_micros(cast(end_ts as timestamp)) - unix_micros(cast(start_ts as timestamp))) div 1000").alias("duration_ms"))


@query("recent_shell_sessions", "SELECT session_id, actor_id, n_shell, first_command, strftime(b, {stamp}) AS end_ts FROM s WHERE n_shell > 0 ORDER BY b DESC, session_id LIMIT 30", SESSION.replace("{w}", " AND ts >= {d1}"))
def shell_sessions(spark, e, d):
    return A.sessions(A.since(e, D1)).where("n_shell > 0").orderBy(F.desc("end_ts"), "session_id").limit(30).select("session_id", "actor_id", "n_shell", "first_command", A.stamp("end_ts").alias("end_ts"))


@query("top_tunnel_targets", "SELECT dst_ip, dst_port, count(*) AS hits, count(DISTINCT actor_id) AS actors, strftime(min(ts), {stamp}) AS first_ts, strftime(max(ts), {stamp}) AS last_ts FROM hp WHERE kind = 'tunnel' AND dst_ip <> '' AND ts >= {d7} GROUP BY 1, 2 ORDER BY hits DESC, max(ts) DESC, dst_ip, dst_port LIMIT 50")
def tunnels(spark, e, d):
    t = A.since(e, D7).where("kind = 'tunnel' and dst_ip <> ''").groupBy("dst_ip", "dst_port").agg(F.count("*").alias("hits"), F.count_distinct("actor_id").alias("actors"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return t.orderBy(F.desc("hits"), F.desc("b"), "dst_ip", "dst_port").limit(50).select("dst_ip", "dst_port", "hits", "actors", A.stamp("a").alias("first_ts"), A.stamp("b").alias("last_ts"))


@query("count_tunnel_targets", "SELECT count(*) AS n FROM (SELECT DISTINCT dst_ip, dst_port FROM hp WHERE kind = 'tunnel' AND dst_ip <> '' AND ts >= {d7})")
def count_tunnels(spark, e, d):
    return A.since(e, D7).where("kind = 'tunnel' and dst_ip <> ''").select("dst_ip", "dst_port").distinct().agg(F.count("*").alias("n"))


@query("credential_usernames", "SELECT username AS value, count(*) AS hits FROM hp WHERE ts >= {d7} AND username NOT IN ('', '?') GROUP BY 1")
def cred_users(spark, e, d):
    return A.since(e, D7).where("username not in ('', '?')").groupBy(F.col("username").alias("value")).agg(F.count("*").alias("hits"))


@query("credential_passwords", "SELECT password AS value, count(*) AS hits FROM hp WHERE ts >= {d7} AND password <> '' GROUP BY 1")
def cred_passwords(spark, e, d):
    return A.since(e, D7).where("password <> ''").groupBy(F.col("password").alias("value")).agg(F.count("*").alias("hits"))


@query("credential_combos", "SELECT username, password, count(*) AS hits FROM hp WHERE ts >= {d7} AND username NOT IN ('', '?') AND password <> '' GROUP BY 1, 2")
def cred_combos(spark, e, d):
    return A.since(e, D7).where("username not in ('', '?') and password <> ''").groupBy("username", "password").agg(F.count("*").alias("hits"))


@query("wordlist_file", "SELECT concat(username, ':', password) AS line FROM (SELECT username, password, count(*) AS c FROM hp WHERE username NOT IN ('', '?') AND password <> '' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 100)")
def wordlist(spark, e, d):
    return e.where("username not in ('', '?') and password <> ''").groupBy("username", "password").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "username", "password").limit(100).select(F.concat("username", F.lit(":"), "password").alias("line"))


@query("capture_summary", "SELECT (SELECT count(*) FROM art) AS total, (SELECT count_if(status = 'fetched') FROM art) AS fetched, (SELECT count_if(status = 'failed') FROM art) AS failed, (SELECT count_if(status = 'capturing') FROM art) AS capturing, (SELECT CAST(coalesce(sum(m), 0) AS BIGINT) FROM (SELECT max(size_bytes) AS m FROM art WHERE status = 'fetched' AND local_path <> '' GROUP BY local_path)) AS bytes")
def capture_summary(spark, e, d):
    a = projection.artifacts(spark, e)
    path = F.when((F.col("status") == "fetched") & (F.col("local_path") != ""), F.col("local_path"))
    per = a.groupBy(path.alias("path")).agg(F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(s) for s in ("fetched", "failed", "capturing")], F.max("size_bytes").alias("m"))
    return per.agg(F.sum("n").alias("total"), *[F.sum(s).alias(s) for s in ("fetched", "failed", "capturing")], F.coalesce(F.sum(F.when(F.col("path").isNotNull(), F.col("m"))), F.lit(0)).alias("bytes"))


@query("distinct_payloads", "SELECT count(DISTINCT sha256) AS n FROM art WHERE coalesce(ts, created_at) >= {d7}")
def payloads(spark, e, d):
    return A.since(projection.artifacts(spark, e), D7).agg(F.count_distinct("sha256").alias("n"))


@query("artifacts_aggregated", "SELECT sha256, max(size_bytes) AS size_bytes, strftime(min(ts), {stamp}) AS first_ts, strftime(max(ts), {stamp}) AS last_ts, count(*) AS occurrences, count(DISTINCT nullif(url, '')) AS urls, count(DISTINCT nullif(src_ip, '')) AS ips, count(DISTINCT nullif(actor_id, '')) AS actors, count(DISTINCT nullif(session_id, '')) AS sessions, max(CASE WHEN local_path <> '' THEN 1 ELSE 0 END) AS has_local, max(CASE WHEN origin = 'quarantine_fetch' THEN 1 ELSE 0 END) AS shareable, arg_max(origin, (ts, id)) AS origin, arg_max(status, (ts, id)) AS status FROM art WHERE ts >= {d7} GROUP BY 1")
def artifact_groups(spark, e, d):
    g = A.artifact_groups(A.since(projection.artifacts(spark, e), D7), ("quarantine_fetch",))
    return g.select("sha256", "size_bytes", A.stamp("first_ts").alias("first_ts"), A.stamp("last_ts").alias("last_ts"), "occurrences", "urls", "ips", "actors", "sessions", "has_local", "shareable", "latest.origin", "latest.status")


@query("share_candidates", "SELECT sha256, id FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY created_at DESC, id DESC) AS r FROM art WHERE status = 'fetched' AND size_bytes >= 64 AND local_path <> '' AND origin IN ('quarantine_fetch') AND created_at >= {d7}) WHERE r = 1")
def share_candidates(spark, e, d):
    a = projection.artifacts(spark, e).where("status = 'fetched' and size_bytes >= 64 and local_path <> '' and origin in ('quarantine_fetch')")
    return A.since(a, D7).groupBy("sha256").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


@query("due_captures", "SELECT id, url FROM art WHERE status IN ('capturing', 'failed') AND attempt_count < 5 ORDER BY created_at, id LIMIT 100")
def due(spark, e, d):
    return projection.artifacts(spark, e).where("status in ('capturing', 'failed') and attempt_count < 5").orderBy("created_at", "id").limit(100).select("id", "url")


@query("ledger_stats", "SELECT count(DISTINCT sha256) AS payloads, count(DISTINCT CASE WHEN sha256 IN (SELECT sha256 FROM led) THEN sha256 END) AS uploaded, count(DISTINCT CASE WHEN sha256 NOT IN (SELECT sha256 FROM led) THEN sha256 END) AS pending FROM art WHERE status = 'fetched'")
def ledger(spark, e, d):
    led = projection.ledger(spark, e).select("sha256", F.lit(1).alias("up"))
    got = projection.artifacts(spark, e).where("status = 'fetched'").select("sha256").distinct().join(led, "sha256", "left")
    return got.agg(F.count("*").alias("payloads"), F.count("up").alias("uploaded"), F.count_if(F.col("up").isNull()).alias("pending"))


@query("unshared_payloads", "SELECT DISTINCT sha256 FROM art WHERE status = 'fetched' AND sha256 NOT IN (SELECT sha256 FROM led)")
def unshared(spark, e, d):
    return projection.artifacts(spark, e).where("status = 'fetched'").select("sha256").distinct().join(projection.ledger(spark, e), "sha256", "left_anti")


@query("upload_sources", "SELECT u.sha256, u.status, min(a.src_ip) AS src_ip, count(a.id) AS sightings FROM led u LEFT JOIN art a USING (sha256) GROUP BY 1, 2")
def upload_sources(spark, e, d):
    per = projection.artifacts(spark, e).groupBy("sha256").agg(F.min("src_ip").alias("src_ip"), F.count("*").alias("sightings"))
    return projection.ledger(spark, e).select("sha256", "status").join(per, "sha256", "left").withColumn("sightings", F.coalesce("sightings", F.lit(0)))


@query("recent_events", "SELECT id, strftime(ts, {stamp}) AS ts, source, kind, src_ip, username, command, actor_id FROM hp ORDER BY hp.ts DESC, id DESC LIMIT 120")
def recent_events(spark, e, d):
    return e.orderBy(F.desc("ts"), F.desc("id")).limit(120).select("id", A.stamp("ts").alias("ts"), "source", "kind", "src_ip", "username", "command", "actor_id")


@query("recent_commands", "SELECT id, command, CASE WHEN username <> '' THEN username ELSE coalesce(u, '') END AS username FROM (SELECT * FROM hp WHERE command <> '' ORDER BY ts DESC, id DESC LIMIT 50) LEFT JOIN (SELECT session_id, coalesce(max(CASE WHEN kind = 'accepted' THEN username END), max(username)) AS u FROM hp WHERE session_id <> '' AND username <> '' GROUP BY 1) USING (session_id)")
def recent_commands(spark, e, d):
    top = e.where("command <> ''").orderBy(F.desc("ts"), F.desc("id")).limit(50)
    names = A.session_usernames(e.join(F.broadcast(top.select("session_id").distinct()), "session_id", "left_semi"))
    return top.join(names, "session_id", "left").select("id", "command", F.when(F.col("username") != "", F.col("username")).otherwise(F.coalesce("session_user", F.lit(""))).alias("username"))


@query("timeline", "SELECT id, kind, src_ip FROM hp WHERE ts >= {d1} ORDER BY ts DESC, id DESC LIMIT 50")
def timeline(spark, e, d):
    return A.since(e, D1).orderBy(F.desc("ts"), F.desc("id")).limit(50).select("id", "kind", "src_ip")


for _kind, _cond, _n in (("recent_command_events", "kind = 'command' AND command <> ''", 200), ("recent_file_downloads", "kind = 'file_download'", 100)):
    query(_kind, f"SELECT id, command, src_ip FROM hp WHERE {_cond} ORDER BY ts DESC, id DESC LIMIT {_n}")(lambda spark, e, d, c=_cond, n=_n: e.where(c).orderBy(F.desc("ts"), F.desc("id")).limit(n).select("id", "command", "src_ip"))


@query("top_users_per_actor", "SELECT actor_id, username, n, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY actor_id ORDER BY n DESC, username) AS r FROM (SELECT actor_id, username, count(*) AS n FROM hp WHERE actor_id <> '' AND username NOT IN ('', '?') GROUP BY 1, 2)) WHERE r <= 8")
def top_users(spark, e, d):
    n = e.where("actor_id <> '' and username not in ('', '?')").groupBy("actor_id", "username").agg(F.count("*").alias("n"))
    return A.ranked(n, ["actor_id"], [F.desc("n"), F.asc("username")], 8)


@query("last_command_per_actor", "SELECT actor_id, arg_max(command, (ts, id)) AS command FROM hp WHERE actor_id <> '' AND command <> '' GROUP BY 1")
def last_command(spark, e, d):
    return e.where("actor_id <> '' and command <> ''").groupBy("actor_id").agg(F.max_by("command", F.struct("ts", "id")).alias("command"))


@query("journal_ip_stats", "SELECT src_ip, count(*) AS n, strftime(min(ts), {stamp}) AS first_ts, strftime(max(ts), {stamp}) AS last_ts, count(DISTINCT CASE WHEN username NOT IN ('', '?') THEN username END) AS users FROM hp WHERE source = 'journal' AND actor_id <> '' GROUP BY 1")
def journal_ips(spark, e, d):
    g = e.where("source = 'journal' and actor_id <> ''").groupBy("src_ip").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"), F.count_distinct(F.when(~F.col("username").isin("", "?"), F.col("username"))).alias("users"))
    return g.select("src_ip", "n", A.stamp("a").alias("first_ts"), A.stamp("b").alias("last_ts"), "users")


@query("actor_ips", "SELECT actor_id, src_ip AS ip, count(*) AS n, strftime(min(ts), {stamp}) AS first_seen, strftime(max(ts), {stamp}) AS last_seen FROM hp WHERE actor_id <> '' GROUP BY 1, 2")
def actor_ips(spark, e, d):
    return e.where("actor_id <> ''").groupBy("actor_id", F.col("src_ip").alias("ip")).agg(F.count("*").alias("n"), A.stamp(F.min("ts")).alias("first_seen"), A.stamp(F.max("ts")).alias("last_seen"))


@query("actor_users", "SELECT actor_id, username, count(*) AS n FROM hp WHERE actor_id <> '' AND username NOT IN ('', '?') GROUP BY 1, 2")
def actor_users(spark, e, d):
    return e.where("actor_id <> '' and username not in ('', '?')").groupBy("actor_id", "username").agg(F.count("*").alias("n"))


@query("retention_purge", "SELECT count(*) AS kept, count(DISTINCT session_id) AS sessions FROM hp WHERE ts >= {d7}")
def purge(spark, e, d):
    return A.since(e, D7).agg(F.count("*").alias("kept"), F.count_distinct("session_id").alias("sessions"))


@query("batch_dedup", "SELECT source, count(*) AS n FROM hp GROUP BY 1")
def batch_dedup(spark, e, d):
    keys = ["ts", "source", "kind", "src_ip", "session_id", "username", "command"]
    twice = e.unionByName(e.where("id % 2 = 0"))
    return A.dedup(twice, None, keys).groupBy("source").agg(F.count("*").alias("n"))


@query("dedup_against_stored", "SELECT count(*) AS n FROM hp WHERE ts >= {d7}")
def dedup_stored(spark, e, d):
    keys = ["ts", "source", "kind", "src_ip", "session_id", "username", "command"]
    stored = e.where(F.col("ts") < F.lit(D7).cast(e.schema["ts"].dataType))
    return A.dedup(e, stored, keys).agg(F.count("*").alias("n"))
