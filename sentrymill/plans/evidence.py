"""What sessions did and left: replay scripts, summaries, recordings and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import payload, tty
from ..operators import aggregates as A
from ..sources import logs
from .archive import recorded
from .base import query

LONGEST_SLEEP = 5.0


def offset(seconds: Column) -> Column:
    """Seconds, minutes and seconds, or hours and minutes."""
    s = seconds.cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    part = lambda n, m: F.floor(s % n / m).cast("long")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(part(3600, 60).cast("string"), F.lit("m"), two(s % 60), F.lit("s")))
        .otherwise(F.concat(F.floor(s / 3600).cast("long").cast("string"), F.lit("h"), two(part(3600, 60)), F.lit("m")))
    )


def replay(events: DataFrame, dry_run: bool = False, sleeps: bool = True) -> DataFrame:
    """(session_id, place, text): a session's replay script in parts. Part 0 says whose it is, each other one waits as long as the
    intruder did (5 s at most, not under 1 s), marks the time since the first command, and gives the command, as a comment in a dry run."""
    shell = events.where("kind = 'command' and session_id <> '' and trim(command) <> ''")
    w = W.partitionBy("session_id").orderBy("ts", "id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    got = shell.withColumns({"place": F.row_number().over(w), "_gap": (us - F.lag(us).over(w)) / 1e6, "_since": (us - F.min(us).over(w)) / 1e6})
    wait = F.least("_gap", F.lit(LONGEST_SLEEP))
    pause = F.when(wait >= 1, F.concat(F.lit("sleep "), F.format_string("%.1f", wait), F.lit("\n"))).otherwise("") if sleeps else F.lit("")
    mark = F.when(F.col("place") > 1, F.concat(F.lit("# T+"), offset(F.col("_since")), F.lit("\n"))).otherwise("")
    command = F.trim("command")
    body = F.concat(F.lit("# "), F.regexp_replace(command, "\n", "\n# ")) if dry_run else command
    parts = got.select("session_id", F.col("place").cast("long").alias("place"), F.concat(pause, mark, body).alias("text"))
    safe = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[\r\n]", " ")
    first = shell.groupBy("session_id").agg(F.min(F.struct("ts", "id", "actor_id", "src_ip", "username")).alias("e"))
    when = F.date_format("e.ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(F.lit("#!/usr/bin/env bash\n# session: "), safe(F.col("session_id")), F.lit("\n# actor:  "), safe(F.col("e.actor_id")), F.lit("\n# src_ip: "), safe(F.col("e.src_ip")), F.lit("\n# user:   "), safe(F.col("e.username")), F.lit("\n# first:  "), when, F.lit("\nset +e"))
    return parts.unionByName(first.select("session_id", F.lit(0).cast("long").alias("place"), head.alias("text")))


_STEP = "st AS (SELECT *, row_number() OVER w AS place, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap, (epoch_us(ts) - epoch_us(min(ts) OVER w)) // 1000000 AS s FROM hp WHERE kind = 'command' AND session_id <> '' AND trim(command) <> '' WINDOW w AS (PARTITION BY session_id ORDER BY ts, id))"


@query(
    "replay_parts",
    "SELECT session_id, place, concat(CASE WHEN least(gap, 5) >= 1 THEN concat('sleep ', format('{:.1f}', least(gap, 5.0)), chr(10)) ELSE '' END, CASE WHEN place > 1 THEN concat('# T+', CASE WHEN s < 60 THEN concat(s, 's') WHEN s < 3600 THEN concat(s // 60, 'm', lpad(CAST(s % 60 AS STRING), 2, '0'), 's') ELSE concat(s // 3600, 'h', lpad(CAST(s % 3600 // 60 AS STRING), 2, '0'), 'm') END, chr(10)) ELSE '' END, '# ', trim(command)) AS text FROM st UNION ALL SELECT session_id, 0, concat('#!/usr/bin/env bash', chr(10), '# session: ', session_id, chr(10), '# actor:  ', actor_id, chr(10), '# src_ip: ', src_ip, chr(10), '# user:   ', username, chr(10), '# first:  ', strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), chr(10), 'set +e') FROM st WHERE place = 1",
    _STEP,
)
def replay_parts(spark, e, d):
    """Dry replay scripts of all sessions, with their waits and marks."""
    return replay(e, dry_run=True)


def summaries(events: DataFrame, bindings: DataFrame) -> DataFrame:
    """A row a session: first address, last name used, span, architecture, and its duration, exact if its end was recorded."""
    known = events.where("session_id <> ''")
    order = F.struct("ts", "id")
    got = known.groupBy("session_id").agg(F.min_by("src_ip", order).alias("ip"), F.coalesce(F.max_by("username", F.when(F.col("username") != "", order)), F.lit("")).alias("user"), F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("events"))
    got = got.join(bindings.select("session_id", "duration_ms", "arch"), "session_id", "left")
    span = F.floor((F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 1000).cast("long")
    exact = F.coalesce(F.col("duration_ms") > 0, F.lit(False))
    return got.select("session_id", "ip", "user", A.stamp("a").alias("start_ts"), A.stamp("b").alias("end_ts"), "events", F.when(exact, F.col("duration_ms")).otherwise(span).alias("duration_ms"), exact.alias("exact"), F.coalesce("arch", F.lit("")).alias("arch"))


_SIDE = "sd AS (SELECT session_id, min(ts) AS t, min(id) AS k FROM hp WHERE session_id <> '' GROUP BY 1), sb AS (SELECT session_id, CASE WHEN k % 3 = 0 THEN k % 977 + 1 END AS ms, CASE WHEN k % 4 = 0 THEN concat('arch-', CAST(k % 5 AS STRING)) END AS arch, CASE WHEN k % 2 = 0 THEN concat('fp', CAST(k % 7 AS STRING)) END AS h FROM sd)"


def side_lines(e: DataFrame) -> DataFrame:
    """Side records of the sessions: for some a fingerprint, an end with its duration, an architecture; each also repeated later with another value."""
    s = e.where("session_id <> ''").groupBy("session_id").agg(F.min("ts").alias("t"), F.min("id").alias("k"))
    at = lambda plus: F.date_format(F.col("t").cast("timestamp") + F.expr(f"interval {plus} seconds"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")
    one = lambda eventid, plus, *more: F.to_json(F.struct(F.lit(f"cowrie.{eventid}").alias("eventid"), at(plus), F.col("session_id").alias("session"), *more)).alias("value")
    fp, arch = F.concat(F.lit("fp"), (F.col("k") % 7).cast("string")), F.concat(F.lit(" arch-"), (F.col("k") % 5).cast("string"))
    rows = [s.where("k % 2 = 0").select(one("client.kex", 1, fp.alias("hassh"))), s.where("k % 2 = 0").select(one("client.kex", 5, F.lit("later").alias("hassh"))), s.where("k % 3 = 0").select(one("session.closed", 2, (F.col("k") % 977 + 1).alias("duration_ms"))), s.where("k % 3 = 0").select(one("session.closed", 1, F.lit(0).alias("duration_ms"))), s.where("k % 4 = 0").select(one("session.params", 1, arch.alias("arch"))), s.where("k % 4 = 0").select(one("session.params", 9, F.lit("other").alias("arch")))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("session_bindings", "SELECT session_id, h AS hassh, coalesce(ms, 0) AS duration_ms, arch FROM sb WHERE h IS NOT NULL OR ms IS NOT NULL OR arch IS NOT NULL", _SIDE)
def session_bindings(spark, e, d):
    """What side records of the sensor say of each session, of each thing the first."""
    return logs.bindings(side_lines(e)).select("session_id", "hassh", F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"), "arch")


@query(
    "session_summaries",
    "SELECT session_id, ip, coalesce(u, '') AS user, strftime(a, {stamp}) AS start_ts, strftime(b, {stamp}) AS end_ts, events, coalesce(ms, (epoch_us(b) - epoch_us(a)) // 1000) AS duration_ms, ms IS NOT NULL AS exact, coalesce(arch, '') AS arch FROM (SELECT session_id, arg_min(src_ip, (ts, id)) AS ip, arg_max(username, (ts, id)) FILTER (WHERE username <> '') AS u, min(ts) AS a, max(ts) AS b, count(*) AS events FROM hp WHERE session_id <> '' GROUP BY 1) LEFT JOIN sb USING (session_id)",
    _SIDE,
)
def session_summaries(spark, e, d):
    """Every session with its last name and its duration, recorded or else spanned."""
    return summaries(e, logs.bindings(side_lines(e)))


@query(
    "recording_transcripts",
    "SELECT k, CASE WHEN k % 9 = 0 THEN '' ELSE concat('echo ', CAST(k AS STRING), chr(10)) END AS transcript, CASE WHEN k % 9 = 0 THEN 0 ELSE 1 END AS frames FROM (SELECT DISTINCT id % 200 AS k FROM hp WHERE source = 'cowrie')",
)
def transcripts(spark, e, d):
    """Transcripts and frames of recordings."""
    return recorded(e).select("k", tty.rendered("content").alias("transcript"), F.size(tty.frames("content")).alias("frames"))


#: Contents by what they begin with, each followed by a number.
_BYTES = ("MZ\x00", "ssh-rsa AAAA", "import os\ndef f():\n    x = ", "C0755 9 x\n#!/bin/sh\necho ", "plain text ", "#!/bin/bash\necho ")


@query(
    "payload_kinds",
    "SELECT k, CASE k % 6 WHEN 0 THEN 'PE executable' WHEN 1 THEN 'SSH key' WHEN 2 THEN 'Python (no shebang)' WHEN 3 THEN 'Shell script (scp-framed)' WHEN 4 THEN 'unknown' ELSE 'Shell script' END AS kind, CASE k % 6 WHEN 0 THEN 'exe,linux' WHEN 1 THEN 'ssh-key,linux' WHEN 2 THEN 'python,script,linux' WHEN 3 THEN 'bash,script,linux' WHEN 4 THEN 'unknown,linux' ELSE 'bash,script,linux' END AS tags, CASE WHEN k % 6 = 4 THEN concat('00000000: 706c 6169 6e20 7465 7874 20', regexp_replace(CAST(100 + k AS STRING), '([0-9])([0-9])([0-9])', '3\\1 3\\23\\3'), '       plain text ', CAST(100 + k AS STRING)) END AS hex FROM (SELECT DISTINCT id % 600 AS k FROM hp)",
)
def payload_kinds(spark, e, d):
    """Kinds, tags and hex previews of payloads."""
    k = e.select((F.col("id") % 600).alias("k")).distinct()
    content = F.concat(F.element_at(F.array(*map(F.lit, _BYTES)), (F.col("k") % 6 + 1).cast("int")), (F.col("k") + 100).cast("string")).cast("binary")
    got = k.select("k", payload.described(content).alias("d"))
    return got.select("k", "d.kind", F.array_join("d.tags", ",").alias("tags"), F.when(F.col("k") % 6 == 4, F.col("d.hex")).alias("hex"))
