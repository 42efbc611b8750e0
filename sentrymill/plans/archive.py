"""Plans over folders of downloads and recordings, and submissions within a budget."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scratch
from ..operators.budget import share_plan
from ..sources import folders
from .base import query

CAP = 4096


def laid_out(rows: DataFrame) -> str:
    """A folder of files, one a row (name, content); each task writes its own. Works where the shared folder is a mounted one."""
    folder = f"{scratch.shared_dir(rows.sparkSession).removeprefix('file://')}/files-{uuid.uuid4().hex}"
    os.makedirs(folder)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with open(f"{folder}/{name}", "wb") as f:
                    f.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    rows.select("name", F.col("content").cast("binary")).mapInArrow(put, "n long").agg(F.sum("n")).collect()
    return folder


def dropped(hp: DataFrame) -> DataFrame:
    """The files that the events' drops left behind: some empty, some too large."""
    k = hp.where("kind in ('file_download', 'file_upload')").select((F.col("id") % 300).alias("k")).distinct()
    content = F.when(F.col("k") % 7 == 0, "").when(F.col("k") % 11 == 0, F.repeat(F.lit("x"), CAP + 1)).otherwise(F.concat(F.lit("payload "), F.col("k").cast("string")))
    return k.select(F.concat(F.lit("f"), F.col("k").cast("string"), F.when(F.col("k") % 10 == 3, " +é%41").otherwise("")).alias("name"), content.alias("content"), "k")


DROPS = "drops AS (SELECT k, concat('f', CAST(k AS STRING), CASE WHEN k % 10 = 3 THEN ' +é%41' ELSE '' END) AS name, CASE WHEN k % 7 = 0 THEN 'empty' WHEN k % 11 = 0 THEN 'oversized' ELSE 'fetched' END AS status, CASE WHEN k % 7 = 0 OR k % 11 = 0 THEN '' ELSE concat('payload ', CAST(k AS STRING)) END AS content FROM (SELECT DISTINCT id % 300 AS k FROM hp WHERE kind IN ('file_download', 'file_upload')))"


def artifacts(rows: DataFrame, url: Column) -> DataFrame:
    return rows.select(url.alias("url"), F.lit("fetched").alias("status"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.lit("").alias("session_id"))


@query(
    "download_folder_plan",
    "SELECT concat('cowrie-download:', name) AS url, CASE WHEN k % 5 = 0 THEN 'touch' WHEN status = 'oversized' THEN 'skip' ELSE 'record' END AS action, CASE WHEN k % 5 = 0 THEN 'fetched' ELSE status END AS status, CASE WHEN k % 5 <> 0 AND status = 'fetched' THEN sha256(content) ELSE '' END AS sha256, CASE WHEN k % 5 <> 0 THEN length(content) ELSE 0 END AS size_bytes, CASE WHEN k % 5 <> 0 AND status = 'fetched' THEN concat('/evidence/', name) ELSE '' END AS local_path FROM drops",
    DROPS,
)
def download_folder(spark: SparkSession, hp: DataFrame, d: str) -> DataFrame:
    """New, known, empty and oversized files of a downloads folder."""
    rows = dropped(hp)
    files = folders.listed(spark, laid_out(rows))
    known = artifacts(rows.where("k % 5 = 0"), F.concat(F.lit("cowrie-download:"), "name"))
    return folders.downloads(files, known, "/evidence", CAP).select("url", "action", "status", "sha256", "size_bytes", "local_path")


@query(
    "download_event_plan",
    "SELECT url, CASE WHEN known THEN 'touch' WHEN d.status = 'oversized' THEN 'skip' ELSE 'record' END AS action, CASE WHEN known THEN 'fetched' ELSE d.status END AS status, n.src_ip, n.session_id, n.actor_id, CASE WHEN NOT known AND d.status = 'fetched' THEN sha256(d.content) ELSE '' END AS sha256, CASE WHEN NOT known AND d.status = 'fetched' THEN concat('/evidence/', n.sha256) ELSE '' END AS local_path FROM named n LEFT JOIN drops d ON d.k = n.k WHERE known OR d.k IS NOT NULL",
    DROPS
    + ", keyed AS (SELECT *, CASE WHEN id % 3 = 0 THEN concat('cowrie-event:', CAST(id AS STRING)) ELSE command END AS url, id % 400 AS k FROM hp WHERE kind = 'file_download'), named AS (SELECT url, url LIKE '%p3' AS known, arg_max(k, (ts, id)) AS k, arg_max(src_ip, (ts, id)) AS src_ip, arg_max(session_id, (ts, id)) AS session_id, arg_max(actor_id, (ts, id)) AS actor_id, arg_max(sha256, (ts, id)) AS sha256 FROM keyed GROUP BY url)",
)
def download_events(spark, hp, d):
    """What file events ask for, found by base name whatever path they claim."""
    rows = dropped(hp)
    name = F.concat(F.lit("f"), (F.col("id") % 400).cast("string"), F.when(F.col("id") % 400 % 10 == 3, " +é%41").otherwise(""))
    events = hp.where("kind = 'file_download'").withColumn("filename", F.concat(F.when(F.col("id") % 2 == 0, "/etc/../").otherwise("sub/"), name)).withColumn("command", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("command")))
    known = artifacts(hp.where("kind = 'file_download' and id % 3 <> 0 and command like '%p3'").select("command").distinct(), F.col("command"))
    return folders.download_events(events, folders.listed(spark, laid_out(rows)), known, "/evidence", CAP).select("url", "action", "status", "src_ip", "session_id", "actor_id", "sha256", "local_path")


def recorded(hp: DataFrame) -> DataFrame:
    """Recordings of terminals: one frame of typed text each; unfinished ones have no digest for a name."""
    k = hp.where("source = 'cowrie'").select((F.col("id") % 200).alias("k")).distinct()
    text = F.concat(F.lit("echo "), F.col("k").cast("string"), F.lit("\n"))
    frame = F.concat(F.unhex(F.concat(F.lit("0300000000000000"), F.lpad(F.hex(F.length(text)), 2, "0"), F.lit("000000" + "01000000" + "0000000000000000"))), text.cast("binary"))
    return k.select(F.when(F.col("k") % 13 == 0, F.concat(F.lit("20240101-"), F.col("k").cast("string"), F.lit("-i.log"))).otherwise(F.sha2(F.concat(F.lit("r"), F.col("k").cast("string")), 256)).alias("name"), F.when(F.col("k") % 9 == 0, F.lit("").cast("binary")).otherwise(frame).alias("content"), "k")


@query(
    "recording_folder_plan",
    "SELECT concat('cowrie-tty:', name) AS url, CASE WHEN known THEN 'bind' ELSE 'record' END AS action, CASE WHEN NOT known AND k % 9 = 0 THEN 'empty' ELSE 'fetched' END AS status, CASE WHEN k % 9 = 0 AND NOT known OR NOT indexed THEN '' ELSE concat('s', CAST(k AS STRING)) END AS session_id, CASE WHEN known OR k % 9 = 0 THEN 0 ELSE 24 + length(text) END AS size_bytes, CASE WHEN known OR k % 9 = 0 THEN '' ELSE text END AS transcript FROM recs WHERE NOT known OR (indexed AND k % 8 <> 4)",
    "recs AS (SELECT k, sha256(concat('r', CAST(k AS STRING))) AS name, k % 4 = 0 AS known, k % 3 <> 0 AS indexed, concat('echo ', CAST(k AS STRING), chr(10)) AS text FROM (SELECT DISTINCT id % 200 AS k FROM hp WHERE source = 'cowrie') WHERE k % 13 <> 0)",
)
def recording_folder(spark, hp, d):
    """New recordings with their session and transcript, and known ones that their session is found for later."""
    rows = recorded(hp)
    line = F.to_json(F.struct(F.when(F.col("k") % 2 == 0, "cowrie.log.closed").otherwise("cowrie.log.closed").alias("eventid"), F.lit("2024-01-02T03:04:05Z").alias("timestamp"), F.sha2(F.concat(F.lit("r"), F.col("k").cast("string")), 256).alias("shasum"), F.concat(F.lit("s"), F.col("k").cast("string")).alias("session")))
    lines = rows.where("k % 3 <> 0").select(line.alias("value")).unionByName(rows.select(F.lit('{"eventid": "cowrie.session.closed", "input": "cowrie.log.closed"}').alias("value")))
    known = artifacts(rows.where("k % 4 = 0"), F.concat(F.lit("cowrie-tty:"), "name")).withColumn("session_id", F.lit(""))
    owned = rows.where("k % 8 = 4").select(F.concat(F.lit("cowrie-tty:"), "name").alias("url"), F.lit("fetched").alias("status"), F.lit("2024-01-05").cast("timestamp").alias("ts"), F.lit("mine").alias("session_id"))
    return folders.recordings(folders.listed(spark, laid_out(rows)), known.unionByName(owned), folders.recording_index(lines), "/evidence").select("url", "action", "status", "session_id", "size_bytes", "transcript")


@query(
    "share_budget",
    "SELECT session_id, CASE WHEN past THEN 'unexamined' WHEN slot = 1 THEN 'submit' ELSE 'skip' END AS action, CASE WHEN past OR slot = 1 THEN '' WHEN NOT ok THEN 'odd address' ELSE 'all indicators already submitted' END AS reason, fresh, CASE WHEN NOT past AND slot = 1 THEN CAST(upto AS BIGINT) ELSE 0 END AS slot FROM summed",
    "cand AS (SELECT session_id, max(ts) AS last_ts, max(src_ip) NOT LIKE '%7' AS ok FROM hp WHERE sha256 <> '' AND session_id <> '' GROUP BY 1), ind AS (SELECT DISTINCT session_id, v FROM (SELECT session_id, sha256 AS v FROM hp WHERE sha256 <> '' UNION ALL SELECT session_id, command FROM hp WHERE sha256 <> '' AND command <> '')), seen AS (SELECT sha256 AS v FROM led UNION ALL SELECT DISTINCT command FROM hp WHERE command LIKE '%p2'), fresh AS (SELECT session_id, count(*) AS n FROM ind WHERE v NOT IN (SELECT v FROM seen) GROUP BY 1), slots AS (SELECT c.*, CASE WHEN ok THEN coalesce(n, 0) ELSE 0 END AS fresh, CASE WHEN ok AND coalesce(n, 0) > 0 THEN 1 ELSE 0 END AS slot FROM cand c LEFT JOIN fresh USING (session_id)), summed AS (SELECT *, sum(slot) OVER (ORDER BY last_ts DESC, session_id ROWS UNBOUNDED PRECEDING) AS upto, sum(slot) OVER (ORDER BY last_ts DESC, session_id ROWS UNBOUNDED PRECEDING) - slot >= 50 AS past FROM slots)",
)
def share_budget(spark, hp, d):
    """Sessions that dropped payloads, newest first, until 50 of them had something new to report."""
    from ..sources import projection

    own = hp.where("sha256 <> '' and session_id <> ''")
    candidates = own.groupBy("session_id").agg(F.max("ts").alias("last_ts"), (~F.max("src_ip").endswith("7")).alias("ok")).withColumn("reason", F.lit("odd address"))
    indicators = own.select("session_id", F.explode(F.array("sha256", "command")).alias("value")).where("value <> ''")
    ledger = projection.ledger(spark, hp).select(F.col("sha256").alias("value")).unionByName(hp.where("command like '%p2'").select(F.col("command").alias("value")))
    return share_plan(candidates, indicators, ledger, "session_id", [F.desc("last_ts")], 50).fillna(0, ["slot"])
