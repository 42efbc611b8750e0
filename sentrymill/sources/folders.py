"""What an archive would do with folders of downloads and recordings: file content as a source.

Names, sizes and times are listed without opening a file. Content is read only where it is needed: size bounds and ``since``
(files changed from then on) reach the reader, digests are computed beside it. Plans say what to record, touch or bind; copying
is left to who keeps the evidence."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tty
from ..functions.vetting import is_sha256
from . import logs

LISTED = "path string, modificationTime timestamp, length long, content binary"
#: Larger files are refused.
CAP = 32 << 20


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)


def listed(spark: SparkSession, folder: str, since: str | None = None) -> DataFrame:
    """(name, path, mtime, length, content) of the regular files of one folder; a folder that does not exist is empty.

    Spark's reader leaves empty files out; the driver, which lists the folder for it anyway, adds their names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    some, empty = False, []
    statuses = store.listStatusIterator(path) if store.exists(path) else None
    while statuses is not None and statuses.hasNext():
        s = statuses.next()
        if s.isFile() and not s.getPath().getName().startswith((".", "_")):
            if s.getLen():
                some = True
            else:
                empty.append((s.getPath().getName(), s.getPath().toString(), s.getModificationTime()))
    files = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/*") if some else spark.createDataFrame([], LISTED)
    files = files.select(base_name(F.col("path")).alias("name"), "path", F.col("modificationTime").alias("mtime"), "length", "content")
    if empty:
        rows = spark.createDataFrame(empty, "name string, path string, ms long")
        files = files.unionByName(rows.select("name", "path", F.timestamp_millis("ms").alias("mtime"), F.lit(0).cast("long").alias("length"), F.lit("").cast("binary").alias("content")))
    return files.where(F.col("mtime") >= F.lit(since).cast("timestamp")) if since else files


def digested(files: DataFrame, cap: int = CAP) -> DataFrame:
    """(name, path, mtime, length, status, sha256): empty files and files over ``cap`` bytes (0: no bound) are not opened."""
    some = F.col("length") > 0
    fits = some & (F.col("length") <= cap) if cap > 0 else some
    read = files.where(fits).select("name", "path", "mtime", "length", F.lit("fetched").alias("status"), F.sha2("content", 256).alias("sha256"))
    rest = files.where(~fits).select("name", "path", "mtime", "length", F.when(some, "oversized").otherwise("empty").alias("status"), F.lit("").alias("sha256"))
    return read.unionByName(rest)


def _known(files: DataFrame, artifacts: DataFrame, prefix: str) -> DataFrame:
    """Files with the artifact (``_status``, ``_session``) that has their key, if there is one."""
    keys = artifacts.groupBy("url").agg(F.max(F.struct("ts", "status", "session_id")).alias("_a")).select("url", F.col("_a.ts").alias("_ts"), F.col("_a.status").alias("_status"), F.coalesce("_a.session_id", F.lit("")).alias("_session"))
    return files.withColumn("url", F.concat(F.lit(prefix), "name")).join(keys, "url", "left")


def downloads(files: DataFrame, artifacts: DataFrame, dest: str, cap: int = CAP) -> DataFrame:
    """What to do with each file of a downloads folder: (url, action, status, ts, sha256, size_bytes, local_path, origin).

    Known keys are touched if the file is newer; new files are recorded as fetched or empty, oversized ones skipped."""
    known = _known(files.drop("content"), artifacts, "cowrie-download:")
    touched = known.where("_status is not null and mtime > _ts").select("url", F.lit("touch").alias("action"), F.col("_status").alias("status"), F.col("mtime").alias("ts"), F.lit("").alias("sha256"), F.lit(0).cast("long").alias("size_bytes"), F.lit("").alias("local_path"), F.lit("cowrie_download").alias("origin"))
    fresh = digested(files, cap).withColumn("url", F.concat(F.lit("cowrie-download:"), "name")).join(artifacts.select("url").distinct(), "url", "left_anti")
    got = F.col("status") == "fetched"
    new = fresh.select(
        "url", F.when(F.col("status") == "oversized", "skip").otherwise("record").alias("action"), "status", F.col("mtime").alias("ts"), "sha256", F.when(got, F.col("length")).otherwise(0).cast("long").alias("size_bytes"),
        F.when(got, F.concat(F.lit(dest.rstrip("/") + "/"), "name")).otherwise("").alias("local_path"), F.lit("cowrie_download").alias("origin"),
    )
    return touched.unionByName(new)


def download_events(events: DataFrame, files: DataFrame, artifacts: DataFrame, dest: str, cap: int = CAP) -> DataFrame:
    """What to do for each key that file events name; the file is looked up by base name only, whatever path an event claims.

    Of events with one key the newest counts. Known keys are touched, events whose file is not there give no row."""
    e = events.where("kind = 'file_download' and filename <> ''").withColumn("url", F.when(F.col("command") != "", F.col("command")).otherwise(F.concat(F.lit("cowrie-event:"), F.col("id").cast("string"))))
    newest = e.groupBy("url").agg(F.max_by(F.struct("ts", "src_ip", "session_id", "actor_id", "filename", F.col("sha256").alias("claimed")), F.struct("ts", "id")).alias("e")).select("url", "e.*")
    keys = artifacts.groupBy("url").agg(F.max("ts").alias("_ts"), F.max_by("status", "ts").alias("_status"))
    both = newest.join(keys, "url", "left")
    blank, none = F.lit(""), F.lit(0).cast("long")
    touched = both.where("_status is not null and ts > _ts").select("url", F.lit("touch").alias("action"), F.col("_status").alias("status"), "ts", "src_ip", "session_id", "actor_id", blank.alias("sha256"), none.alias("size_bytes"), blank.alias("local_path"))
    found = both.where("_status is null").withColumn("name", base_name(F.col("filename"))).join(digested(files, cap).select("name", "length", F.col("status"), "sha256"), "name")
    got = F.col("status") == "fetched"
    new = found.select(
        "url", F.when(F.col("status") == "oversized", "skip").otherwise("record").alias("action"), "status", "ts", "src_ip", "session_id", "actor_id", "sha256", F.when(got, F.col("length")).otherwise(0).cast("long").alias("size_bytes"),
        F.when(got, F.concat(F.lit(dest.rstrip("/") + "/"), F.when(F.col("claimed") != "", F.col("claimed")).otherwise(F.col("name")))).otherwise("").alias("local_path"),
    )
    return touched.unionByName(new)


def recording_index(lines: DataFrame) -> DataFrame:
    """(sha256, session_id, ts) of closed recordings in sensor logs: only lines that name the event are decoded, the latest wins."""
    r = logs.sensor_lines(lines.where(F.col("value").contains("cowrie.log.closed"))).where("eventid = 'cowrie.log.closed' and coalesce(shasum, '') <> '' and coalesce(session, '') <> ''")
    at = logs.instant(F.trim("timestamp"))
    return r.groupBy(F.lower(F.trim("shasum")).alias("sha256")).agg(F.max_by("session", F.struct(at, "session")).alias("session_id"), F.max(at).alias("ts"))


def recordings(files: DataFrame, artifacts: DataFrame, index: DataFrame, dest: str, cap: int = CAP, head: int = 200) -> DataFrame:
    """What to do with each finished recording (named by a SHA-256): (url, action, status, session_id, sha256, size_bytes, local_path, transcript).

    New ones are recorded with their session and the first ``head`` characters of their transcript; known ones without a session
    are bound once the index knows it, and never rebound."""
    done = files.where(is_sha256(F.col("name")))
    bound = index.select(F.col("sha256").alias("_sha"), F.col("session_id").alias("_of"))
    known = _known(done.drop("content"), artifacts, "cowrie-tty:").where("_status is not null and _session = ''").join(bound, F.lower("name") == F.col("_sha"))
    binding = known.select("url", F.lit("bind").alias("action"), F.col("_status").alias("status"), F.col("_of").alias("session_id"), F.lit("").alias("sha256"), F.lit(0).cast("long").alias("size_bytes"), F.lit("").alias("local_path"), F.lit("").alias("transcript"))
    new = done.withColumn("url", F.concat(F.lit("cowrie-tty:"), "name")).join(artifacts.select("url").distinct(), "url", "left_anti")
    fits = (F.col("length") > 0) & ((F.col("length") <= cap) if cap > 0 else F.lit(True))
    session = lambda df: df.join(bound, F.lower("name") == F.col("_sha"), "left").withColumn("session_id", F.coalesce("_of", F.lit("")))
    read = session(new.where(fits).select("name", "url", "length", F.sha2("content", 256).alias("sha256"), F.substring(tty.rendered("content"), 1, head).alias("transcript")))
    rest = new.where(~fits).select("url", "length")
    return (
        binding.unionByName(read.select("url", F.lit("record").alias("action"), F.lit("fetched").alias("status"), "session_id", "sha256", F.col("length").alias("size_bytes"), F.concat(F.lit(dest.rstrip("/") + "/"), "name").alias("local_path"), "transcript"))
        .unionByName(rest.select("url", F.when(F.col("length") > 0, "skip").otherwise("record").alias("action"), F.when(F.col("length") > 0, "oversized").otherwise("empty").alias("status"), F.lit("").alias("session_id"), F.lit("").alias("sha256"), F.lit(0).cast("long").alias("size_bytes"), F.lit("").alias("local_path"), F.lit("").alias("transcript")))
    )


def expired(files: DataFrame, before: str) -> DataFrame:
    """Source files last changed before a moment, which retention removes; listing opens none."""
    return files.where(F.col("mtime") < F.lit(before).cast("timestamp")).select("name", "path", "mtime", "length")


def remove(spark: SparkSession, files: DataFrame) -> int:
    """Deletes listed files where they lie; each task deletes its own. Gives how many went."""

    def away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = 0
            for uri in b.column(0).to_pylist():
                local = uri.startswith(("file:", "/"))
                where, path = (fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(quote(uri, safe=":/"))
                try:
                    where.delete_file(path)
                    gone += 1
                except FileNotFoundError:  # another attempt of this task was here
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([gone])], names=["gone"])

    return int(files.select("path").mapInArrow(away, "gone long").agg(F.coalesce(F.sum("gone"), F.lit(0))).first()[0])
