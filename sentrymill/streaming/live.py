"""Incremental ingest: growing logs are followed, each micro-batch of lines is parsed once and folded into the store.

A batch is taken once, however often it runs; what it held is counted while it is parsed, without another pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import scratch
from ..sources import logs
from .store import Store
from .tail import follow


def counts(observed: dict) -> dict[str, int]:
    return {k: int(v or 0) for k, v in observed.items()}


def take(store: Store, lines: DataFrame, stream: str = "", batch: int = 0, source: str = "cowrie", fit: bool = False) -> dict[str, int]:
    """Parses ``value`` lines of a sensor log (or a journal) once, folds them into the store, and says how many lines it saw, kept and skipped."""
    seen = Observation()
    if source == "journal":
        records = logs.journal(lines, fit).withColumn("event", F.col("kind").isNotNull())
    else:
        records = logs.sensor_records(lines)
    records = scratch.cut(records.observe(seen, F.count(F.lit(1)).alias("lines"), F.count_if("event").alias("events"), F.count_if("skipped").alias("skipped")))
    columns = [c for c in logs.EVENT_COLUMNS if c in records.columns]
    fresh = store.ingest(records.where("event").select(*columns), logs.bindings_of(records) if source == "cowrie" else None, stream, batch)
    scratch.drop(records)
    return counts(seen.get) | {"taken": int(fresh)}


def start(spark: SparkSession, path: str, store: Store, checkpoint: str, seconds: int | None = None, source: str = "cowrie", report: Callable[[dict], None] | None = None, fit: bool = False) -> StreamingQuery:
    """Follows growing log files below a path or glob; ``seconds`` None takes what is there and ends. ``report`` gets each batch's counts."""

    def batch(lines: DataFrame, i: int) -> None:
        got = take(store, lines.select("value"), f"{source}:{path}", i, source, fit)
        if report:
            report(got)

    w = follow(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)).start()


def journal_counts(spark: SparkSession, folder: str, minutes: int = 10, late: str = "1 hour") -> DataFrame:
    """A stream of attempts a window and address; the watermark bounds the state."""
    e = logs.journal(spark.readStream.text(folder)).where("kind is not null").withWatermark("ts", late)
    return e.dropDuplicatesWithinWatermark(["ts", "kind", "src_ip", "src_port", "username", "raw"]).groupBy(F.window("ts", f"{minutes} minutes"), "src_ip").agg(F.count("*").alias("attempts"))
