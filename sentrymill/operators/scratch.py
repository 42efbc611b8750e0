"""Tables written to the folder that all executors share, so that lost executors never cost lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset and all runs in one process (tests)."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        have = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="sentrymill-")
        shared_dir.own = have
    return have.rstrip("/")


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder, in folders of the values of ``by``, and reads it back: what follows no longer depends on its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sentrymill_path = path
    return out


def together(tables: list[DataFrame]) -> DataFrame:
    """The rows of several tables of one schema made by ``cut``, in one scan."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t._sentrymill_path for t in tables])


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by ``cut`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_sentrymill_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
