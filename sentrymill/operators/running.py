"""Running totals and digests over ordered groups of any size: no group has to fit into one task.

Rows are dealt by range of group and order, so a large group lies in several partitions in turn. Each partition adds up its
own rows; what a group brings along from earlier partitions is one number a partition, which the driver adds up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch


def changes(columns: list[pa.Array]) -> np.ndarray:
    """Which rows differ from the row before in any column; null equals null. The first row counts as equal."""
    out = np.zeros(len(columns[0]), bool)
    for c in columns:
        a, b = c[:-1], c[1:]
        same = pc.if_else(pc.or_(a.is_null(), b.is_null()), pc.and_(a.is_null(), b.is_null()), pc.fill_null(pc.equal(a, b), True))
        out[1:] |= ~same.to_numpy(zero_copy_only=False)
    return out


def running(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """``df`` with the total of ``sums``' columns (new name: long column, null as 0) over each group's rows up to and with this one.

    Rows that are equal in group and order come in the order of their files. ``keep`` names the columns that travel on after
    the sort (all if None), beside those of ``group`` and ``sums``. Returns a stored table (see ``scratch.cut``)."""
    spark, n = df.sparkSession, scratch.parts(df.sparkSession)
    kept = [c for c in df.columns if keep is None or c in keep or c in group or c in sums.values()]
    dealt = [*[F.col(c) for c in group], *order, F.col("_tie")]
    rows = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *dealt).sortWithinPartitions(*dealt).select(*kept)
    names, at = list(sums), [kept.index(c) for c in sums.values()]
    by = [kept.index(c) for c in group]
    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_row", T.LongType()), T.StructField("_head", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in names]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, head, last = TaskContext.get().partitionId(), 0, True, None
        carry = np.zeros(len(at), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            new = changes([b.column(i) for i in by]) if by else np.zeros(b.num_rows, bool)
            first = [b.column(i)[:1] for i in by]
            if last is not None and any(bool(changes([pa.concat_arrays([x, y])])[1]) for x, y in zip(last, first)):
                new[0] = True
            starts = np.flatnonzero(new)
            of = np.cumsum(new)  # 0: the group that the batch before ended in
            out = []
            for k, i in enumerate(at):
                v = pc.fill_null(b.column(i).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
                total = np.cumsum(v)
                base = np.concatenate([[-carry[k]], total[starts] - v[starts]])
                out.append(total - base[of])
            heads = (of == 0) if head else np.zeros(b.num_rows, bool)
            head = head and not len(starts)
            carry = np.array([o[-1] for o in out], np.int64)
            last = [b.column(i)[-1:] for i in by]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(row, row + b.num_rows)), pa.array(heads), *map(pa.array, out)], names=schema.names)
            row += b.num_rows

    table = scratch.cut(rows.mapInArrow(add, schema))
    key = F.struct(*group) if group else F.struct(F.lit(0))
    # one row a partition, so the driver sees as many rows as there are partitions
    ends = table.groupBy("_part").agg(F.min_by(key, "_row").alias("first"), F.max_by(key, "_row").alias("last"), F.max_by(F.struct(*names), "_row").alias("sums")).orderBy("_part").collect()
    carried, before, total = [], None, [0] * len(names)
    for r in ends:
        brought = total if before is not None and r["first"] == before else [0] * len(names)
        if any(brought):
            carried.append((r["_part"], *brought))
        whole = r["first"] == r["last"]
        before, total = r["last"], [s + (b if whole else 0) for s, b in zip(r["sums"], brought)]
    out = [c for c in table.columns if c not in ("_part", "_row", "_head")]
    if carried:
        more = spark.createDataFrame(carried, "_part int, " + ", ".join(f"_more{i} long" for i in range(len(names))))
        got = table.join(F.broadcast(more), "_part", "left")
        for i, c in enumerate(names):
            got = got.withColumn(c, F.when(F.col("_head"), F.col(c) + F.coalesce(f"_more{i}", F.lit(0))).otherwise(F.col(c)))
        got = got.select(*out)
    else:
        got = table.select(*out)
    got._sentrymill_path = table._sentrymill_path
    return got


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str, keep: list[str] | None = None) -> DataFrame:
    """``df`` with each row's place in its group, from 1; see ``running``."""
    got = running(df.withColumn("_one", F.lit(1).cast("long")), group, order, {name: "_one"}, keep and [*keep, "_one"])
    out = got.drop("_one")
    out._sentrymill_path = got._sentrymill_path
    return out


def digested(df: DataFrame, group: list[str], order: str, text: str, name: str, between: str = ",", head: str = "", tail: str = "", chunk: int = 1 << 16, digest: str = "sha256") -> DataFrame:
    """One row a group: the lowercase digest (SHA-256 if not told otherwise) of its texts joined in order, between ``head`` and ``tail``.

    Partitions of a range join their texts to chunks first; a group's chunks are then read in turn, one batch at a time, as
    the digest demands. ``order`` must tell the rows of a group apart; null texts count as empty."""
    n, between_bytes = scratch.parts(df.sparkSession), between.encode()
    rows = df.select(*group, F.col(order).alias("_o"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("_t"))
    keys, width = [F.col(c) for c in group], len(group)
    fields = rows.schema.fields

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, mark = 0, None

        def done():
            return pa.RecordBatch.from_arrays([*mark, pa.array([between_bytes.join(held)], pa.binary())], names=[f.name for f in fields])

        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(i) for i in range(width)]
            new = changes(columns) if width else np.zeros(b.num_rows, bool)
            if mark is not None and width and any(bool(changes([pa.concat_arrays([x, y[:1]])])[1]) for x, y in zip(mark, columns)):
                new[0] = True
            for i, t in enumerate(b.column(width + 1).to_pylist()):
                if mark is not None and (new[i] or size >= chunk):
                    yield done()
                    mark = None
                if mark is None:
                    held, size, mark = [], 0, [b.column(j)[i : i + 1] for j in range(width + 1)]
                held.append(t)
                size += len(t) + 1
        if mark is not None:
            yield done()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, so_far = None, None

        def done():
            so_far.update(tail.encode())
            return pa.RecordBatch.from_arrays([*mark, pa.array([so_far.hexdigest()])], names=[*group, name])

        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(i) for i in range(width)]
            new = changes(columns) if width else np.zeros(b.num_rows, bool)
            if mark is not None and width and any(bool(changes([pa.concat_arrays([x, y[:1]])])[1]) for x, y in zip(mark, columns)):
                new[0] = True
            for i, t in enumerate(b.column(width + 1)):
                if mark is not None and new[i]:
                    yield done()
                    mark = None
                if mark is None:
                    mark, so_far = [c[i : i + 1] for c in columns], hashlib.new(digest, head.encode())
                else:
                    so_far.update(between_bytes)
                so_far.update(t.as_buffer())
        if mark is not None:
            yield done()

    chunks = rows.repartitionByRange(n, *keys, "_o").sortWithinPartitions(*keys, "_o").mapInArrow(join, rows.schema)
    dealt = chunks.repartition(n, *keys) if group else chunks.repartition(1)
    out = T.StructType([*fields[:width], T.StructField(name, T.StringType())])
    return dealt.sortWithinPartitions(*keys, "_o").mapInArrow(fold, out)
