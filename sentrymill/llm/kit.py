"""Helpers that the corpus operators share: byte-level word hashing, bounded slices of Arrow
batches, and tables written to the shared folder so that lost executors never cost lineage."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import cut, drop, parts, shared_dir

U = np.uint64
#: The words of the contracts are runs of bytes other than these.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _LOWER[97:123]
_P = U(0x9E3779B97F4A7C15)
_PINV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def beside(texts: DataFrame, rows: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """Joins texts with rows that grow with them: a merge join at every size, never one that broadcasts while rows are few."""
    return texts.join(rows.hint("merge"), key, how)


#: Stands for a null id in joins: it sorts first, as nulls do.
NO_ID = -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _id, _k) of every row, which is known by its id (``NO_ID`` for null) and a hash of id and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_key(docs))


def row_key(docs: DataFrame, names: tuple[str, str] = ("_id", "_k")) -> list:
    of = F.col("doc_id").cast("long")
    return [F.coalesce(of, F.lit(NO_ID)).alias(names[0]), F.xxhash64(of, "text").alias(names[1])]


def fresh(name: str, df: DataFrame) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(col: str, n: int):
    """crc32 of a column as text, modulo n; a null counts as the empty string."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def trim() -> None:
    """Gives memory that earlier tasks of this worker have freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what was freed for later
        pass


def bounds(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``limit`` bytes; a longer text is a range of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    lo = size = 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = 1_000_000) -> Iterator[tuple[list, ...]]:
    """Rows of Arrow batches as column lists, cut so that the texts of a slice hold about ``limit`` bytes.

    Only one slice at a time becomes Python objects; a longer text is a slice of its own."""
    trim()
    for b in batches:
        for lo, hi in bounds(b.column(text), limit):
            yield tuple(c.to_pylist() for c in b.slice(lo, hi - lo).columns)


#: Numbers worked on at a time, so that intermediate results stay in the processor's cache.
STRIDE = 1 << 14


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; one-to-one."""
    out = np.array(x, np.uint64)
    flat = out.reshape(-1)
    t = np.empty(min(len(flat), STRIDE), np.uint64)
    for i in range(0, len(flat), STRIDE):
        o = flat[i : i + STRIDE]
        u = t[: len(o)]
        o ^= np.right_shift(o, U(30), out=u)
        o *= U(0xBF58476D1CE4E5B9)
        o ^= np.right_shift(o, U(27), out=u)
        o *= U(0x94D049BB133111EB)
        o ^= np.right_shift(o, U(31), out=u)
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_P, _PINV)):
            a = np.full(max(n, 1 << 16), base, np.uint64)
            a[0] = 1
            _POWERS[k] = np.cumprod(a, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


class Words:
    """The words of some texts: places in one byte buffer, the text of each, and a 64-bit hash of each.

    ``first[i]:first[i + 1]`` are the words of text i."""

    def __init__(self, texts: list[str | None], lower: bool, hashes: bool = True):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = b"\n".join(raw) + b"\n"
        buf = np.frombuffer(self.data, np.uint8)
        solid = ~SPACE[buf]
        edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        if len(solid) and solid[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)
        if hashes:
            pw, inv = _powers(len(buf) + 1)
            acc = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum((_LOWER if lower else _BYTE)[buf] * pw[: len(buf)], out=acc[1:])
            self.hash = mix((acc[self.end] - acc[self.start]) * inv[self.start])

    def text_of(self, lo: int, hi: int) -> bytes:
        """Words lo to hi joined by one space."""
        d, s, e = self.data, self.start[lo:hi].tolist(), self.end[lo:hi].tolist()
        return b" ".join([d[a:b] for a, b in zip(s, e)])


def unique(x: np.ndarray) -> np.ndarray:
    """Distinct values in order; lighter than the library's for short arrays."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Distinct sorted hashes of the k-word shingles of one text; fewer words count as one shingle, none as nothing."""
    n = len(h)
    if n == 0:
        return h
    if n < k:
        x = np.array([n], np.uint64)
        for i in range(n):
            x = mix(h[i : i + 1] * U(0x9E3779B97F4A7C15) + x)
        return x
    x = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        x = mix(x * U(0xD6E8FEB86659FD93) + h[i : n - k + 1 + i])
    return unique(x)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished queries now rather than at the driver's next collection.

    The second round finds what listeners still held in the first."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.6)
