"""Line dedup: of fuzzy copies of a line anywhere in the corpus one is kept.

Lines are compared without case and with white space runs as one space. Different lines become sets of hashed
character shingles; one-permutation MinHash signatures (empty bins densified by hashing) are banded for high recall;
lines that share a band are candidates, verified by exact Jaccard similarity on the whole sets; distributed
union-find joins what is linked, and of every component the occurrence with the smallest (doc_id, line number)
stays. Equal lines are one class from the start, blank lines are never removed.

A null text has no lines and stays null; null ids come first; among rows of equal id the smallest hash of the text comes
first, and of rows equal in both all keep what the first one keeps; an empty table gives an empty result; columns other
than doc_id and text are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kit, links

U = np.uint64
SHINGLE = 5
#: A pair at similarity 0.8 shares no band in at most so many cases, if its minima are independent.
MISSED = 4e-4


class Bands:
    """Rows and bands for a number of lines: a row more for every 16 times as many lines keeps chance pairs of a line as few.

    In between some bands, ``long``, have the further row already, so many that the pairs of a line whose minima agree
    in one of 16 cases stay as few as at 2^22 lines; there is no size at which the work leaps."""

    def __init__(self, lines: float, share: float):
        more = max(0.0, math.log(max(lines, 1) / 2**22, 16))
        self.rows = 5 + int(more)
        part = (1 - 16 ** -(more % 1)) / (1 - 1 / 16)
        missed = [math.log(1 - share**r) for r in (self.rows, self.rows + 1)]
        self.bands = max(1, math.ceil(math.log(MISSED) / (missed[0] + part * (missed[1] - missed[0]))))
        self.long = int(part * self.bands)
        self.bins = max(96, self.rows * self.bands + self.long)
        self.probe = np.random.default_rng(77).integers(0, self.bins, (48, self.bins))


EMPTY = np.uint32(0xFFFFFFFF)


#: White space other than blank and line feed, which few texts hold.
ODD = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def normals(text: str) -> list[str]:
    """``normal`` of each line; lines of a text with single blanks only need not be taken apart."""
    low = text.lower()
    if "  " in low or any(c in low for c in ODD):
        return [" ".join(x.split()) for x in low.split("\n")]
    return [x.strip(" ") for x in low.split("\n")]


def line_id(norm: str) -> int:
    x = xxhash.xxh3_64_intdigest(norm.encode("utf-8", "surrogatepass"))
    return x - (x >> 63 << 64)


def distinct(texts: list[str | None]) -> list[str]:
    """The different lines of some texts, without blank ones, in order."""
    some = {n for t in texts if t for n in normals(t)}
    some.discard("")
    return sorted(some)


def _codes(norms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of the shingle from every place of all lines, bounds of the lines); places of the last
    SHINGLE - 1 characters of a line are void. Lines shorter than a shingle are padded with zeros."""
    pad = "\0" * SHINGLE
    lines = [n if len(n) >= SHINGLE else (n + pad)[:SHINGLE] for n in norms]
    c = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    bounds = np.concatenate([[0], np.cumsum([len(n) for n in lines])]).astype(np.int64)
    h = c[: len(c) - SHINGLE + 1] + U(1)
    for at in range(0, len(h), kit.STRIDE):
        o = h[at : at + kit.STRIDE]
        for i in range(1, SHINGLE):
            o *= U(0x9E3779B97F4A7C15)
            o += c[at + i : at + i + len(o)]
    return kit.mix(h), bounds


def shingle_set(norm: str) -> np.ndarray:
    return np.unique(_codes([norm])[0])


def shingle_sets(bodies: list[bytes]) -> list[np.ndarray]:
    """The sets of many lines (UTF-8), hashed together."""
    if not bodies:
        return []
    h, bounds = _codes([b.decode("utf-8", "surrogatepass") for b in bodies])
    return [kit.unique(h[a : b - SHINGLE + 1]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def signatures(norms: list[str], plan: Bands) -> np.ndarray:
    """One-permutation MinHash: for each line the smallest hash of each bin, empty bins borrowing from others."""
    sig = np.full((len(norms), plan.bins), EMPTY, np.uint32)
    lo = size = 0
    for i, n in enumerate(norms):  # some lines at a time, so that memory does not follow the batch
        size += max(len(n), SHINGLE)
        if size > 150_000 or i == len(norms) - 1:
            _minima(norms[lo : i + 1], sig[lo : i + 1].reshape(-1), plan.bins)
            lo, size = i + 1, 0
    full = sig != EMPTY
    r, c = np.nonzero(~full)
    for probe in plan.probe:
        src = probe[c]
        take = full[r, src]
        sig[r[take], c[take]] = sig[r[take], src[take]]
        r, c = r[~take], c[~take]
        if not len(r):
            break
    sig[r, c] = sig[r, full.argmax(1)[r]]
    return sig


def _minima(norms: list[str], sig: np.ndarray, bins: int) -> None:
    """Puts the smallest hash of each line and bin into ``sig``, flat and in place."""
    h, bounds = _codes(norms)
    line = np.repeat(np.arange(len(norms)) * bins, np.diff(bounds))[: len(h)]
    ok = np.ones(len(h), bool)
    for i in range(1, SHINGLE):
        at = bounds[1:] - i
        ok[at[at < len(h)]] = False
    h, line = h[ok], line[ok]
    line += ((h >> U(32)) * U(bins) >> U(32)).astype(np.int64)
    np.minimum.at(sig, line, h.astype(np.uint32) >> np.uint32(1))


def band_keys(sig: np.ndarray, plan: Bands) -> np.ndarray:
    """A 64-bit key for every band of every line."""
    x = np.zeros((len(sig), plan.bands), np.uint64) + np.arange(1, plan.bands + 1, dtype=np.uint64) * U(0xD1B54A32D192ED03)
    for i in range(plan.rows):
        x = x * U(0x9E3779B97F4A7C15) + sig[:, i * plan.bands : (i + 1) * plan.bands]
        x ^= x >> U(29)
    if plan.long:
        last = x[:, : plan.long]
        last *= U(0x9E3779B97F4A7C15)
        last += sig[:, plan.rows * plan.bands : plan.rows * plan.bands + plan.long]
        last ^= last >> U(29)
    return x


def sketches(sig: np.ndarray) -> np.ndarray:
    """One bit of each of the first 96 minima of every line, as a long and a short word."""
    bits = np.packbits((sig[:, :96] & np.uint32(1)).astype(np.uint8), axis=1)
    return np.ascontiguousarray(bits).view([("low", "<u8"), ("high", "<u4")]).ravel()


def _bands(docs: DataFrame, plan: Bands, targets: int) -> DataFrame:
    """Packed (band key, line, sketch) entries of the different lines of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in kit.slices(batches):
            some = distinct(texts)
            if some:
                ids = np.array([line_id(n) for n in some], np.int64)
                sig = signatures(some, plan)
                yield links.sketched(band_keys(sig, plan), ids, sketches(sig), targets)

    return docs.select("_k", "text").mapInArrow(run, links.PACKED)


def _occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, _id, _k, _n, _lines): the id of each line, null for blank ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, no_id, keys in kit.slices(batches):
            out = [[line_id(n) if n else None for n in normals(t)] if t is not None else [] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(no_id, pa.int64()), pa.array(keys, pa.int64()), pa.array([len(r) for r in out], pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "_id", "_k", "_n", "_lines"])

    return docs.mapInArrow(run, "doc_id long, _id long, _k long, _n long, _lines array<long>")


def _bodies(docs: DataFrame, ids: DataFrame, num: int, den: int) -> DataFrame:
    """(id, body, cls) of the different lines of each batch that are among ``ids``, and of few others; ``cls``: the class of the set's size."""
    shared = docs.sparkSession.sparkContext.broadcast(links.sieve(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for _, texts in kit.slices(batches):
            norms = distinct(texts)
            got = np.array([line_id(n) for n in norms], np.int64)
            k = np.flatnonzero(links.sifted(got, bits))
            body = [norms[i].encode("utf-8", "surrogatepass") for i in k.tolist()]
            cls = links.size_class(np.array([len(s) for s in shingle_sets(body)], np.int64), num, den)
            yield pa.RecordBatch.from_arrays([pa.array(got[k]), pa.array(body, pa.binary()), pa.array(cls, pa.int32())], names=["id", "body", "cls"])

    return docs.select("_k", "text").mapInArrow(run, "id long, body binary, cls int")


def line_components(docs: DataFrame, num: int = 80, den: int = 100, block: int = 8_000_000) -> DataFrame:
    """(id, component) of the lines that are linked to another line, but each component's own smallest id.

    Candidate groups of more than ``block`` bytes are compared by pairs of blocks of fitting sizes; the result does not depend on it."""
    spark = docs.sparkSession
    n = kit.parts(spark)
    size = docs.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    plan = Bands(size / 128, num / den)
    comps = links.components(links.alike_edges(_bands(docs, plan, 4 * n), n), thin=True)
    kit.release(spark)
    groups = kit.cut(comps.select("id", F.col("component").alias("grp")).unionByName(comps.select(F.col("component").alias("id"), F.col("component").alias("grp")).distinct()))
    members = kit.cut(kit.beside(_bodies(docs, groups, num, den), groups, "id").select("grp", "id", "body", "cls").dropDuplicates(["id"]))
    kit.drop(comps, groups)
    kit.release(spark)
    return links.link_groups(links.by_class(members, block, 1000), shingle_sets, num, den, links.linked_by_size)


def removals(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, _id, _k, n_lines, removed): for each document the numbers of the lines that go, from 0."""
    docs = kit.keyed(docs)
    comps = kit.cut(line_components(docs, num, den))
    seen = kit.cut(_occurrences(docs))
    each = seen.select("_id", "_k", F.posexplode("_lines").alias("at", "_line")).where("_line is not null")
    rooted = each.join(comps.withColumnRenamed("id", "_line"), "_line", "left").select("_id", "_k", "at", F.coalesce("component", "_line").alias("_root"))
    place = F.struct("_id", "_k", "at")
    first = rooted.groupBy("_root").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).where(F.col("_first") != F.col("_last")).drop("_last")
    gone = rooted.join(first, "_root").where(place != F.col("_first")).groupBy("_id", "_k").agg(F.array_sort(F.collect_set("at")).alias("removed"))
    return seen.select("doc_id", "_id", "_k", F.col("_n").alias("n_lines")).join(gone, ["_id", "_k"], "left").select("doc_id", "_id", "_k", "n_lines", F.coalesce("removed", F.expr("cast(array() as array<int>)")).alias("removed"))


def deduped(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """All columns of ``docs``, with the removed lines gone from ``text``."""
    names, out = (kit.fresh("_id", docs), kit.fresh("_k", docs)), kit.fresh("_removed", docs)
    gone = removals(docs, num, den).where(F.size("removed") > 0).select(F.col("_id").alias(names[0]), F.col("_k").alias(names[1]), F.col("removed").alias(out)).dropDuplicates([*names])
    cols = docs.columns
    keyed = kit.beside(docs.select("*", *kit.row_key(docs, names)), gone, [*names], "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(out, i)), "\n")
    return keyed.withColumn("text", F.when(F.col(out).isNull(), F.col("text")).otherwise(kept)).select(*cols)


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = removals(kit.read(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")
