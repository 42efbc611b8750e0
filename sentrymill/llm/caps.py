"""Embedding near-dedup by spherical-cap filters with structured random product codes.

Vectors are scaled to length one and rotated at random; each half is scored against its own random codebook.
A filter is a pair of code words, its score the sum of both; a vector is list-decoded to all filters whose
score exceeds a threshold, which about ``lists`` of them do. Books and lists grow with the number of vectors
(``sized``), so that a filter holds about as many vectors whatever the input. Vectors that meet in a filter are compared in blocks
by cosine in double precision. A pair is counted in the first filter that both pass, so no pair is emitted
or counted twice: tasks give link counts and spanning edges only. Filters that many vectors pass are dealt
into blocks, and every pair of blocks is a task of its own. A vector goes to each of its filters, many times its own bytes,
so filters are worked off in rounds, each of which shuffles a bounded multiple of the input; its files are deleted before the next.

Equal vectors are one class with a weight. Vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, and vectors of different lengths do not link with each other. Repeated
rows and ids are vectors of their own; null ids are kept; an empty table gives an empty result; other columns are
never read. A link is missed where its vectors share no filter: of pairs at cosine 0.9 exactly, 0.99 are found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import together
from . import kit, links

BLOCK = 2048
#: Bytes that a round may shuffle: so many, or so many times the bytes of the vectors if that is more.
ROUND, TIMES = 1 << 30, 1.5


class Code:
    """Product code of two books of ``words`` directions for vectors of ``dim`` numbers."""

    def __init__(self, dim: int, words: int, lists: float, seed: int = 97):
        rng = np.random.default_rng(seed + dim)
        self.half = (dim + 1) // 2
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0].astype(np.float32)
        book = lambda n: (lambda c: c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9))(rng.standard_normal((words, max(n, 1)))).astype(np.float32)
        self.books = book(self.half), book(dim - self.half)
        self.words = words
        self.least = NormalDist().inv_cdf(1 - min(0.5, lists / words**2)) * (2 / dim) ** 0.5

    def lists(self, x: np.ndarray) -> list[np.ndarray]:
        """The filters that each row of unit vectors passes, ascending."""
        y = x.astype(np.float32) @ self.turn
        a = y[:, : self.half] @ self.books[0].T
        b = y[:, self.half :] @ self.books[1].T if y.shape[1] > self.half else np.zeros((len(x), self.words), np.float32)
        out = []
        for p, q in zip(a, b):
            i = np.flatnonzero(p > self.least - q.max())
            j = np.flatnonzero(q > self.least - p.max())
            r, c = np.nonzero(p[i][:, None] + q[j][None] > self.least)
            out.append(i[r] * self.words + j[c])
        return out


def sized(vectors: int, held: int = 256) -> tuple[int, float]:
    """(words of a book, filters of a vector) for about ``held`` vectors a filter. Twice as many words need 1.41 times as
    many filters of a vector for the same recall (0.99 at cosine 0.9 with 64 numbers, drawn pairs; more with 256)."""
    words, lists = 128, 80.0
    while vectors * lists > held * words**2:
        words, lists = 2 * words, lists * 2**0.5
    return words, lists


def _bodies(docs: DataFrame) -> DataFrame:
    """(vec_id, _cls, _body): valid vectors as 32-bit floats (64-bit where the column is), null for others."""
    wide = "double" in docs.schema["embedding"].dataType.simpleString()
    kind = np.float64 if wide else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, body = [], []
            for v in b.column(1):
                x = v.values.to_numpy(zero_copy_only=False).astype(kind) if v.is_valid and v.values.null_count == 0 else np.zeros(0, kind)
                ok = len(x) and np.isfinite(x).all() and 0 < np.linalg.norm(x.astype(np.float64)) < np.inf
                raw = (x + kind(0)).tobytes() if ok else None
                body.append(raw)
                cls.append(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True) if ok else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, pa.int64()), pa.array(body, pa.binary())], names=["vec_id", "_cls", "_body"])

    return docs.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, _cls long, _body binary")


def near(docs: DataFrame, share: float = 0.9, words: int | None = None, lists: float | None = None, held: int = 256, rounds: int | None = None) -> DataFrame:
    """For each vector its links with cosine >= ``share``, its component and whether it is the one kept.

    ``words`` and ``lists``: words of a book and filters of a vector, from the number of vectors where they are not given;
    ``held``: about how many vectors a filter then holds. Filters that hold more than two blocks are known on the driver
    (the 100,000 largest at most) and dealt into blocks. ``rounds``: among how many rounds the filters are shared, from the bytes that
    they take where it is not given; the result does not depend on it."""
    spark = docs.sparkSession
    kind = np.float64 if "double" in docs.schema["embedding"].dataType.simpleString() else np.float32
    size = np.dtype(kind).itemsize
    rows = kit.cut(_bodies(docs))
    classes = kit.cut(rows.where("_cls is not null").groupBy("_cls").agg(F.count("*").alias("_w"), F.min("_body").alias("_body")))
    fitted = sized(classes.count(), held)
    words, lists = words or fitted[0], lists or fitted[1]
    index = np.int32 if words**2 < 2**31 else np.int64
    codes: dict[int, Code] = {}

    def decode(bodies: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(bodies)
        for n in {len(x) for x in bodies}:
            k = [i for i, x in enumerate(bodies) if len(x) == n]
            dim = n // size
            code = codes.setdefault(dim, Code(dim, words, lists))
            x = np.frombuffer(b"".join(bodies[i] for i in k), kind).reshape(-1, dim).astype(np.float64)
            x /= np.abs(x).max(1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for i, f in zip(k, code.lists(x)):
                out[i] = f
        return out

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kit.trim()
        for b in batches:
            got = np.frombuffer(b"".join(b.column(0).to_pylist()), index)
            if len(got):
                f, n = np.unique(got, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(n)], names=["f", "n"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kit.trim()
        for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            fs = [f.astype(index).tobytes() for f in decode(b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fs, pa.binary())], names=["_cls", "_w", "_body", "_fs"])

    # each vector with its filters, decoded once for all rounds
    coded = kit.cut(classes.select("_cls", "_w", "_body").mapInArrow(listed, "_cls long, _w long, _body binary, _fs binary"))
    counts = kit.cut(coded.select("_fs").mapInArrow(passes, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")))
    blocks = F.when(F.col("n") > 2 * BLOCK, F.ceil(F.col("n") / BLOCK)).otherwise(1)
    entries = counts.agg(F.sum(F.col("n") * blocks)).collect()[0][0] or 0
    if rounds is None:
        own = coded.agg(F.sum(F.length("_body")), F.sum(F.length("_body") + F.length("_fs") / 2 + 48) / F.count("*")).collect()[0]
        rounds = max(1, int(-(-(entries * (own[1] or 0)) // max(ROUND, TIMES * (own[0] or 0)))))
    sizes = {r["f"]: r["n"] for r in counts.where(F.col("n") > 2 * BLOCK).orderBy(F.desc("n"), "f").limit(100_000).collect()}

    def settle(held: list[tuple]) -> tuple[list, list, list]:
        u, v, n = [], [], []
        by: dict[int, list[tuple]] = {}
        for r in held:
            by.setdefault(r[7], []).append(r)
        for width, rs in by.items():
            a, b, c = _links(rs, width, kind, index, share)
            u += a
            v += b
            n += c
        return u, v, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: tuple[list, list, list] = ([], [], [])
        kit.trim()
        for b in (b.slice(i, 2000) for b in batches for i in range(0, b.num_rows, 2000)):
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if held and row[:3] != held[0][:3]:
                    for c, x in zip(out, settle(held)):
                        c += x
                    held = []
                held.append(row)
        if held:
            for c, x in zip(out, settle(held)):
                c += x
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["u", "v", "n"])

    def deal(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        kit.trim()
        width = np.dtype(index).itemsize
        for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            out: list[list] = [[] for _ in range(8)]
            for cls, w, body, raw in zip(*[c.to_pylist() for c in b.columns]):
                fs = np.frombuffer(raw, index)
                at = np.flatnonzero(kit.mix(fs.astype(np.uint64)) % np.uint64(rounds) == turn) if rounds > 1 else np.arange(len(fs))
                for k, f in zip(at.tolist(), fs[at].tolist()):
                    whole = body + raw[: k * width]  # with the filters before this one
                    blocks = -(-sizes[f] // BLOCK) if f in sizes else 1
                    own = (cls * 2654435761 >> 7) % blocks
                    for o in range(blocks):
                        for c, v in zip(out, (f, min(own, o), max(own, o), own, cls, w, whole, len(body))):
                            c.append(v)
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["f", "a", "b", "own", "cls", "w", "body", "width"])

    n, found = 4 * kit.parts(spark), []
    for turn in range(rounds):
        if turn:
            kit.release(spark)
        dealt = coded.mapInArrow(lambda batches, turn=turn: deal(batches, turn), "f long, a int, b int, own int, cls long, w long, body binary, width int")
        found.append(kit.cut(dealt.repartition(n, "f", "a", "b").sortWithinPartitions("f", "a", "b").mapInArrow(run, "u long, v long, n long")))
        del dealt
    kit.drop(coded, counts)
    found = together(found)
    direct = found.where("v is null").groupBy("u").agg(F.sum("n").alias("_n"))
    comps = links.components(found.where("v is not null").select("u", "v"))
    got = rows.select("vec_id", "_cls").join(classes.select("_cls", "_w"), "_cls", "left")
    got = got.join(direct.withColumnRenamed("u", "_cls"), "_cls", "left").join(comps.withColumnRenamed("id", "_cls"), "_cls", "left")
    got = got.withColumn("_root", F.coalesce("component", "_cls"))
    least = got.where("_root is not null").groupBy("_root").agg(F.min("vec_id").alias("_least"))
    got = got.join(least, "_root", "left").withColumn("component_id", F.when(F.col("_root").isNull(), F.col("vec_id")).otherwise(F.col("_least")))
    count = F.coalesce("_n", F.lit(0)) + F.coalesce(F.col("_w") - 1, F.lit(0))
    return got.select("vec_id", count.cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _links(rows: list[tuple], width: int, kind: type, index: type, share: float) -> tuple[list, list, list]:
    """Link counts (u, null, n) and spanning edges (u, v, 0) among the vectors of one filter, or between two blocks of it."""
    cross = rows[0][1] != rows[0][2]
    rows.sort(key=lambda r: (r[3], r[4]))
    x = np.stack([np.frombuffer(r[6][:width], kind) for r in rows]).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    norm = np.linalg.norm(x, axis=1)
    earlier = [np.frombuffer(r[6][width:], index) for r in rows]
    weight, own, n = np.array([r[5] for r in rows], np.int64), np.array([r[3] for r in rows]), len(rows)
    count, comp = np.zeros(n, np.int64), np.arange(n)
    for i in range(0, n, 1024):
        for j in range(i, n, 1024):
            p, q = np.arange(i, min(i + 1024, n)), np.arange(j, min(j + 1024, n))
            hit = x[p] @ x[q].T >= share * norm[p][:, None] * norm[q][None]
            hit &= p[:, None] < q[None]
            if cross:
                hit &= own[p][:, None] != own[q][None]
            if not hit.any():
                continue
            # pairs that meet in an earlier filter are counted there
            r, c = hit.any(1), hit.any(0)
            pr, qc = p[r], q[c]
            cols = np.unique(np.concatenate([earlier[k] for k in pr]))
            if len(cols):
                ma, mb = np.zeros((len(pr), len(cols)), np.float32), np.zeros((len(qc), len(cols)), np.float32)
                for m, ks in ((ma, pr), (mb, qc)):
                    for row, k in enumerate(ks):
                        at = np.searchsorted(cols, earlier[k])
                        at = at[(at < len(cols)) & (cols[np.minimum(at, len(cols) - 1)] == earlier[k])]
                        m[row, at] = 1
                fresh = hit[np.ix_(r, c)] & (ma @ mb.T == 0)
            else:
                fresh = hit[np.ix_(r, c)]
            count[pr] += fresh @ weight[qc]
            count[qc] += fresh.T @ weight[pr]
            for row in np.flatnonzero(fresh.any(1)):
                k = np.append(qc[fresh[row]], pr[row])
                of = np.unique(comp[k])
                if len(of) > 1:
                    comp[np.isin(comp, of)] = of[0]
    ids = np.array([r[4] for r in rows], np.int64)
    u, v, m = [], [], []
    for k in np.flatnonzero(count):
        u.append(int(ids[k])), v.append(None), m.append(int(count[k]))
        if comp[k] != k:
            u.append(int(ids[k])), v.append(int(ids[comp[k]])), m.append(0)
    return u, v, m


def op3_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(kit.read(spark, sf_dir, "embeddings"))
