"""Document fingerprints by winnowing.

Every run of ``k`` code points is hashed; of every ``window`` neighbouring hashes the smallest is kept,
the rightmost on ties, with its position. Two texts that share a run of at least ``window + k - 1`` code
points share a fingerprint entry. A text shorter than ``k`` has one entry, the hash of the whole text; an
empty (or null) text has none.

The comparison with the next document needs an order over all documents: they are dealt into ranges of
doc_id (bounds from one small aggregate), each text is shuffled once, and the head of every range is also
sent to the range before it. Null ids come first; rows with equal ids are ordered by their text, null text
first; a table of one row is its own next. Columns other than the id and the text are never read.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kit

U = np.uint64
#: What the query uses: a shared run of 8 code points is always seen, so near copies of short texts are too.
K, WINDOW = 5, 4
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def winnow(texts: list[str], k: int = 16, window: int = 48) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the 32-bit hashes kept and their positions (code points), in text order."""
    sizes = [len(t) for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    empty = np.zeros(0, np.uint32)
    if not len(codes):
        return [(empty, empty)] * len(texts)
    grams = _grams(codes, k)
    key = ((grams >> U(32)) << U(32)) | (U(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64))
    lows = _window_min(key, window)
    out, at = [], 0
    for n, t in zip(sizes, texts):
        g = n - k + 1
        if n == 0:
            sel = empty
        elif g <= 0:
            whole = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
            h = U(n)
            for c in whole:
                with np.errstate(over="ignore"):  # products are meant to wrap
                    h = kit.mix(np.array([h * U(0x100000001B3) + U(c)], np.uint64))[0]
            out.append((np.array([h >> U(32)], np.uint32), np.zeros(1, np.uint32)))
            at += n
            continue
        elif g < window:
            sel = key[at : at + g].min(keepdims=True)
        else:
            sel = lows[at : at + g - window + 1]
            sel = sel[np.concatenate([[True], sel[1:] != sel[:-1]])]
        if len(sel):
            out.append(((sel >> U(32)).astype(np.uint32), ((U(0xFFFFFFFF) - (sel & U(0xFFFFFFFF))).astype(np.int64) - at).astype(np.uint32)))
        else:
            out.append((empty, empty))
        at += n
    return out


def _grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k code points from every place, by doubling."""
    h, width, done, got = kit.mix(codes + U(0x9E3779B97F4A7C15)), 1, 0, None
    while True:
        if k & width:
            if got is None:
                got, done = h, width
            else:
                n = len(codes) - done - width + 1
                got = kit.mix(got[: max(n, 0)] * U(0xD6E8FEB86659FD93) + h[done : done + max(n, 0)])
                done += width
        if done == k:
            return got
        n = len(h) - width
        h = kit.mix(h[: max(n, 0)] * U(0xA0761D6478BD642F) + h[width : width + max(n, 0)])
        width *= 2


def _window_min(key: np.ndarray, window: int) -> np.ndarray:
    m, width = key, 1
    while width * 2 <= window:
        m = np.minimum(m[:-width], m[width:]) if len(m) > width else m[:0]
        width *= 2
    rest = window - width
    return (np.minimum(m[:-rest], m[rest:]) if len(m) > rest else m[:0]) if rest else m


def encoded(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Eight hex digits of hash and eight of position for each entry."""
    return np.stack([hashes, positions], 1).astype(">u4").tobytes().hex()


def packed(hashes: np.ndarray, positions: np.ndarray, window: int) -> str:
    """The same entries in base64: all hashes of four bytes, then each position's distance from the one before, of one byte if windows
    are under 256 wide and four otherwise; a third to less than half of the characters of ``encoded``."""
    gaps = np.diff(positions.astype(np.int64), prepend=0)
    return base64.b64encode(hashes.astype(">u4").tobytes() + gaps.astype("u1" if window < 256 else ">u4").tobytes()).decode()


def unpacked(text: str, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of what ``packed`` made."""
    raw, width = base64.b64decode(text), 1 if window < 256 else 4
    n = len(raw) // (4 + width)
    return np.frombuffer(raw[: 4 * n], ">u4").astype(np.uint32), np.cumsum(np.frombuffer(raw[4 * n :], "u1" if width == 1 else ">u4").astype(np.int64)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Dice over the hashes, counting repeats; two empty fingerprints are alike."""
    if not len(a) and not len(b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    x, m = np.unique(a, return_counts=True)
    y, n = np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    same = x[at] == y
    return float(2.0 * np.minimum(m[at[same]], n[same]).sum() / (len(a) + len(b)))


def _ranges(docs: DataFrame, n: int) -> list[int]:
    """At most n - 1 ids present in the table, each the smallest of its range."""
    q = [i / n for i in range(1, n)] or [0.5]
    got = docs.agg(F.min("doc_id").alias("lo"), F.percentile_approx("doc_id", q, F.lit(max(10_000, 20 * n))).alias("q")).collect()
    lo, q = got[0]["lo"], got[0]["q"]
    return sorted({v for v in q or [] if v > lo})


def fingerprints(docs: DataFrame, k: int = 16, window: int = 48, pack: bool = False) -> DataFrame:
    """Each document's winnowed fingerprint and its edited text's, with their likeness and the next document's. Fingerprints are
    written as ``encoded`` does, or ``packed`` with ``pack``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = kit.parts(spark)
    bounds = _ranges(docs.select("doc_id"), n)
    first = docs.agg(F.min("doc_id"), F.count(F.when(F.col("doc_id").isNull(), 1))).collect()[0]
    head = {b: i for i, b in enumerate(bounds)}
    head[None if first[1] else first[0]] = len(bounds)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            own = [0 if d is None else bisect_right(bounds, d) for d in ids]
            copies = [i for i, d in enumerate(ids) if d in head]
            take = pa.array([*range(len(ids)), *copies], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(own + [head[ids[i]] for i in copies], pa.int32()), pa.array([0] * len(ids) + [1] * len(copies), pa.int32()), b.column(0).take(take), b.column(1).take(take)], names=["_range", "_tail", "doc_id", "text"])

    dealt = docs.mapInArrow(deal, "_range int, _tail int, doc_id long, text string").repartition(n, "_range")
    dealt = dealt.sortWithinPartitions("_range", "_tail", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for cols in kit.slices(batches, text=3):
            rows += zip(*cols)
            yield from _compare(rows, k, window, pack)
            rows = rows[-1:]

    return dealt.mapInArrow(run, RESULT)


def _compare(rows: list[tuple], k: int, window: int, pack: bool) -> Iterator[pa.RecordBatch]:
    """Result of all own rows that have another row of their range behind them."""
    at = [i for i in range(len(rows) - 1) if not rows[i][1]]
    if not at:
        return
    texts = [r[3] or "" for r in rows]
    edited = []
    for i in at:
        t, q = texts[i], len(texts[i]) // 4
        edited.append(t[: len(t) - q] + texts[i + 1][:q])
    text = (lambda h, p: packed(h, p, window)) if pack else encoded
    plain = winnow(texts, k, window)
    changed = winnow(edited, k, window)
    out: list[list] = [[] for _ in range(7)]
    for (i, e, (eh, ep)) in zip(at, edited, changed):
        h, p = plain[i]
        row = (rows[i][2], len(texts[i]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), text(h, p), text(eh, ep), likeness(h, eh), likeness(h, plain[i + 1][0]))
        for c, v in zip(out, row):
            c.append(v)
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=[x.split()[0] for x in RESULT.split(", ")])


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(kit.read(spark, sf_dir, "documents"), K, WINDOW, pack=True)
