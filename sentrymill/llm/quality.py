"""Quality: Bradley-Terry scores learned from preference pairs, cut at a quantile of the scores.

A text of label 1 is preferred to one of label 0. With scores linear in a text's features, the chance that one text is
preferred to another is the logistic of the difference of their scores, so weights are fitted by logistic loss on differences
of features over pairs (Newton steps, ridge). Features are rates over bytes and words of the whole text, each as steps
at quantiles of all labelled rows. The threshold is the quantile of their scores at the share of label 0 among them;
a text's score is the chance that it is preferred to a text at that quantile, moved so that it is ``threshold`` there.

All labelled rows outside the held-out part are learned from, by Spark jobs over 19 bytes a row: every row of the commoner label is in
a pair, with rows of the other label in turn, and no row is left out. Of rows with one id the one with the smallest features counts.
Every text is scored whole. Null and empty texts have the features of an empty text; null or repeated ids are scored like others;
null labels are not used, of several labels of one id the largest counts; without four rows of either label the score is the share of label 1 (0.5
without labels). An empty table gives an empty result; with ``keep`` all columns stay whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kit

LETTER, UPPER, DIGIT, STOP, BANG, SIGN, LINE, HIGH = (1 << i for i in range(8))
#: The classes of each byte; bytes of longer code points count as letters.
CLASS = np.zeros(256, np.uint8)
CLASS[[*range(65, 91), *range(97, 123)]] |= LETTER
CLASS[65:91] |= UPPER
CLASS[48:58] |= DIGIT
CLASS[[ord(c) for c in ".,;:"]] |= STOP
CLASS[[ord(c) for c in "!?"]] |= BANG
CLASS[[c for c in range(33, 127) if not CLASS[c]]] |= SIGN
CLASS[10] |= LINE
CLASS[128:] |= LETTER | HIGH
FEATURES = 19


def features(texts: pa.Array) -> np.ndarray:
    """A row of features a text, all texts together."""
    texts = texts.cast(pa.large_string())
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    w = kit.Words(texts.to_pylist(), lower=False)
    data = np.frombuffer(w.data, np.uint8)
    kind = CLASS[data]
    kind[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] |= UPPER  # capitals of Latin-1
    at = np.concatenate([[0], np.cumsum(sizes + 1)])  # one byte stands between texts
    rows, n = len(texts), np.diff(w.first)

    def sums(marks: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marks)])
        return total

    def each(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = sums(marks)
        return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)

    def has(bit: int) -> np.ndarray:
        return (kind & bit) > 0

    def inside(bit: int) -> np.ndarray:
        total = sums(has(bit))
        return total[w.end] - total[w.start]

    byte = {b: each(has(b), at) for b in (LETTER, UPPER, DIGIT, STOP, BANG, SIGN, LINE, HIGH)}
    byte[LINE] = byte[LINE] - 1  # without the byte between texts
    length = w.end - w.start
    letters, uppers = inside(LETTER), inside(UPPER) + inside(HIGH) // 2
    of = np.repeat(np.arange(rows), n)
    same = lambda k: np.concatenate([np.zeros(min(k, len(of)), bool), (w.hash[k:] == w.hash[:-k]) & (of[k:] == of[:-k])])
    _, kept = np.unique(kit.mix(w.hash + of.astype(np.uint64) * kit._P), return_index=True)
    last, first = kind[w.end - 1], kind[w.start]
    word = lambda marks: each(marks, w.first)
    longest = np.zeros(rows)
    np.maximum.at(longest, of, length)
    m, size = np.maximum(n, 1), np.maximum(sizes, 1)
    return np.stack([
        np.log1p(n), np.log1p(word(length) / m), byte[UPPER] / np.maximum(byte[LETTER], 1), byte[DIGIT] / size, byte[STOP] / m, byte[BANG] / m, byte[SIGN] / m,
        word(letters == 0) / m, word((last & (SIGN | BANG)) > 0) / m, word(same(1)) / m, word(same(2)) / m, np.bincount(of[kept], minlength=rows) / m,
        word((length > 1) & (uppers >= letters) & (letters > 0)) / m, word((first & UPPER) > 0) / m, byte[LINE] / m, byte[HIGH] / size, np.log1p(longest), word(length == 1) / m, word((last & STOP) > 0) / m,
    ], 1)


class Model:
    """Bradley-Terry weights over steps of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, share: float, threshold: float, pairs: int = 20_000, steps: int = 12, ridge: float = 1.0, rounds: int = 12):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, steps + 2)[1:-1])) for c in x.T]
        z, rng = self._steps(x), np.random.default_rng(13)
        better, worse = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        # every row of the rarer label is in as many pairs as any other
        draw = lambda rows: np.concatenate([rng.permutation(rows) for _ in range(-(-pairs // len(rows)))])[:pairs]
        d = z[draw(better)] - z[draw(worse)]
        self.w = np.zeros(d.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(np.clip(d @ self.w, -30, 30)))  # the chance of the other outcome
            step = np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]) + ridge * np.eye(len(self.w)), d.T @ p - ridge * self.w)
            self.w += step
            if np.abs(step).max() < 1e-6:
                break
        self.at = self._quantile(z @ self.w, y, share) - math.log(threshold / (1 - threshold))

    @staticmethod
    def _quantile(s: np.ndarray, y: np.ndarray, share: float) -> float:
        """The score below which ``share`` of all labelled rows lie, between two rows; rows of a label stand for all that were labelled so."""
        o = np.argsort(s, kind="stable")
        weight = np.where(y == 1, (1 - share) / max(1, (y == 1).sum()), share / max(1, (y == 0).sum()))[o]
        k = int(np.searchsorted(np.cumsum(weight), share - 1e-9)) + 1
        return float((s[o][min(k, len(o)) - 1] + s[o][min(k, len(o) - 1)]) / 2)

    def _steps(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([(c[:, None] > e).astype(float) for c, e in zip(x.T, self.edges)], 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._steps(x) @ self.w - self.at, -30, 30)))


def dense(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kit.trim()
        for b in (b.slice(lo, hi - lo) for b in batches for lo, hi in kit.bounds(b.column(1), 1_000_000)):
            x = features(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * FEATURES, pa.int32()), pa.array(x.reshape(-1)))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.select("doc_id").schema["doc_id"], T.StructField("x", T.ArrayType(T.DoubleType()))]))


def matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), FEATURES)


def kth(scores: DataFrame, k: int) -> float:
    """The k-th smallest (from 1) of column ``s``, exactly: ranges of 1024 buckets until all values of the one that holds it are equal."""
    lo, hi = scores.agg(F.min("s"), F.max("s")).collect()[0]
    while lo < hi:
        inside = scores.where(F.col("s").between(lo, hi)).groupBy(F.least(F.floor((F.col("s") - lo) / (hi - lo) * 1024), F.lit(1023)).alias("b"))
        for r in inside.agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).orderBy("b").collect():  # 1024 rows at most
            if k <= r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
    return lo


def _normal(big: np.ndarray, small: np.ndarray, sign: float, times: int, w: np.ndarray, steps) -> np.ndarray:
    """Gradient and upper half of the Hessian, in one row, over pairs of each row of the commoner label with rows of the other in turn."""
    g, h, n = np.zeros(len(w)), np.zeros((len(w), len(w))), len(big)
    for i in range(0, n * times, 4096):
        k = np.arange(i, min(i + 4096, n * times))
        d = sign * (steps(big[k % n]) - steps(small[(k + k // n) % len(small)]))
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # the chance of the other outcome
        g += d.T @ p
        h += d.T @ (d * (p * (1 - p))[:, None])
    return np.concatenate([g, h[np.triu_indices(len(w))]])


def learn(made: DataFrame, labels: DataFrame, out: Column, threshold: float, pairs: int = 20_000, steps: int = 12, ridge: float = 1.0, rounds: int = 12, least: int = 20_000) -> Model | float:
    """The model of all labelled rows of ``made`` (doc_id, x), or the share of label 1 where there is nothing to learn; rows of labels
    where ``out`` holds are not used. Rows are dealt into groups of about ``least`` (more beyond 24 groups), each of which makes its pairs."""
    labels = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~out).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("quality").cast("int").alias("_y"))
    size = {r["_y"]: r["count"] for r in labels.groupBy("_y").count().collect()}
    share = size.get(0, 0) / max(1, sum(size.values()))
    if min(size.get(0, 0), size.get(1, 0)) < 4:
        return 1 - share if size else 0.5
    rows = kit.cut(made.select(F.col("doc_id").cast("long").alias("_id"), "x").join(labels, "_id").groupBy("_id", "_y").agg(F.min("x").alias("x")))
    size = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    if min(size.get(0, 0), size.get(1, 0)) < 4:
        return 1 - share
    model, q = Model.__new__(Model), np.linspace(0, 1, steps + 2)[1:-1].tolist()
    at = rows.agg(*[F.percentile_approx(F.get("x", F.lit(i)), q, F.lit(10_000)).alias(f"q{i}") for i in range(FEATURES)]).collect()[0]
    model.edges = [np.unique(np.array(c)) for c in at]
    edges, rare, n = model.edges, min(size, key=lambda y: (size[y], y)), sum(size.values())
    first, column = np.concatenate([[i] * len(e) for i, e in enumerate(edges)]), np.concatenate([np.arange(len(e)) for e in edges])
    unfolded = lambda bins: (bins[:, first] > column[None]).astype(float)

    # every group holds rows of both labels: those of the rarer one go to as many groups as that takes
    groups = max(-(-n // 250_000), min(24, -(-n // least)))
    copies = min(groups, -(-64 * groups // size[rare]))
    place = F.pmod(F.xxhash64("_id", F.lit(13)), F.lit(groups))
    many = F.when(F.col("_y") == rare, F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda j: (place + j) % groups)).otherwise(F.array(place))

    def packed(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("_y", "ascending"), ("_id", "ascending")])
        x, y = matrix(t["x"].combine_chunks()), t["_y"].to_numpy()
        bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1).astype(np.uint8)
        return pa.table({"g": pa.array([key[0].as_py()], pa.int64()), "big": pa.array([bins[y != rare].tobytes()], pa.binary()), "small": pa.array([bins[y == rare].tobytes()], pa.binary())})

    dealt = kit.cut(rows.select(F.explode(many).alias("g"), "_id", "_y", "x").groupBy("g").applyInArrow(packed, "g long, big binary, small binary").repartition(groups, "g"))
    times, sign = -(-pairs // (n - size[rare])), 1.0 if rare == 0 else -1.0

    def sums(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for g, big, small in zip(*[c.to_pylist() for c in b.columns]):
                    big, small = (np.frombuffer(v, np.uint8).reshape(-1, FEATURES) for v in (big, small))
                    v = _normal(big, small, sign, times, w, unfolded) if len(big) and len(small) else np.zeros(len(w) * (len(w) + 3) // 2)
                    yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([v.tobytes()], pa.binary())], names=["g", "v"])

        # one row of some 200 KB a group, added in the groups' order
        return np.sum([np.frombuffer(r["v"]) for r in sorted(dealt.mapInArrow(run, "g long, v binary").collect(), key=lambda r: r["g"])], axis=0)

    w = np.zeros(len(first))
    for _ in range(rounds):
        got = sums(w)
        h = np.zeros((len(w), len(w)))
        h[np.triu_indices(len(w))] = got[len(w) :]
        step = np.linalg.solve(h + np.triu(h, 1).T + ridge * np.eye(len(w)), got[: len(w)] - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    model.w, model.at = w, 0.0

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model._steps(matrix(b.column(0))) @ w)], names=["s"])

    scores = kit.cut(rows.select("x").mapInArrow(scored, "s double"))
    model.at = (kth(scores, size[0]) + kth(scores, size[0] + 1)) / 2 - math.log(threshold / (1 - threshold))
    kit.drop(rows, dealt, scores)
    return model


def score(docs: DataFrame, labels: DataFrame, out: Column | None = None, threshold: float = 0.3, keep: bool = False) -> DataFrame:
    """(doc_id, _score, _predicted) of each document; with ``keep`` all columns of the documents that are predicted 1.

    ``out`` tells which labelled ids are held out (none if None). Features are worked out once, but for ``keep``, where texts are read again."""
    made = kit.cut(dense(docs))
    model = learn(made, labels, F.lit(False) if out is None else out, threshold)
    rows = docs.select(*[docs[c] for c in docs.columns]) if keep else made
    at = [c.lower() for c in rows.columns].index("text" if keep else "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kit.trim()
        cuts = (b.slice(lo, hi - lo) for b in batches for lo, hi in kit.bounds(b.column(at), 1_000_000)) if keep else (b.slice(i, 5000) for b in batches for i in range(0, b.num_rows, 5000))
        for b in cuts:
            s = np.full(b.num_rows, model) if isinstance(model, float) else model(features(b.column(at)) if keep else matrix(b.column(at)))
            good = s >= threshold
            if keep:  # rejected documents never leave the worker
                yield b.filter(pa.array(good))
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(good.astype(np.int32))], names=["doc_id", "_score", "_predicted"])

    schema = rows.schema if keep else T.StructType([rows.schema["doc_id"], T.StructField("_score", T.DoubleType()), T.StructField("_predicted", T.IntegerType())])
    return rows.mapInArrow(run, schema)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = kit.crc_mod("doc_id", 5) == 0
    got = score(kit.read(spark, sf_dir, "documents"), kit.read(spark, sf_dir, "labels"), held)
    return got.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))
