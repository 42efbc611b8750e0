"""Toxicity: gradient-boosted trees over a few dense features, with isotonic calibration.

Features of a text: densities and weights of a lexicon (words and word beginnings learned from labelled
texts), how near lexicon words stand to second-person words, capitals, punctuation, and words written in
disguise (digits or symbols among letters). The model is fitted on about ``sample`` labelled rows outside
the held-out third, chosen by a hash of doc_id (all, if there are no more), with a lexicon of at most ``top`` terms;
two folds keep the lexicon and the calibration honest. Every text is scored whole. Null or empty texts get the features of an empty text; ids may be null or repeat;
labels that are null are not used; without four rows of either class the score is the share of label 1 (0.5 without labels).
An empty table gives an empty result; with ``keep`` all columns stay whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kit

WORD = re.compile(r"[^\W_]+")
#: A word written in disguise: letters with digits or symbols between them.
DISGUISED = re.compile(r"[^\W\d_]+(?:[0-9@$*!|]+[^\W\d_]+)+|[@$*!|0-9]+[^\W\d_]{2,}")
#: What every disguised word holds, and what it lies in: such runs are found by their few digits and symbols.
MARKED, RUN, MARKS = re.compile(r"[0-9@$*!|][^\W\d_]"), re.compile(r"(?:[^\W\d_]|[0-9@$*!|])+"), frozenset("0123456789@$*!|")
CAPITALS = bytes(c for c in range(256) if re.match(r"[A-ZÀ-ÖØ-Þ]", chr(c)))
#: Words whose weight a task keeps.
KNOWN = 100_000
PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": None})
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti usted ustedes vosotros".split())
FEATURES = 16


def terms(word: str) -> tuple[str, ...]:
    """The lexicon entries that a word can match: itself and its beginnings."""
    n = len(word)
    if n < 4:
        return (word,)
    return ("=" + word, word[:4] + "-", word[:5] + "-") if n > 4 else ("=" + word, word + "-")


def disguised(t: str) -> list[str]:
    """All that ``DISGUISED`` finds; words without digits or symbols are not tried, letter by letter, one after another."""
    out, end = [], 0
    while m := MARKED.search(t, end):
        at = m.start()
        while at > end and ((c := t[at - 1]) in MARKS or c.isalnum() and not c.isdecimal()):
            at -= 1
        end = RUN.match(t, at).end()
        out += DISGUISED.findall(t, at, end)
    return out


def features(text: str | None, lexicon: dict[str, float], known: dict[str, float] | None = None) -> list[float]:
    """``known`` keeps the weights of words for further texts and the same lexicon."""
    t, known = text or "", {} if known is None else known
    words = WORD.findall(t.lower())
    n = len(words)
    hits: list[tuple[int, float]] = []
    uniq = set(words)
    if len(known) > KNOWN:
        known.clear()
    for w in uniq.difference(known):
        known[w] = max((lexicon[x] for x in terms(w) if x in lexicon), default=0.0)
    weight = {w: s for w in uniq if (s := known[w]) > 0}
    if weight:
        hits = [(i, weight[w]) for i, w in enumerate(words) if w in weight]
    near = 0
    if hits and not SECOND.isdisjoint(uniq):
        second = np.array([i for i, w in enumerate(words) if w in SECOND])
        at = np.array([i for i, _ in hits])
        j = np.searchsorted(second, at)
        left = np.abs(at - second[np.maximum(j - 1, 0)])
        right = np.abs(second[np.minimum(j, len(second) - 1)] - at)
        near = int((np.minimum(left, right) <= 4).sum())
    odd = disguised(t)
    odd_hits = sum(1 for w in odd if any(x in lexicon for x in terms(w.lower().translate(PLAIN))))
    letters = sum(map(len, words))
    caps = len(t) - len(t.encode("latin-1", "replace").translate(None, CAPITALS))
    bangs = t.count("!") + t.count("?")
    marks = len(t) - letters - t.count(" ") - t.count("\n")
    total = sum(s for _, s in hits)
    m = max(n, 1)
    return [len(hits) / m, total / m, float(len(hits)), total, max((s for _, s in hits), default=0.0), float(len(weight)), near / m, float(near), caps / max(letters, 1), bangs / m, max(marks, 0) / max(len(t), 1), len(odd) / m, float(odd_hits), math.log1p(n), letters / m, n / max(t.count("\n") + 1, 1)]


def fit_lexicon(counts: list[tuple[str, int, int]], n: tuple[int, int], top: int = 4000) -> dict[str, float]:
    """Log odds of terms that labelled texts of class 1 have far more often; counts: term, texts of class 0, of class 1."""
    found = []
    for term, a, b in counts:
        s = math.log((b + 0.2) / (n[1] + 1)) - math.log((a + 0.2) / (n[0] + 1))
        if b >= 3 and s >= 2.0:
            found.append((s * math.log1p(b), term, s))
    return {t: s for _, t, s in sorted(found, reverse=True)[:top]}


class Trees:
    """Boosted regression trees for the logistic loss over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: int = 4):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        z, self.trees = self._bins(x), []
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = math.log(p / (1 - p))
        f = np.full(len(y), self.base)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, np.maximum(q * (1 - q), 1e-6)
            node = np.zeros(len(y), int)
            tree: dict[int, tuple] = {}
            self._grow(z, g, h, np.arange(len(y)), 1, depth, rate, least, tree, node)
            self.trees.append(tree)
            f += np.array([tree[k][1] for k in node])

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], 1)

    def _grow(self, z, g, h, rows, k, depth, rate, least, tree, node):
        value = rate * g[rows].sum() / (h[rows].sum() + 1.0)
        best = None
        if depth and len(rows) >= 2 * least:
            whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
            for j in range(z.shape[1]):
                m = len(self.edges[j]) + 1
                gs = np.cumsum(np.bincount(z[rows, j], g[rows], m))
                hs = np.cumsum(np.bincount(z[rows, j], h[rows], m))
                ns = np.cumsum(np.bincount(z[rows, j], minlength=m))
                ok = (ns >= least) & (len(rows) - ns >= least)
                gain = np.where(ok, gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - whole, -1)
                b = int(gain.argmax())
                if gain[b] > 1e-9 and (best is None or gain[b] > best[0]):
                    best = (gain[b], j, b)
        if best is None:
            tree[k] = (None, value)
            node[rows] = k
            return
        _, j, b = best
        tree[k] = (j, b)
        left = z[rows, j] <= b
        self._grow(z, g, h, rows[left], 2 * k, depth - 1, rate, least, tree, node)
        self._grow(z, g, h, rows[~left], 2 * k + 1, depth - 1, rate, least, tree, node)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z, f = self._bins(x), np.full(len(x), self.base)
        for tree in self.trees:
            self._add(tree, 1, z, np.arange(len(x)), f)
        return f

    def _add(self, tree, k, z, rows, f):
        j, b = tree[k]
        if j is None:
            f[rows] += b
        elif len(rows):
            left = z[rows, j] <= b
            self._add(tree, 2 * k, z, rows[left], f)
            self._add(tree, 2 * k + 1, z, rows[~left], f)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: steps (from, value) of the non-decreasing fit; one pseudo-row at each end."""
    o = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[o], y[o]):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and (blocks[-2][1] >= blocks[-1][1] or blocks[-2][0] == blocks[-1][0]):
            a2, v, w = blocks.pop()
            blocks[-1][1] = (blocks[-1][1] * blocks[-1][2] + v * w) / (blocks[-1][2] + w)
            blocks[-1][2] += w
    return np.array([b[0] for b in blocks]), np.array([(b[1] * b[2] + 0.5 * 0.2) / (b[2] + 0.2) for b in blocks])


def calibrated(steps: tuple[np.ndarray, np.ndarray], f: np.ndarray) -> np.ndarray:
    """Linear between the steps' starts, so that equal ranks of margin stay apart."""
    return np.clip(np.interp(f, steps[0], np.maximum.accumulate(steps[1])), 0, 1)


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000):
    """(lexicon, trees, calibration), or the constant share of label 1 where there is nothing to learn."""
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (kit.crc_mod("doc_id", 3) != 1))
    labels = labels.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_y"))
    n = labels.count()
    if not n:
        return 0.5
    draw = F.xxhash64("doc_id", F.lit(11)) / F.lit(2.0**64) + 0.5
    chosen = labels.where(draw < min(1.0, sample / n)).withColumn("_fold", F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(2)).cast("int"))
    # about ``sample`` rows of a few bytes, whatever the input, so they are sent to every task
    rows = kit.cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("_fold", "text", "_y"))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fold, texts, y in kit.slices(batches):
            ts, fs, ys = [], [], []
            for f, t, v in zip(fold, texts, y):
                got = {x for w in set(WORD.findall((t or "").lower())) for x in terms(w)}
                ts += got
                fs += [f] * len(got)
                ys += [v] * len(got)
            yield pa.RecordBatch.from_arrays([pa.array(ts, pa.string()), pa.array(fs, pa.int32()), pa.array(ys, pa.int32())], names=["t", "f", "y"])

    sizes = {(r["_fold"], r["_y"]): r["count"] for r in rows.groupBy("_fold", "_y").count().collect()}
    size = lambda y, folds: sum(sizes.get((f, y), 0) for f in folds)
    if min(size(0, (0, 1)), size(1, (0, 1))) < 4:
        return size(1, (0, 1)) / max(1, size(0, (0, 1)) + size(1, (0, 1)))
    # terms that pass the lexicon's own test in a fold or in both together; those of the sample only, so they are bounded
    passes = " or ".join(f"({b} >= 3 and ({b} + 0.2) * {size(0, k) + 1} >= exp(1.99) * ({a} + 0.2) * {size(1, k) + 1})" for a, b, k in (("c00", "c01", (0,)), ("c10", "c11", (1,)), ("(c00 + c10)", "(c01 + c11)", (0, 1))))
    one = lambda f, y: F.count(F.when((F.col("f") == f) & (F.col("y") == y), 1))
    terms_of = rows.mapInArrow(explode, "t string, f int, y int").groupBy("t").agg(*[one(f, y).alias(f"c{f}{y}") for f in (0, 1) for y in (0, 1)]).where(passes)
    got = [tuple(r) for r in terms_of.collect()]
    lex = [fit_lexicon([(t, c00, c01) for t, c00, c01, _, _ in got], (size(0, (0,)), size(1, (0,)))), fit_lexicon([(t, c10, c11) for t, _, _, c10, c11 in got], (size(0, (1,)), size(1, (1,))))]
    full = fit_lexicon([(t, a + c, b + d) for t, a, b, c, d in got], (size(0, (0, 1)), size(1, (0, 1))))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fold, texts, y in kit.slices(batches):
            x = [features(t, lex[1 - f]) for f, t in zip(fold, texts)]
            yield pa.RecordBatch.from_arrays([pa.array(fold, pa.int32()), pa.array(y, pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["f", "y", "x"])

    table = sorted((r["f"], r["y"], *r["x"]) for r in rows.mapInArrow(dense, "f int, y int, x array<double>").collect())
    kit.drop(rows)
    a = np.array(table, float)
    f, y, x = a[:, 0], a[:, 1], a[:, 2:]
    out = np.zeros(len(y))
    for k in (0, 1):
        if len(set(y[f != k])) == 2 and (f == k).any():
            out[f == k] = Trees(x[f != k], y[f != k])(x[f == k])
        else:
            return float(y.mean())
    return full, Trees(x, y), isotonic(out, y)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = 20_000, keep: bool = False) -> DataFrame:
    """Each document's id, score and prediction; with ``keep`` all columns of the documents that are predicted 0."""
    model = learn(docs, labels, sample)
    cols = docs.columns if keep else ["doc_id"]
    at = cols.index("text") if keep else 1
    mark, guess = (kit.fresh(c, docs.select(*cols)) for c in ("_score", "_predicted"))
    rows = docs.select(*cols) if keep else docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kit.trim()
        known: dict[str, float] = {}
        for b in (b.slice(lo, hi - lo) for b in batches for lo, hi in kit.bounds(b.column(at), 1_000_000)):
            if isinstance(model, float):
                s = np.full(b.num_rows, model)
            else:
                lexicon, trees, steps = model
                x = np.array([features(t, lexicon, known) for t in b.column(at).to_pylist()], float).reshape(-1, FEATURES)
                s = calibrated(steps, trees(x))
            guesses = (s >= threshold).astype(np.int32)
            if keep:  # rejected documents never leave the worker
                yield b.filter(pa.array(guesses == 0))
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(guesses, pa.int32())], names=["doc_id", mark, guess])

    if keep:
        return rows.mapInArrow(run, rows.schema)
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField(mark, T.DoubleType()), T.StructField(guess, T.IntegerType())]))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = score(kit.read(spark, sf_dir, "documents"), kit.read(spark, sf_dir, "labels"))
    return got.select("doc_id", (kit.crc_mod("doc_id", 3) == 1).alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))
