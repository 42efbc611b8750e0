"""LM scoring with deleted interpolation.

The probability of a word mixes maximum-likelihood estimates, of the word after its predecessor, of the word
alone, and the uniform one over the vocabulary and one unknown word. The weights depend on a bucket of the
context's count; expectation-maximisation learns them on held-out counts: each training token is scored by
counts from which it has been deleted. Deleted probabilities are summed in a bounded table of cells.

Counts cover all training documents. Documents are dealt into chunks; a chunk sends the distinct words and
word pairs it holds, sorted and packed, to the part that counts them, and gets the totals back in the same order.
So words travel once for each chunk, a word in every text is no hot key, and a chunk needs memory for its own
texts only. Pairs are known by 40 bits of hash beside their part, words by 64.

A null text is empty: it has the end token alone. Repeated rows and ids count as often as they occur, null
ids hash as the empty string, an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kit

U = np.uint64
START, END = U(0x1F83D9ABFB41BD6B), U(0x5BE0CD19137E2179)
WORD, PAIR = 0, 1
#: One for contexts never seen and one for each power of two that a count can reach.
BUCKETS = 65
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, _counts binary"


def planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit numbers, byte by byte over all of them, which packs well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(b: bytes, width: int) -> np.ndarray:
    n = len(b) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


class Chunk:
    """The tokens of some texts: word keys, pair keys, and the distinct ones of each by part."""

    def __init__(self, texts: list[str | None], parts: int):
        words = kit.Words(texts, lower=True)
        n = len(texts)
        size = np.diff(words.first) + 1
        self.first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.word = np.empty(int(self.first[-1]), np.uint64)
        ends = self.first[1:] - 1
        inner = np.ones(len(self.word), bool)
        inner[ends] = False
        self.word[inner], self.word[ends] = words.hash, END
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        before[self.first[:-1][size > 0] if n else []] = START
        pair = kit.mix(before * U(0xD6E8FEB86659FD93) + self.word)
        self.keys = []
        for key, bits in ((self.word, 64), (pair, 40)):
            part = ((key >> U(44 if bits == 64 else 40)) % U(parts)).astype(np.int32)
            low = key if bits == 64 else key & U((1 << 40) - 1)
            self.keys.append((part, low))

    def grouped(self, kind: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(part, key) of the distinct keys in order, how many there are in each part, and each token's index."""
        part, low = self.keys[kind]
        order = np.lexsort((low, part))
        p, k = part[order], low[order]
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (k[1:] != k[:-1])]) if len(p) else np.zeros(0, bool)
        index = np.empty(len(p), np.int64)
        index[order] = np.cumsum(new) - 1
        return p[new], k[new], np.bincount(p[new], minlength=parts), index


def _requests(chunks: DataFrame, parts: int) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        chunk = t.column("_chunk")[0].as_py()
        c = Chunk(t.column("text").to_pylist(), parts)
        train = np.repeat(~np.array(t.column("held_out").to_pylist(), bool), np.diff(c.first))
        by: dict[int, list] = {}
        for kind, width in ((WORD, 8), (PAIR, 5)):
            _, key, sizes, index = c.grouped(kind, parts)
            count = np.bincount(index[train], minlength=len(key))
            at = np.concatenate([[0], np.cumsum(sizes)])
            for p in np.flatnonzero(sizes):
                k = key[at[p] : at[p + 1]]
                by.setdefault(int(p), [b"", b"", b"", b""])[2 * kind : 2 * kind + 2] = planes(np.diff(k, prepend=U(0)), width), planes(count[at[p] : at[p + 1]].astype(np.uint64), 4)
        cols = [pa.array(list(by), pa.int32()), pa.array([chunk] * len(by), pa.int32())] + [pa.array([v[i] for v in by.values()], pa.binary()) for i in range(4)]
        return pa.table(cols, names=["part", "chunk", "words", "word_counts", "pairs", "pair_counts"])

    return chunks.groupBy("_chunk").applyInArrow(run, "part int, chunk int, words binary, word_counts binary, pairs binary, pair_counts binary")


def _answers(requests: DataFrame, n: int) -> DataFrame:
    """Totals for each chunk and part in the order of its keys; as chunk -1 the sum and number of counted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for part, *row in zip(*[c.to_pylist() for c in b.columns]):
                held.setdefault(part, []).append(row)
        for part, got in held.items():
            totals: list[list[bytes]] = [[], []]
            n = v = 0
            for kind, width in ((WORD, 8), (PAIR, 5)):
                keys = [np.cumsum(unplanes(r[1 + 2 * kind], width), dtype=np.uint64) for r in got]
                every, at = np.unique(np.concatenate(keys), return_inverse=True)
                total = np.bincount(at, np.concatenate([unplanes(r[2 + 2 * kind], 4) for r in got]).astype(float), len(every)).astype(np.uint64)
                lo = 0
                for k in keys:
                    totals[kind].append(planes(total[at[lo : lo + len(k)]], 5))
                    lo += len(k)
                if kind == WORD:
                    n, v = int(total.sum()), int((total > 0).sum())
            chunks = [r[0] for r in got] + [-1]
            cols = [pa.array(chunks, pa.int32()), pa.array([part] * len(chunks), pa.int32()), *[pa.array(t + [b""], pa.binary()) for t in totals], pa.array([0] * len(got) + [n], pa.int64()), pa.array([0] * len(got) + [v], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["_chunk", "part", "words", "pairs", "n", "v"])

    return requests.repartition(n, "part").mapInArrow(run, "_chunk int, part int, words binary, pairs binary, n long, v long")


def _counted(chunks: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    """Each document with the training counts of its words and pairs, token by token."""

    def run(t: pa.Table, a: pa.Table) -> pa.Table:
        c = Chunk(t.column("text").to_pylist(), parts)
        per: list[np.ndarray] = []
        for kind in (WORD, PAIR):
            _, key, sizes, index = c.grouped(kind, parts)
            got = sorted(zip(a.column("part").to_pylist(), a.column(("words", "pairs")[kind]).to_pylist()))
            total = np.concatenate([unplanes(x, 5) for _, x in got]) if got else np.zeros(0, np.uint64)
            assert len(total) == len(key), "a chunk changed between two reads of the input"
            per.append(total[index])
        known, body = [], []
        for i in range(t.num_rows):
            w, p = per[0][c.first[i] : c.first[i + 1]], per[1][c.first[i] : c.first[i + 1]]
            known.append(int((w > 0).sum()))
            body.append(zlib.compress(planes(w, 5) + planes(p, 5), 1))
        return pa.table([t.column("doc_id"), t.column("held_out"), pa.array(np.diff(c.first), pa.int64()), pa.array(known, pa.int64()), pa.array(body, pa.binary())], names=["doc_id", "held_out", "n_tokens", "n_known", "_counts"])

    return chunks.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(run, RESULT)


def _unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(body)
    return unplanes(raw[: len(raw) // 2], 5).astype(np.int64), unplanes(raw[len(raw) // 2 :], 5).astype(np.int64)


def _before(word: np.ndarray, docs: int) -> np.ndarray:
    """Counts of the contexts: the word before, or the start, as often as there are training texts."""
    return np.concatenate([[docs], word[:-1]])


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, then by powers of two."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)


def _cells(counted: DataFrame, n: int, docs: int) -> DataFrame:
    """Deleted probabilities of all training tokens, summed in cells of a bucket and two rounded logarithms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, ps, qs = [], [], []
            for held, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held:
                    continue
                w, p = _unpacked(body)
                context = np.maximum(_before(w, docs) - 1, 0)
                high = np.where(context > 0, (p - 1) / np.maximum(context, 1), 0.0)
                low = (w - 1) / max(n - 1, 1)
                grid = lambda x: np.where(x > 0, np.clip(np.floor(-3 * np.log2(np.maximum(x, 1e-30))), 0, 120) + 1, 0).astype(np.int64)
                codes.append((bucket(context) * 128 + grid(high)) * 128 + grid(low))
                ps.append(high)
                qs.append(low)
            if codes:
                u, inv = np.unique(np.concatenate(codes), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.bincount(inv, minlength=len(u)).astype(np.int64)), pa.array(np.bincount(inv, np.concatenate(ps), len(u))), pa.array(np.bincount(inv, np.concatenate(qs), len(u)))], names=["cell", "n", "p", "q"])

    return counted.select("held_out", "_counts").mapInArrow(run, "cell long, n long, p double, q double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("q").alias("q"))


def weights(cells: list[tuple[int, int, float, float]], v: int, rounds: int = 100) -> np.ndarray:
    """Mixture weights (pair, word, uniform) for each bucket by expectation-maximisation; buckets without
    tokens take those of the bucket below."""
    out = np.tile([0.0, 0.8, 0.2], (BUCKETS, 1))
    a = np.array(sorted(cells), float).reshape(-1, 4)
    of = a[:, 0].astype(np.int64) // (128 * 128)
    for k in range(BUCKETS):
        r = a[of == k]
        if not len(r):
            if k:
                out[k] = out[k - 1] if k > 1 else [0.4, 0.4, 0.2]
            continue
        m = r[:, 1]
        probs = np.stack([r[:, 2] / m, r[:, 3] / m, np.full(len(r), 1 / (v + 1))], 1)
        lam = np.array([0.4, 0.4, 0.2]) if k else np.array([0.0, 0.8, 0.2])
        for _ in range(rounds):
            post = probs * lam
            post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
            lam = (post * m[:, None]).sum(0) / m.sum()
            lam[-1] = max(lam[-1], 1e-6)
            lam /= lam.sum()
        out[k] = lam
    return out


def score(docs: DataFrame) -> DataFrame:
    """Each document's token counts, base score and log10 probability."""
    spark = docs.sparkSession
    n = kit.parts(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (kit.crc_mod("doc_id", 5) == 1).alias("held_out"))
    chunks = rows.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(4 * n)).cast("int")).repartition(n, "_chunk")
    answers = kit.cut(_answers(_requests(chunks, n), n))
    kit.release(spark)
    total = answers.where("_chunk = -1").agg(F.sum("n"), F.sum("v")).collect()[0]
    tokens, vocabulary = total[0] or 0, total[1] or 0
    counted = kit.cut(_counted(chunks, answers.where("_chunk >= 0").select("_chunk", "part", "words", "pairs"), n))
    kit.drop(answers)
    kit.release(spark)
    train_docs = counted.where("not held_out").count()
    lam = weights([tuple(r) for r in _cells(counted, tokens, train_docs).collect()], vocabulary)
    base_of = tokens + 0.5 * (vocabulary + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, full = [], []
            for body in b.column(4).to_pylist():
                w, p = _unpacked(body)
                base.append(float(np.log10((w + 0.5) / base_of).sum()))
                context = _before(w, train_docs)
                k = lam[bucket(context)]
                x = k[:, 0] * np.where(context > 0, p / np.maximum(context, 1), 0.0) + k[:, 1] * (w / max(tokens, 1)) + k[:, 2] / (vocabulary + 1)
                full.append(float(np.log10(x / (1.0 if tokens else k.sum(1))).sum()) if tokens else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([tokens] * b.num_rows, pa.int64()), pa.array(base, pa.float64()), pa.array(full, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return counted.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(kit.read(spark, sf_dir, "documents"))
