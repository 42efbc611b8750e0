"""Language ID with a linear-chain conditional random field over the words of a text.

A word's features are its beginnings and endings, its letter n-grams and itself as a lexicon entry, all
hashed over UTF-8 bytes into one weight table; transitions between the languages of neighbouring words are
learned. Forward-backward gives every word a distribution over languages, so code-switched text is labelled
word by word; a document's language is the one with the largest mean over its words with letters.

The model is fitted on about ``per_lang`` documents of each language outside the held-out third (chosen by
a hash of doc_id), from training chains that switch language between segments. A segment begins at any word
of those documents, in proportion to their words, but a document counts as at most ``most`` words: no text is
cut and no long one takes the training over. Every text is labelled whole.
``und`` with score 0 stands for null texts and texts without letters, and for all where nothing was learned.
Repeated ids and rows are kept; columns other than doc_id, text and (for learning) lang are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kit

U = np.uint64
BITS = 17
HEAD, TAIL, CHUNK = 12, 4, 32
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _index(kind: int, value: np.ndarray) -> np.ndarray:
    h = (value * np.uint32(2654435761) + np.uint32(kind * 40503 + 12345)) * np.uint32(2246822519)
    return np.maximum(h >> np.uint32(32 - BITS), 1).astype(np.int32)


def rest_features(words: kit.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, indexes): the n-grams of each word that ``word_features`` has no slot for, those behind its first bytes."""
    low = np.frombuffer(words.data, np.uint8).astype(np.uint32)
    low[(low >= 65) & (low <= 90)] += 32
    more = np.maximum(words.end[at] - words.start[at] - HEAD, 0)
    bounds = np.concatenate([[0], np.cumsum(more)])
    b = np.repeat(words.start[at] + HEAD - 1 - bounds[:-1], more) + np.arange(bounds[-1])
    with np.errstate(over="ignore"):
        pair = low[b] << np.uint32(8) | low[b + 1]
        both = np.column_stack([_index(1, pair), _index(2, low[b - 1] << np.uint32(16) | pair)])
    return 2 * bounds, both.ravel()


def word_features(words: kit.Words, at: np.ndarray) -> np.ndarray:
    """Indexes into the weight table, a column for each feature slot; index 0 stands for none."""
    buf = np.frombuffer(words.data, np.uint8)
    start, end = words.start[at], words.end[at]
    size = end - start
    pad = np.concatenate([buf, np.zeros(HEAD, np.uint8)])
    head = pad[start[:, None] + np.arange(HEAD)].astype(np.uint32)
    upper = (head >= 65) & (head <= 90)
    head[upper] += 32
    head[np.arange(HEAD) >= size[:, None]] = 0
    tail = buf[np.maximum(end[:, None] - 1 - np.arange(TAIL), start[:, None])].astype(np.uint32)
    upper = (tail >= 65) & (tail <= 90)
    tail[upper] += 32
    cols = []

    def slot(kind: int, value: np.ndarray, ok: np.ndarray) -> None:
        cols.append(np.where(ok, _index(kind, value), 0).astype(np.int32))

    with np.errstate(over="ignore"):
        for i in range(HEAD - 1):
            slot(1, head[:, i] << np.uint32(8) | head[:, i + 1], size > i + 1)
        for i in range(HEAD - 2):
            slot(2, head[:, i] << np.uint32(16) | head[:, i + 1] << np.uint32(8) | head[:, i + 2], size > i + 2)
        v = np.zeros(len(at), np.uint32)
        for i in range(4):
            v = v << np.uint32(8) | head[:, i]
            slot(3 + i, v, size > i)
        v = np.zeros(len(at), np.uint32)
        for i in range(TAIL):
            v = v << np.uint32(8) | tail[:, i]
            slot(7 + i, v, size > i)
        slot(11, (words.hash[at] >> U(32)).astype(np.uint32), size > 0)
    return np.stack(cols, 1)


class Begins:
    """Draws places in the words of some documents; a document weighs as many words as it has, ``most`` at most."""

    def __init__(self, doc: np.ndarray, most: int):
        edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
        self.first, self.size = edge[:-1], np.diff(edge)
        self.weight = np.cumsum(np.minimum(self.size, most))

    def __call__(self, rng: np.random.Generator) -> int:
        d = int(np.searchsorted(self.weight, rng.integers(self.weight[-1]), "right"))
        return int(self.first[d] + rng.integers(self.size[d]))


class Chain:
    """Weights of a field over ``langs``: ``table`` for features, ``trans`` between neighbours."""

    def __init__(self, langs: list[str]):
        n = len(langs)
        self.langs, self.table, self.trans = langs, np.zeros((1 << BITS, n), np.float32), np.eye(n, dtype=np.float32)

    def emit(self, feats: np.ndarray, rest: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        out = np.zeros((len(feats), len(self.langs)), np.float32)
        for c in feats.T:
            out += self.table[c]
        bounds, index = rest
        of = np.repeat(np.arange(len(feats)), np.diff(bounds))
        for k in range(out.shape[1] if len(of) else 0):
            out[:, k] += np.bincount(of, self.table[index, k], len(feats)).astype(np.float32)
        return out

    def fit(self, feats: np.ndarray, rest: tuple[np.ndarray, np.ndarray], row: np.ndarray, label: np.ndarray, doc: np.ndarray, most: int, seed: int = 5, steps: int = 260, chains: int = 48, length: int = 64) -> None:
        """Adagrad on the conditional likelihood of chains spliced from runs of words of one language each.

        Each word has its row in ``feats``, its language and its document; a document's words are neighbours."""
        rng, n = np.random.default_rng(seed), len(self.langs)
        g2, t2 = np.full((1 << BITS, n), 1e-4, np.float32), np.full((n, n), 1e-2, np.float32)
        starts = [np.flatnonzero(label == k) for k in range(n)]
        begins = [Begins(doc[s], most) for s in starts]
        for _ in range(steps):
            rows = np.empty((chains, length), np.int64)
            for c in range(chains):
                at = 0
                while at < length:
                    k = rng.integers(n)
                    s, lo = starts[k], begins[k](rng)
                    m = min(int(rng.integers(6, 40)), length - at)
                    rows[c, at : at + m] = s[(lo + np.arange(m)) % len(s)]
                    at += m
            y = label[rows]
            w = row[rows.ravel()]
            f, size = feats[w], np.diff(rest[0])[w]
            bounds = np.concatenate([[0], np.cumsum(size)])
            more = rest[1][np.repeat(rest[0][w] - bounds[:-1], size) + np.arange(bounds[-1])]
            e = self.emit(f, (bounds, more)).reshape(chains, length, n)
            p, pair = self._marginals(e)
            g = -p
            g[np.arange(chains)[:, None], np.arange(length)[None], y] += 1
            g2d = g.reshape(-1, n)
            idx, gr = np.concatenate([f.ravel(), more]), np.concatenate([np.repeat(g2d, f.shape[1], 0), np.repeat(g2d, size, 0)])
            u, inv = np.unique(idx, return_inverse=True)
            acc = np.stack([np.bincount(inv, gr[:, k], len(u)) for k in range(n)], 1).astype(np.float32) / chains
            acc[u == 0] = 0
            g2[u] += acc**2
            self.table[u] += 0.1 * acc / np.sqrt(g2[u])
            gt = -pair
            np.add.at(gt, (y[:, :-1], y[:, 1:]), 1)
            gt = (gt / chains).astype(np.float32)
            t2 += gt**2
            self.trans += 0.1 * gt / np.sqrt(t2)

    def _marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, t, n = e.shape
        x, m = np.exp(e - e.max(2, keepdims=True)), np.exp(self.trans)
        a, b = np.empty_like(x), np.ones_like(x)
        v = np.full((c, n), 1 / n, np.float32)
        for i in range(t):
            v = (v @ m) * x[:, i]
            v /= v.sum(1, keepdims=True)
            a[:, i] = v
        for i in range(t - 2, -1, -1):
            w = (b[:, i + 1] * x[:, i + 1]) @ m.T
            b[:, i] = w / w.sum(1, keepdims=True)
        p = a * b
        p /= p.sum(2, keepdims=True)
        pair = np.einsum("cti,ij,ctj->ctij", a[:, :-1], m, b[:, 1:] * x[:, 1:])
        pair /= pair.sum((2, 3), keepdims=True)
        return p, pair.sum((0, 1))

    def marginals(self, emit: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Forward-backward over whole chains of any length: texts are cut into chunks whose transfer matrices
        carry the exact messages across chunk borders. ``first`` are the chains' bounds."""
        n = len(self.langs)
        out = np.zeros((len(emit), n), np.float32)
        sizes = np.diff(first)
        chunks = -(-sizes // CHUNK)
        total = int(chunks.sum())
        if not total:
            return out
        base = np.concatenate([[0], np.cumsum(chunks)])
        owner = np.repeat(np.arange(len(sizes)), chunks)
        place = np.arange(total) - base[owner]
        lo = first[owner] + place * CHUNK
        width = np.minimum(CHUNK, first[owner + 1] - lo)
        idx = lo[:, None] + np.arange(CHUNK)
        ok = np.arange(CHUNK) < width[:, None]
        x = np.exp(emit - emit.max(1, keepdims=True))[np.minimum(idx, len(emit) - 1)]
        m = np.exp(self.trans)
        prod = np.broadcast_to(np.eye(n, dtype=np.float32), (total, n, n)).copy()
        for i in range(CHUNK):
            k = np.flatnonzero(ok[:, i])
            q = (prod[k].reshape(-1, n) @ m).reshape(-1, n, n) * x[k, i, None, :]
            prod[k] = q / q.sum((1, 2), keepdims=True)
        fore, back = np.empty((total, n), np.float32), np.empty((total, n), np.float32)
        v, w = np.full((len(sizes), n), 1 / n, np.float32), np.ones((len(sizes), n), np.float32)
        for j in range(int(chunks.max())):
            d = np.flatnonzero(chunks > j)
            c = base[d] + j
            fore[c] = v[d]
            q = np.einsum("ci,cij->cj", v[d], prod[c])
            v[d] = q / q.sum(1, keepdims=True)
            c = base[d + 1] - 1 - j
            back[c] = w[d]
            q = np.einsum("cij,cj->ci", prod[c], w[d])
            w[d] = q / q.sum(1, keepdims=True)
        a = np.empty((total, CHUNK, n), np.float32)
        v = fore
        for i in range(CHUNK):
            q = (v @ m) * x[:, i]
            v = np.where(ok[:, i, None], q / q.sum(1, keepdims=True), v)
            a[:, i] = v
        w = back
        for i in range(CHUNK - 1, -1, -1):
            p = a[:, i] * w
            p /= p.sum(1, keepdims=True)
            k = ok[:, i]
            out[idx[k, i]] = p[k]
            q = (w * x[:, i]) @ m.T
            w = np.where(k[:, None], q / q.sum(1, keepdims=True), w)
        return out


def has_letter(words: kit.Words) -> np.ndarray:
    """Whether each word has a letter of any script."""
    buf = np.frombuffer(words.data, np.uint8)
    count = np.concatenate([[0], np.cumsum(_ASCII_LETTER[buf])])
    out = count[words.end] > count[words.start]
    wide = np.concatenate([[0], np.cumsum(buf >= 128)])
    for i in np.flatnonzero(~out & (wide[words.end] > wide[words.start])):
        out[i] = any(c.isalpha() for c in words.data[words.start[i] : words.end[i]].decode("utf-8", "replace"))
    return out


def learn(docs: DataFrame, per_lang: int = 400, most: int = 1000) -> Chain | None:
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (kit.crc_mod("doc_id", 3) != 1))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    draw = F.xxhash64("doc_id", F.lit(21)) / F.lit(2.0**64) + 0.5
    cuts = F.coalesce(*[F.when(F.col("lang") == k, min(1.0, per_lang / n)) for k, n in counts.items()])
    rows = known.where(draw < cuts).select("lang", "text").collect()
    rows.sort(key=lambda r: (r["lang"], r["text"]))
    words = kit.Words([r["text"] for r in rows], lower=True)
    use = np.flatnonzero(has_letter(words))
    if not len(use):
        return None
    of = np.searchsorted(words.first, use, "right") - 1
    langs = sorted({rows[i]["lang"] for i in set(of.tolist())})
    code = {k: i for i, k in enumerate(langs)}
    label = np.array([code.get(r["lang"], -1) for r in rows])[of]
    _, at, row = np.unique(words.hash[use], return_index=True, return_inverse=True)
    model = Chain(langs)
    model.fit(word_features(words, use[at]), rest_features(words, use[at]), row, label, of, most)
    return model


def predict(docs: DataFrame, model: Chain | None) -> DataFrame:
    held = (kit.crc_mod("doc_id", 3) == 1).alias("held_out")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, held_out in kit.slices(batches):
            lang, score = ["und"] * len(ids), [0.0] * len(ids)
            words = kit.Words(texts, lower=True)
            if model and len(words.start):
                _, at, inv = np.unique(words.hash, return_index=True, return_inverse=True)
                p = model.marginals(model.emit(word_features(words, at), rest_features(words, at))[inv], words.first)
                real = has_letter(words)
                p[~real] = 0
                acc = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, 0, dtype=float)])
                mass = acc[words.first[1:]] - acc[words.first[:-1]]
                n = np.concatenate([[0], np.cumsum(real)])
                n = n[words.first[1:]] - n[words.first[:-1]]
                for i in np.flatnonzero(n):
                    k = int(mass[i].argmax())
                    lang[i], score[i] = model.langs[k], min(1.0, float(mass[i, k] / n[i]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held_out, pa.bool_()), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held).mapInArrow(run, RESULT)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kit.read(spark, sf_dir, "documents")
    return predict(docs, learn(docs.select("doc_id", "text", "lang")))
