"""SentencePiece encoding and decoding over a lattice of substrings.

Text becomes "words", a run of spaces with the characters behind it; no piece of the models served here reaches
from a character into a space, so words are encoded on their own. Two forms build the same lattice:

* ``encode_words``: relational. Substrings of bounded length are exploded, equi-joined to the piece table (broadcast:
  a model file has a fixed number of pieces), grouped by word and folded with Spark's ``aggregate``.
* ``encode``: for whole documents. The distinct words of an Arrow batch go through the same steps as arrays, and
  each text takes its words' ids. A relational join of every word occurrence with its ids would shuffle the corpus
  several times, which the README gives figures for.

The fold depends on the model: a unigram model takes the Viterbi path; a BPE model merges, in every step, the
adjacent pair whose piece scores best (leftmost on ties), since a best-sum path is not what such a model means.
Characters without a piece become byte pieces. Null and empty texts have no ids and decode to the empty text;
U+2581 stands for a space, as in the format; repeated rows are rows of their own; other columns are never read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kit

U = np.uint64
META = "▁"


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        v = s = 0
        while True:
            c = b[i]
            i += 1
            v |= (c & 127) << s
            s += 7
            if c < 128:
                return v

    while i < len(b):
        k = number()
        kind = k & 7
        if kind == 0:
            yield k >> 3, number()
        else:
            n = number() if kind == 2 else 4 if kind == 5 else 8
            yield k >> 3, b[i : i + n]
            i += n


class Model:
    """Pieces of a model file: text with spaces, id, score; byte pieces; whether it is a BPE model."""

    def __init__(self, name: str = "piece_bpe_32k.model"):
        import public_tokenizers

        with open(public_tokenizers.path(name), "rb") as f:
            raw = f.read()
        self.pieces: list[tuple[str, int, float]] = []
        self.byte_ids = np.zeros(256, np.int32)
        self.bytes_of: list[bytes] = []
        self.bpe, self.unknown = False, 0
        for field, v in _fields(raw):
            if field == 1:
                got = dict(_fields(v))
                text, score, kind, i = got[1].decode(), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, 1), len(self.bytes_of)
                if kind == 6:  # <0xNN>
                    self.byte_ids[int(text[3:5], 16)] = i
                    self.bytes_of.append(bytes([int(text[3:5], 16)]))
                else:
                    self.bytes_of.append(text.replace(META, " ").encode() if kind in (1, 4) else b"")
                if kind in (1, 4):
                    self.pieces.append((text.replace(META, " "), i, score))
            elif field == 2:
                self.bpe = dict(_fields(v)).get(3) == 2
        self.longest = max(len(p.encode()) for p, _, _ in self.pieces)
        flat = np.array([len(x) for x in self.bytes_of])
        self.offset = np.concatenate([[0], np.cumsum(flat)])
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        words = [p.encode() for p, _, _ in self.pieces]
        self.ids = np.array([i for _, i, _ in self.pieces], np.int32)
        score = np.array([s for _, _, s in self.pieces])
        self.score = score.astype(np.float32)
        rank = np.empty(len(score), np.int32)
        rank[np.argsort(score, kind="stable")] = np.arange(1, len(score) + 1)
        self.rank = rank
        self.hash = np.array([_hash_of(w) for w in words], np.uint64)
        # two direct tables: pieces that share a slot of the first one lie in the second
        self.slots = np.full((2, 1 << 20), -1, np.int32)
        for i, h in enumerate(self.hash.tolist()):
            a, b = h >> 44, (h >> 20) & 0xFFFFF
            if self.slots[0, a] < 0:
                self.slots[0, a] = i
            elif self.slots[1, b] < 0:
                self.slots[1, b] = i
            else:
                raise ValueError("piece table slots exhausted")

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, or -1."""
        a = self.slots[0][(h >> U(44)).astype(np.int64)]
        miss = (a < 0) | (self.hash[a] != h)
        k = np.flatnonzero(miss)
        hk = h[k]
        b = self.slots[1][((hk >> U(20)) & U(0xFFFFF)).astype(np.int64)]
        b[(b >= 0) & (self.hash[b] != hk)] = -1
        a[k] = b
        return a


def _hash_of(w: bytes) -> int:
    pw, inv = kit._powers(len(w) + 1)
    x = kit._BYTE[np.frombuffer(w, np.uint8)] * pw[: len(w)]
    return int(kit.mix(np.array([x.sum(dtype=np.uint64)], np.uint64))[0])


@lru_cache(2)
def model(name: str) -> Model:
    return Model(name)


class Words:
    """Words of texts (with the space that goes before a text), their hashes and the words of each text."""

    def __init__(self, texts: list[str | None]):
        raw = [(" " + t.replace(META, " ")).encode("utf-8", "replace") if t else b"" for t in texts]
        self.buf = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(r) for r in raw]) if raw else np.zeros(0, np.int64)
        space = self.buf == 32
        new = space.copy()
        new[1:] &= ~space[:-1]
        starts = np.concatenate([[0], ends[:-1]])[[len(r) > 0 for r in raw]].astype(np.int64) if raw else np.zeros(0, np.int64)
        new[starts] = True
        self.start = np.flatnonzero(new)
        self.end = np.append(self.start[1:], len(self.buf)).astype(np.int64)
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)
        pw, inv = kit._powers(len(self.buf) + 1)
        acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kit._BYTE[self.buf] * pw[: len(self.buf)], dtype=np.uint64)])
        self.hash = kit.mix((acc[self.end] - acc[self.start]) * inv[self.start] + (self.end - self.start).astype(np.uint64))


def _encode_distinct(m: Model, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each word, all ids in order)."""
    counts = np.zeros(len(start), np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lo = 0
    for hi in (4, 6, 8, 10, 12, 16, 24, 40, 80):
        at = np.flatnonzero((size > lo) & (size <= hi))
        step = max(64, 1_500_000 // (hi * min(hi, m.longest)))
        for k in range(0, len(at), step):
            out.append(_fold_block(m, buf, start, size, at[k : k + step], hi))
        lo = hi
    for i in np.flatnonzero(size > lo):
        out.append(_fold_long(m, buf[start[i] : start[i] + size[i]].tobytes(), i))
    word = np.concatenate([o[0] for o in out]) if out else np.zeros(0, np.int64)
    pos = np.concatenate([o[1] for o in out]) if out else np.zeros(0, np.int64)
    ids = np.concatenate([o[2] for o in out]) if out else np.zeros(0, np.int32)
    order = np.lexsort((pos, word))
    np.add.at(counts, word, 1)
    return counts, ids[order]


def _fold_block(m: Model, buf: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of words of at most ``width`` bytes: (word, byte position, id)."""
    n, w = size[at], len(at)
    idx = start[at][:, None] + np.arange(width)
    byte = buf[np.minimum(idx, len(buf) - 1)]
    byte[np.arange(width) >= n[:, None]] = 0
    pw, inv = kit._powers(width + 1)
    acc = np.zeros((w, width + 1), np.uint64)
    np.cumsum(kit._BYTE[byte] * pw[:width], axis=1, out=acc[:, 1:])
    top = min(width, m.longest)
    # the lattice: which piece, if any, each bounded substring is
    edge = np.full((w, width, top + 1), -1, np.int32)
    for k in range(1, top + 1):
        h = kit.mix(((acc[:, k:] - acc[:, : width - k + 1]) * inv[: width - k + 1]).ravel())
        got = m.find(h).reshape(w, width - k + 1)
        got[np.arange(width - k + 1) + k > n[:, None]] = -1
        edge[:, : width - k + 1, k] = got
    head = ((byte & 0xC0) != 0x80) & (np.arange(width) < n[:, None])
    head[:, 0] = n > 0
    follow = np.full((w, width + 1), width, np.int64)
    nxt = n.copy()
    for j in range(width - 1, -1, -1):
        follow[:, j] = nxt
        nxt = np.where(head[:, j], j, nxt)
    follow[:, width] = 10 * width
    stop = (_merge if m.bpe else _viterbi)(m, edge, head, follow, n, top)
    r, p = np.nonzero(head)
    e = stop[r, p]
    piece = edge[r, p, np.minimum(e - p, top)]
    piece[e - p > top] = -1
    ok = piece >= 0
    words, pos, ids = [r[ok]], [p[ok]], [m.ids[piece[ok]]]
    r, p, e = r[~ok], p[~ok], e[~ok]  # characters without a piece
    for j in range(4):
        k = p + j < e
        words.append(r[k]), pos.append(p[k] + j), ids.append(m.byte_ids[byte[r[k], p[k] + j]])
    return at[np.concatenate(words)], np.concatenate(pos), np.concatenate(ids)


def _merge(m: Model, edge: np.ndarray, head: np.ndarray, follow: np.ndarray, n: np.ndarray, top: int) -> np.ndarray:
    """Merges the best adjacent pair of every word until none is a piece; ``head`` loses what is merged."""
    width = head.shape[1]
    live = np.arange(len(head))
    rank = np.append(m.rank, 0)  # index -1: no piece
    cols = np.arange(width)
    while len(live):
        f = follow[live]
        second = np.minimum(f[:, :width], width)
        end = np.take_along_axis(f, second, 1)
        span = end - cols
        ok = head[live] & (second < n[live][:, None]) & (span <= top)
        got = np.where(ok, rank[edge[live[:, None], cols, np.where(ok, span, 0)]], 0)
        best = got.argmax(1)
        hit = got[np.arange(len(live)), best] > 0
        rows, b = live[hit], best[hit]
        j = follow[rows, b]
        head[rows, j] = False
        follow[rows, b] = follow[rows, j]
        live = rows
    return follow[:, :width]


def _viterbi(m: Model, edge: np.ndarray, head: np.ndarray, follow: np.ndarray, n: np.ndarray, top: int) -> np.ndarray:
    """The path of the largest score; ``head`` keeps its places only."""
    w, width = head.shape
    score = np.append(m.score, -np.inf).astype(np.float64)
    lost = float(m.score.min()) - 10
    best = np.full((w, width + 1), -np.inf)
    back = np.zeros((w, width + 1), np.int64)
    best[:, 0] = 0
    for e in range(1, width + 1):
        for k in range(min(e, top), 0, -1):
            s = e - k
            one = follow[:, s] == e
            v = best[:, s] + np.maximum(score[edge[:, s, k]], np.where(one, lost, -np.inf))
            v = np.where(head[:, s], v, -np.inf)
            up = v > best[:, e]
            best[up, e], back[up, e] = v[up], s
    stop = follow[:, :width].copy()
    at, keep = n.copy(), np.zeros_like(head)
    while (at > 0).any():
        k = np.flatnonzero(at > 0)
        s = back[k, at[k]]
        keep[k, s] = True
        stop[k, s] = at[k]
        at[k] = s
    head[:] = keep
    return stop


def _fold_long(m: Model, word: bytes, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same folds for one long word, with a heap (BPE) or a running window (unigram)."""
    import heapq

    if not hasattr(m, "by_text"):
        m.by_text = {p.encode(): (s, k) for p, k, s in m.pieces}
    chars = [c.encode() for c in word.decode()]
    n = len(chars)
    if m.bpe:
        sym, left, right = list(chars), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple] = []

        def offer(a: int) -> None:
            b = right[a]
            if b < n and (got := m.by_text.get(sym[a] + sym[b])):
                heapq.heappush(heap, (-got[0], a, sym[a], sym[b]))

        for a in range(n):
            offer(a)
        while heap:
            _, a, x, y = heapq.heappop(heap)
            if sym[a] != x or right[a] >= n or sym[right[a]] != y:
                continue
            b = right[a]
            sym[a], sym[b], right[a] = x + y, None, right[b]
            if right[b] < n:
                left[right[b]] = a
            offer(a)
            if left[a] >= 0:
                offer(left[a])
        parts = [s for s in sym if s is not None]
    else:
        lost = float(m.score.min()) - 10
        best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
        wide = max(len(p) for p, _, _ in m.pieces)
        for e in range(1, n + 1):
            for s in range(max(0, e - wide), e):
                got = m.by_text.get(b"".join(chars[s:e]))
                v = best[s] + (got[0] if got else lost if e - s == 1 else -np.inf)
                if v > best[e]:
                    best[e], back[e] = v, s
        parts, e = [], n
        while e:
            parts.append(b"".join(chars[back[e] : e]))
            e = back[e]
        parts.reverse()
    ids = [k for p in parts for k in ([m.by_text[p][1]] if p in m.by_text else m.byte_ids[list(p)].tolist())]
    return np.full(len(ids), i), np.arange(len(ids)), np.array(ids, np.int32)


def encode_texts(m: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bounds of each text's ids, ids)."""
    words = Words(texts)
    if not len(words.start):
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32)
    _, at, inv = np.unique(words.hash, return_index=True, return_inverse=True)
    counts, ids = _encode_distinct(m, words.buf, words.start[at], words.end[at] - words.start[at])
    base = np.concatenate([[0], np.cumsum(counts)])
    each = counts[inv]
    ends = np.concatenate([[0], np.cumsum(each)])
    flat = ids[np.repeat(base[inv] - ends[:-1], each) + np.arange(ends[-1])]
    return ends[words.first], flat


def decode_ids(m: Model, bounds: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """UTF-8 of each text: its pieces' bytes without the space that goes before a text."""
    size = m.offset[ids + 1] - m.offset[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    raw = m.flat[np.repeat(m.offset[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
    at = ends[bounds].tolist()
    return [raw[a + (raw[a : a + 1] == b" ") : b] for a, b in zip(at, at[1:])]


def encode(docs: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, ids) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in kit.slices(batches):
            bounds, flat = encode_texts(model(name), texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [x or [] for x in b.column(1).to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            flat = np.array([i for x in lists for i in x], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode("utf-8", "replace") for t in decode_ids(model(name), bounds, flat)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def piece_table(spark: SparkSession, name: str = "piece_bpe_32k.model") -> DataFrame:
    return spark.createDataFrame(model(name).pieces, "piece string, id int, score double")


def encode_words(words: DataFrame, name: str = "piece_bpe_32k.model", fold: str | None = None) -> DataFrame:
    """(word, pieces) for distinct ``word`` strings (spaces as they are), with DataFrame functions only.

    ``fold`` is "viterbi" or "bpe"; the model's own by default. Characters without a piece stand as themselves."""
    m = model(name)
    wide = max(len(p) for p, _, _ in m.pieces)
    fold = fold or ("bpe" if m.bpe else "viterbi")
    one = words.select("word").where(F.length("word") > 0).distinct()
    spans = one.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("word")))).withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(wide), F.length("word") - F.col("at") + 1))))
    edges = spans.withColumn("piece", F.substring("word", F.col("at"), F.col("n"))).join(F.broadcast(piece_table(words.sparkSession, name)), "piece", "left")
    edges = edges.where("id is not null or n = 1").groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct((F.col("at") * 1000 + F.col("n")).alias("k"), F.coalesce("score", F.lit(float(m.score.min()) - 10)).alias("v")))).alias("edges"))
    size = F.length("word")
    if fold == "viterbi":
        start = F.array(F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("from")))

        def step(state, e):
            into = F.transform(F.sequence(F.lit(1), F.least(F.lit(wide), e)), lambda n: F.struct((F.element_at(state, e - n + 1)["s"] + F.element_at("edges", (e - n + 1) * 1000 + n)).alias("s"), (e - n).alias("from")))
            return F.concat(state, F.array(F.array_max(F.filter(into, lambda x: x["s"].isNotNull()))))

        state = F.aggregate(F.sequence(F.lit(1), size), start, step)
        cuts = F.aggregate(F.sequence(F.lit(1), size), F.array(size), lambda acc, _: F.when(acc[0] > 0, F.concat(F.array(F.element_at("state", acc[0] + 1)["from"]), acc)).otherwise(acc))
        done = edges.withColumn("state", state).withColumn("cuts", cuts)
    else:

        def merge(acc, _):
            pairs = F.transform(F.sequence(F.lit(1), F.size(acc) - 2), lambda i: F.struct(F.element_at("edges", (F.element_at(acc, i) + 1) * 1000 + F.element_at(acc, i + 2) - F.element_at(acc, i)).alias("s"), (-i).alias("i")))
            best = F.array_max(F.filter(pairs, lambda x: x["s"].isNotNull()))
            return F.when((F.size(acc) < 3) | best.isNull(), acc).otherwise(F.concat(F.slice(acc, F.lit(1), -best["i"]), F.slice(acc, 2 - best["i"], F.size(acc))))

        cuts = F.aggregate(F.sequence(F.lit(1), size), F.sequence(F.lit(0), size), lambda acc, x: F.when(F.size(acc) < 3, acc).otherwise(merge(acc, x)))
        done = edges.withColumn("cuts", cuts)
    pieces = F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda i: F.substring(F.col("word"), F.element_at("cuts", i) + 1, F.element_at("cuts", i + 1) - F.element_at("cuts", i)))
    return done.select("word", pieces.alias("pieces"))


def op10_pieces(spark: SparkSession, sf_dir: str, name: str = "piece_bpe_32k.model") -> DataFrame:
    """Per document the number and crc32 of its ids (little-endian 32-bit), and the digest of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in kit.slices(batches):
            m = model(name)
            bounds, flat = encode_texts(m, texts)
            raw = flat.astype("<u4").tobytes()
            back = decode_ids(m, bounds, flat)
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            same = [x == (t or "").encode("utf-8", "replace") for x, t in zip(back, texts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    docs = kit.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
