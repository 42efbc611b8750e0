"""Substring dedup: every word covered by a window of words that also starts elsewhere is removed.

Super-k-mer partitioning. A window's minimiser is the smallest hash of its runs of ``M`` words; consecutive
windows with the same minimiser form a super-k-mer, whose words travel as one packed string to the bucket
of that minimiser, where sorting counts the windows exactly (equal hashes are compared as strings).

Before anything travels, texts with the same words become one class with a weight (equal windows of copies
need no counting), and minimisers are counted: only super-k-mers whose minimiser occurs twice can hold a
repeated window, so only their texts are shuffled. Minimisers with more than ``hot`` occurrences are split:
their windows go one by one to the bucket of their own hash, after equal windows of one task are merged, so
that no task gathers a hot group. The rows of the result are the same whatever ``hot`` is.

A null text has no words; texts with fewer words than a window keep all; repeated rows and ids count as
occurrences of their own; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kit

U = np.uint64
M = 8
NOTHING = hashlib.sha256(b"").hexdigest()


def minimisers(words: kit.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window + 1, minimiser, places) of each super-k-mer; windows are numbered by their first word.

    ``places`` is how often the minimiser occurs in the super-k-mer: only with two can it repeat a window itself."""
    none = np.zeros(0, np.int64)
    h, n = words.hash, len(words.hash)
    if n < window:
        return none, none, np.zeros(0, np.uint64), none
    m = min(M, window)
    g = h[: n - m + 1]
    for i in range(1, m):
        g = kit.mix(g * U(0xD6E8FEB86659FD93) + h[i : n - m + 1 + i])
    span, width = window - m + 1, 1
    low = g
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if rest := span - width:
        low = np.minimum(low[:-rest], low[rest:])
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    ok = doc[: n - window + 1] == doc[window - 1 :]
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (low[1:] != low[:-1]) | (doc[1 : len(ok)] != doc[: len(ok) - 1])
    start = np.flatnonzero(new)
    stop = np.flatnonzero(ok & np.concatenate([~ok[1:] | new[1:], [True]])) + 1
    size = stop - start + span - 1
    ends = np.cumsum(size)
    at = np.arange(int(size.sum())) + np.repeat(start - ends + size, size)
    same = g[at] == np.repeat(low[start], size)
    places = np.add.reduceat(same, ends - size, dtype=np.int64) if len(start) else none
    return start, stop, low[start], places


def sequence_hashes(words: kit.Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's word sequence."""
    out, n = [], np.diff(words.first).astype(np.uint64)
    for salt in (U(0x243F6A8885A308D3), U(0x13198A2E03707344)):
        x = kit.mix(words.hash ^ salt)
        pw, inv = kit._powers(len(x) + 1)
        acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * pw[: len(x)], dtype=np.uint64)])
        out.append(kit.mix((acc[words.first[1:]] - acc[words.first[:-1]]) * inv[words.first[:-1]] + n).view(np.int64))
    return out[0], out[1]


def window_hashes(words: kit.Words, window: int) -> np.ndarray:
    """A hash of the window from every word (windows across texts are meaningless)."""
    h, n = words.hash, len(words.hash)
    pw, inv = kit._powers(n + 1)
    acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kit.mix(h) * pw[:n], dtype=np.uint64)])
    return kit.mix((acc[window:] - acc[:-window]) * inv[: max(n - window + 1, 0)]) if n >= window else np.zeros(0, np.uint64)


def _scan(docs: DataFrame, window: int) -> DataFrame:
    """A row for each document: its class, its words, the digest of all of them, its minimisers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, no_id, keys in kit.slices(batches):
            words = kit.Words(texts, lower=False)
            h1, h2 = sequence_hashes(words)
            start, _, mini, places = minimisers(words, window)
            twice = np.minimum(places, 2)
            at = np.concatenate([[0], np.cumsum(twice)])[np.searchsorted(start, words.first)]
            mini = np.repeat(mini.view(np.int64), twice)
            sha = [hashlib.sha256(b" ".join(t.encode("utf-8", "surrogatepass").split())).hexdigest() if t else NOTHING for t in texts]
            minis = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(mini, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(no_id, pa.int64()), pa.array(keys, pa.int64()), pa.array(h1), pa.array(h2), pa.array(np.diff(words.first)), pa.array(sha), minis], names=["doc_id", "_id", "_k", "_h1", "_h2", "n_words", "_sha", "_minis"])

    return docs.mapInArrow(run, "doc_id long, _id long, _k long, _h1 long, _h2 long, n_words long, _sha string, _minis array<long>")


#: Bytes of hot windows that a task remembers; beyond them it starts anew, which only merges less.
REMEMBER = 48_000_000


def _runs(places: list[int]) -> list[tuple[int, int]]:
    """Ascending window numbers as ranges (first, last + 1)."""
    x = np.array(places, np.int64)
    cut = np.flatnonzero(np.diff(x) > 1)
    return list(zip(x[np.concatenate([[0], cut + 1])].tolist(), (x[np.append(cut, len(x) - 1)] + 1).tolist()))


def _send(rows: DataFrame, window: int) -> DataFrame:
    """Packed super-k-mers of the minimisers that occur twice; single windows of hot ones.

    A task sends a hot window at most twice: once two occurrences are sent (or one stands for two), all that follow are
    known to repeat. Known windows travel as merged ranges, dealt by their text, and are counted nowhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}  # -1: settled; -2: sent once, in an earlier slice; else where this slice sends it
        held, sent = 0, set()
        for h1, texts, h2, weight, wanted, hots in kit.slices(batches):
            words = kit.Words(texts, lower=False)
            start, stop, mini, _ = minimisers(words, window)
            owner = np.searchsorted(words.first, start, "right") - 1
            mini = mini.view(np.int64)
            whash = window_hashes(words, window).view(np.int64)
            out: list[list] = [[] for _ in range(7)]
            fresh: list[bytes] = []
            bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
            for d in range(len(texts)):
                if weight[d] > 1:  # repeated rows: one of them stands for its class
                    if (h1[d], h2[d]) in sent:
                        continue
                    if len(sent) > 500_000:
                        sent.clear()
                    sent.add((h1[d], h2[d]))
                want, hot = set(wanted[d]), set(hots[d] or ())
                base, known = int(words.first[d]), []
                for i in range(bounds[d], bounds[d + 1]):
                    k = int(mini[i])
                    if k not in want:
                        continue
                    lo, hi = int(start[i]), int(stop[i])
                    if k not in hot:
                        row = (k, words.text_of(lo, hi + window - 1), h1[d], h2[d], lo - base, weight[d], None)
                        for c, v in zip(out, row):
                            c.append(v)
                        continue
                    for w in range(lo, hi):
                        text = words.text_of(w, w + window)
                        at = seen.get(text)
                        count = weight[d]
                        if at == -1:
                            known.append(w - base)
                            continue
                        if at is None:
                            if held > REMEMBER:
                                seen, held = {}, 0
                            held += len(text) + 100
                            seen[text] = len(out[0]) if count < 2 else -1
                            fresh.append(text)
                        else:
                            seen[text] = -1
                            if at >= 0:
                                out[5][at] = 2
                                known.append(w - base)
                                continue
                            count = 2
                        for c, v in zip(out, (int(whash[w]), text, h1[d], h2[d], w - base, count, None)):
                            c.append(v)
                if known and weight[d] == 1:
                    for lo, hi in _runs(known):
                        for c, v in zip(out, (h1[d], None, h1[d], h2[d], lo, 2, hi)):
                            c.append(v)
            for text in fresh:
                if seen.get(text, -1) >= 0:
                    seen[text] = -2
            types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["b", "packed", "_h1", "_h2", "at", "w", "known"])

    return rows.select("_h1", "text", "_h2", "_w", "_want", "_hot").mapInArrow(run, "b long, packed binary, _h1 long, _h2 long, at long, w int, known long")


def _count(sent: DataFrame, window: int) -> DataFrame:
    """Ranges of repeated windows: class, first window, last window + 1."""

    def flush(keys: np.ndarray, packed: list[bytes], h1, h2, at, weight) -> pa.RecordBatch:
        words = kit.Words([p.decode("utf-8", "surrogatepass") for p in packed], lower=False)
        first = words.first
        sizes = np.diff(first) - window + 1
        owner = np.repeat(np.arange(len(packed)), sizes)
        local = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        win = first[owner] + local
        h = window_hashes(words, window)[win]
        key = kit.mix(h + keys[owner].view(np.uint64) * U(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        key, own, win = key[order], owner[order], win[order]
        run = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        stop = np.append(run[1:], len(key))
        w = weight[own]
        total = np.add.reduceat(w, run) if len(run) else w
        repeated = np.zeros(len(key), bool)
        d, s, e = words.data, words.start, words.end
        for a, b in zip(run[total > 1].tolist(), stop[total > 1].tolist()):
            if b - a == 1:
                repeated[a] = True
                continue
            texts = [d[s[i] : e[i + window - 1]] for i in win[a:b]]
            if texts.count(texts[0]) == len(texts):
                repeated[a:b] = True
            else:  # unequal windows with one hash
                count: dict[bytes, int] = {}
                for t, x in zip(texts, w[a:b]):
                    count[t] = count.get(t, 0) + int(x)
                repeated[a:b] = [count[t] > 1 for t in texts]
        flag = np.zeros(len(key), bool)
        flag[order] = repeated
        new = flag & np.concatenate([[True], ~flag[:-1] | (owner[1:] != owner[:-1])]) if len(flag) else flag
        last = flag & np.concatenate([~flag[1:] | (owner[1:] != owner[:-1]), [True]]) if len(flag) else flag
        lo, hi = np.flatnonzero(new), np.flatnonzero(last)
        o = owner[lo]
        return pa.RecordBatch.from_arrays([pa.array(h1[o]), pa.array(h2[o]), pa.array(at[o] + local[lo]), pa.array(at[o] + local[hi] + 1)], names=["_h1", "_h2", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(6)]
        size = 0
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            if k := [i for i, x in enumerate(cols[6]) if x is not None]:
                yield pa.RecordBatch.from_arrays([pa.array([cols[j][i] for i in k], pa.int64()) for j in (2, 3, 4, 6)], names=["_h1", "_h2", "lo", "hi"])
            for i in range(b.num_rows):
                if cols[6][i] is not None:
                    continue
                if size > 3_000_000 and cols[0][i] != held[0][-1]:
                    yield flush(*_arrays(held))
                    held, size = [[] for _ in range(6)], 0
                for c, v in zip(held, cols):
                    c.append(v[i])
                size += len(cols[1][i])
        if held[0]:
            yield flush(*_arrays(held))

    def _arrays(held: list[list]) -> tuple:
        return (np.array(held[0], np.int64), held[1], *[np.array(c, np.int64) for c in held[2:6]])

    n = kit.parts(sent.sparkSession)
    return sent.repartition(n, "b").sortWithinPartitions("b").mapInArrow(run, "_h1 long, _h2 long, lo long, hi long")


def repeats(docs: DataFrame, window: int = 35, hot: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(documents with their class, classes with repeated windows and their text)."""
    docs = kit.keyed(docs)
    seen = kit.cut(_scan(docs, window))
    row = F.min(F.struct("_id", "_k")).alias("_row")
    classes = seen.groupBy("_h1", "_h2").agg(F.count("*").alias("_w"))
    of_class = seen.groupBy("_h1", "_h2", "_minis").agg(F.count("*").alias("_w"), row).where(F.size("_minis") > 0)
    each = of_class.select("_h1", "_h2", "_row", F.least("_w", F.lit(2)).cast("int").alias("_w"), F.explode("_minis").alias("_m"))
    shared = each.groupBy("_m").agg(F.sum("_w").alias("_c"), F.min("_w").alias("_least")).where("_c >= 2 and _least = 1")
    want = each.join(shared, "_m").groupBy("_h1", "_h2", "_row", "_w").agg(F.collect_set("_m").alias("_want"), F.collect_set(F.when(F.col("_c") > hot, F.col("_m"))).alias("_hot"))
    want = want.select("_row._id", "_row._k", "_h1", "_h2", "_w", "_want", "_hot")
    texts = kit.cut(kit.beside(docs.select("_id", "_k", "text"), want, ["_id", "_k"]).drop("_id", "_k"))
    ranges = _count(_send(texts, window), window).groupBy("_h1", "_h2").agg(F.collect_list(F.struct("lo", "hi")).alias("_ranges"))
    cut_out = kit.beside(texts.where("_w = 1").select("_h1", "_h2", "text"), ranges, ["_h1", "_h2"])
    return seen.drop("_minis").join(classes.select("_h1", "_h2", "_w"), ["_h1", "_h2"]), cut_out


def covered(n: int, ranges: list, window: int) -> np.ndarray:
    """Which of n words a repeated window covers."""
    step = np.zeros(n + 1, np.int64)
    for r in ranges:
        step[r["lo"]] += 1
        step[r["hi"] + window - 1] -= 1
    return np.cumsum(step[:n]) > 0


def _trim(cut_out: DataFrame, window: int, with_text: bool) -> DataFrame:
    """For each class the number of words removed, the digest of the words kept, and the text left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h1, texts, h2, ranges in kit.slices(batches):
            out: list[list] = [[] for _ in range(3)]
            for t, r in zip(texts, ranges):
                words = kit.Words([t], lower=False, hashes=False)
                gone = covered(len(words.start), r, window)
                keep = np.flatnonzero(~gone)
                s, e, d = words.start, words.end, words.data
                out[0].append(int(gone.sum()))
                out[1].append(hashlib.sha256(b" ".join([d[s[i] : e[i]] for i in keep])).hexdigest())
                if with_text:  # runs of kept words with the white space between them as it was
                    cuts = np.flatnonzero(np.diff(keep) > 1)
                    a, b = keep[np.concatenate([[0], cuts + 1])] if len(keep) else keep, keep[np.concatenate([cuts, [-1]]).astype(int)] if len(keep) else keep
                    out[2].append("\n".join(d[s[i] : e[j]].decode("utf-8", "surrogatepass") for i, j in zip(a, b)))
                else:
                    out[2].append(None)
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=["_h1", "_h2", "_gone", "_kept", "_left"])

    return cut_out.select("_h1", "text", "_h2", "_ranges").mapInArrow(run, "_h1 long, _h2 long, _gone long, _kept string, _left string")


def dedup(docs: DataFrame, window: int = 35) -> DataFrame:
    """For each document its words, how many go, and the digest of those that stay (joined by one space)."""
    seen, cut_out = repeats(docs, window)
    got = seen.join(_trim(cut_out, window, False), ["_h1", "_h2"], "left")
    copies = (F.col("_w") > 1) & (F.col("n_words") >= window)
    return got.select("doc_id", "n_words", F.when(copies, F.col("n_words")).otherwise(F.coalesce("_gone", F.lit(0).cast("long"))).alias("n_removed"), F.when(copies, NOTHING).otherwise(F.coalesce("_kept", "_sha")).alias("kept_sha256"))


def trimmed(docs: DataFrame, window: int = 35) -> DataFrame:
    """All columns of ``docs`` with the repeated words gone from ``text``; texts without any stay as they are."""
    seen, cut_out = repeats(docs, window)
    got = seen.join(_trim(cut_out, window, True), ["_h1", "_h2"], "left")
    copies = (F.col("_w") > 1) & (F.col("n_words") >= window)
    new = got.where(copies | F.col("_gone").isNotNull()).select("_id", "_k", F.when(copies, "").otherwise(F.col("_left")).alias("_new")).dropDuplicates(["_id", "_k"])
    cols, names, out = docs.columns, (kit.fresh("_id", docs), kit.fresh("_k", docs)), kit.fresh("_new", docs)
    new = new.select(F.col("_id").alias(names[0]), F.col("_k").alias(names[1]), F.col("_new").alias(out))
    return kit.beside(docs.select("*", *kit.row_key(docs, names)), new, [*names], "left").withColumn("text", F.coalesce(out, "text")).select(*cols)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(kit.read(spark, sf_dir, "documents"))
