"""Best-fit packing: token pieces put into fixed-length sequences, improved by swap-based local search.

Texts are tokenised where they lie; only piece records (a few integers) are shuffled. They are dealt
at random into groups of bounded size. Each group is packed best-fit decreasing, then underfull bins
exchange pieces (move, one for one, two for one, one for two), every exchange raising the sum of
squared fills, so that sparse bins empty. Full bins are final; the pieces of the others
meet again in fewer groups, until one group of bounded size is left.

Null texts count as empty (one end id), null ids are kept, repeated rows are packed as rows of their
own, an empty table gives an empty result; columns other than the id and the text are never read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kit

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
#: A run of white space (as the tokenizer's pattern counts it) with the run of other characters behind it.
#: No token crosses from a run of other characters into white space, so such chunks are encoded on their own.
_SP = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(rf"[{_SP}]*[^{_SP}]+|[{_SP}]+")
SPECIAL = "<|endoftext|>"
CACHE = 300_000


class Encoder:
    """Token ids as little-endian 32-bit bytes. Chunks seen before are looked up in a bounded cache."""

    def __init__(self, name: str = "byte_bpe_50k"):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.part = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.seen: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if SPECIAL in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        seen, chunks = self.seen, CHUNK.findall(text)
        try:
            return b"".join([seen[c] for c in chunks])
        except KeyError:
            pass
        if len(seen) > CACHE:
            seen.clear()
        out = []
        for c in chunks:
            b = seen.get(c)
            if b is None:
                b = np.array(self.part.encode_ordinary(c), "<u4").tobytes()
                if len(c) <= 64:
                    seen[c] = b
            out.append(b)
        return b"".join(out)


def pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Each document's ids and an end id, cut into pieces of ``capacity`` from its end: the first may be shorter."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for ids, texts in kit.slices(batches):
            encode = encode or Encoder()
            rows: list[list] = [[], [], [], [], []]
            for d, t in zip(ids, texts):
                data = (encode(t) if t else b"") + end
                n, lo, k = len(data) // 4, 0, 0
                hi = n % capacity or capacity
                while lo < n:
                    for col, v in zip(rows, (d, k, lo, hi - lo, zlib.crc32(data[4 * lo : 4 * hi]))):
                        col.append(v)
                    lo, hi, k = hi, hi + capacity, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: every piece goes into the fullest bin that it fits."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = {}
    rooms: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        at = bisect_left(rooms, n)
        if at < len(rooms):
            r = rooms[at]
            b = room[r].pop()
            if not room[r]:
                del room[r]
                rooms.pop(at)
            bins[b].append(i)
            r -= n
        else:
            b, r = len(bins), capacity - n
            bins.append([i])
        if r:
            if r not in room:
                room[r] = []
                insort(rooms, r)
            room[r].append(b)
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search over underfull bins; every exchange moves length from an emptier bin to a fuller one.

    The emptiest bin gives to the others, fullest first, for as long as exchanges are found; then the next
    emptiest. Each exchange raises the sum of squared fills, which is bounded, so the search ends: when no bin
    can give any more, or the bins are as few as the total length allows. Bins of equal lengths are alike: each
    pair of kinds is tried once."""
    bins = [list(b) for b in bins]
    fill = [sum(lengths[i] for i in b) for b in bins]
    count, least = len(bins), -(-sum(fill) // capacity)
    alike: dict[tuple, set[int]] = {}
    born: list[tuple[int, tuple]] = []  # room and kind of underfull bins, in the order in which the first and second of a kind came up
    seen: dict[tuple, int] = {}  # how many of those a kind has failed against
    todo: list[tuple[int, tuple]] = []

    def enter(k: int) -> None:
        if bins[k] and fill[k] < capacity:
            kind = tuple(sorted(lengths[i] for i in bins[k]))
            at = alike.setdefault(kind, set())
            at.add(k)
            if len(at) <= 2:
                born.append((capacity - fill[k], kind))
            heappush(todo, (fill[k], kind))

    def leave(k: int) -> None:
        alike[tuple(sorted(lengths[i] for i in bins[k]))].discard(k)

    for k in range(len(bins)):
        enter(k)
    waiting: set[tuple[int, tuple]] = set()  # what failed, and is tried again with the kinds that came up since
    while count > least:
        if not todo:
            todo = [x for x in waiting if alike[x[1]] and seen[x[1]] < len(born)]
            if not todo:
                break
            waiting.difference_update(todo)
            heapify(todo)
        size, kind = heappop(todo)
        if not alike[kind] or seen.get(kind, 0) == len(born):
            if alike[kind]:
                waiting.add((size, kind))
            continue
        src, at, first = min(alike[kind]), (-1, ()), kind
        while bins[src]:
            now = tuple(sorted(lengths[i] for i in bins[src]))
            fresh = sorted({x for x in born[seen.get(now, 0) :] if at < x and x[0] <= capacity - fill[src] and len(alike[x[1]]) > (x[1] == now)})
            hit = next((x for x in fresh if _gain(now, x[1], x[0])[0]), None)
            if hit is None:
                break
            (room, other), at = hit, hit
            give, take = _gain(now, other, room)
            dst = min(alike[other] - {src})
            leave(src)
            leave(dst)
            gone, come = _pick(bins[src], give, lengths), _pick(bins[dst], take, lengths)
            bins[src] = [i for i in bins[src] if i not in gone] + come
            bins[dst] = [i for i in bins[dst] if i not in come] + gone
            fill[src] -= sum(give) - sum(take)
            fill[dst] += sum(give) - sum(take)
            enter(src)
            enter(dst)
            count -= not bins[src]
        if at == (-1, ()):
            seen[first] = len(born)
            waiting.add((size, first))
        elif alike[first]:
            heappush(todo, (size, first))
    return [b for b in bins if b]


def _pick(b: list[int], want: tuple[int, ...], lengths: list[int]) -> list[int]:
    out: list[int] = []
    for n in want:
        out.append(next(i for i in b if lengths[i] == n and i not in out))
    return out


@lru_cache(8192)
def _sums(kind: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different lengths of a bin, the different sums of two of its pieces, and the smaller piece of each."""
    have = np.array(kind, np.int64)
    one, n = np.unique(have, return_counts=True)
    x, y = np.triu_indices(len(one))
    ok = (x != y) | (n[x] > 1)
    two, at = np.unique(one[x[ok]] + one[y[ok]], return_index=True)
    return one, two, one[x[ok]][at]


def _gain(src: tuple[int, ...], dst: tuple[int, ...], room: int) -> tuple[tuple, tuple]:
    """The exchange that fills the target best, in lengths: (what the source gives, what it takes)."""
    one, two, small = _sums(src)
    one_b, two_b, small_b = _sums(dst)
    best, found = 0, ((), ())
    for give, take, part, part_b in ((one, _NONE, None, None), (one, one_b, None, None), (two, one_b, small, None), (one, two_b, None, small_b)):
        if not len(give) or not len(take):
            continue
        at = give.searchsorted(take + room, "right") - 1
        gain = np.where(at >= 0, give[at] - take, 0)
        k = int(gain.argmax())
        if gain[k] > best:
            best, g, t = int(gain[k]), int(give[at[k]]), int(take[k])
            gs = (g,) if part is None else (int(part[at[k]]), g - int(part[at[k]]))
            ts = () if not t else (t,) if part_b is None else (int(part_b[k]), t - int(part_b[k]))
            found = gs, ts
            if best == room:
                break
    return found


_NONE = np.zeros(1, np.int64)


def _exchange(src: list[int], dst: list[int], lengths: list[int], room: int) -> tuple[tuple, tuple]:
    """The exchange that fills the target best: (what the source gives, what it takes)."""
    kinds = [tuple(sorted(lengths[i] for i in b)) for b in (src, dst)]
    give, take = _gain(*kinds, room)
    return tuple(_pick(src, give, lengths)), tuple(_pick(dst, take, lengths))


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, group: int = 16384) -> DataFrame:
    """Every piece with the sequence that it goes into and its place there (gapless from 0).

    ``group`` bounds the pieces that one task packs."""
    spark = docs.sparkSession
    todo = kit.cut(pieces(docs, capacity, end_id))
    done: list[DataFrame] = [_place(todo.where(F.col("length") == capacity), capacity, 0, final=True)]
    rest, level = todo.where(F.col("length") < capacity), 1
    while True:
        n = rest.count()
        groups = max(1, -(-n // group))
        placed = kit.cut(_place(rest.repartition(groups), capacity, level, final=groups == 1))
        if groups == 1:
            return _union(done + [placed])
        done.append(placed.where("sequence_id is not null"))
        rest, level = placed.where("sequence_id is null").select(*PIECES_COLUMNS), level + 1
        if groups <= -(-rest.count() // group):  # groups no longer shrink: what is underfull stays so
            return _union(done + [_place(rest.repartition(groups), capacity, level, final=True)])


PIECES_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _place(rows: DataFrame, capacity: int, level: int, final: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (level << 56) + (TaskContext.get().partitionId() << 32)
        if level == 0:
            for b in batches:
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(range(base, base + n), pa.int64()), pa.array([0] * n, pa.int64())], names=[*PIECES_COLUMNS, "sequence_id", "offset"])
                base += n
            return
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        lengths = t.column("length").to_pylist()
        seq, off = [None] * len(lengths), [None] * len(lengths)
        for k, b in enumerate(improve(best_fit(lengths, capacity), lengths, capacity)):
            if final or sum(lengths[i] for i in b) == capacity:
                at = 0
                for i in b:
                    seq[i], off[i] = base + k, at
                    at += lengths[i]
        t = t.append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(off, pa.int64()))
        yield from t.combine_chunks().to_batches()

    return rows.mapInArrow(run, PACKED)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(kit.read(spark, sf_dir, "documents"))
