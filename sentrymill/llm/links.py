"""Finding and joining links: packed candidate exchange, distributed union-find, exact linking inside groups.

Candidates travel as packed blocks (one binary row for each batch and target) instead of a row each. Equal
keys of a batch are joined before the shuffle, so a key that a third of all rows share arrives as one entry
for each batch. What is linked is decided in groups of candidates: small groups in one task, large ones in
pairs of blocks of bounded bytes, never by emitting all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

U = np.uint64
PACKED = "part int, block binary"


def packed(keys: np.ndarray, values: np.ndarray, targets: int) -> pa.RecordBatch:
    """Rows (part, block): entries of (key, value...) dealt by key; ``values`` has a row of 64-bit numbers for each key."""
    entry = np.column_stack([keys.view(np.uint64), values.view(np.uint64).reshape(len(keys), -1)]) if len(keys) else np.zeros((0, 2), np.uint64)
    part = (kit.mix(keys.view(np.uint64)) >> U(33)) % U(targets)
    order = np.argsort(part, kind="stable")
    part, entry = part[order].astype(np.int64), entry[order]
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    stop = np.append(at[1:], len(part))
    return pa.RecordBatch.from_arrays([pa.array(part[at], pa.int32()), pa.array([entry[a:b].tobytes() for a, b in zip(at, stop)], pa.binary())], names=["part", "block"])


def stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries sorted by (key, id): each entry's leader (the smallest id of its key) and which entries lead."""
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    lead = ids[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))] if len(keys) else ids
    return lead, lead != ids, new


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The blocks of one part after another, of rows sorted by part; blocks of part -1 come as they are read."""
    kit.trim()
    now, held = None, []
    for b in batches:
        for part, block in zip(b.column(0).to_pylist(), b.column(1)):
            if part < 0:
                yield part, [block.as_py()]
                continue
            if part != now and held:
                yield now, held
                held = []
            now = part
            held.append(block.as_py())
    if held:
        yield now, held


def dealt(entries: DataFrame, targets: int) -> DataFrame:
    """Blocks sorted by part, the same number of parts in each partition; edges that need no exchange (part -1) anywhere."""
    at = F.when(F.col("part") < 0, F.pmod(F.xxhash64("block"), F.lit(targets))).otherwise(F.col("part")).cast("int")
    return entries.repartitionById(targets, at).sortWithinPartitions("part")


class Edges:
    """Edges gathered as arrays and thinned to a spanning forest, so that few are held and sent."""

    def __init__(self):
        self.u: list[int] = []
        self.v: list[int] = []
        self.most = 400_000

    def add(self, e: np.ndarray) -> None:
        e = e[e[:, 0] != e[:, 1]]
        e = e[np.lexsort((e[:, 1], e[:, 0]))]
        e = e[np.concatenate([[True], (e[1:] != e[:-1]).any(1)])] if len(e) else e
        self.u += e[:, 0].tolist()
        self.v += e[:, 1].tolist()
        if len(self.u) > self.most:
            self.thin()
            self.most = max(self.most, 2 * len(self.u))  # else a forest of more would be made anew at every call

    def thin(self) -> None:
        f = _forest(self.u, self.v)
        self.u, self.v = list(f), list(f.values())

    def batch(self) -> pa.RecordBatch:
        self.thin()
        return pa.RecordBatch.from_arrays([pa.array(self.u, pa.int64()), pa.array(self.v, pa.int64())], names=["u", "v"])


def star_edges(batches_of: DataFrame, targets: int) -> DataFrame:
    """Edges (u, v) that tie every id of a key to the smallest one, from packed (key, id) blocks.

    Part -1 holds edges found before the exchange, as (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Edges()
        for part, blocks in by_part(batches):
            e = np.concatenate([np.frombuffer(x, np.uint64) for x in blocks]).reshape(-1, 2)
            if part < 0:
                out.add(e.view(np.int64))
                continue
            e = e[np.lexsort((e[:, 1].view(np.int64), e[:, 0]))]
            ids = e[:, 1].view(np.int64)
            lead, tied, _ = stars(e[:, 0], ids)
            out.add(np.column_stack([ids[tied], lead[tied]]))
        yield out.batch()

    return dealt(batches_of, targets).mapInArrow(run, "u long, v long")


def combined(keys: np.ndarray, ids: np.ndarray, targets: int) -> pa.RecordBatch:
    """Packs (key, id) entries of one batch: repeats of a key within the batch become edges at once."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    lead, tied, new = stars(keys, ids)
    out = packed(keys[new].view(np.int64), ids[new], targets)
    if tied.any():
        e = np.unique(np.column_stack([ids[tied], lead[tied]]), axis=0)
        out = pa.RecordBatch.from_arrays([pa.concat_arrays([out.column(0), pa.array([-1], pa.int32())]), pa.concat_arrays([out.column(1), pa.array([e.tobytes()], pa.binary())])], names=["part", "block"])
    return out


#: A key of a sketched entry (with its part), the id, and one bit of each of 96 minima; the last one's bit marks stars.
SKETCHED = np.dtype([("key", "<u4"), ("id", "<i8"), ("low", "<u8"), ("high", "<u4")])
STAR = np.uint32(1 << 31)
ALIKE = 73  # of 95 minima; at similarity 0.8 fewer than that agree in about 1 of 20,000 pairs
PAIRS = 64  # beyond so many ids of one key in a batch, and four times as many in all, they are tied without a look


def alike(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> np.ndarray:
    """Which of the pairs of sketches agree in ``ALIKE`` places."""
    return np.bitwise_count(~(low ^ low2)) + np.bitwise_count(~(high ^ high2) & ~STAR) >= ALIKE


def sketched(keys: np.ndarray, ids: np.ndarray, sketch: np.ndarray, targets: int) -> pa.RecordBatch:
    """Packs (key, id, sketch) entries of one batch, whose rows of ``keys`` belong to one id each. Ids of a key that very
    many hold become edges at once (part -1)."""
    full = kit.mix(keys.ravel())
    order = np.argsort(full)
    row = order // keys.shape[1]
    full, ids, sketch = full[order], ids[row], sketch[row]
    part = ((full >> U(32)) * U(targets) >> U(32)).astype(np.int64)  # in order as well
    e = np.empty(len(ids), SKETCHED)
    e["key"], e["id"], e["low"], e["high"] = full.astype(np.uint32), ids, sketch["low"], sketch["high"] & ~STAR
    run = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (e["key"][1:] != e["key"][:-1])])) if len(e) else np.zeros(0, np.int64)
    size = np.diff(np.append(run, len(e)))
    ties = np.zeros((0, 2), np.int64)
    if (size > PAIRS).any():
        lead, many = np.repeat(ids[run], size), np.repeat(size > PAIRS, size)
        ties = np.unique(np.column_stack([ids, lead])[many & (ids != lead)], axis=0)
        first = np.zeros(len(e), bool)
        first[run] = True
        e["high"][many & first] |= STAR
        part, e = part[~many | first], e[~many | first]
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    blocks = [e[i:j].tobytes() for i, j in zip(at, np.append(at[1:], len(part)))]
    to = part[at].tolist()
    if len(ties):
        blocks.append(ties.tobytes())
        to.append(-1)
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(blocks, pa.binary())], names=["part", "block"])


def alike_edges(entries: DataFrame, targets: int) -> DataFrame:
    """Edges (u, v) between ids of a key whose sketches agree in ``ALIKE`` places; keys of very many ids tie all to one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Edges()
        for part, blocks in by_part(batches):
            if part < 0:
                out.add(np.frombuffer(blocks[0], np.int64).reshape(-1, 2))
                continue
            e = np.concatenate([np.frombuffer(x, SKETCHED) for x in blocks])
            key = np.ascontiguousarray(e["key"])
            order = np.argsort(key)
            key = key[order]
            same = key[1:] == key[:-1]
            e = e[order[np.append(same, False) | np.append(False, same)]]  # most keys are held once
            if not len(e):
                continue
            e = e[np.lexsort((e["id"], e["key"]))]
            new = np.concatenate([[True], (e["key"][1:] != e["key"][:-1]) | (e["id"][1:] != e["id"][:-1])])
            star = np.logical_or.reduceat(e["high"] >= STAR, np.flatnonzero(new))
            e = e[new]
            run = np.flatnonzero(np.concatenate([[True], e["key"][1:] != e["key"][:-1]]))
            size = np.diff(np.append(run, len(e)))
            many = np.repeat(np.logical_or.reduceat(star, run) | (size > 4 * PAIRS), size)
            out.add(np.column_stack([e["id"], np.repeat(e["id"][run], size)])[many])
            left = np.repeat(size + run, size) - np.arange(len(e)) - 1  # entries of the key behind this one
            left[many] = 0
            i, step = np.flatnonzero(left > 0), 1
            ids, low, high = (np.ascontiguousarray(e[x]) for x in ("id", "low", "high"))
            while len(i):
                j = i + step
                hit = alike(low[i], high[i], low[j], high[j])
                if hit.any():
                    out.add(np.column_stack([ids[j[hit]], ids[i[hit]]]))
                step += 1
                i = i[left[i] >= step]
        yield out.batch()

    return dealt(entries, targets).mapInArrow(run, "u long, v long")


def _forest(u: list[int], v: list[int]) -> dict[int, int]:
    """Smallest id reachable, for every id but the smallest itself."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        r = x
        while r in up:
            r = up[r]
        while x != r:
            up[x], x = r, up[x]
        return r

    for a, b in zip(u, v):
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def components(edges: DataFrame, rounds: int = 40, thin: bool = False) -> DataFrame:
    """(id, component) of every id of ``edges`` (u, v) but the components' own smallest ids: large-star and
    small-star steps after each partition has replaced its edges by a spanning star (``thin``: it has already). Hubs are aggregated before
    the shuffle and their joins are skew joins; each step is written to the shared folder."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Edges()
        for b in batches:
            out.add(np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]))
        yield out.batch()

    now = kit.cut(edges.select("u", "v") if thin else edges.select("u", "v").mapInArrow(contract, "u long, v long"))
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        new = kit.cut(small)
        got = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).collect()[0]
        kit.drop(now)
        now = new
        if mark == tuple(got):
            break
        mark = tuple(got)
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))


class CountTree:
    """A packed R-tree over count vectors.

    Tokens are hashed into groups; a set is the point of its group counts. Two sets share at most the sum of
    the smaller coordinates; a node keeps the largest coordinates and the smallest size below it, so the same
    sum bounds what a set can share with anything in it."""

    GROUPS, LEAF = 256, 16

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        of = np.concatenate(sets) >> U(56)
        row = np.repeat(np.arange(len(sets), dtype=np.int64), self.size)
        wide = np.uint16 if self.size.max(initial=0) < 65536 else np.int32
        self.point = np.bincount(row * self.GROUPS + of.astype(np.int64), minlength=len(sets) * self.GROUPS).astype(wide).reshape(len(sets), self.GROUPS)
        # tiles: by size, then by where in the lattice the counts lie
        tile = np.empty(len(sets), np.int64)
        tile[np.argsort(self.size, kind="stable")] = np.arange(len(sets)) // (self.LEAF * 8)
        self.order = np.lexsort((self.point[:, 1], self.point[:, 0], tile))
        p, z = self.point[self.order], self.size[self.order]
        self.at = np.arange(0, len(sets), self.LEAF)
        self.high = np.maximum.reduceat(p, self.at)
        self.low_size = np.minimum.reduceat(z, self.at)
        self.high_size = np.maximum.reduceat(z, self.at)

    def near(self, q: int, share: float, open_: np.ndarray) -> np.ndarray:
        """Sets among ``open_`` that may have Jaccard similarity ``share`` or more with set q."""
        n = self.size[q]
        fit = (self.high_size >= share * n - 1e-9) & (self.low_size <= n / share + 1e-9) & np.logical_or.reduceat(open_[self.order], self.at)
        leaves = np.flatnonzero(fit)
        if not len(leaves):
            return leaves
        bound = np.minimum(self.high[leaves], self.point[q]).sum(1, dtype=np.int64)
        least = np.maximum(self.low_size[leaves], share * n)
        leaves = leaves[bound >= share / (1 + share) * (n + least) - 1e-9]
        at = (leaves[:, None] * self.LEAF + np.arange(self.LEAF)).ravel()
        k = self.order[at[at < len(self.order)]]
        k = k[open_[k]]
        bound = np.minimum(self.point[k], self.point[q]).sum(1, dtype=np.int64)
        return k[bound >= share / (1 + share) * (n + self.size[k]) - 1e-9]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def prefix_sizes(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many of a set's first elements, in an order that all sets share, hold one of any set that links with it."""
    return n - -(-num * n // den) + 1


def _by_rare(sets: list[np.ndarray], num: int, den: int) -> list[np.ndarray]:
    """Groups of sets that share an element among the rarest of each; sets that link are in one group."""
    size = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int64), size)
    order = np.argsort(flat, kind="stable")
    x = flat[order]
    new = np.concatenate([[True], x[1:] != x[:-1]])
    run = np.cumsum(new) - 1
    often = np.empty(len(x), np.int64)
    often[order] = np.bincount(run)[run]
    rank = np.argsort(owner * (len(sets) + 1) + often, kind="stable")  # sets are sorted, so ties are in order of the hash
    at = np.arange(len(rank)) - np.repeat(np.cumsum(size) - size, size)
    k = rank[(at < np.repeat(prefix_sizes(size, num, den), size)) & (often[rank] > 1)]
    k = k[np.argsort(flat[k], kind="stable")]
    lead, tied, _ = stars(flat[k], owner[k])
    up = _forest(owner[k][tied].tolist(), lead[tied].tolist())
    comp = np.arange(len(sets))
    for i, j in up.items():
        comp[i] = j
    order = np.argsort(comp, kind="stable")
    return [g for g in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1) if len(g) > 1]


def linked(sets: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None) -> np.ndarray:
    """Component of each set (index of a member) where den * intersection >= num * union links two.

    Many sets are first told apart by their rarest elements. Pairs that are in one component already need no
    look; with ``side`` only pairs of different sides count."""
    comp = np.arange(len(sets))
    if len(sets) < 2:
        return comp
    if len(sets) <= 64:
        return _search(sets, num, den, side)
    for g in _by_rare(sets, num, den):
        comp[g] = g[_search([sets[i] for i in g], num, den, None if side is None else side[g])]
    return comp


def _search(sets: list[np.ndarray], num: int, den: int, side: np.ndarray | None) -> np.ndarray:
    comp, place = np.arange(len(sets)), np.arange(len(sets))
    tree = CountTree(sets) if len(sets) > 6 else None  # a tree over so few is one leaf
    for q in range(len(sets)):
        open_ = (comp != comp[q]) & (place > q)
        if side is not None:
            open_ &= side != side[q]
        if not open_.any():
            continue
        k = np.flatnonzero(open_) if tree is None else tree.near(q, num / den, open_)
        for j in k:
            if comp[j] == comp[q]:
                continue
            both = overlap(sets[q], sets[j])
            if den * both >= num * (len(sets[q]) + len(sets[j]) - both):
                a, b = comp[q], comp[j]
                comp[comp == max(a, b)] = min(a, b)
    return comp


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A row of ``bits`` bits or more for each sorted set, of hashes, whose elements set the bits that their first bits name."""
    w = max(6, (bits - 1).bit_length())
    x = np.concatenate(sets) >> U(64 - w)
    word = np.repeat(np.arange(len(sets), dtype=np.int64) << w - 6, [len(s) for s in sets]) + (x >> U(6)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out = np.zeros(len(sets) << w - 6, np.uint64)
    out[word[at]] = np.bitwise_or.reduceat(U(1) << (x & U(63)), at)
    return out.reshape(len(sets), -1)


def linked_by_size(sets: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None) -> np.ndarray:
    """As ``linked``, in order of size: sets meet those of fitting size only, and are looked at whole if their bitmaps let them link.

    A bit of one set that the other lacks stands for an element or more that the other lacks, so no link is missed; what
    unrelated sets cost is some words of their bitmaps."""
    if len(sets) <= 6:
        return _search(sets, num, den, side) if len(sets) > 1 else np.arange(len(sets))
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size, sets = size[order], [sets[i] for i in order.tolist()]
    side = None if side is None else side[order]
    stop = np.searchsorted(num * size, den * size, side="right")
    comp = np.arange(len(sets))
    lo = 0
    while lo < len(sets):
        hi = int(stop[lo])
        some, top = sets[lo : stop[hi - 1]], int(size[stop[hi - 1] - 1])
        coarse, bits = np.ascontiguousarray(bitmaps(some, 2 * top).T), bitmaps(some, 8 * top)
        step = max(16, (1 << 17) // len(coarse))
        for q in range(lo, hi):
            open_ = comp[q + 1 : stop[q]] != comp[q]
            if side is not None:
                open_ &= side[q + 1 : stop[q]] != side[q]
            k = np.flatnonzero(open_) + q + 1
            for at in range(0, len(k), step):
                j = k[at : at + step]
                j = j[comp[j] != comp[q]]
                lacks = np.bitwise_count(coarse[:, q - lo, None] & ~np.take(coarse, j - lo, axis=1)).sum(0, dtype=np.uint32)
                j = j[(num + den) * (size[q] - lacks) >= num * (size[q] + size[j])]
                lacks = np.bitwise_count(bits[q - lo] & ~bits[j - lo]).sum(1, dtype=np.int64)
                j = j[(num + den) * (size[q] - lacks) >= num * (size[q] + size[j])]
                lacks = np.bitwise_count(bits[j - lo] & ~bits[q - lo]).sum(1, dtype=np.int64)
                j = j[(num + den) * (size[j] - lacks) >= num * (size[q] + size[j])]
                for i in j.tolist():
                    if comp[i] == comp[q]:
                        continue
                    both = overlap(sets[q], sets[i])
                    if den * both >= num * (size[q] + size[i] - both):
                        a, b = comp[q], comp[i]
                        comp[comp == max(a, b)] = min(a, b)
        lo = hi
    least = np.full(len(sets), len(sets))
    np.minimum.at(least, comp, order)
    out = np.empty(len(sets), np.int64)
    out[order] = least[comp]
    return out


def finer(chunks: DataFrame, num: int, den: int, targets: int, parts: int) -> DataFrame:
    """(id, component): candidate components of sets that share an element among the rarest of each, rarest over all ``chunks``.

    ``chunks``: (chunk, ids, bodies), arrays of ids and of sorted sets. A chunk asks once for each different element
    and is told how many sets hold it, if two or more do. Sets that link share one of their ``prefix_sizes`` rarest
    elements (ties in order of the hash), so none of their links is missed; elements that few hold tie few."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, bodies in zip(b.column(0).to_pylist(), b.column(1)):
                x, n = np.unique(np.frombuffer(b"".join(bodies.as_py()), np.uint64), return_counts=True)
                yield packed(x, np.column_stack([np.full(len(x), chunk, np.int64), n]), targets)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in by_part(batches):
            e = np.concatenate([np.frombuffer(x, np.uint64) for x in blocks]).reshape(-1, 3)
            e = e[np.argsort(e[:, 0], kind="stable")]
            at = np.flatnonzero(np.concatenate([[True], e[1:, 0] != e[:-1, 0]]))
            n = np.repeat(np.add.reduceat(e[:, 2], at), np.diff(np.append(at, len(e))))
            e = np.column_stack([e[:, 1], e[:, 0], n])[n > 1]
            e = e[np.argsort(e[:, 0], kind="stable")]
            at = np.flatnonzero(np.concatenate([[True], e[1:, 0] != e[:-1, 0]])) if len(e) else np.zeros(0, np.int64)
            stop = np.append(at[1:], len(e))
            yield pa.RecordBatch.from_arrays([pa.array(e[at, 0].view(np.int64)), pa.array([e[i:j, 1:].tobytes() for i, j in zip(at, stop)], pa.binary())], names=["chunk", "block"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kit.trim()
        for b in batches:
            for ids, bodies, blocks in zip(*[c.to_pylist() for c in b.columns]):
                known = np.frombuffer(b"".join(blocks), np.uint64).reshape(-1, 2)
                known = known[np.argsort(known[:, 0])]
                out, owner = [], []
                for i, body in zip(ids, bodies):
                    x = np.frombuffer(body, np.uint64)
                    at = np.minimum(np.searchsorted(known[:, 0], x), max(len(known) - 1, 0))
                    often = np.where(known[at, 0] == x, known[at, 1], 1) if len(known) else np.ones(len(x), np.uint64)
                    k = np.argsort(often, kind="stable")[: int(prefix_sizes(np.array([len(x)]), num, den)[0])]
                    out.append(x[k[often[k] > 1]])
                    owner.append(np.full(len(out[-1]), i, np.int64))
                if len(x := np.concatenate(out)):
                    yield combined(kit.mix(x), np.concatenate(owner), targets)

    told = dealt(chunks.select("chunk", "bodies").mapInArrow(ask, PACKED), parts).mapInArrow(answer, "chunk long, block binary").groupBy("chunk").agg(F.collect_list("block").alias("blocks"))
    return components(star_edges(kit.beside(chunks, told, "chunk").select("ids", "bodies", "blocks").mapInArrow(keys, PACKED), parts), thin=True)


#: Bits of a sieve, as a power of two; a bitmap of 16 MB at every size.
SIEVE, CHUNK = 27, 19


def sieve(ids: DataFrame) -> np.ndarray:
    """A bitmap with the bit of each id set, ids being hashes. Its size is fixed: where ids are very many it lets more others pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> U(64 - SIEVE)
            of = (x >> U(CHUNK)).astype(np.int64)
            for c in np.unique(of).tolist():
                held.setdefault(c, np.zeros(1 << CHUNK, bool))[x[of == c] & U((1 << CHUNK) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in held.values()], pa.binary())], names=["part", "block"])

    bits = np.zeros(1 << SIEVE - 3, np.uint8)
    chunk = F.shiftrightunsigned("id", 64 - SIEVE + CHUNK)
    for part, block in ids.select("id").repartition(kit.parts(ids.sparkSession), chunk).mapInArrow(run, PACKED).collect():
        bits[part << CHUNK - 3 : part + 1 << CHUNK - 3] = np.frombuffer(block, np.uint8)
    return bits


def sifted(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which ids may be among those of the sieve."""
    x = ids.view(np.uint64) >> U(64 - SIEVE)
    return (bits[x >> U(3)] >> (x & U(7)).astype(np.uint8) & 1).astype(bool)


def blocks_of(sizes: DataFrame, block_bytes: int) -> DataFrame:
    """(grp, _blocks) from (grp, bytes): blocks of about ``block_bytes`` that the members of a group are dealt into."""
    return sizes.groupBy("grp").agg(F.greatest(F.lit(1), F.ceil(F.sum("bytes") / block_bytes)).cast("int").alias("_blocks"))


def size_class(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Ranges of set sizes, numbered, such that sets that can link lie in one range or in two neighbouring ones."""
    return (np.log(np.maximum(n, 1)) / (np.log(den / num) * (1 + 1e-9))).astype(np.int32)


def by_class(members: DataFrame, block_bytes: int, least: int) -> DataFrame:
    """(grp, id, body, _blocks, _shared) from (grp, id, body, cls): groups of more than one block as groups of two
    neighbouring size classes each, so that blocks meet only where sizes fit; their rows are in two groups (``_shared``).

    A row counts for its body and ``least`` bytes."""
    weight = (F.length("body") + least).alias("bytes")
    whole = kit.beside(members, blocks_of(members.select("grp", weight), block_bytes), "grp")
    one = whole.where("_blocks = 1").select("grp", "id", "body", "_blocks", F.lit(False).alias("_shared"))
    many = whole.where("_blocks > 1").select(F.explode(F.array(F.xxhash64("grp", "cls"), F.xxhash64("grp", F.col("cls") + 1))).alias("grp"), "id", "body")
    sized = kit.beside(many, blocks_of(many.select("grp", weight), block_bytes), "grp")
    return one.unionByName(sized.select("grp", "id", "body", "_blocks", F.lit(True).alias("_shared")))


def link_groups(members: DataFrame, to_sets: Callable[[list[bytes]], list[np.ndarray]], num: int, den: int, link: Callable = linked) -> DataFrame:
    """Exact components inside candidate groups: (id, component) for ids that are not their component's smallest.

    ``members``: (grp, id, body, _blocks), with ``_blocks`` from ``blocks_of``, or rows of ``by_class``; ``to_sets`` gives the
    sets of a batch of bodies, ``link`` the components of sets. Groups of one block are settled in one task; equal rows count once.
    Larger ones are dealt into blocks by a hash of the id and every pair of blocks is settled in a task of its
    own; the edges of such groups go through ``components``."""
    spark = members.sparkSession
    shared = F.col("_shared") if "_shared" in members.columns else F.lit(False)
    sized = members.withColumn("_own", F.pmod(F.xxhash64("id", F.lit(7)), F.col("_blocks")).cast("int"))
    other = F.when(F.col("_blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1))
    pairs = sized.withColumn("_other", F.explode(other)).select("grp", F.least("_own", "_other").alias("_a"), F.greatest("_own", "_other").alias("_b"), "_own", ((F.col("_blocks") > 1) | shared).alias("_large"), "id", "body")

    def settle(rows: list[tuple]) -> tuple[list[int], list[int], list[bool]]:
        rows = list({r[5]: r for r in sorted(rows, key=lambda r: r[5])}.values())
        sets = [r[6] for r in rows]
        side = np.array([r[3] for r in rows]) if rows[0][1] != rows[0][2] else None
        comp = link(sets, num, den, side)
        k = np.flatnonzero(comp != np.arange(len(rows)))
        return [rows[i][5] for i in k], [rows[comp[i]][5] for i in k], [rows[i][4] for i in k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        u: list[int] = []
        v: list[int] = []
        w: list[bool] = []

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(w, pa.bool_())], names=["u", "v", "large"])
            u.clear(), v.clear(), w.clear()
            return b

        kit.trim()
        for *of, bodies in kit.slices(batches, 6):
            for row in zip(*of, to_sets(bodies)):
                if held and row[:3] != held[0][:3]:
                    for c, x in zip((u, v, w), settle(held)):
                        c += x
                    held = []
                held.append(row)
            if len(u) > 50_000:
                yield out()
        if held:
            for c, x in zip((u, v, w), settle(held)):
                c += x
        yield out()

    n = kit.parts(spark)
    edges = kit.cut(pairs.repartition(n, "grp", "_a", "_b").sortWithinPartitions("grp", "_a", "_b").mapInArrow(run, "u long, v long, large boolean"))
    done = edges.where("not large").select(F.col("u").alias("id"), F.col("v").alias("component"))
    if edges.where("large").limit(1).count():
        done = done.unionByName(components(edges.where("large")))
    return done
