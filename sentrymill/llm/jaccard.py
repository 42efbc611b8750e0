"""N-gram Jaccard join over word shingles with a count-vector R-tree.

Two documents link when their sets of ``k``-word shingles have Jaccard similarity of at least num/den. Sets that
link differ in few shingles, so a split of the hash range into more pieces than they may differ in leaves some
pieces equal in both: equal pieces that hold something (with their size class) lead to candidates, and none is missed. Shingles are
hashed into groups; inside each group of candidates an R-tree over group-count vectors bounds the overlap by
summed coordinate minima, and surviving pairs are verified on the whole sets.

Documents with equal sets form one class from the start. A document without words (or text) links with
nothing. Repeated rows and ids are documents of their own; null ids form components whose id is null unless
another member has one; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kit, links

U = np.uint64
HALF = U(32)


class SizeClasses:
    """Ranges of set sizes such that sets that can link lie in one class or in two neighbouring ones."""

    def __init__(self, num: int, den: int, top: int = 1 << 40):
        self.low = [1]
        while self.low[-1] < top:
            self.low.append(self.low[-1] * den // num + 1)
        share = Fraction(num, den)
        # the most elements by which sets a <= b with a in the class can differ
        self.differ = [int((n - 1) * (1 + 1 / share) * (1 - share) / (1 + share)) for n in self.low[1:]]
        self.spare = [_spare(n, d + 1) for n, d in zip(self.low, self.differ)]

    def of(self, n: int) -> int:
        return bisect_right(self.low, n) - 1


def _spare(n: int, pieces: int) -> int:
    """Pieces to add so that few sets of n elements leave more than those empty."""
    e = 0
    while pieces > 1:
        m = pieces + e
        mean = m * (1 - 1 / m) ** n
        if e >= mean + 2 * mean**0.5 or e >= pieces:
            break
        e += max(1, pieces // 64)
    return e


#: Splits of the hash range tried for sets that leave too many pieces empty, before empty pieces count.
SPLITS = 6


def signatures(s: np.ndarray, classes: SizeClasses) -> np.ndarray:
    """Keys of the pieces of a set, for its own class and the one below.

    Of differ + 1 + spare pieces at least spare + 1 are equal in two sets that link. Only pieces that hold something give
    keys: if one of the two leaves at most ``spare`` empty, one equal piece is not empty, and both give its key. Sets that
    leave more empty are split again by another hash, so two of them meet there; after ``SPLITS`` splits empty
    pieces count too. So nothing is missed, and texts that have nothing in common share no key."""
    c, out = classes.of(len(s)), []
    for k in (c, c - 1):
        if k < 0:
            continue
        spare = classes.spare[k]
        m = classes.differ[k] + 1 + spare
        for split in range(SPLITS):
            x = s if split == 0 else np.sort(kit.mix(s + U(split * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))
            piece = (((x >> HALF) * U(m)) >> HALF).astype(np.int64)  # x is sorted, so pieces are runs
            at = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            sums = np.add.reduceat(kit.mix(x ^ U(0xA5A5A5A5A5A5A5A5)), at)
            held = piece[at]
            few = m - len(at) <= spare
            if not few and split == SPLITS - 1:
                sums, held = np.concatenate([sums, np.zeros(m - len(at), np.uint64)]), np.concatenate([held, np.setdiff1d(np.arange(m), held)])
            out.append(kit.mix(kit.mix(sums + U((k * SPLITS + split) * 0x9E3779B1 + 77)) + held.astype(np.uint64) * U(0xD1B54A32D192ED03)))
            if few:
                break
    return np.concatenate(out)


def set_id(s: np.ndarray) -> int:
    return int(kit.mix(np.array([kit.mix(s).sum(dtype=np.uint64) + U(len(s))], np.uint64)).view(np.int64)[0])


def _rows(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, _k, n_shingles, _cls) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, rows in kit.slices(batches):
            words = kit.Words(texts, lower=True)
            sets = [links_set(words, i, k) for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([kit.NO_ID if i is None else i for i in ids], pa.int64()), pa.array(rows, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())], names=["doc_id", "_id", "_k", "n_shingles", "_cls"])

    return docs.select("doc_id", "text", "_k").mapInArrow(run, "doc_id long, _id long, _k long, n_shingles long, _cls long")


def _keys(docs: DataFrame, k: int, num: int, den: int, targets: int) -> DataFrame:
    """Packed candidate keys of the different sets of each batch."""
    classes = SizeClasses(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, rows in kit.slices(batches):
            words = kit.Words(texts, lower=True)
            seen, keys, owner = set(), [], []
            for i in range(len(ids)):
                s = links_set(words, i, k)
                cls = set_id(s) if len(s) else None
                if cls is not None and cls not in seen:
                    seen.add(cls)
                    keys.append(signatures(s, classes))
                    owner.append(np.full(len(keys[-1]), cls, np.int64))
            if keys:
                yield links.combined(np.concatenate(keys), np.concatenate(owner), targets)

    return docs.select("doc_id", "text", "_k").mapInArrow(run, links.PACKED)


def links_set(words: kit.Words, i: int, k: int) -> np.ndarray:
    return kit.shingles(words.hash[words.first[i] : words.first[i + 1]], k)


def join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, block: int = 16_000_000) -> DataFrame:
    """(doc_id, _k, _root, n_shingles, component_id): the size of each document's set and the smallest id it reaches.

    Candidate groups with sets of more than ``block`` bytes are first told apart by rare shingles, counted over all of
    them, and what stays larger is compared by pairs of blocks; the result does not depend on it."""
    spark = docs.sparkSession
    n = kit.parts(spark)
    docs = kit.keyed(docs)
    rows = kit.cut(_rows(docs, k))
    groups = kit.cut(_groups(links.components(links.star_edges(_keys(docs, k, num, den, 4 * n), n), thin=True)))
    kit.release(spark)
    reps = rows.where("_cls is not null").groupBy("_cls").agg(F.min(F.struct("_id", "_k")).alias("_rep"), F.min("n_shingles").alias("_n"))
    known = kit.cut(groups.join(reps, F.col("id") == F.col("_cls")).select("_rep._id", "_rep._k", "grp", "id", (8 * F.col("_n") + 64).alias("bytes")))
    kit.drop(groups)
    sized = kit.cut(known.join(links.blocks_of(known, block), "grp").select("_id", "_k", "grp", "id", "_blocks"))
    kit.drop(known)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grp, texts, ids, blocks in kit.slices(batches):
            words = kit.Words(texts, lower=True)
            body = [links_set(words, i, k).tobytes() for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([pa.array(grp, pa.int64()), pa.array(ids, pa.int64()), pa.array(body, pa.binary()), pa.array(blocks, pa.int32())], names=["grp", "id", "body", "_blocks"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, ids, _ in kit.slices(batches):
            words = kit.Words(texts, lower=True)
            body = [links_set(words, i, k).tobytes() for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([pa.array(ids[:1], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([body], pa.list_(pa.binary()))], names=["chunk", "ids", "bodies"])

    def bodies(of: DataFrame) -> DataFrame:
        return kit.beside(docs.select("_id", "_k", "text"), of, ["_id", "_k"]).select("grp", "text", "id", "_blocks")

    members = bodies(sized.where("_blocks = 1")).mapInArrow(sets, "grp long, id long, body binary, _blocks int")
    made = []
    if sized.where("_blocks > 1").limit(1).count():
        many = kit.cut(bodies(sized.where("_blocks > 1")).mapInArrow(chunks, "chunk long, ids array<long>, bodies array<binary>"))
        kit.release(spark)
        small = kit.cut(_groups(links.finer(many, num, den, 4 * n, n)))
        kit.release(spark)
        each = many.select(F.explode(F.arrays_zip("ids", "bodies")).alias("_e")).select(F.col("_e.ids").alias("id"), F.col("_e.bodies").alias("body"))
        each = kit.cut(kit.beside(each, small, "id").select("grp", "id", "body"))
        kit.drop(many, small)
        blocks = links.blocks_of(each.select("grp", (F.length("body") + 64).alias("bytes")), block)
        members = members.unionByName(each.join(blocks, "grp").select("grp", "id", "body", "_blocks"))
        made = [each]
    comps = links.link_groups(members, lambda bodies: [np.frombuffer(b, np.uint64) for b in bodies], num, den)
    kit.drop(sized, *made)
    kit.release(spark)
    joined = rows.join(comps.withColumnRenamed("id", "_cls"), "_cls", "left").withColumn("_root", F.coalesce("component", "_cls"))
    least = joined.where("_root is not null").groupBy("_root").agg(F.min("doc_id").alias("_least"))
    return joined.join(least, "_root", "left").select("doc_id", "_k", "_root", "n_shingles", F.when(F.col("_root").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"))


def _groups(comps: DataFrame) -> DataFrame:
    """(id, grp) with every member of every group, the smallest id too."""
    return comps.select("id", F.col("component").alias("grp")).unionByName(comps.select(F.col("component").alias("id"), F.col("component").alias("grp")).distinct())


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(kit.read(spark, sf_dir, "documents")).drop("_k", "_root")
