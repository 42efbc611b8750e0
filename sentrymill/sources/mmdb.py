"""City databases in the public binary tree format (MMDB 2.0) as a table of address blocks.

The file ends in metadata; before that lies a section of typed values, and first of all a binary tree over address bits whose
leaves point into that section. Subtrees are walked by different tasks, each with the file's bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MARK = b"\xab\xcd\xefMaxMind.com"
SCHEMA = "start string, bits int, cc string, country string, city string, lat double, lon double"
#: A larger file is not sent to the executors.
LIMIT = 1 << 30


class Values:
    """Typed values that start at ``base`` in a buffer; pointers count from there."""

    def __init__(self, data: bytes, base: int):
        self.data, self.base = data, base

    def at(self, offset: int) -> tuple:
        """(value, offset behind it)."""
        d, p = self.data, self.base + offset
        control, p = d[p], p + 1
        kind, size = control >> 5, control & 31
        if kind == 1:
            more = size >> 3
            raw = int.from_bytes(d[p : p + more + 1], "big")
            target = raw + (0, 2048, 526336)[more] + ((size & 7) << 8 * (more + 1)) if more < 3 else raw
            return self.at(target)[0], p + more + 1 - self.base
        if kind == 0:
            kind, p = d[p] + 7, p + 1
        if size >= 29:
            n = size - 28
            size, p = int.from_bytes(d[p : p + n], "big") + (29, 285, 65821)[n - 1], p + n
        if kind == 7:
            out, q = {}, p - self.base
            for _ in range(size):
                key, q = self.at(q)
                out[key], q = self.at(q)
            return out, q
        if kind == 11:
            items, q = [], p - self.base
            for _ in range(size):
                item, q = self.at(q)
                items.append(item)
            return items, q
        if kind == 14:
            return bool(size), p - self.base
        raw, q = d[p : p + size], p + size - self.base
        if kind == 2:
            return raw.decode("utf-8", "replace"), q
        if kind == 3:
            return struct.unpack(">d", raw)[0], q
        if kind == 15:
            return struct.unpack(">f", raw)[0], q
        if kind == 4:
            return raw, q
        if kind == 8:
            return int.from_bytes(raw.rjust(4, b"\0"), "big", signed=True), q
        if kind in (5, 6, 9, 10):
            return int.from_bytes(raw, "big"), q
        raise ValueError(f"a value of unknown kind {kind}")


class Tree:
    """The binary tree over address bits. Nodes below ``count`` are inner ones, ``count`` itself is empty, larger ones are leaves."""

    def __init__(self, data: bytes):
        at = data.rfind(MARK)
        if at < 0:
            raise ValueError("not a city database: its mark is missing")
        meta = Values(data, at + len(MARK)).at(0)[0]
        self.data, self.count, self.size, self.version = data, meta["node_count"], meta["record_size"], meta["ip_version"]
        if self.size not in (24, 28, 32):
            raise ValueError(f"records of {self.size} bits are not known")
        self.depth = 128 if self.version == 6 else 32
        self.values = Values(data, self.count * self.size // 4 + 16)

    def child(self, node: int, bit: int) -> int:
        d, n = self.data, self.size // 4
        p = node * n
        if self.size == 28:
            high = d[p + 3]
            return int.from_bytes(d[p : p + 3], "big") | (high & 0xF0) << 20 if not bit else int.from_bytes(d[p + 4 : p + 7], "big") | (high & 0x0F) << 24
        return int.from_bytes(d[p + bit * n // 2 : p + (bit + 1) * n // 2], "big")

    def below(self, node: int, prefix: int, bits: int, stop: int | None = None) -> Iterator[tuple[int, int, int]]:
        """(node, prefix, bits) of the leaves below a node, or of all nodes ``stop`` bits deep."""
        todo = [(node, prefix, bits)]
        while todo:
            node, prefix, bits = todo.pop()
            if node > self.count or bits == stop and node < self.count:
                yield node, prefix, bits
            elif node < self.count and bits < self.depth:
                todo += [(self.child(node, b), prefix << 1 | b, bits + 1) for b in (1, 0)]

    def record(self, leaf: int) -> dict:
        return self.values.at(leaf - self.count - 16)[0]


def row(record: dict, prefix: int, bits: int, depth: int) -> tuple:
    """A block's row; the record of a place without code and coordinates says nothing, as a miss does."""
    place, where = record.get("location") or {}, record.get("country") or {}
    lat, lon, cc = place.get("latitude") or 0.0, place.get("longitude") or 0.0, where.get("iso_code") or ""
    start, bits = prefix << depth - bits, bits + 128 - depth
    if not lat and not lon and not cc:
        return f"{start:032x}", bits, None, None, None, None, None
    return f"{start:032x}", bits, cc, (where.get("names") or {}).get("en", ""), ((record.get("city") or {}).get("names") or {}).get("en", ""), float(lat), float(lon)


def blocks(spark: SparkSession, path: str, spread: int = 8) -> DataFrame:
    """(start, bits, cc, country, city, lat, lon) of all blocks of a city database; start is the first address in 32 hex digits.

    IPv4 blocks lie under 96 zero bits. Blocks do not overlap. The tree is cut ``spread`` inner levels down (below the 96 bits
    that lead to IPv4) and the subtrees are dealt to tasks. The file is read by Spark, so any path that Spark knows will do;
    it goes to every executor and so must not exceed ``LIMIT``."""
    found = spark.read.format("binaryFile").load(path)
    size = found.selectExpr("max(length)", "count(*)").first()
    if size[1] != 1 or size[0] > LIMIT:
        raise ValueError(f"one file of at most {LIMIT} bytes is needed; found {size[1]}, the largest of {size[0]}")
    shared = spark.sparkContext.broadcast(bytes(found.select("content").first()[0]))
    tree = Tree(shared.value)
    heads: list[tuple[int, int, int]] = []
    for head in tree.below(0, 0, 0, spread):
        heads += tree.below(*head, 96 + spread) if tree.version == 6 and head[1] == 0 and head[0] < tree.count else [head]
    frame = spark.createDataFrame([(n, f"{p:x}", b) for n, p, b in heads], "node long, prefix string, bits int").repartition(max(1, min(len(heads), 4 * spark.sparkContext.defaultParallelism)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tree(shared.value)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        types = [{"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[f.split()[1]] for f in SCHEMA.split(", ")]
        emit = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names=names)
        held: list[tuple] = []
        for b in batches:
            for head in b.to_pylist():
                for leaf, prefix, bits in t.below(head["node"], int(head["prefix"], 16), head["bits"]):
                    held.append(row(t.record(leaf), prefix, bits, t.depth))
                    if len(held) >= 20_000:
                        yield emit(held)
                        held = []
        if held:
            yield emit(held)

    return frame.mapInArrow(walk, SCHEMA)
