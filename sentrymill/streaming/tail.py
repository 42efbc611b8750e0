"""Following growing log files: a streaming source whose offsets are (inode, position, head signature) of every file.

Spark's own file source takes a file once; a live log grows, is moved away or is cut to nothing in place. ``register`` makes
``spark.readStream.format("logtail").load(path)`` known, with the path of a file or a glob that driver and executors all see
(a mounted folder on a cluster). Rows: path, start (byte offset of the line), value, oversized.

- A batch ends at the last line break of each file; an unterminated last line is held back until its break is written.
- A file that shrank, got another inode, or whose first bytes are others than when it was last read starts anew.
- What was left unread in a file that was moved away is read first, from the sibling that has its inode, its last line with
  or without a break.
- A line longer than ``linecap`` bytes (2 MiB) gives a row with null ``value`` and ``oversized`` true; it is never held in
  memory and the position moves past it.
- A large backlog is dealt to tasks in pieces of ``splitbytes``; a piece holds the lines that start in it.
- Blank lines give no row. Bytes that are not UTF-8 are replaced.
"""

from __future__ import annotations

import glob
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, start long, value string, oversized boolean"
HEAD, BLOCK = 512, 1 << 16
_ARROW = pa.schema([("path", pa.string()), ("start", pa.int64()), ("value", pa.string()), ("oversized", pa.bool_())])


def signature(path: str, n: int) -> str:
    """Digest of the first ``n`` bytes; empty if there are fewer."""
    with open(path, "rb") as f:
        data = f.read(n)
    return hashlib.sha256(data).hexdigest()[:16] if len(data) == n else ""


def last_break(path: str, size: int) -> int:
    """The position behind the last line break before ``size``, 0 if there is none."""
    with open(path, "rb") as f:
        at = size
        while at > 0:
            lo = max(0, at - BLOCK)
            f.seek(lo)
            k = f.read(at - lo).rfind(b"\n")
            if k >= 0:
                return lo + k + 1
            at = lo
    return 0


def lines(path: str, lo: int, hi: int, end: int, cap: int) -> Iterator[tuple[int, bytes | None]]:
    """(start, line) of the lines that start in [lo, hi) and end before ``end``; None for one of more than ``cap`` bytes.

    A break just before ``lo`` is where its first line starts, so callers give a ``lo`` that is 0 or any byte of the file."""
    with open(path, "rb") as f:
        at = lo
        f.seek(lo)
        rest, start, length, over = b"", lo, 0, False
        while at < end:
            data = f.read(min(BLOCK, end - at))
            if not data:
                break
            at += len(data)
            pieces = data.split(b"\n")
            for i, piece in enumerate(pieces):
                length += len(piece)
                over = over or length > cap
                rest = b"" if over else rest + piece
                if i < len(pieces) - 1:
                    yield start, None if over else rest
                    start, rest, length, over = start + length + 1, b"", 0, False
                    if start >= hi:
                        return
        if length and start < hi:  # a whole file's last line without a break
            yield start, None if over else rest


@dataclass
class Piece(InputPartition):
    inode: int
    name: str
    lo: int
    hi: int
    end: int


class Follower(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.pattern = options["path"]
        self.cap, self.split = int(options.get("linecap", 2 << 20)), int(options.get("splitbytes", 64 << 20))

    def files(self) -> list[str]:
        return sorted(p for p in ({self.pattern} if os.path.exists(self.pattern) and not os.path.isdir(self.pattern) else glob.glob(self.pattern)) if os.path.isfile(p))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for p in self.files():
            try:
                st = os.stat(p)
                n = min(HEAD, st.st_size)
                out[p] = {"inode": st.st_ino, "pos": last_break(p, st.st_size), "n": n, "sig": signature(p, n)}
            except FileNotFoundError:  # moved away between listing and reading: it is found by its inode next time
                continue
        return out

    def sibling(self, path: str, inode: int) -> str | None:
        """The file beside ``path`` that has this inode, itself or one whose name goes on from its name."""
        for p in [path, *sorted(glob.glob(glob.escape(path) + "*"))]:
            try:
                if os.stat(p).st_ino == inode and os.path.isfile(p):
                    return p
            except FileNotFoundError:
                continue
        return None

    def pieces(self, inode: int, name: str, lo: int, end: int) -> list[Piece]:
        return [Piece(inode, name, a, min(a + self.split, end), end) for a in range(lo, end, self.split)]

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out: list[Piece] = []
        for name, now in end.items():
            was, lo = start.get(name), 0
            here = self.sibling(name, now["inode"])
            if was and was["inode"] != now["inode"]:
                old = self.sibling(name, was["inode"])
                if old and os.path.getsize(old) >= was["pos"] and (not was["n"] or signature(old, was["n"]) == was["sig"]):
                    out += self.pieces(was["inode"], name, was["pos"], os.path.getsize(old))
            elif was and here and now["pos"] >= was["pos"] and (not was["n"] or signature(here, was["n"]) == was["sig"]):
                lo = was["pos"]
            if here and lo < now["pos"]:
                out += self.pieces(now["inode"], name, lo, now["pos"])
        return out or [Piece(0, "", 0, 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        p = partition
        if not p.name:
            return
        path = self.sibling(p.name, p.inode)  # the file may have been moved since the batch was planned
        if path is None:
            raise FileNotFoundError(f"{p.name}: the file that was followed is gone, {p.end - p.lo} bytes unread")
        held: list[tuple] = []
        size = 0
        # a line that starts in this piece follows a break at lo - 1 or later
        skip = 0
        if p.lo:
            with open(path, "rb") as f:
                f.seek(p.lo - 1)
                at = p.lo - 1
                while at < p.end:
                    data = f.read(min(BLOCK, p.end - at))
                    k = data.find(b"\n")
                    if k >= 0 or not data:
                        skip = (at + k + 1 if k >= 0 else p.end) - p.lo
                        break
                    at += len(data)
                else:
                    return
        if p.lo + skip >= p.hi:
            return
        for start, line in lines(path, p.lo + skip, p.hi, p.end, self.cap):
            if line is not None and not line.strip():
                continue
            held.append((p.name, start, None if line is None else line.decode("utf-8", "replace"), line is None))
            size += len(line or b"")
            if size > 1 << 20 or len(held) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _ARROW.types)], schema=_ARROW)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _ARROW.types)], schema=_ARROW)

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Follower:
        return Follower(self.options)


def follow(spark: SparkSession, path: str, **options):
    """A stream of the lines of growing files below a path or glob."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("logtail").options(**options).load(path)
