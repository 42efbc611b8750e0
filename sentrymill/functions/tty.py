"""Terminal recordings: frames of a binary log and the transcript that they make."""

from __future__ import annotations

import codecs
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the format: operation and direction numbers, header layout, caps.
OPEN, CLOSE, WRITE, EXEC = 1, 2, 3, 4
INPUT, OUTPUT, INTERACT = 1, 2, 3
HEADER = struct.Struct("<iiiiII")
FRAME_CAP, TEXT_CAP = 16 << 20, 256 << 10
_FRAME = T.StructType([T.StructField("us", T.LongType()), T.StructField("op", T.IntegerType()), T.StructField("direction", T.IntegerType()), T.StructField("data", T.BinaryType())])


def decode(log: bytes) -> list[tuple[int, int, int, bytes]]:
    """(microseconds, op, direction, data) of each frame; a torn end keeps what is there, an oversized frame ends the log."""
    out, at = [], 0
    while at + HEADER.size <= len(log):
        op, _, size, direction, sec, usec = HEADER.unpack_from(log, at)
        at += HEADER.size
        data = b""
        if size > 0 and op in (WRITE, EXEC):
            if size > FRAME_CAP:
                break
            data = log[at : at + size]
            at += size
        out.append((sec * 1_000_000 + usec, op, direction, data))
    return out


class Plain:
    """Text without terminal control: escape sequences may be split over frames, as may characters."""

    def __init__(self):
        self.state, self.text = "", codecs.getincrementaldecoder("utf-8")("replace")

    def __call__(self, data: bytes) -> str:
        out = []
        for c in self.text.decode(data):
            if self.state == "esc":
                self.state = {"[": "csi", "]": "osc"}.get(c, "")
            elif self.state == "csi":
                self.state = "" if "@" <= c <= "~" else "csi"
            elif self.state == "osc":
                self.state = "" if c == "\a" else "osc-esc" if c == "\x1b" else "osc"
            elif self.state == "osc-esc":
                self.state = "" if c == "\\" else "osc"
            elif c == "\x1b":
                self.state = "esc"
            elif c in "\n\t" or c.isprintable():
                out.append(c)
            elif c == "\r":
                out.append("\n")
        return "".join(out)


def transcript(log: bytes, output: bool = True) -> str:
    plain = {True: Plain(), False: Plain()}
    parts, size = [], 0
    for _, op, direction, data in sorted(decode(log), key=lambda f: f[0]):
        typed = op == EXEC or (op == WRITE and direction in (INPUT, INTERACT))
        if not typed and not (output and op == WRITE and direction == OUTPUT):
            continue
        parts.append(plain[typed](data))
        size += len(parts[-1].encode())
        if size > TEXT_CAP:
            return "".join(parts).encode()[:TEXT_CAP].decode("utf-8", "ignore") + "\n[transcript cut]\n"
    return "".join(parts)


def _frames(log: pd.Series) -> pd.Series:
    return log.map(lambda b: [dict(zip(("us", "op", "direction", "data"), f)) for f in decode(bytes(b or b""))])


def _rendered(log: pd.Series) -> pd.Series:
    return log.map(lambda b: transcript(bytes(b or b"")))


def frames(log: Column | str) -> Column:
    """Frames of a binary column; made when used, as it needs a session."""
    return F.pandas_udf(_frames, T.ArrayType(_FRAME))(log)


def rendered(log: Column | str) -> Column:
    return F.pandas_udf(_rendered, T.StringType())(log)
