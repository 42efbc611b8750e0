"""Fill-in-middle: documents cut into prefix, middle and suffix and put together in another order for training.

A text's units are a word with the white space before it, or white space that ends the text. All rows of a slice of an
Arrow batch are cut together over their UTF-8 bytes: a table gives each byte's class, neighbours whose classes differ mark
where units end, a cumulative sum that starts anew with each document counts them, and one binary search finds the cuts.

Null texts count as empty. A text that is empty or holds a mark (``<P>``, ``<S>``, ``<M>``) stays plain. A null id is drawn
for as the empty string; ids may repeat, equal rows give equal rows. An empty table gives an empty result. Columns beside
``doc_id`` and ``text`` are not read, whatever their names. A slice holds about 4 MB of text or one longer text, so memory
follows the longest text and not the partition. There is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kit

#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


class Units:
    """The units of some texts that lie one after the other in one buffer; text i is ``data[at[i]:at[i + 1]]``."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at
        solid = ~kit.SPACE[data]
        ends = np.zeros(len(data), bool)
        ends[:-1] = solid[:-1] & ~solid[1:]
        ends[at[1:][at[1:] > at[:-1]] - 1] = True  # the last byte of a text ends its last unit, word or not
        self.seen = np.concatenate([[0], np.cumsum(ends)])
        self.before = self.seen[at[:-1]]
        self.n = self.seen[at[1:]] - self.before

    def end(self, k: np.ndarray) -> np.ndarray:
        """Where the first ``k[i]`` units of text i end."""
        return np.where(k > 0, np.searchsorted(self.seen, self.before + k), self.at[:-1])

    def marked(self) -> np.ndarray:
        """Which texts hold a mark."""
        d, found = self.data, np.zeros(len(self.at) - 1, bool)
        at = np.flatnonzero(d[:-2] == ord("<")) if len(d) > 2 else np.zeros(0, int)
        if len(at):
            at = at[np.isin(d[at + 1], [ord(m[1]) for m in MARKS]) & (d[at + 2] == ord(">"))]
            of = np.searchsorted(self.at, at, "right") - 1
            found[of[at + 3 <= self.at[of + 1]]] = True
        return found


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of all pieces, one after the other."""
    after = np.cumsum(length)
    return data[np.repeat(start - (after - length), length) + np.arange(after[-1] if len(after) else 0)]


def arranged(ids: pa.Array, texts: pa.Array, h: list[np.ndarray], rate: int, spm: int) -> pa.RecordBatch:
    """The rows of one slice in their new order."""
    texts = texts.fill_null("").cast(pa.large_string())
    raw, rows = texts.buffers(), len(texts)
    at = np.frombuffer(raw[1], np.int64, rows + 1, texts.offset * 8)
    data = np.frombuffer(raw[2], np.uint8)[at[0] : at[-1]] if raw[2] and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    u = Units(data, at)
    one, two = h[0] % (u.n + 1), h[1] % (u.n + 1)
    a, b = u.end(np.minimum(one, two)), u.end(np.maximum(one, two))
    plain = (u.n == 0) | (h[2] % 100 >= rate) | u.marked()
    front = ~plain & (h[3] % 100 < spm)

    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    marks = np.frombuffer("".join(MARKS).encode(), np.uint8)
    p, s, m = len(data) + 3 * np.arange(3)
    # six pieces a row: mark, text, mark, text, mark, text; a plain row has its text in the last
    start, length = np.empty((rows, 6), np.int64), np.full((rows, 6), 3)
    start[:, 0], start[:, 2], start[:, 4] = np.where(front, s, p), np.where(front, p, s), m
    start[:, 1], length[:, 1] = np.where(front, b, at[:-1]), np.where(front, at[1:] - b, a - at[:-1])
    start[:, 3], length[:, 3] = np.where(front, at[:-1], b), np.where(front, a - at[:-1], at[1:] - b)
    start[:, 5], length[:, 5] = a, b - a
    start[plain, 5], length[plain] = at[:-1][plain], 0
    length[plain, 5] = (at[1:] - at[:-1])[plain]
    out = gather(np.concatenate([data, marks]), start.ravel(), length.ravel())
    ends = np.concatenate([[0], np.cumsum(length.sum(1))])
    output = pa.LargeStringArray.from_buffers(rows, pa.py_buffer(ends), pa.py_buffer(out)).cast(pa.string())
    form = pa.array(np.where(plain, "plain", np.where(front, "spm", "psm")), pa.string())
    count = lambda lo, hi: pa.array(chars[hi] - chars[lo], pa.int64(), mask=plain)
    return pa.RecordBatch.from_arrays([ids, pa.array(u.n, pa.int64()), form, count(at[:-1], a), count(a, b), output], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, limit: int = 4_000_000) -> DataFrame:
    """Each document's number of units, its form (plain, psm or spm), the code points of prefix and middle, and the text to train on.

    ``rate`` of 100 documents are cut, ``spm`` of 100 of these with the suffix first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kit.trim()
        for b in batches:
            for lo, hi in kit.bounds(b.column(1), limit):
                c = b.slice(lo, hi - lo).columns
                yield arranged(c[0], c[1], [x.to_numpy() for x in c[2:]], rate, spm)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *draws(F.col("doc_id"), seed)).mapInArrow(run, SCHEMA)


def restored(rows: DataFrame, output: str = "output", form: str = "form", name: str = "restored") -> DataFrame:
    """``rows`` with the exact text that ``transform`` was given, as column ``name``.

    A text that was cut holds no mark of its own, nor can its pieces form one with a mark beside them."""
    parts, part = kit.fresh("_parts", rows), lambda i: F.get(parts, i)
    whole = F.when(F.col(form) == "psm", F.concat(part(1), part(3), part(2))).when(F.col(form) == "spm", F.concat(part(2), part(3), part(1))).otherwise(F.col(output))
    return rows.withColumn(parts, F.split(output, f"<[{''.join(m[1] for m in MARKS)}]>")).withColumn(name, whole).drop(parts)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = restored(transform(kit.read(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(F.col("restored")).alias("restored_sha256"))


SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), numbers AS (
  SELECT doc_id, t, units, CAST(len(units) AS BIGINT) AS n,
    CAST('0x' || substr(hex, 1, 8) AS BIGINT) % (len(units) + 1) AS one, CAST('0x' || substr(hex, 9, 8) AS BIGINT) % (len(units) + 1) AS two,
    CAST('0x' || substr(hex, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(hex, 25, 8) AS BIGINT) % 100 AS h4
  FROM drawn
), cuts AS (
  SELECT doc_id, t, n,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 50 THEN 'plain' WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(units[1:least(one, two)], '') AS p, array_to_string(units[least(one, two) + 1:greatest(one, two)], '') AS m, array_to_string(units[greatest(one, two) + 1:], '') AS s
  FROM numbers
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cuts
"""
