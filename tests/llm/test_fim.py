"""Fill-in-middle against a plain version that works on one text at a time."""

import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentrymill.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc_id, text, rate=50, spm=80):
    t = text or ""
    units = UNIT.findall(t)
    d = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in fim.MARKS) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, t
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: repr(r)
    got = fim.restored(fim.transform(df, **how)).collect()
    want = [plain_version(i, t, how.get("rate", 50)) for i, t in rows]
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    assert sorted(r["restored"] for r in got) == sorted(t or "" for _, t in rows)


def test_edges(spark):
    odd = [None, "", " ", "\t\n ", "a", " a", "a ", "  é ü  ", "a b", "x<P>y", "<", "<S", "a <M", "S> b", "M><P", "<<S>", "\x0b\x0c", "日本 語 ", "a\x00b c", "😀 😀\n"]
    check(spark, [(i, t) for i in [None, 0, 1, 2, 3, -5, 2**62] for t in odd * 2], rate=100)
    check(spark, [(i, t) for i, t in enumerate(odd * 10)], rate=100, limit=8)
    check(spark, [(1, "word " * 400_000), (2, ""), (3, "tail")], rate=100)
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string, n long, output string")).count() == 0


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=" \t\n<PSM>aé日😀 ", max_size=24), min_size=1, max_size=60))
def test_any_text(spark, texts):
    check(spark, list(enumerate(texts)), rate=100)


def test_clashing_names(spark):
    df = spark.createDataFrame([(7, "a b c", "x", 1)], "doc_id int, text string, _parts string, restored int")
    assert tuple(fim.transform(df).first()) == plain_version(7, "a b c")


def test_query_and_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"

    db = duckdb.connect()
    db.sql(f"create view documents as from '{sf}/documents.parquet'")
    got = sorted(map(tuple, fim.op11_fim(spark, sf).collect()))
    assert got == sorted(db.sql(fim.SQL).fetchall()) and {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.op11_fim(spark, sf).where(F.col("restored_sha256").isNull()).count() == 0
