"""Running totals, numbers and digests of groups that lie in several partitions."""

import hashlib
import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from sentrymill.operators import running as R


def rows(n, seed=1):
    rng = random.Random(seed)
    group = lambda: rng.choice(["hot"] * 6 + [None, "a", "b", "ü"])
    return [(group(), rng.randrange(n), i, rng.choice([None, *range(9)])) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 7, 3000])
def test_running_totals(spark, n):
    data = rows(n)
    df = spark.createDataFrame(data, "g string, o int, i int, v int").repartition(5)
    got = R.running(df, ["g"], [F.col("o"), F.col("i")], {"total": "v"}).collect()
    want = {}
    for g, own in groupby(sorted(data, key=lambda r: (r[0] or "", r[1], r[2])), key=lambda r: r[0]):
        t = 0
        for r in own:
            t += r[3] or 0
            want[r[2]] = t
    assert {r["i"]: r["total"] for r in got} == want and len(got) == n


def test_numbers_of_one_group_and_of_none(spark):
    df = spark.range(5000).withColumn("g", F.lit(None).cast("string"))
    got = R.numbered(df, ["g"], [F.desc("id")], "place").collect()
    assert {r["id"]: r["place"] for r in got} == {i: 5000 - i for i in range(5000)}
    got = R.numbered(spark.range(100), [], [F.col("id")], "place", keep=["id"]).collect()
    assert {r["id"]: r["place"] for r in got} == {i: i + 1 for i in range(100)}


def test_equal_rows_get_different_places(spark):
    df = spark.createDataFrame([("a", 1)] * 500, "g string, o int").repartition(3)
    assert sorted(r["place"] for r in R.numbered(df, ["g"], [F.col("o")], "place").collect()) == list(range(1, 501))


@pytest.mark.parametrize("chunk", [1, 40, 1 << 16])
def test_digests(spark, chunk):
    data = rows(2500, 2)
    df = spark.createDataFrame(data, "g string, o int, i int, v int").repartition(5)
    got = {r["g"]: r["sum"] for r in R.digested(df, ["g"], "i", "v", "sum", chunk=chunk).collect()}
    want = {}
    for g, _, i, v in data:
        want.setdefault(g, []).append("" if v is None else str(v))
    assert got == {g: hashlib.sha256(",".join(t).encode()).hexdigest() for g, t in want.items()}
    assert R.digested(df.limit(0), ["g"], "i", "v", "sum").count() == 0
    whole = R.digested(df, [], "i", "v", "sum", "|", "<", ">", chunk).first()["sum"]
    assert whole == hashlib.sha256(("<" + "|".join("" if r[3] is None else str(r[3]) for r in data) + ">").encode()).hexdigest()
