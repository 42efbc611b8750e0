"""Addresses whose last part outgrew its place: the tables number sources without an end, and the SQL counts all of them."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from sentrymill.functions import net
from sentrymill.plans import registry
from tests.test_queries import plain

DATA = "/root/testdata/sf0.001"
NAMES = [
    "admin_events",
    "admin_filter",
    "askable_addresses",
    "cached_answers",
    "country_fallback",
    "followed_logs",
    "host_verdicts",
    "incremental_equals_full",
    "journal_parse",
    "public_sources",
    "report_vetting",
    "report_plan",
    "report_suggestions",
    "skipped_lines",
]


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """The smallest events, numbered like those of a larger table."""
    folder = tmp_path_factory.mktemp("wide")
    more = spark.read.parquet(f"{DATA}/events.parquet").withColumn("user_id", F.col("user_id") * 97 + 230).withColumn("event_id", F.col("event_id") * 150)
    more.toPandas().to_parquet(f"{folder}/events.parquet", coerce_timestamps="us")
    return str(folder)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the provided tables")
@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, wide, name):
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{wide}/events.parquet'")
    assert plain(registry.queries()[name](spark, wide).toPandas()) == plain(c.execute(registry.oracle_sql()[name]).df())


def test_fitted(spark):
    cases = {"45.67.1.255": "45.67.1.255", "45.67.1.256": "45.67.1.255", "45.67.1.90000": "45.67.1.255", "45.67.256.9": "45.67.256.9", "45.67.1.0256": "45.67.1.0256", "45.67.1.900\n": "45.67.1.900\n", "1.2.3": "1.2.3", "a": "a", "2a00:150d8::1": "2a00:50d8::1", "2a00:50d8::1": "2a00:50d8::1", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "ip string")
    assert {r[0]: r[1] for r in df.select("ip", net.fitted(F.col("ip"))).collect()} == cases
    # only who asks for it reads such texts as addresses, and only blocks that the first three parts decide hold them
    asked = spark.createDataFrame([("45.67.3.1500",)], "ip string").select(net.is_public(F.col("ip")), net.in_set(F.col("ip"), ("45.67.3.0/24",)), net.in_set(F.col("ip"), ("45.67.3.0/24",), fit=True), net.in_set(F.col("ip"), ("45.67.3.128/25", "45.67.3.255"), fit=True))
    assert tuple(asked.collect()[0]) == (False, False, True, False)
