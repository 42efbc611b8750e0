"""Where addresses are: longest match against blocks of places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, scratch
from .base import query

#: Addresses of both kinds that the events stand for; both dialects read this text.
SEEN_SQL = """
SELECT DISTINCT ip, hex8, kind FROM (
  SELECT src_ip AS ip, '' AS hex8, 4 AS kind FROM hp
  UNION ALL SELECT concat('45.', CAST(60 + id % 9 AS STRING), '.', CAST(CAST(floor(id / 9) AS INT) % 64 AS STRING), '.', CAST(id % 251 AS STRING)), '', 4 FROM hp
  UNION ALL SELECT concat('2001:db8:', lower(hex(id % 37)), '::', lower(hex(id % 251))), lower(concat(lpad(hex(id % 37), 4, '0'), lpad(hex(id % 251), 4, '0'))), 6 FROM hp
)
"""
#: Blocks that follow from the events: nested ones, one kind without code and coordinates, which says nothing.
BLOCKS_SQL = """
SELECT DISTINCT concat('45.', CAST(60 + id % 9 AS STRING), '.0.0/16') AS network, concat('C', CAST(id % 9 AS STRING)) AS cc, concat('Land ', CAST(id % 9 AS STRING)) AS country, '' AS city, id % 9 + 0.5 AS lat, id % 9 - 20.25 AS lon FROM hp WHERE id % 9 % 3 <> 0
UNION ALL SELECT DISTINCT concat('45.', CAST(60 + id % 9 AS STRING), '.', CAST(CAST(floor(id / 9) AS INT) % 64 AS STRING), '.128/26'), 'DD', 'Land D', concat('City ', CAST(CAST(floor(id / 9) AS INT) % 64 AS STRING)), 1.5, 2.5 FROM hp WHERE CAST(floor(id / 9) AS INT) % 64 % 4 = 0
UNION ALL SELECT DISTINCT concat('45.', CAST(60 + id % 9 AS STRING), '.', CAST(CAST(floor(id / 9) AS INT) % 64 AS STRING), '.0/24'), '', '', '', 0.0, 0.0 FROM hp WHERE CAST(floor(id / 9) AS INT) % 64 % 8 = 3
UNION ALL SELECT DISTINCT concat('45.67.', CAST(CAST(floor(id / 9) AS INT) % 64 % 7 AS STRING), '.', CAST(id % 251 - id % 251 % 4 AS STRING), '/30'), 'EE', 'Land E', 'Block', -3.5, 4.5 FROM hp WHERE id % 5 = 0
UNION ALL SELECT DISTINCT '100.64.0.0/10', 'FF', 'Shared', '', 7.0, 8.0 FROM hp
UNION ALL SELECT DISTINCT '2001:db8::/32', 'GG', 'Wide', '', 9.0, 10.0 FROM hp
UNION ALL SELECT DISTINCT concat('2001:db8:', lower(hex(id % 37)), '::/48'), 'HH', 'Land H', concat('Net ', lower(hex(id % 37))), 11.0, 12.0 FROM hp WHERE id % 37 % 2 = 0
UNION ALL SELECT DISTINCT concat('2001:db8:', lower(hex(id % 37)), '::', lower(hex(id % 251 - id % 251 % 8)), '/125'), 'II', 'Land I', 'Few', 13.0, 14.0 FROM hp WHERE id % 37 = 5
"""
FIELDS = ["cc", "country", "city", "lat", "lon"]


def places(spark: SparkSession, hp: DataFrame) -> DataFrame:
    """The blocks with their bounds; a place without code and coordinates is a miss."""
    got = spark.sql(BLOCKS_SQL.replace("FROM hp", "FROM {hp}"), hp=hp)
    got = got.withColumn("b", blocks.from_cidr(F.col("network")))
    known = ~((F.col("cc") == "") & (F.col("lat") == 0) & (F.col("lon") == 0))
    return got.select("b.start", "b.bits", *[F.when(known, F.col(c).cast("double" if c in ("lat", "lon") else "string")).alias(c) for c in FIELDS])


NUMBERS = f"""seen AS ({SEEN_SQL}), parts AS (
  SELECT ip, kind, hex8, CASE WHEN kind = 4 THEN list_transform(string_split(ip, '.'), lambda x: CAST(x AS UBIGINT)) END AS p FROM seen
), numbers AS (
  SELECT ip, CASE WHEN kind = 6 THEN concat('20010db8', hex8[1:4], '0000000000000000', hex8[5:8])
                  WHEN list_max(p) < 256 THEN lpad(lower(printf('%x', ((p[1] * 256 + p[2]) * 256 + p[3]) * 256 + p[4])), 32, '0') END AS k FROM parts
), nets AS (
  SELECT *, string_split(network, '/')[1] AS head, CAST(string_split(network, '/')[2] AS INT) AS given FROM ({BLOCKS_SQL}) b
), cut AS (
  SELECT *, given + CASE WHEN contains(head, ':') THEN 0 ELSE 96 END AS bits,
    CASE WHEN contains(head, ':') THEN concat('20010db8', CASE WHEN head = '2001:db8::' THEN '0000' ELSE lpad(string_split(head, ':')[3], 4, '0') END, '0000000000000000', lpad(string_split(head, ':')[-1], 4, '0'))
         ELSE lpad(lower(printf('%x', list_reduce(list_transform(string_split(head, '.'), lambda x: CAST(x AS UBIGINT)), lambda a, x: a * 256 + x))), 32, '0') END AS lo
  FROM nets
), span AS (
  SELECT *, CASE WHEN given + 96 = bits THEN lpad(lower(printf('%x', CAST('0x' || lo[25:32] AS UBIGINT) + (CAST(1 AS UBIGINT) << (128 - bits)) - 1)), 32, '0')
                 ELSE concat(lo[1:CAST(bits // 4 AS INT)], CASE WHEN bits % 4 = 0 THEN '' ELSE lower(printf('%x', CAST('0x' || lo[bits // 4 + 1:bits // 4 + 1] AS UBIGINT) + (1 << (4 - bits % 4)) - 1)) END, repeat('f', 32 - CAST(ceil(bits / 4) AS INT))) END AS hi
  FROM cut
), best AS (
  SELECT n.ip, arg_max({{'cc': cc, 'country': country, 'city': city, 'lat': CAST(lat AS DOUBLE), 'lon': CAST(lon AS DOUBLE)}}, bits) AS hit FROM numbers n JOIN span s ON n.k BETWEEN s.lo AND s.hi GROUP BY n.ip
), found AS (SELECT ip, hit FROM best WHERE NOT (hit.cc = '' AND hit.lat = 0 AND hit.lon = 0))"""


@query("city_lookup", "SELECT n.ip, hit.cc AS cc, hit.country AS country, hit.city AS city, hit.lat AS lat, hit.lon AS lon FROM numbers n LEFT JOIN found f ON f.ip = n.ip", NUMBERS)
def _(spark, hp, sf_dir):
    """The place of every source address of either kind; null where no block or an empty one holds it."""
    seen = spark.sql(SEEN_SQL.replace("FROM hp", "FROM {hp}"), hp=hp)
    return blocks.lookup(seen, "ip", places(spark, hp), FIELDS)


@query(
    "events_by_city",
    "SELECT coalesce(hit.cc, '') AS cc, coalesce(hit.city, '') AS city, count(*) AS n, count(DISTINCT hp.src_ip) AS ips FROM hp LEFT JOIN found f ON f.ip = hp.src_ip GROUP BY ALL",
    NUMBERS,
)
def _(spark, hp, sf_dir):
    """Events and addresses a place: events are counted by address before they meet their place."""
    counts = scratch.cut(hp.groupBy("src_ip").agg(F.count("*").alias("n")))
    found = blocks.lookup(counts, "src_ip", places(spark, hp), FIELDS)
    cc, city = (F.coalesce(c, F.lit("")).alias(c) for c in ("cc", "city"))
    return counts.join(found, "src_ip", "left").groupBy(cc, city).agg(F.sum("n").alias("n"), F.count("*").alias("ips"))
