"""Conversation prefix trie: which first turns conversations share, and what computing shared turns once would save.

A node is a distinct sequence of first turns and is known by its depth and the smallest conv_id among its members. The trie
is built level by level: a level groups the live conversations by (parent node, next turn) and gives each group its smallest
conv_id. A conversation stays live while it shares its node; one that is alone goes on as a chain whose rows follow from its
length, so there are as many levels as the longest shared prefix has turns. Then joins from the deepest level upwards roll
up children, leaves and savings.

A turn is known by 128 bits of the SHA-256 of role and text (null: empty), so texts are shuffled once, when turns are put in
order. Turns of equal number are ordered by role, then text; repeated rows are turns of their own. Rows whose conv_id is null
belong to no conversation and are left out. An empty table has no conversation and so no nodes. Other columns are not read.

Hot groups: turns are numbered by ranges (see ``operators.running``), so a conversation may be of any length; a node that more
than a thousandth of the live conversations share meets them by broadcast (fewer than 1000 such nodes a level, whatever the
input), all others by a shuffle; counts are added up before they travel. A node's digest of ended conversations is computed
from chunks that ranges of ids have joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import running, scratch
from . import kit

NOTHING = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
#: Turns of one conversation that meet in one join key, and depths that a row explodes to at once.
BLOCK = 100_000


def long(n: int | None) -> Column:
    return F.lit(n).cast("long")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth from 1, turn, chars) of every turn: conversations in the order of their turns, null numbers first."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_at"), role.alias("_role"), text.alias("_text"),
        F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16).alias("turn"), F.length(text).cast("long").alias("chars"),
    )
    return running.numbered(rows, ["conv_id"], [F.col("_at").asc_nulls_first(), F.col("_role"), F.col("_text")], "depth", keep=["turn", "chars"])


def lengths(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.max("depth").alias("len"))


def band(depth: Column) -> Column:
    """Folder of a depth: shallow levels have one each, deeper ones share one with all up to twice their depth."""
    return F.when(depth <= 64, depth).otherwise(F.lit(58) + F.ceil(F.log2(depth))).cast("int")


def rebuilt(turns: DataFrame, group: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of conversations whose first h turns are those of the first conversation of their ``group``.

    h is the CRC-32 of the decimal conv_id modulo ``heads``; a conversation keeps its own turns after its first h."""
    h, base = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads, F.col("conv_id") - F.col("conv_id") % group
    own = lengths(turns)
    of = own.select(F.col("conv_id").alias("_base"), F.col("len").alias("_there"))
    plan = scratch.cut(own.select("conv_id", "len", h.alias("h"), base.alias("_base")).join(of, "_base", "left").withColumn("m", F.least(F.col("h"), F.coalesce("_there", F.lit(0)))))
    # a conversation meets its plan block by block, so that one of any length is spread over tasks
    blocks = plan.select("conv_id", "h", "m", F.explode(F.sequence(F.lit(0), F.expr(f"len div {BLOCK}"))).alias("_block"))
    rest = turns.where(F.col("depth") > h).withColumn("_block", F.expr(f"depth div {BLOCK}")).join(blocks, ["conv_id", "_block"])
    rest = rest.select("conv_id", (F.col("depth") - F.col("h") + F.col("m")).alias("depth"), "turn", "chars")
    firsts = turns.where((F.col("depth") < heads) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "_base")
    taken = plan.where("m > 0").select("conv_id", "_base", "m").join(firsts, "_base").where("depth <= m").select("conv_id", "depth", "turn", "chars")
    return taken.unionByName(rest), plan.select("conv_id", (F.col("m") + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("len"))


def build(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, depth, turn, chars); ``lengths`` (conv_id, len) names every conversation, turnless ones too."""
    spark, n = turns.sparkSession, scratch.parts(turns.sparkSession)
    lengths = scratch.cut(lengths)
    whole = lengths.agg(F.count("*").alias("n"), F.min("conv_id").alias("root")).first()
    if not whole["n"]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    order = ["_band", "depth", "conv_id"]
    turns = scratch.cut(turns.select("conv_id", "depth", "turn", "chars", band(F.col("depth")).alias("_band")).repartitionByRange(n, *order).sortWithinPartitions(*order), by="_band")

    live = scratch.cut(lengths.select("conv_id", long(whole["root"]).alias("node"), "len", long(0).alias("depth")))
    root = scratch.cut(spark.range(1).select(long(None).alias("parent"), F.lit(None).cast("binary").alias("turn"), long(whole["root"]).alias("conv_id"), long(whole["n"]).alias("n_convs"), long(0).alias("chars"), long(0).alias("depth")))
    levels, lives, count = [root], [live], whole["n"]
    while count:
        d = len(levels)
        depth = long(d)
        here = turns.where((F.col("_band") == band(depth)) & (F.col("depth") == d)).select("conv_id", "turn", "chars")
        following = scratch.cut(live.where(F.col("len") >= d).select("conv_id", F.col("node").alias("parent"), "len").join(here, "conv_id"))
        nodes = scratch.cut(following.groupBy("parent", "turn").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars")).withColumn("depth", depth))
        most = max(1, count // 1000)
        shared = nodes.where("n_convs > 1").select("parent", "turn", F.col("conv_id").alias("node"), "n_convs")
        got = following.select("conv_id", "parent", "turn", "len").join(F.broadcast(shared.where(F.col("n_convs") > most).drop("n_convs")), ["parent", "turn"], "left")
        rest = got.where("node is null").drop("node").join(shared.where(F.col("n_convs") <= most).drop("n_convs"), ["parent", "turn"])
        columns = ["conv_id", "node", "len"]
        live = scratch.cut(got.where("node is not null").select(*columns).unionByName(rest.select(*columns)).withColumn("depth", depth))
        scratch.drop(following)
        count = live.count()
        levels.append(nodes)
        lives.append(live)
    scratch.drop(turns)

    above, rolled = None, []
    for level in reversed(levels):
        own = level.where((F.col("n_convs") > 1) | (F.col("depth") == 0)).drop("turn")
        saved = (F.col("n_convs") - 1) * F.col("chars")
        if above is None:
            of = own.select("*", long(0).alias("n_children"), long(1).alias("n_leaves"), saved.alias("saved_tokens"))
        else:
            of = own.join(above, "conv_id", "left").select(*own.columns, F.coalesce("_children", F.lit(0)).alias("n_children"), F.coalesce("_leaves", F.lit(1)).alias("n_leaves"), (saved + F.coalesce("_saved", F.lit(0))).alias("saved_tokens"))
        rolled.append(scratch.cut(of))
        alone = level.where("n_convs = 1 and depth > 0").select("parent", long(1).alias("n_leaves"), long(0).alias("saved_tokens"))
        both = rolled[-1].select("parent", "n_leaves", "saved_tokens").unionByName(alone)
        above = both.groupBy(F.col("parent").alias("conv_id")).agg(F.count("*").alias("_children"), F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))

    ended = scratch.together(lives).where("depth = len").select("depth", F.col("node").alias("conv_id"), F.col("conv_id").alias("_one"))
    ends = running.digested(ended, ["depth", "conv_id"], "_one", "_one", "_ends")
    shared = scratch.together(rolled).join(ends, ["depth", "conv_id"], "left").select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("_ends", F.lit(NOTHING)).alias("ends_sha256"))

    one, none = long(1), long(0)
    alone = scratch.together(levels).where("n_convs = 1 and depth > 0").select("conv_id", "parent", F.col("depth").alias("_from")).join(lengths, "conv_id")
    blocks = alone.select("*", F.explode(F.sequence(F.expr(f"_from div {BLOCK}"), F.expr(f"len div {BLOCK}"))).alias("_block")).repartition(n, "conv_id", "_block")
    chains = blocks.select("*", F.explode(F.sequence(F.greatest(F.col("_from"), F.col("_block") * BLOCK), F.least(F.col("len"), F.col("_block") * BLOCK + BLOCK - 1))).alias("depth"))
    last = F.col("depth") == F.col("len")
    chains = chains.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("_from"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"), F.when(last, none).otherwise(one).alias("n_children"),
        one.alias("n_leaves"), none.alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(NOTHING).alias("ends_sha256"),
    )
    return shared.unionByName(chains)


def trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of conversations as they are: a row a node."""
    rows = turns(conversations)
    return build(rows, lengths(rows))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(*rebuilt(turns(kit.read(spark, sf_dir, "conversations"))))


SQL = r"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), sizes AS (SELECT conv_id, max(pos) AS len FROM own GROUP BY conv_id),
bits AS (
  SELECT conv_id, len, flatten(list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: [ascii(substr(CAST(conv_id AS VARCHAR), CAST(i AS INT), 1)), -1, -1, -1, -1, -1, -1, -1, -1])) AS steps FROM sizes
), plan AS (
  SELECT conv_id, len, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(steps, lambda s: CAST(s AS BIGINT))),
    lambda acc, s: CASE WHEN s >= 0 THEN xor(acc, s) WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384) ELSE acc // 2 END), 4294967295) % 6 AS h FROM bits
), ready AS (SELECT p.*, least(h, coalesce(b.len, 0)) AS m FROM plan p LEFT JOIN sizes b ON b.conv_id = p.base),
turned AS (
  SELECT r.conv_id, o.pos AS depth, o.role, o.text FROM ready r JOIN own o ON o.conv_id = r.base AND o.pos <= r.m
  UNION ALL SELECT r.conv_id, o.pos - r.h + r.m, o.role, o.text FROM ready r JOIN own o ON o.conv_id = r.conv_id AND o.pos > r.h
), whole AS (
  SELECT r.conv_id, count(t.conv_id) AS len, coalesce(list({'r': t.role, 't': t.text} ORDER BY t.depth) FILTER (t.conv_id IS NOT NULL), []) AS path FROM ready r LEFT JOIN turned t ON t.conv_id = r.conv_id GROUP BY r.conv_id
), places AS (SELECT conv_id AS c, len, d AS depth, path[1:d] AS prefix FROM whole, unnest(range(0, len + 1)) AS u(d)),
nodes AS (
  SELECT depth, prefix, min(c) AS conv_id, count(*) AS n_convs, coalesce(length(prefix[depth].t), 0) AS chars,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len = depth), '')) AS ends_sha256 FROM places GROUP BY depth, prefix
), ways AS (SELECT p.c, p.depth, n.conv_id FROM places p JOIN nodes n ON n.depth = p.depth AND n.prefix = p.prefix),
kids AS (SELECT n.depth - 1 AS depth, w.conv_id, count(*) AS n_children FROM nodes n JOIN ways w ON w.c = n.conv_id AND w.depth = n.depth - 1 GROUP BY ALL),
below AS (
  SELECT w.depth, w.conv_id, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved
  FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.conv_id = n.conv_id JOIN ways w ON w.c = n.conv_id AND w.depth <= n.depth GROUP BY ALL
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, b.n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.depth = n.depth AND b.conv_id = n.conv_id LEFT JOIN kids k ON k.depth = n.depth AND k.conv_id = n.conv_id LEFT JOIN ways p ON p.c = n.conv_id AND p.depth = n.depth - 1
"""
