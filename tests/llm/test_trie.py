"""The conversation trie against a plain version, and its SQL."""

import hashlib
import random
import zlib

import pytest

from sentrymill.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, node string, len int"


def plain_rebuilt(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    base = lambda c: c - (abs(c) % 100) * (1 if c >= 0 else -1)
    cut = lambda c: zlib.crc32(str(c).encode()) % 6
    return own, {c: own.get(base(c), [])[: cut(c)] + v[cut(c) :] for c, v in own.items()}


def plain_trie(convs):
    nodes = {}
    for c, path in convs.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    kids, leaves, saved = {}, dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] += p not in kids
        saved[p] += (len(nodes[p]) - 1) * len(p[-1][1]) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(nodes[p]) if len(convs[c]) == len(p)).encode()).hexdigest()
    return {(min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], ends(p)) for p, m in nodes.items()}


def rows(seed, n=260, deep=0):
    rng = random.Random(seed)
    say = lambda: rng.choice(["", None, "hallo", "wie geht es", "é😀", "ja", "a:b", "nein " * rng.randrange(3)])
    out = []
    for c in rng.sample(range(-250, 700), n):
        for t in range(rng.randrange(1, 8)):
            out.append((c, rng.choice([None, t, t, t, t]), rng.choice(["user", "assistant", None]), say()))
    out += [(c, t, "user", f"step {t}") for c in (900, 1000, 1100) for t in range(deep)]
    return out + [(None, 1, "user", "of nobody"), (800, 3, "user", "alone"), (800, 3, "user", "alone"), (801, None, None, None)]


def frame(spark, data):
    return spark.createDataFrame([(*r, 1, "clash", 2) for r in data], SCHEMA).repartition(4)


@pytest.mark.parametrize("seed,deep,block", [(1, 0, 100_000), (2, 11, 2)])
def test_against_plain_version(spark, monkeypatch, seed, deep, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    data = rows(seed, deep=deep)
    df, (own, rebuilt) = frame(spark, data), plain_rebuilt(data)
    assert any(not p for p in rebuilt.values())  # turnless ones count
    got = trie.build(*trie.rebuilt(trie.turns(df))).collect()
    assert {tuple(r) for r in got} == plain_trie(rebuilt) and len({(r["conv_id"], r["depth"]) for r in got}) == len(got)
    got = trie.trie(df).collect()
    assert {tuple(r) for r in got} == plain_trie(own) and len(got) == len(plain_trie(own))


def test_one_conversation_and_none(spark):
    assert trie.trie(frame(spark, [])).count() == 0 and trie.trie(frame(spark, [(None, 1, "user", "x")])).count() == 0
    for data in ([(5, 1, "user", "x"), (5, 2, "user", "")], [(5, 1, None, None)]):
        assert {tuple(r) for r in trie.trie(frame(spark, data)).collect()} == plain_trie(plain_rebuilt(data)[0])


def test_copies_and_a_hot_turn(spark):
    data = [(c, t, "user", f"t{t}") for c in range(4000) for t in range(3)] + [(c, 3, "user", str(c % 7)) for c in range(0, 4000, 2)]
    assert {tuple(r) for r in trie.trie(frame(spark, data)).collect()} == plain_trie(plain_rebuilt(data)[0])


def test_a_long_conversation_is_a_chain(spark):
    data = [(1, t, "user", str(t)) for t in range(30_000)] + [(2, 0, "user", "0")]
    got = trie.trie(frame(spark, data))
    assert got.count() == 30_001 and got.where("n_convs = 2").count() == 2 and got.agg({"depth": "max"}).first()[0] == 30_000


def test_query_and_sql(spark):
    import duckdb

    sf, db = "/root/testdata/sf0.01", duckdb.connect()
    db.sql(f"create view conversations as from '{sf}/conversations.parquet'")
    got = trie.op12_trie(spark, sf)
    want = db.sql(trie.SQL)
    assert got.columns == want.columns and sorted(map(tuple, got.select([got[c] for c in got.columns]).collect()), key=str) == sorted(want.fetchall(), key=str)
