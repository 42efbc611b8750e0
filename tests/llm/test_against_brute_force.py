"""Operators on the small tables against plain Python, and models on rows they have not seen."""

from __future__ import annotations

import collections
import hashlib
import math
import os
import re
import zlib

import numpy as np
import pytest

from sentrymill.llm import caps, fingerprints, jaccard, kit, langid, lines, links, ngrams, packing, sentencepieces, substrings, toxicity

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the provided tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").repartition(4).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_winnowing(docs, texts):
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    order = sorted(texts)
    for d, nxt in zip(order, order[1:] + order[:1]):
        t, q = texts[d], len(texts[d]) // 4
        e = t[: len(t) - q] + texts[nxt][:q]
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        if d < 25:
            assert got[d]["fingerprint"] == _plain_winnow(t) and got[d]["edited_fingerprint"] == _plain_winnow(e)
    assert np.median([r["near_edited"] for r in got.values()]) > 0.7


def _plain_winnow(t, k=16, w=48):
    if len(t) < k:
        return fingerprints.encoded(*fingerprints.winnow([t])[0])
    g = (fingerprints._grams(np.frombuffer(t.encode("utf-32-le"), "<u4").astype(np.uint64), k) >> np.uint64(32)).tolist()
    out = []
    for i in range(max(1, len(g) - w + 1)):
        win = g[i : i + w]
        j = i + max(x for x, v in enumerate(win) if v == min(win))
        if not out or out[-1][1] != j:
            out.append((g[j], j))
    return "".join("%08x%08x" % x for x in out)


def test_lines(docs, texts):
    got = {r["doc_id"]: r["removed"] for r in lines.removals(docs).collect()}
    ids: dict = {}
    seen = [(d, i, ids.setdefault(n, len(ids))) for d in sorted(texts) for i, x in enumerate(texts[d].split("\n")) if (n := lines.normal(x))]
    sets = [{n[i : i + 5] for i in range(max(1, len(n) - 4))} for n in ids]
    up = Union()
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    for x, a in enumerate(order):
        for b in order[x + 1 :]:
            if 0.8 * len(sets[b]) > len(sets[a]):
                break
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                up.join(a, b)
    gone, first = collections.defaultdict(list), set()
    for d, i, n in seen:
        if up.find(n) in first:
            gone[d].append(i)
        first.add(up.find(n))
    wrong = sum(got[d] != gone[d] for d in texts)
    assert wrong <= 1  # banding finds 99.6 % of pairs at the threshold


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_jaccard(docs, texts, k, num):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs, k, num).collect()}
    sets = {}
    for d, t in texts.items():
        w = WORD.findall(t.translate(LOWER))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    up = Union()
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                up.join(a, b)
    assert got == {d: (len(s), up.find(d)) for d, s in sets.items()}


def test_substrings(docs, texts):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.dedup(docs).collect()}
    words = {d: WORD.findall(t) for d, t in texts.items()}
    count = collections.Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert got[d] == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_hot_windows_are_split(docs):
    plain = {r["doc_id"]: r for r in substrings.dedup(docs).collect()}
    seen, cut = substrings.repeats(docs, 35, hot=1)  # every repeated minimiser counts as hot
    got = {(r["_h1"], r["_h2"]): r["_gone"] for r in substrings._trim(cut, 35, False).collect()}
    for r in seen.collect():
        if r["_w"] == 1:
            assert plain[r["doc_id"]]["n_removed"] == got.get((r["_h1"], r["_h2"]), 0)


def test_language_on_held_out(docs):
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = [r for r in langid.predict(docs, langid.learn(docs)).collect() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got]) > 0.95


def test_field_messages_equal_enumeration():
    rng = np.random.default_rng(1)
    m = langid.Chain(["a", "b", "c"])
    m.trans = rng.normal(size=(3, 3)).astype(np.float32)
    emit = rng.normal(size=(71, 3)).astype(np.float32)
    first = np.array([0, 70, 70, 71])
    p = m.marginals(emit, first)
    q, _ = m._marginals(emit[None, :70])
    assert np.allclose(p[:70], q[0], atol=1e-4)


def test_scoring(docs, texts):
    got = {r["doc_id"]: r for r in ngrams.score(docs).collect()}
    tokens = {d: WORD.findall(t.translate(LOWER)) + [None] for d, t in texts.items()}
    c = collections.Counter(x for d, w in tokens.items() if zlib.crc32(str(d).encode()) % 5 != 1 for x in w)
    n, v = sum(c.values()), len(c)
    base = held = size = 0.0
    for d, w in tokens.items():
        want = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], want, rel_tol=1e-9)
        if r["held_out"]:
            base, held, size = base + want, held + r["score"], size + len(w)
    assert held / size > base / size  # the mixture beats the base on unseen texts


def test_mixture_is_a_distribution():
    lam = ngrams.weights([((3 * 128 + 5) * 128 + 20, 10, 5.0, 0.1), (2 * 128 * 128 + 30, 4, 0.0, 0.2)], 100)
    assert np.allclose(lam.sum(1), 1) and (lam >= 0).all() and lam[0, 0] == 0


def test_toxicity_on_held_out(spark):
    d, lab = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    y = {r["doc_id"]: r["toxic"] for r in lab.collect()}
    got = [(y[r["doc_id"]], r["_score"], r["_predicted"]) for r in toxicity.score(d, lab).collect() if y.get(r["doc_id"]) is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    pos, neg = [s for t, s, _ in got if t], [s for t, s, _ in got if not t]
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert auc > 0.75 and sum(p for t, _, p in got if not t) <= 0.03 * len(neg)


def test_packing(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: whole.encode(t, add_special_tokens=False).ids + [0] for d, t in texts.items()}
    total, by, got = 0, collections.defaultdict(list), packing.pack(docs).collect()
    for r in got:
        x = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(x) == r["length"] and zlib.crc32(np.array(x, "<u4").tobytes()) == r["ids_crc32"]
        assert r["length"] == 2048 or r["piece"] == 0
        by[r["sequence_id"]].append((r["offset"], r["length"]))
        total += r["length"]
    for v in by.values():
        assert sum(n for _, n in v) <= 2048 and [o for o, _ in sorted(v)] == list(np.cumsum([0] + [n for _, n in sorted(v)])[:-1])
    assert total == sum(map(len, ids.values())) and len(by) <= math.ceil(total / 2048) + 1


def test_search_empties_bins():
    bins = packing.improve([[0, 1], [2, 3], [4]], [900, 700, 1000, 600, 400], 2000)
    assert len(bins) == 2 and sorted(i for b in bins for i in b) == [0, 1, 2, 3, 4]
    assert packing._exchange([0], [1], [500, 300], 250) == ((0,), (1,))


def test_special_token_text_and_chunks():
    e = packing.Encoder()
    for t in ("a<|endoftext|>b", "x  \n\n y ", "\x1c!\x1c a", "l'été don't 12345  ", " leading", "日本　語"):
        assert np.frombuffer(e(t), "<u4").tolist() == e.whole.encode(t, add_special_tokens=False).ids


def test_pieces(docs, texts, spark):
    import public_tokenizers
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    odd = ["Hello  world\n  foo\tbar ", "", "  ", " x", "日本 é 👍", "a" * 300 + " " + "xyz" * 90, "▁a b"]
    m = sentencepieces.model("piece_bpe_32k.model")
    every = [*list(texts.values())[:40], *odd]
    bounds, ids = sentencepieces.encode_texts(m, every)
    for i, t in enumerate(every):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == s.encode(t)
    words = sorted({" " + w for t in list(texts.values())[:2] for w in t.split()})[:60]
    for fold in ("bpe", "viterbi"):
        rel = {r["word"]: r["pieces"] for r in sentencepieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), fold=fold).collect()}
        was, m.bpe = m.bpe, fold == "bpe"
        try:
            b, flat = sentencepieces.encode_texts(m, [w[1:] for w in words])
        finally:
            m.bpe = was
        for i, w in enumerate(words):
            mine = [m.bytes_of[k] for k in flat[b[i] : b[i + 1]]]
            assert b"".join(x.encode() for x in rel[w]) == b"".join(mine) == w.encode()
            if fold == "bpe":
                assert len([x for x in rel[w] if x.encode() in m.bytes_of]) <= len(mine)


def test_caps_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 64))
    x = np.concatenate([x, x[:150] + 0.3 * rng.normal(size=(150, 64)), x[:20]]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in caps.near(df).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (y @ y.T >= 0.9).sum(1) - 1
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.98 * want.sum()


@pytest.mark.parametrize("dim", [64, 256])
def test_caps_recall_of_pairs_at_the_threshold(dim):
    rng = np.random.default_rng(5)
    x, z = rng.normal(size=(2, 800, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    for vectors in (50_000, 5_000_000):  # books of 128 and of 2048 words
        code = caps.Code(dim, *caps.sized(vectors))
        met = [len(np.intersect1d(p, q)) > 0 for p, q in zip(code.lists(x), code.lists(0.9 * x + 0.19**0.5 * z))]
        assert np.mean(met) >= 0.97


def test_caps_give_the_same_whatever_the_books(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 32))
    x = np.concatenate([x, x[:100] + 0.2 * rng.normal(size=(100, 32))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "x", 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, _cls string, _w int")
    a, b = ({tuple(r) for r in caps.near(df, held=h).collect()} for h in (256, 1))
    assert len(a) == 300 and len(a - b) <= 4


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)] + [(1000, i) for i in range(1001, 1200)]
    up = Union()
    for a, b in edges:
        up.join(a, b)
    got = {r["id"]: r["component"] for r in links.components(spark.createDataFrame(edges, "u long, v long").repartition(6)).collect()}
    for x in {n for e in edges for n in e}:
        assert got.get(x, x) == up.find(x)


def test_large_groups_are_dealt_in_blocks(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[:38], rng.integers(0, 2**63, 2, dtype=np.uint64)])) for _ in range(60)] + [np.unique(rng.integers(0, 2**63, 40, dtype=np.uint64)) for _ in range(5)]
    df = spark.createDataFrame([(1, i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "grp long, id long, body binary")
    for size in (10**9, 4000):
        blocks = links.blocks_of(df.selectExpr("grp", "length(body) as bytes"), size)
        got = {r["id"]: r["component"] for r in links.link_groups(df.join(blocks, "grp"), lambda bs: [np.frombuffer(b, np.uint64) for b in bs], 80, 100).collect()}
        assert got == {i: 0 for i in range(1, 60)}
