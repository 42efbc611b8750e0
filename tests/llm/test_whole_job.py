"""Operators on rows that an earlier form cut off or passed over."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest

from sentrymill.llm import fingerprints, jaccard, langid, lines, links, packing, substrings

DATA = "/root/testdata/sf0.1"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the provided tables")


@needs_data
def test_near_copies_of_short_texts(spark):
    rows = fingerprints.op1_winnowing(spark, DATA).select("n_chars", "near_edited").collect()
    n, near = (np.array([r[c] for r in rows]) for c in ("n_chars", "near_edited"))
    assert (near[n - n // 4 >= 8] > 0).all()  # a shared run of 8 code points
    for lo, hi in ((16, 62), (63, 127), (128, 511), (512, n.max())):
        at = (n >= lo) & (n <= hi)
        assert at.sum() > 20 and np.median(near[at]) > 0.65 and (near[at] < 0.5).mean() <= 0.01


def test_language_learns_from_all_of_the_sample(spark):
    rng = random.Random(8)
    vocabulary = {"de": ["apfel", "birne", "haus", "wolke", "strasse"], "en": ["cloud", "quick", "jumpy", "vexing", "lodge"]}
    prose = lambda g: " ".join(rng.choice(vocabulary[g]) for _ in range(50))
    rows = [(i, prose(g), g) for i in range(120) for g in [("de", "en")[i % 2]]]
    rows += [(1000 + i, "00zz " * 130_000, "en") for i in range(3)]  # sorts before all others and is longer than they are together
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(docs.where("doc_id < 1000"), langid.learn(docs)).collect()
    assert all(r["lang_pred"] == ("de", "en")[r["doc_id"] % 2] and r["score"] > 0.9 for r in got)


def test_long_documents_weigh_a_bounded_number_of_words():
    doc = np.repeat([3, 4, 9], [10, 100_000, 10])
    draw, rng = langid.Begins(doc, 20), np.random.default_rng(0)
    at = np.array([draw(rng) for _ in range(4000)])
    share = [(doc[at] == d).mean() for d in (3, 4, 9)]
    assert np.allclose(share, [0.25, 0.5, 0.25], atol=0.04) and len(set(at[doc[at] == 4])) > 1900


def test_search_runs_until_no_bin_can_give():
    rng = random.Random(25)
    lengths = [700] * 60 + [rng.randint(300, 1023) for _ in range(400)]
    bins = packing.improve(packing.best_fit(lengths, 2048), lengths, 2048)
    assert sorted(i for b in bins for i in b) == list(range(460)) and len(bins) <= 149  # 152 when eight alike bins ended it
    fill = [sum(lengths[i] for i in b) for b in bins]
    assert max(fill) <= 2048
    for x, a in enumerate(bins):
        for y, b in enumerate(bins):
            if x != y and fill[x] <= fill[y] < 2048:
                assert packing._exchange(a, b, lengths, 2048 - fill[y]) == ((), ())


def test_pairs_of_bins_with_many_pieces():
    assert packing._exchange(list(range(50)), [50], [3] * 50 + [5], 1) == ((0, 1), (50,))
    assert packing._exchange([0], list(range(1, 51)), [7] + [3] * 50, 1) == ((0,), (1, 2))


def test_bins_that_are_nearly_full_meet_again(spark):
    rows = spark.createDataFrame([(1, 0, 0, 2040, 0), (2, 0, 0, 1000, 0), (3, 0, 0, 1048, 0)], packing.PIECES).coalesce(1)
    got = {r["doc_id"]: r["sequence_id"] for r in packing._place(rows, 2048, 1, final=False).collect()}
    assert got[1] is None and got[2] is not None and got[2] == got[3]


@pytest.mark.parametrize("size", [1e6, 7e6, 4e8])
def test_recall_of_line_pairs_at_the_threshold(size):
    rng = random.Random(1)
    draw = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz")
    pairs = []
    while len(pairs) < 3000:
        a = "".join(draw() for _ in range(rng.randint(40, 80)))
        b = list(a)
        b[rng.randrange(len(b))] = draw()
        x, y = (set(lines.shingle_set(t).tolist()) for t in (a, "".join(b)))
        if 0.8 <= len(x & y) / len(x | y) < 0.83:
            pairs.append((a, "".join(b)))
    plan = lines.Bands(size, 0.8)
    one, two = (lines.signatures(list(side), plan) for side in zip(*pairs))
    band = (lines.band_keys(one, plan) == lines.band_keys(two, plan)).any(1)
    x, y = lines.sketches(one), lines.sketches(two)
    alike = links.alike(x["low"], x["high"], y["low"], y["high"])
    assert (band & alike).mean() >= 0.9995


def test_bands_grow_without_leaps():
    plans = [lines.Bands(2 ** (k / 4), 0.8) for k in range(60, 180)]
    for p, q in zip(plans, plans[1:]):
        assert p.bands <= q.bands <= 1.1 * p.bands + 1
        miss = (1 - 0.8**q.rows) ** (q.bands - q.long) * (1 - 0.8 ** (q.rows + 1)) ** q.long
        assert miss <= 1.01 * lines.MISSED


def test_lines_of_a_text_are_normal_lines():
    rng = random.Random(2)
    for letters in ("aB  \n\t\r\u2003\u3000\x1c\x85\xa0Σσİß.é", "aB Σ\nİé."):
        for _ in range(3000):
            t = "".join(rng.choice(letters) for _ in range(rng.randrange(14)))
            assert lines.normals(t) == [lines.normal(x) for x in t.split("\n")]


def test_sieve_passes_all_ids_and_few_others(spark):
    x = np.random.default_rng(4).integers(-(2**63), 2**63 - 1, 4000)
    bits = links.sieve(spark.createDataFrame([(int(i),) for i in x[:2000]], "id long"))
    got = links.sifted(x, bits)
    assert got[:2000].all() and got[2000:].sum() < 5
    assert not links.sieve(spark.createDataFrame([], "id long")).any()


def test_unrelated_sets_share_no_key():
    rng = np.random.default_rng(3)
    for num in (80, 90):
        classes = jaccard.SizeClasses(num, 100)
        keys = [jaccard.signatures(np.unique(rng.integers(0, 2**64, rng.integers(1, 500), dtype=np.uint64)), classes) for _ in range(1500)]
        every = np.concatenate([np.unique(k) for k in keys])
        assert len(np.unique(every)) == len(every)


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(4)
    for num in (80, 90):
        classes = jaccard.SizeClasses(num, 100)
        for _ in range(1500):
            a = np.unique(rng.integers(0, 2**64, rng.integers(1, 400), dtype=np.uint64))
            less, more = rng.integers(0, len(a) // 4 + 1), rng.integers(0, len(a) // 4 + 1)
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[less:]], rng.integers(0, 2**64, more, dtype=np.uint64)]))
            both = len(a) - less
            if 100 * both >= num * (len(a) + len(b) - both):
                assert len(np.intersect1d(jaccard.signatures(a, classes), jaccard.signatures(b, classes)))


def test_groups_told_apart_by_rare_shingles(spark):
    rng = random.Random(5)
    word = lambda: "w%d" % rng.randrange(10**6)
    shared = [word() for _ in range(60)]
    rows = []
    for i in range(60):  # texts around one passage, and near copies of some
        own = [word() for _ in range(25)]
        rows.append((2 * i, " ".join(own + shared)))
        rows.append((2 * i + 1, " ".join((own[:-1] + [word()] if i % 3 else [word() for _ in range(25)]) + shared)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    one, two = ({tuple(r) for r in jaccard.join(df, 5, 80, 100, block=b).select("doc_id", "component_id").collect()} for b in (10**9, 2000))
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in rows for w in [t.split()]}
    near = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    up = {d: d for d in sets}
    for _ in sets:
        for a, b in near:
            up[b] = up[a] = min(up[a], up[b])
    assert one == two == set(up.items())


def test_pipeline_keeps_one_of_equal_rows(spark):
    import corpus_pipeline

    text = " ".join("v%d" % i for i in range(60))
    rows = [(1, text, "a"), (1, text, "b"), (2, text, "c"), (3, "", "d"), (3, "", "d"), (4, None, "e"), (None, "x y z other words", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _k string")
    kept = corpus_pipeline.dedup_documents(spark, df, "")
    assert kept.columns == df.columns
    got = sorted(((r[0], r[1]) for r in kept.collect()), key=str)
    assert got == sorted([(1, text), (3, ""), (3, ""), (4, None), (None, "x y z other words")], key=str)
    cut = corpus_pipeline.cut_passages(spark, kept, "")
    assert text in [r["text"] for r in cut.collect()]


def test_hot_windows_over_many_batches(spark):
    passage = " ".join("p%d" % i for i in range(50))
    df = spark.createDataFrame([(i, f"a{i} {passage} b{i} {'filler%d ' % i * 3}") for i in range(300)], "doc_id long, text string").repartition(7)
    for hot in (5, 10**6):
        seen, cut = substrings.repeats(df, 35, hot=hot)
        assert {r["_gone"] for r in substrings._trim(cut, 35, False).collect()} == {50} and cut.count() == 300


def test_packed_fingerprints_hold_the_same_in_less(spark):
    texts = ["", "abc", "abcdef", "the quick brown fox jumps over the lazy dog " * 40, "x" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for k, window in ((5, 4), (16, 300)):
        a, b = ({r["doc_id"]: r for r in fingerprints.fingerprints(docs, k, window, pack=p).collect()} for p in (False, True))
        for d in a:
            for c in ("fingerprint", "edited_fingerprint"):
                assert fingerprints.encoded(*fingerprints.unpacked(b[d][c], window)) == a[d][c]
            assert a[d][:3] == b[d][:3] and a[d][5:] == b[d][5:]
    rows = fingerprints.fingerprints(docs, fingerprints.K, fingerprints.WINDOW, pack=True).collect()
    assert len(rows[3]["fingerprint"]) < 5 * 0.4 * len(texts[3]) * 1.5  # five bytes for each of about 2 entries in 5 code points, in base64


def test_caps_rounds_give_the_same_rows(spark):
    import numpy as np

    from sentrymill.llm import caps

    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 32))
    x = np.concatenate([x, x[:100] + 0.2 * rng.normal(size=(100, 32)), x[:20]]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    a, b = (sorted(tuple(r) for r in caps.near(df, rounds=n).collect()) for n in (1, 3))
    assert a == b and sum(r[1] for r in a) > 100
