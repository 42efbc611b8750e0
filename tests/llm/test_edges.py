"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for all operators and stages."""

from __future__ import annotations

import hashlib
import random

import pytest

import corpus_pipeline
from sentrymill.llm import caps, fingerprints, jaccard, langid, lines, ngrams, packing, sentencepieces, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k long, _text string, _score double, held_out boolean, score double, removed array<int>"
EMPTY = hashlib.sha256(b"").hexdigest()


def rows():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    one = prose(60)
    out = [(1, one, "en"), (2, one, "en"), (3, None, "en"), (4, "", None), (5, "   \n\t ", "de"), (6, "short", "de"), (7, prose(40) + "\n" + prose(9), "de"), (8, prose(30000), "en"), (9, "é👍 日本 ퟿", None), (None, prose(50), "de"), (None, None, None), (7, "tie of ids", "de"), (10, one, "en"), (10, one, "en"), (11, "x" * 5000, "en")]
    return [(d, t, g, "s", None, 7, "clash", 0.5, True, 0.5, [1]) for d, t, g in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, 1), (3, 1, None), (None, 1, 1), (7, 0, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")


def test_fingerprints(docs, none):
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == len(rows()) and not fingerprints.fingerprints(none).collect()
    by = {(r["doc_id"], r["n_chars"]): r for r in got}
    assert by[1, len(rows()[0][1])]["near_next"] == 1.0  # its copy follows
    assert by[3, 0]["fingerprint"] == "" and by[3, 0]["near_next"] == 1.0  # null, then empty
    assert by[1, len(rows()[0][1])]["fingerprint"] == by[2, len(rows()[0][1])]["fingerprint"]


def test_lines(docs, none):
    got = lines.removals(docs).collect()
    assert len(got) == len(rows()) and not lines.removals(none).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[2]["removed"] == [0] and by[1]["removed"] == [] and by[3]["n_lines"] == 0 and by[5]["removed"] == []
    assert lines.deduped(docs).columns == docs.columns and lines.deduped(docs).count() == len(rows())


def test_jaccard(docs, none):
    got = jaccard.join(docs).collect()
    assert len(got) == len(rows()) and not jaccard.join(none).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[2]["component_id"] == by[10]["component_id"] == 1 and by[3]["n_shingles"] == 0 and by[3]["component_id"] == 3 and by[6]["n_shingles"] == 1


def test_substrings(docs, none):
    got = substrings.dedup(docs).collect()
    assert len(got) == len(rows()) and not substrings.dedup(none).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_removed"] == by[1]["n_words"] == 60 and by[1]["kept_sha256"] == EMPTY and by[3]["n_words"] == 0 and by[8]["n_removed"] == 0
    trimmed = substrings.trimmed(docs)
    assert trimmed.columns == docs.columns and trimmed.count() == len(rows())
    assert {r["text"] for r in trimmed.where("doc_id = 3").collect()} == {None} and trimmed.where("doc_id = 8").collect()[0]["text"] == rows()[7][1]


def test_language(docs, none):
    got = langid.predict(docs, langid.learn(docs)).collect()
    assert len(got) == len(rows()) and not langid.predict(none, langid.learn(none)).collect()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 5)} == {"und"} and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}


def test_scoring(docs, none):
    got = ngrams.score(docs).collect()
    assert len(got) == len(rows()) and not ngrams.score(none).collect()
    assert all(r["n_tokens"] >= 1 and r["score"] <= 0 for r in got)


def test_toxicity(docs, none, labels):
    for lab in (labels, labels.where("false")):
        got = toxicity.score(docs, lab)
        assert got.count() == len(rows()) and all(0 <= r["_score"] <= 1 for r in got.collect())
    assert toxicity.score(none, labels).count() == 0
    kept = toxicity.score(docs, labels, keep=True)
    assert kept.columns == docs.columns


def test_packing(docs, none):
    got = packing.pack(docs).collect()
    assert packing.pack(none).count() == 0
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048
    assert sum(1 for r in got if r["piece"] == 0) == len(rows())


def test_pieces(docs, none):
    got = sentencepieces.encode(docs)
    assert got.count() == len(rows()) and sentencepieces.encode(none).count() == 0
    back = {(r["doc_id"], r["text"]) for r in sentencepieces.decode(got).collect()}
    assert back == {(d, t or "") for d, t, *_ in rows()}


def test_caps(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.1], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [float("nan"), 1.0], 1), (8, [], 1), (None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 2)], "vec_id long, embedding array<float>, label int")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"]) for r in caps.near(e, lists=9000.0).collect())
    assert got == [(-1, 4, 1), (1, 4, 1), (1, 4, 1), (2, 4, 1), (3, 4, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9)]
    assert caps.near(e.where("false")).count() == 0


def test_stages(spark, docs, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, none):
        kept = table
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, str(tmp_path))
            if name != "packing":
                assert kept.columns == docs.columns
                path = f"{tmp_path}/{name}-{table is none}"
                kept.write.parquet(path)
                kept = spark.read.parquet(path)
        assert (kept.count() > 0) == (table is docs)
