"""Preference-pair scores: held-out accuracy, the threshold, features against a plain count, and odd rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sentrymill.llm import kit, quality

SCHEMA = "doc_id long, text string, quality int, _score double, _y int, x array<double>"


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = quality.op13_quality(spark, sf)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    got = got.cache()
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count() and got.where("score < 0 or score > 1 or predicted <> int(score >= 0.3)").count() == 0
    held = got.where("held_out").join(kit.read(spark, sf, "labels").where("quality is not null"), "doc_id").toPandas()
    good, bad = held[held.quality == 1], held[held.quality == 0]
    assert (good.predicted == 1).mean() >= 0.99 and (bad.predicted == 0).mean() >= 0.98
    pairs = (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None]).mean()
    assert pairs >= 0.999
    assert got.where("held_out").count() == sum(__import__("zlib").crc32(str(r[0]).encode()) % 5 == 0 for r in got.select("doc_id").collect())


def test_held_out_labels_change_nothing(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = kit.read(spark, sf, "documents"), kit.read(spark, sf, "labels")
    out = kit.crc_mod("doc_id", 5) == 0
    flipped = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.score(docs, x, out).collect())) for x in (labels, flipped))
    assert a == b


def test_features_of_small_texts():
    texts = ["aa aa. B!", None, "", "  \n", "ÉÉ é | |\n12x"]
    got = quality.features(pa.array(texts, pa.string()))
    alone = np.concatenate([quality.features(pa.array([t], pa.string())) for t in texts])
    assert got.shape == (5, quality.FEATURES) and np.allclose(got, alone) and np.isfinite(got).all()
    assert np.allclose(got[1], got[2])  # null as empty
    name = dict(n=0, capitals=2, stops=4, bangs=5, signs=6, bare=7, repeat=9, distinct=11, upper=12, lines=14, single=17)
    first = {k: got[0][i] for k, i in name.items()}
    assert np.allclose([first[k] for k in name], [np.log1p(3), 1 / 5, 1 / 3, 1 / 3, 0, 0, 0, 1, 1 / 3, 0, 0])
    last = {k: got[4][i] for k, i in name.items()}
    assert np.allclose([last[k] for k in name], [np.log1p(5), 2 / 7, 0, 0, 2 / 5, 2 / 5, 1 / 5, 4 / 5, 1 / 5, 1 / 5, 2 / 5])


def test_scores_follow_preferences_and_the_quantile():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 4))
    truth = x @ [3.0, -2.0, 0.0, 0.0]
    y = (truth + rng.logistic(size=3000) > -1.5).astype(int)
    model = quality.Model(x, y, share=(y == 0).mean(), threshold=0.3)
    got = model(x)
    order = np.corrcoef(np.argsort(np.argsort(got)), np.argsort(np.argsort(truth)))[0, 1]
    assert order > 0.95
    assert abs((got < 0.3).mean() - (y == 0).mean()) < 0.002  # as many rejected as are of label 0


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(["the", "tree", "stands", "by", "water."], 30)) for _ in range(40)]
    bad = [" ".join(rng.choice(["%%", "BUY!!", "|", "x"], 30)) for _ in range(40)]
    rows = [(i, t, None, 0.5, 1, [1.0]) for i, t in enumerate(good + bad)]
    rows += [(None, "the tree", None, 0.0, 0, None), (500, None, None, 0.0, 0, None), (501, "", None, 0.0, 0, None), (3, "the water", None, 0.0, 0, None), (502, "word " * 300_000, None, 0.0, 0, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)] + [(1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    got = quality.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["_score"] <= 1 for r in got)
    by = {r["doc_id"]: r["_predicted"] for r in got}
    assert all(by[i] == 1 for i in range(40)) and all(by[i] == 0 for i in range(40, 80))
    assert len({r["_score"] for r in got if r["doc_id"] in (500, 501)}) == 1
    kept = quality.score(docs, labels, keep=True)
    assert kept.columns == docs.columns and kept.where("doc_id between 40 and 79").count() == 0 and kept.where("doc_id < 40").count() == 41
    assert quality.score(docs.limit(0), labels).count() == 0
    assert {r["_score"] for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}
    few = spark.createDataFrame([(1, 1), (2, 1), (50, 0), (None, 0), (3, None)], "doc_id long, quality int")
    assert {round(r["_score"], 6) for r in quality.score(docs, few).collect()} == {round(2 / 3, 6)}


def test_every_labelled_row_counts(spark):
    """More rows than any bound on a sample had: rows of one kind, wherever they are, move the model."""
    rng = np.random.default_rng(3)
    n = 24_000
    x, y = rng.normal(size=(n, quality.FEATURES)), np.ones(n, int)
    y[:5000] = 0
    x[y == 0, 0] += 4
    made = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, x array<double>")
    labels = spark.createDataFrame(list(enumerate(y.tolist())), "doc_id long, quality int")
    model = quality.learn(made, labels, F.lit(False), 0.3)
    few = quality.learn(made, labels, F.lit(False), 0.3, least=2000)  # twelve groups instead of two
    got = model(x)
    assert abs((got < 0.3).sum() - 5000) <= 1  # the threshold is the exact quantile over all rows
    assert (got[y == 0] < 0.3).mean() > 0.9 and np.corrcoef(got, few(x))[0, 1] > 0.95  # other pairs, the same rows
    order = np.sort(rng.normal(size=3000).round(2))
    scores = spark.createDataFrame([(float(v),) for v in rng.permutation(order)], "s double")
    assert [quality.kth(scores, k) for k in (1, 2, 1500, 3000)] == [order[k - 1] for k in (1, 2, 1500, 3000)]
