"""Whole queries: pieces against their library, the pipeline from end to end, and buckets of counts of any size."""

import hashlib
import zlib

import numpy as np
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from sentrymill.llm import kit, ngrams, packing, sentencepieces

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def library():
    import public_tokenizers

    return sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))


def test_pieces_equal_the_library(spark):
    sp, texts = library(), {r["doc_id"]: r["text"] or "" for r in kit.read(spark, SF, "documents").collect()}
    got = sentencepieces.op10_pieces(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        ids = sp.encode(texts[r["doc_id"]])
        assert r["n_ids"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_relational_pieces_equal_the_library(spark):
    sp = library()
    words = sorted({w for r in kit.read(spark, SF, "documents").limit(20).collect() for w in (r["text"] or "").split() if len(w) <= 24})[:300]
    # the library writes the space before a word as a mark
    mark = " "
    got = {r["word"]: [p.replace(" ", "▁") for p in r["pieces"]] for r in sentencepieces.encode_words(spark.createDataFrame([(mark + w,) for w in words], "word string")).collect()}
    assert len(got) == len(words)
    for w in words:
        want = sp.encode(w, out_type=str)
        if not any(sp.piece_to_id(p) == sp.unk_id() for p in want):
            assert got[mark + w] == want, w


def test_pipeline_from_end_to_end(spark):
    docs = kit.read(spark, LARGER, "documents")
    labels = kit.read(spark, LARGER, "labels")
    got = corpus_pipeline.run(spark, LARGER)
    rows = got.collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(got.columns)
    ids = {r["doc_id"] for r in rows}
    assert ids <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    assert len(ids & toxic) <= 0.2 * len(toxic)
    clean = {r["doc_id"] for r in labels.where("toxic = 0 and quality = 1").collect()}
    assert len(ids & clean) >= 0.7 * len(clean)  # the others are near copies of one that stays
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(docs.where(F.col("doc_id").isin(*ids))).columns == got.columns


def test_buckets_of_any_count():
    counts = np.array([0, 1, 2, 3, 4, 2**22, 2**23, 2**40, 2**62])
    assert ngrams.bucket(counts).tolist() == [0, 1, 2, 2, 3, 23, 24, 41, 63] and ngrams.bucket(counts).max() < ngrams.BUCKETS
