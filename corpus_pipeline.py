"""A corpus pipeline: each stage applies one operator to all that its predecessor kept.

Toxic documents go; of fuzzy copies of a line one stays; of documents with nearly equal word n-grams one stays; passages
that repeat are cut out; what is left is packed into sequences. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrymill.llm import jaccard, kit, lines, packing, substrings, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator scores below its threshold."""
    return toxicity.score(docs, kit.read(spark, sf_dir, "labels"), keep=True)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines of which an earlier fuzzy copy stays."""
    return lines.deduped(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8 or more; the smallest id of a group stays, of equal
    ids the smallest hash of the text (null ids first), and of rows equal in both one. Documents without words stay, all."""
    cols = docs.columns
    groups = jaccard.join(docs, k=5, num=80, den=100)
    no_id = F.coalesce("doc_id", F.lit(kit.NO_ID))
    keep = groups.where("n_shingles > 0").groupBy("_root").agg(F.min(F.struct(no_id.alias("_id"), "_k")).alias("_first"))
    names = kit.fresh("_id", docs), kit.fresh("_k", docs)
    worded = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    # equal rows collapse before they travel, however many there are
    rows = docs.where(worded).select("*", *kit.row_key(docs, names)).dropDuplicates([*names])
    kept = kit.beside(rows, keep.select(F.col("_first._id").alias(names[0]), F.col("_first._k").alias(names[1])), [*names], "left_semi")
    return kept.select(*cols).unionByName(docs.where(~F.coalesce(worded, F.lit(False))))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words that repeated windows of 35 words cover."""
    return substrings.trimmed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of at most 2048 tokens that the documents' pieces go into."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("jaccard_join", dedup_documents), ("substring_dedup", cut_passages), ("packing", pack)]

#: The first stage is a learned model, so no SQL gives these rows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next."""
    docs = kit.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        was, docs = docs, kit.cut(stage(spark, docs, sf_dir))
        kit.drop(was)
        kit.release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
