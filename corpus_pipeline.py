"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor
kept. A document is known by its id and text together, so ids that are null or repeat
do not lead a stage astray; rows that repeat both are one document, share its fate, and
near-dedup leaves one of them. All stages but the last return the columns of documents,
whatever further ones there are. A null or empty text is a document like any other: the
classifier judges its shape, it has no lines, is nobody's near duplicate, holds no test
item and packs as the end token alone. Without documents every stage gives none; without
labels, or with none of both kinds, the classifier keeps all; without a benchmark all
documents are clean.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspar.llm.decontaminate import WINDOW, decontaminate
from lumenspar.llm.line_dedup import line_dedup
from lumenspar.llm.near_dedup import near_duplicates
from lumenspar.llm.pack import pack_documents
from lumenspar.llm.quality_classifier import classify
from lumenspar.work import in_few, materialize

KEY = "_document"


def _key() -> Column:
    """Id and two hashes of id and text: what tells documents apart."""
    return F.struct("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(7), "doc_id").alias("k2"))


def _without(docs: DataFrame, rejected: DataFrame, once: bool = False) -> DataFrame:
    """The documents less the rejected ones, given by key; ``once``: one row of each document."""
    gone = rejected.select(F.col("doc_id.k1").alias("k1"), F.col("doc_id.k2").alias("k2")).distinct()
    # wrapped up, whatever the columns are called
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key().alias("key"))
    left = keyed.join(gone, (keyed.key.k1 == gone.k1) & (keyed.key.k2 == gone.k2), "left_anti")
    return in_few((left.dropDuplicates(["key"]) if once else left).select("row.*"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier of low quality or toxic than not go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = classify(docs.select("doc_id", "text", "source", "lang", _key().alias(KEY)), labels, carry=[KEY])
    return _without(docs, judged.where(~F.col("kept")).select(F.col(KEY).alias("doc_id")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go; a document made of nothing else goes with them."""
    cut = line_dedup(docs)
    left = cut.where("n_deleted = 0 or n_deleted < n_lines")
    return in_few(left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, five words a shingle and 0.8 alike, one document stays."""
    judged = near_duplicates(docs.select(_key().alias("doc_id"), "text"))
    return _without(docs, judged.where(~F.col("kept")), once=True)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a whole window of eight words of a test item, or two items, go.

    An item of fewer words, which may stand in a text by chance, rejects none alone.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = decontaminate(docs.select(_key().alias("doc_id"), "text"), benchmark)
    # spans are start, end, start, end ...
    run = F.transform("spans", lambda x, i: F.when(i % 2 == 1, x - F.get("spans", i - 1)))
    leaks = F.coalesce(F.array_max(run), F.lit(0)) >= WINDOW
    return _without(docs, judged.where(F.col("contaminated") | leaks))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    packed = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", without_benchmark),
    ("packing", packing),
]

#: The classifier's fit is not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
