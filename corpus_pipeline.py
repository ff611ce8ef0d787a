"""Corpus cleaning: toxicity, exact duplicates, near-duplicates, repeated passages, packing.

Each stage takes what its predecessor kept, with the columns of `documents`; the last one
returns the packed pieces. `run` writes each stage's result in the shared checkpoint folder
and reads it back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.llm import exact_dedup, packing, simhash_dedup, substring_dedup, toxicity
from rostra.llm.common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; trained on all of `documents` that is not held out."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out("doc_id"))
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


ROW = "__row"


def _numbered(docs: DataFrame) -> DataFrame:
    """`docs` with numbers that tell rows apart whose ids repeat or are null; the same at each read, as docs are files."""
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    return docs.join(kept.select(F.col("row").alias(ROW)), ROW, "left_semi").drop(ROW)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row with the largest doc_id."""
    rows = _numbered(docs)
    return _only(rows, exact_dedup.exact_duplicates(rows, row_col=ROW).where("kept"))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component, one row with the smallest doc_id."""
    rows = _numbered(docs)
    return _only(rows, simhash_dedup.near_duplicates(rows, row_col=ROW).where("kept"))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that documents with smaller ids hold, too; texts
    that lose none stay as they are."""
    got = substring_dedup.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return got.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact), ("near_dedup", drop_near),
          ("substring_dedup", drop_passages), ("packing", pack)]
ORACLE_SQL = None  # learnt scores, XXH64 and token ids: tested against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
