"""A17 as a streaming aggregation: incremental batches and resume from the checkpoint."""

import os

from pyspark.sql import functions as F

from rostra.model import TOKEN_PATTERN
from rostra.streaming import run_term_frequency, term_frequency_stream

SMALL = "/root/testdata/sf0.001"


def _batch_tf(df):
    words = F.regexp_extract_all(F.col("text"), F.lit(TOKEN_PATTERN), 0)
    return {r["token"]: r["tf"] for r in df.select(F.explode(F.transform(words, F.lower)).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("tf")).collect()}


def test_incremental_vocabulary_and_resume(spark, scratch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    src = os.path.join(scratch, "incoming")
    parts = [docs.where(F.col("doc_id") % 3 == i) for i in range(3)]
    parts[0].coalesce(1).write.parquet(os.path.join(src, "b0"))
    parts[1].coalesce(1).write.parquet(os.path.join(src, "b1"))
    sink, state = os.path.join(scratch, "vocab"), os.path.join(scratch, "state")
    glob = os.path.join(src, "*", "*.parquet")
    q = term_frequency_stream(spark, glob, sink, state, available_now=True, max_files_per_trigger=1)
    q.awaitTermination()
    assert len(q.recentProgress) >= 2  # one file per micro-batch
    first = {r["token"]: r["tf"] for r in spark.read.parquet(sink).collect()}
    assert first == _batch_tf(parts[0].unionByName(parts[1]))
    parts[2].coalesce(1).write.parquet(os.path.join(src, "b2"))
    final = {r["token"]: r["tf"] for r in run_term_frequency(spark, glob, sink, state).collect()}
    assert final == _batch_tf(docs)
