"""Structured Streaming forms of the corpus operators.

A17 (building a vocabulary with term frequencies from a stream of token lists) is an
incremental aggregation: documents arrive as files, tokens are counted with a
streaming `groupBy`, and every micro-batch writes the complete table to a sink folder
through `foreachBatch` (state lives in the checkpoint folder, so a restarted query
resumes where it stopped).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import TOKEN_PATTERN


def token_stream(spark: SparkSession, source: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Lemmas of documents arriving as parquet files below `source` (a folder or glob).
    Without a per-trigger file cap each micro-batch takes what has arrived, so the
    complete vocabulary is rewritten once per batch, not once per file."""
    schema = spark.read.parquet(source).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    docs = reader.parquet(source)
    words = F.regexp_extract_all(F.col("text"), F.lit(TOKEN_PATTERN), 0)
    return docs.select(F.explode(F.transform(words, F.lower)).alias("token"))


def term_frequency_stream(spark: SparkSession, source: str, sink: str, checkpoint: str,
                          available_now: bool = True, max_files_per_trigger: int | None = None):
    """A17 streaming: running (token, tf). Returns the started StreamingQuery; with
    `available_now` it processes what is there and stops."""
    counts = token_stream(spark, source, max_files_per_trigger).groupBy("token") \
        .agg(F.count(F.lit(1)).alias("tf"))

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(sink)

    writer = counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def run_term_frequency(spark: SparkSession, source: str, sink: str, checkpoint: str) -> DataFrame:
    """Run the stream over the files present and return the stored vocabulary table."""
    q = term_frequency_stream(spark, source, sink, checkpoint, available_now=True)
    q.awaitTermination()
    return spark.read.parquet(sink)
