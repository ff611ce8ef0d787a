"""Registered round trips for sources and sinks: data derived from the driver tables is
written below the session's checkpoint folder and read back with the library's readers;
the oracle is the same data computed by SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import sources as SRC
from ..model import SQL_CODES, SQL_DTM, SQL_SPEECH_TOKENS, SQL_UTTERANCES, with_sql
from ..operators import dtm as D
from ..operators import speech_text as T
from ..session import scratch_path
from .catalog import corpus, register

_ST = with_sql(SQL_SPEECH_TOKENS)


def _run_dir(spark, name: str) -> str:
    return scratch_path(spark, f"io-{name}-{uuid.uuid4().hex}")


@register("S01_speech_index_csv", _ST + """
SELECT document_id, document_name, speech_id, person_id, CAST(year AS INTEGER) AS year, chamber_abbrev
FROM speech_index
""")
def q_s01(spark, sf_dir):
    si = corpus(spark, sf_dir).speech_index
    stored = si.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in si.columns
                         else (F.col("speech_id") if f.name == "u_id" else F.col("person_id").cast("string"))
                         .alias(f.name) for f in SRC.SPEECH_INDEX_SCHEMA.fields])
    path = _run_dir(spark, "s01")
    stored.write.option("sep", ";").option("header", True).option("compression", "gzip").csv(path)
    back = SRC.read_speech_index(spark, path)
    return back.select("document_id", "document_name", "speech_id", F.col("person_id").cast("bigint")
                       .alias("person_id"), "year", "chamber_abbrev")


@register("S04_protocols_json", with_sql(SQL_UTTERANCES) + """
SELECT CAST(protocol_id AS VARCHAR) AS protocol_name, turn, u_id, who, page_number, num_tokens, num_words, paragraph
FROM utterances
""")
def q_s04(spark, sf_dir):
    u = corpus(spark, sf_dir).utterances
    nested = u.groupBy("protocol_id").agg(F.sort_array(F.collect_list(F.struct(
        "turn", "u_id", "who", F.lit(None).cast("string").alias("speaker_note_id"), "page_number", "num_tokens",
        "num_words", F.split("paragraph", "\n").alias("paragraphs")))).alias("us"))
    protocols = nested.select(F.col("protocol_id").cast("string").alias("name"), F.lit(None).cast("string")
                              .alias("date"), F.transform("us", lambda x: x.dropFields("turn")).alias("utterances"))
    path = _run_dir(spark, "s04")
    protocols.write.json(path)
    return T.protocol_utterances(T.read_protocols(spark, path)).drop("speaker_note_id")


@register("S06_store_load_corpus", with_sql(SQL_SPEECH_TOKENS, SQL_DTM) + """
SELECT d.token, d.document_id, d.n, v.tf FROM dtm d JOIN (SELECT token, CAST(sum(n) AS BIGINT) AS tf FROM dtm GROUP BY token) v
  USING (token)
JOIN speech_index USING (document_id)
""")
def q_s06(spark, sf_dir):
    c = corpus(spark, sf_dir)
    folder = _run_dir(spark, "s06")
    SRC.store_corpus(c.dtm, D.vocabulary(c.dtm), c.speech_index, folder, "tag")
    dtm, vocab, index = SRC.load_corpus(spark, folder, "tag")
    return dtm.join(vocab, "token").join(index.select("document_id"), "document_id").select(
        "token", "document_id", "n", "tf")


@register("S09_document_index_tsv", _ST + """
SELECT document_id, document_name, CAST(year AS INTEGER) AS year FROM speech_index
""")
def q_s09(spark, sf_dir):
    si = corpus(spark, sf_dir).speech_index
    idx = si.select(F.concat(F.lit("texts/"), F.col("document_name"), F.lit(".txt")).alias("filename"),
                    "year", "document_id")
    path = _run_dir(spark, "s09")
    SRC.store_document_index(idx, path)
    return SRC.read_document_index(spark, path).select("document_id", "document_name", "year")


@register("S10_vocabulary_store", with_sql(SQL_SPEECH_TOKENS, SQL_DTM) + """
SELECT token, tf, row_number() OVER (ORDER BY tf DESC, token) - 1 AS token_id
FROM (SELECT token, CAST(sum(n) AS BIGINT) AS tf FROM dtm GROUP BY token)
""")
def q_s10(spark, sf_dir):
    vocab = D.vocabulary(corpus(spark, sf_dir).dtm, with_ids=True)
    path = _run_dir(spark, "s10")
    SRC.store_vocab(vocab, path)
    back = SRC.load_vocab(spark, path)
    return SRC.ids_to_tokens(back.select("token_id", "tf"), back).select("token", "tf", "token_id")


@register("S11_speech_export_files", with_sql(SQL_UTTERANCES, SQL_CODES) + """
SELECT count(*) AS n_files FROM protocol_speech_index
""")
def q_s11(spark, sf_dir):
    c = corpus(spark, sf_dir)
    texts = T.speech_texts(c.protocol_speech_index, c.utterances, c.persons, c.speaker_notes, c.gender, c.party)
    path = _run_dir(spark, "s11")
    T.write_export(T.export_rows(texts), path)
    return spark.read.json(path).agg(F.count(F.lit(1)).alias("n_files"))


@register("S12_frames_gzip_csv", with_sql(SQL_CODES) + "SELECT CAST(party_id AS VARCHAR) AS party_id, party FROM party")
def q_s12(spark, sf_dir):
    path = _run_dir(spark, "s12")
    SRC.store_frames({"party": corpus(spark, sf_dir).party.select("party_id", "party")}, path)
    return spark.read.option("header", True).csv(f"{path}/party")
