"""Registered protocol / speech-text queries."""

from __future__ import annotations


from ..model import SQL_CODES, SQL_UTTERANCES, with_sql
from ..operators import speech_text as T
from .catalog import corpus, register

_SQL_BOUNDS = with_sql(SQL_UTTERANCES, SQL_CODES) + """
, b AS (
  SELECT *, coalesce(sum(n_utterances) OVER (PARTITION BY protocol_id ORDER BY speech_no
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u_start
  FROM protocol_speech_index
)
, a AS (
  SELECT b.speech_no, u.* FROM b JOIN utterances u
    ON u.protocol_id = b.protocol_id AND u.turn >= b.u_start AND u.turn < b.u_start + b.n_utterances
)
"""


@register("W04_assign_utterances", _SQL_BOUNDS + "SELECT protocol_id, turn, speech_no FROM a")
def q_w04(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return T.assign_utterances(c.protocol_speech_index, c.utterances).select("protocol_id", "turn", "speech_no")


_SQL_TEXTS = _SQL_BOUNDS + r"""
, sp AS (
  SELECT protocol_id, speech_no, arg_min(who, turn) AS who, arg_min(u_id, turn) AS u_id,
         string_agg(paragraph, chr(10) ORDER BY turn) AS txt, CAST(sum(num_tokens) AS BIGINT) AS num_tokens,
         CAST(sum(num_words) AS BIGINT) AS num_words, arg_min(page_number, turn) AS p1, arg_max(page_number, turn) AS p2
  FROM a GROUP BY protocol_id, speech_no
)
, texts AS (
  SELECT s.document_id, s.document_name, s.protocol_name, s.speech_id, sp.who, sp.u_id,
         regexp_replace(sp.txt, '\s([,?.!"%'';:`](?:\s|$))', '\1', 'g') AS speech_text,
         sp.num_tokens, sp.num_words,
         CASE WHEN coalesce(sp.p1, 0) = 0 THEN '?' ELSE CAST(sp.p1 AS VARCHAR) END AS page_number,
         CASE WHEN coalesce(sp.p2, 0) = 0 THEN '?' ELSE CAST(sp.p2 AS VARCHAR) END AS page_number2,
         coalesce(pe.name, CAST(s.person_id AS VARCHAR)) AS name,
         CASE WHEN s.speaker_note_id IS NULL THEN ''
              WHEN s.speaker_note_id = 'missing' THEN 'Talet saknar notering'
              ELSE coalesce(n.speaker_note, '(introductory note not found)') END AS speaker_note,
         coalesce(g.gender, 'Okänt') AS gender, coalesce(pa.party_abbrev, 'Okänt') AS party_abbrev,
         CAST(NULL AS VARCHAR) AS error
  FROM protocol_speech_index s
  LEFT JOIN sp ON s.protocol_id = sp.protocol_id AND s.speech_no = sp.speech_no
  LEFT JOIN persons pe ON s.person_id = pe.person_id
  LEFT JOIN speaker_notes n ON s.speaker_note_id = n.speaker_note_id
  LEFT JOIN gender g ON s.gender_id = g.gender_id
  LEFT JOIN party pa ON s.party_id = pa.party_id
)
"""


def _texts(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return T.speech_texts(c.protocol_speech_index, c.utterances, c.persons, c.speaker_notes, c.gender, c.party)


@register("E07_speech_text", _SQL_TEXTS + "SELECT * FROM texts")
def q_e07(spark, sf_dir):
    return _texts(spark, sf_dir)


@register("E08_speech_export", _SQL_TEXTS + """
SELECT name || '_' || speech_id || '.txt' AS filename, speech_text AS text FROM texts
""")
def q_e08(spark, sf_dir):
    return T.export_rows(_texts(spark, sf_dir))


@register("A18_speech_records", with_sql(SQL_UTTERANCES) + """
SELECT protocol_id, string_agg('speech_no:' || speech_no || '|speech_id:' || speech_id || '|n_utterances:' || n_utterances,
                               ',' ORDER BY speech_no) AS records
FROM protocol_speech_index GROUP BY protocol_id
""")
def q_a18(spark, sf_dir):
    return T.speech_records(corpus(spark, sf_dir).protocol_speech_index)
