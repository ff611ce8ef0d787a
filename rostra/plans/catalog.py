"""Registered queries: each Spark query (spark, sf_dir) -> DataFrame has, where SQL can
express it, an oracle in DuckDB SQL over the same parquet tables. Column names match;
doubles are rounded to 6 digits on both sides; lists are returned as sorted,
delimiter-joined strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SQL_CODES, SQL_DTM, SQL_SPEECH_TOKENS, Corpus, PreparedCorpus, with_sql
from . import jobs

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def queries() -> dict[str, Query]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_SQL)


def _load_all() -> None:
    from . import catalog_files, catalog_indexes, catalog_io, catalog_more, catalog_ops, catalog_ops2, catalog_stats, catalog_text  # noqa: F401


# sf_dir -> folder of a prepared corpus (tokens and DTM stored once, see model.prepare_corpus)
_PREPARED: dict[str, str] = {}


def use_prepared(sf_dir: str, folder: str | None) -> None:
    """Serve queries on `sf_dir` from a prepared corpus folder (None: back to the raw tables)."""
    if folder is None:
        _PREPARED.pop(sf_dir, None)
    else:
        _PREPARED[sf_dir] = folder


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    folder = _PREPARED.get(sf_dir)
    return PreparedCorpus(spark, sf_dir, folder) if folder else Corpus(spark, sf_dir)


# --- E03 word trends ----------------------------------------------------------------

TREND_WORDS = ["der", "the", "la", "de", "und"]


@register("E03_word_trends", with_sql(SQL_SPEECH_TOKENS) + r"""
, t AS (
  SELECT year, token, CAST(count(*) AS BIGINT) AS n
  FROM (SELECT year, unnest(lemma) AS token FROM speech_tokens)
  WHERE token IN ('der', 'the', 'la', 'de', 'und')
  GROUP BY year, token
)
SELECT year, token AS label, n FROM t
UNION ALL
SELECT year, 'Totalt' AS label, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY year
""")
def q_e03(spark, sf_dir):
    return jobs.word_trends(corpus(spark, sf_dir), TREND_WORDS)


@register("E03_word_trends_by_party", with_sql(SQL_SPEECH_TOKENS, SQL_CODES) + r"""
, t AS (
  SELECT year, party_id, token, CAST(count(*) AS BIGINT) AS n
  FROM (SELECT year, party_id, unnest(lemma) AS token FROM speech_tokens
        WHERE party_id IN (5, 6, 7) AND year BETWEEN 1975 AND 2010)
  WHERE token IN ('the', 'de')
  GROUP BY year, party_id, token
), l AS (
  SELECT t.year, t.token || ' ' || p.party_abbrev AS label, t.n FROM t LEFT JOIN party p ON t.party_id = p.party_id
), g AS (SELECT year, label, CAST(sum(n) AS BIGINT) AS n FROM l GROUP BY year, label)
SELECT year, label, n FROM g
UNION ALL
SELECT year, 'Totalt', CAST(sum(n) AS BIGINT) FROM g GROUP BY year
""")
def q_e03_party(spark, sf_dir):
    return jobs.word_trends(corpus(spark, sf_dir), ["the", "de"], {"party_id": [5, 6, 7], "year": (1975, 2010)})


@register("E03_word_trends_normalized", with_sql(SQL_SPEECH_TOKENS, SQL_CODES) + r"""
, t AS (
  SELECT year, gender_id, token, count(*) AS n
  FROM (SELECT year, gender_id, unnest(lemma) AS token FROM speech_tokens WHERE gender_id IN (1, 2))
  WHERE token IN ('the', 'la')
  GROUP BY year, gender_id, token
), raw AS (
  SELECT year, gender_id, sum(n_raw_tokens) AS raw FROM speech_tokens WHERE gender_id IN (1, 2)
  GROUP BY year, gender_id
), l AS (
  SELECT t.year, t.token || ' ' || g.gender AS label, t.n / raw.raw AS n
  FROM t JOIN raw USING (year, gender_id) LEFT JOIN gender g ON t.gender_id = g.gender_id
), g AS (SELECT year, label, sum(n) AS n FROM l GROUP BY year, label)
SELECT year, label, round(n, 6) AS n FROM g
UNION ALL
SELECT year, 'Totalt', round(sum(n), 6) FROM g GROUP BY year
""")
def q_e03_norm(spark, sf_dir):
    df = jobs.word_trends(corpus(spark, sf_dir), ["the", "la"], {"gender_id": [1, 2]}, normalize=True)
    return df.withColumn("n", F.round("n", 6))


@register("E03_word_trends_tf_idf", with_sql(SQL_SPEECH_TOKENS, SQL_DTM) + r"""
, nd AS (SELECT CAST(count(*) AS DOUBLE) AS nd FROM speech_index)
, df AS (SELECT token, CAST(count(*) AS DOUBLE) AS df FROM dtm WHERE n <> 0 GROUP BY token)
, w AS (SELECT document_id, token, n * (ln((nd + 1) / (df + 1)) + 1) AS n FROM dtm JOIN df USING (token), nd)
, nr AS (SELECT document_id, sqrt(sum(n * n)) AS norm FROM w GROUP BY document_id)
, x AS (SELECT document_id, token, n / norm AS n FROM w JOIN nr USING (document_id) WHERE token IN ('the', 'und'))
, l AS (SELECT si.year, x.token || ' ' || si.chamber_abbrev AS label, sum(x.n) AS n
        FROM x JOIN speech_index si USING (document_id) WHERE si.chamber_abbrev IN ('en', 'de') GROUP BY 1, 2)
, g AS (SELECT year, label, sum(n) AS n FROM l GROUP BY year, label)
SELECT year, label, round(n, 6) AS n FROM g
UNION ALL SELECT year, 'Totalt', round(sum(n), 6) FROM g GROUP BY year
""")
def q_e03_tfidf(spark, sf_dir):
    df = jobs.word_trends(corpus(spark, sf_dir), ["the", "und"], {"chamber_abbrev": ["en", "de"]}, keyness="tf_idf")
    return df.withColumn("n", F.round("n", 6))


@register("E03_word_trends_tf_normalized", with_sql(SQL_SPEECH_TOKENS, SQL_DTM) + r"""
, x AS (SELECT dtm.document_id, dtm.token,
               CASE WHEN si.n_raw_tokens > 0 THEN dtm.n / si.n_raw_tokens ELSE 0.0 END AS n
        FROM dtm LEFT JOIN speech_index si USING (document_id) WHERE dtm.token IN ('la', 'der'))
, g AS (SELECT si.year, x.token AS label, sum(x.n) AS n FROM x JOIN speech_index si USING (document_id)
        GROUP BY 1, 2)
SELECT year, label, round(n, 6) AS n FROM g
UNION ALL SELECT year, 'Totalt', round(sum(n), 6) FROM g GROUP BY year
""")
def q_e03_tfn(spark, sf_dir):
    df = jobs.word_trends(corpus(spark, sf_dir), ["la", "der"], keyness="tf_normalized")
    return df.withColumn("n", F.round("n", 6))
