"""Registered operator-level queries (P, A, T, U rows) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import SQL_CODES, SQL_DTM, SQL_SPEECH_TOKENS, with_sql
from ..operators import dtm as D
from ..operators import pos as POS
from ..operators import predicates as P
from ..operators import tokens as TK
from .catalog import corpus, register

_ST = with_sql(SQL_SPEECH_TOKENS)
_STD = with_sql(SQL_SPEECH_TOKENS, SQL_DTM)
_STC = with_sql(SQL_SPEECH_TOKENS, SQL_CODES)
_STDC = with_sql(SQL_SPEECH_TOKENS, SQL_DTM, SQL_CODES)


def _dtm_corpus(c):
    return D.DTMCorpus(c.dtm, c.speech_index)


# --- P: filters ------------------------------------------------------------------------------

@register("P01_filter", _ST + """
SELECT document_id, year, chamber_abbrev, gender_id, party_id FROM speech_index
WHERE year BETWEEN 1980 AND 1990 AND chamber_abbrev IN ('en', 'fr') AND NOT coalesce(gender_id = 0, false)
  AND party_id >= 10
""")
def q_p01(spark, sf_dir):
    si = corpus(spark, sf_dir).speech_index
    opts = {"year": (1980, 1990), "chamber_abbrev": ["en", "fr"], "gender_id": (False, 0), "party_id": ("ge", 10),
            "no_such_column": 1, "speech_index": None}
    return P.apply_filter(si, opts).select("document_id", "year", "chamber_abbrev", "gender_id", "party_id")


@register("P02_filter_list", _ST + """
SELECT document_id, year, chamber_abbrev FROM speech_index
WHERE year BETWEEN 1990 AND 1999 AND NOT coalesce(chamber_abbrev IN ('de'), false)
""")
def q_p02(spark, sf_dir):
    si = corpus(spark, sf_dir).speech_index
    m = [{"name": "year", "value": (1990, 1999)}, {"name": "chamber_abbrev", "value": ["de"], "sign": False}]
    return si.where(P.predicate_list(m)).select("document_id", "year", "chamber_abbrev")


@register("P04_request_filter", _ST + """
SELECT document_id, document_name, chamber_abbrev, year, speech_id, speech_name, person_id, gender_id, party_id
FROM speech_index WHERE party_id IN (1, 2, 3) AND gender_id IN (1) AND year BETWEEN 1975 AND 3000
""")
def q_p04(spark, sf_dir):
    opts = P.request_filter_opts(party_id=[1, 2, 3], gender_id=[1], from_year=1975)
    return P.speeches_by_opts(corpus(spark, sf_dir).speech_index, opts)


@register("P06_token_pattern", _ST + r"""
, h AS (
  SELECT st.document_id, g.P FROM speech_tokens st, unnest(generate_series(1, len(st.word))) AS g(P)
  WHERE (CASE WHEN regexp_full_match(st.word[g.P], '[0-9]+') THEN 'RG'
              WHEN substr(st.word[g.P], 1, 1) <> lower(substr(st.word[g.P], 1, 1)) THEN 'PM' ELSE 'NN' END) = 'PM'
    AND regexp_full_match(st.word[g.P + 1], '(?i)d[a-z]+')
)
SELECT document_id, count(*) AS n_hits FROM h GROUP BY document_id
""")
def q_p06(spark, sf_dir):
    st = corpus(spark, sf_dir).tokens_with_pos()
    pattern = [{"target": "pos", "value": "PM", "ignore_case": False}, {"target": "word", "value": "d[a-z]+"}]
    hits = TK.match_tokens(st, pattern, keep=["document_id"])
    return hits.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_hits"))


@register("P08_filter_documents", _STD + """
SELECT * FROM dtm WHERE document_id IN (SELECT document_id FROM speech_index WHERE year BETWEEN 1970 AND 1975)
""")
def q_p08(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return D.filter_documents(_dtm_corpus(c), {"year": (1970, 1975)}).dtm


@register("P09_filter_by_labels", _STC + """
SELECT document_id, party_id FROM speech_index WHERE party_id IN (SELECT party_id FROM party
                                                                WHERE party IN ('NATION_3', 'NATION_7'))
""")
def q_p09(spark, sf_dir):
    c = corpus(spark, sf_dir)
    labels = P.parse_value_pairs(["party: NATION_3,NATION_7"])["party"]
    return P.filter_by_labels(c.speech_index.select("document_id", "party_id"), c.party, label_column="party",
                              id_column="party_id", labels=labels)


@register("P10_words_in_vocabulary", _STD + """
, v AS (SELECT DISTINCT token FROM dtm)
, t AS (SELECT * FROM (VALUES (0, 'The'), (1, 'und'), (2, 'XYZQ'), (3, 'Der')) AS t(ord, term))
SELECT t.ord, t.term, coalesce(e.token, l.token) AS token
FROM t LEFT JOIN v e ON t.term = e.token LEFT JOIN v l ON lower(t.term) = l.token
WHERE coalesce(e.token, l.token) IS NOT NULL
""")
def q_p10(spark, sf_dir):
    c = corpus(spark, sf_dir)
    terms = D.terms_frame(spark, ["The", "und", "XYZQ", "Der"])
    return D.words_in_vocabulary(terms, D.term_frequency(c.dtm))


@register("P12_slice_by_predicate", _STD + "SELECT * FROM dtm WHERE regexp_matches(token, '^q')")
def q_p12(spark, sf_dir):
    return D.slice_by_predicate(corpus(spark, sf_dir).dtm, lambda t: t.rlike("^q"))


@register("P14_rename_columns", _ST + """
SELECT min(year) AS "first year", max(year) AS "max year" FROM speech_index
""")
def q_p14(spark, sf_dir):
    yr = D.year_range(corpus(spark, sf_dir).speech_index)
    return P.rename_columns(yr, [("_year", " year"), ("min", "first")])


# --- A: aggregations --------------------------------------------------------------------------

@register("A01_group_by_pivot_keys", _STD + """
SELECT si.year - si.year % 10 AS time_period, si.party_id, d.token, CAST(sum(d.n) AS BIGINT) AS n
FROM dtm d JOIN speech_index si USING (document_id) WHERE si.chamber_abbrev IN ('en')
GROUP BY 1, 2, 3
""")
def q_a01(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return D.group_by_pivot_keys(_dtm_corpus(c), "decade", ["party_id"], {"chamber_abbrev": ["en"]}).dtm


@register("A01_grouped_index", _ST + """
SELECT year - year % 10 AS time_period, party_id, CAST(sum(n_tokens) AS BIGINT) AS n_tokens,
       CAST(sum(n_raw_tokens) AS BIGINT) AS n_raw_tokens, count(DISTINCT document_id) AS n_documents,
       CAST(year - year % 10 AS VARCHAR) || '_' || CAST(party_id AS VARCHAR) AS document_name
FROM speech_index WHERE chamber_abbrev IN ('en') GROUP BY 1, 2
""")
def q_a01_index(spark, sf_dir):
    c = corpus(spark, sf_dir)
    gi = D.group_by_pivot_keys(_dtm_corpus(c), "decade", ["party_id"], {"chamber_abbrev": ["en"]}).index
    return gi.select("time_period", "party_id", "n_tokens", "n_raw_tokens", "n_documents", "document_name")


@register("A02_group_by_column_mean", _STD + """
, g AS (SELECT gender_id, count(DISTINCT document_id) AS nd FROM speech_index GROUP BY gender_id)
SELECT si.gender_id AS category, d.token, round(sum(d.n) / g.nd, 6) AS n
FROM dtm d JOIN speech_index si USING (document_id) JOIN g ON si.gender_id = g.gender_id
GROUP BY si.gender_id, d.token, g.nd
""")
def q_a02(spark, sf_dir):
    c = corpus(spark, sf_dir)
    g = D.group_by_column(_dtm_corpus(c), "gender_id", aggregate="mean")
    return g.dtm.withColumn("n", F.round("n", 6))


@register("A03_group_by_year_fill_gaps", _ST + """
, f AS (SELECT * FROM speech_index WHERE party_id IN (3))
, g AS (SELECT year AS category, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, CAST(sum(n_raw_tokens) AS BIGINT) AS n_raw_tokens,
               count(DISTINCT document_id) AS n_documents, CAST(year AS VARCHAR) AS document_name FROM f GROUP BY year)
, spine AS (SELECT unnest(generate_series((SELECT min(category) FROM g), (SELECT max(category) FROM g))) AS category)
SELECT * FROM g
UNION ALL
SELECT category, 0, 0, 0, CAST(category AS VARCHAR) FROM spine WHERE category NOT IN (SELECT category FROM g)
""")
def q_a03(spark, sf_dir):
    c = corpus(spark, sf_dir)
    sub = D.filter_documents(_dtm_corpus(c), {"party_id": [3]})
    g = D.group_by_year(sub, fill_gaps=True)
    return g.index.select("category", "n_tokens", "n_raw_tokens", "n_documents", "document_name")


@register("A04_group_by_decade", _STD + """
SELECT si.year - si.year % 10 AS time_period, d.token, CAST(sum(d.n) AS BIGINT) AS n
FROM dtm d JOIN speech_index si USING (document_id) GROUP BY 1, 2
""")
def q_a04(spark, sf_dir):
    return D.group_by_temporal_key(_dtm_corpus(corpus(spark, sf_dir)), "decade").dtm


_SQL_MAPPING = """
, mp AS (
  SELECT 'q' || CAST(quality AS VARCHAR) AS group_id, doc_id AS document_id FROM labels
  UNION ALL SELECT 't' || CAST(toxic AS VARCHAR), doc_id FROM labels
)"""


def _mapping(spark, sf_dir):
    lab = corpus(spark, sf_dir).table("labels")
    q = lab.select(F.concat(F.lit("q"), F.col("quality").cast("string")).alias("group_id"),
                   F.col("doc_id").alias("document_id"))
    t = lab.select(F.concat(F.lit("t"), F.col("toxic").cast("string")).alias("group_id"),
                   F.col("doc_id").alias("document_id"))
    return q.unionByName(t)


@register("A05_group_by_mapping", _STD + _SQL_MAPPING + """
SELECT mp.group_id, d.token, CAST(sum(d.n) AS BIGINT) AS n FROM dtm d JOIN mp USING (document_id) GROUP BY 1, 2
""")
def q_a05(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return D.group_by_mapping(_dtm_corpus(c), _mapping(spark, sf_dir)).dtm


@register("A06_index_group_by_column", _STC + """
, g AS (SELECT chamber_abbrev AS category, CAST(sum(n_tokens) AS BIGINT) AS n_tokens,
               CAST(sum(n_raw_tokens) AS BIGINT) AS n_raw_tokens, min(year) AS year_from, max(year) AS year_to,
               count(*) AS n_documents FROM speech_index GROUP BY chamber_abbrev)
SELECT c.chamber_abbrev AS category, g.n_tokens, g.n_raw_tokens, g.year_from, g.year_to, g.n_documents
FROM chamber c LEFT JOIN g ON c.chamber_abbrev = g.category
""")
def q_a06(spark, sf_dir):
    c = corpus(spark, sf_dir)
    values = c.chamber.select(F.col("chamber_abbrev").alias("category"))
    return D.index_group_by_column(c.speech_index, "chamber_abbrev", index_values=values)


@register("A07_index_group_by_lustrum", _ST + """
SELECT year - year % 5 AS category, CAST(sum(n_tokens) AS BIGINT) AS n_tokens,
       CAST(sum(n_raw_tokens) AS BIGINT) AS n_raw_tokens, min(year) AS year_from, max(year) AS year_to,
       count(*) AS n_documents
FROM speech_index GROUP BY 1
""")
def q_a07(spark, sf_dir):
    g, _ = D.index_group_by_temporal_key(corpus(spark, sf_dir).speech_index, "lustrum")
    return g


@register("A07_lustrum_members", _ST + "SELECT year - year % 5 AS time_period, document_id FROM speech_index")
def q_a07_members(spark, sf_dir):
    _, members = D.index_group_by_temporal_key(corpus(spark, sf_dir).speech_index, "lustrum")
    return members


@register("A08_count_documents", _ST + """
SELECT chamber_abbrev, count(*) AS n_documents FROM speech_index GROUP BY 1 ORDER BY 1
""")
def q_a08(spark, sf_dir):
    return D.count_documents_by_pivot(corpus(spark, sf_dir).speech_index, "chamber_abbrev")


@register("A09_term_frequency", _STD + "SELECT token, CAST(sum(n) AS BIGINT) AS tf FROM dtm GROUP BY token")
def q_a09(spark, sf_dir):
    return D.term_frequency(corpus(spark, sf_dir).dtm)


@register("A09_word_vector", _STD + """
SELECT si.document_id, coalesce(d.n, 0) AS n FROM speech_index si
LEFT JOIN (SELECT document_id, n FROM dtm WHERE token = 'und') d USING (document_id)
""")
def q_a09_vec(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return D.word_vector(c.dtm, c.speech_index, "und")


@register("A10_document_token_counts", _STD + "SELECT document_id, CAST(sum(n) AS BIGINT) AS n_tokens FROM dtm GROUP BY 1")
def q_a10(spark, sf_dir):
    return D.document_token_counts(corpus(spark, sf_dir).dtm)


_SQL_A11 = _ST + """
, h AS (
  SELECT st.speech_id, st.word, g.P FROM speech_tokens st, unnest(generate_series(1, len(st.lemma))) AS g(P)
  WHERE st.lemma[g.P] = 'die'
), win AS (SELECT speech_id, array_to_string(list_slice(word, greatest(P - 1, 1), P + 1), ' ') AS "window" FROM h)
"""


@register("A11_keyword_windows", _SQL_A11 + """
SELECT "window", count(*) AS window_count, count(DISTINCT speech_id) AS n_documents FROM win GROUP BY "window"
""")
def q_a11(spark, sf_dir):
    st = corpus(spark, sf_dir).speech_tokens
    return TK.keyword_windows(TK.windows(st, [{"target": "lemma", "value": "die"}], context=2))


@register("A11_window_documents", _SQL_A11 + 'SELECT DISTINCT "window", speech_id FROM win')
def q_a11_docs(spark, sf_dir):
    st = corpus(spark, sf_dir).speech_tokens
    return TK.window_documents(TK.windows(st, [{"target": "lemma", "value": "die"}], context=2))


@register("A15_corpus_stats", _STD + """
, tf AS (SELECT token, sum(n) AS tf FROM dtm GROUP BY token)
, top AS (SELECT string_agg(token, ' ' ORDER BY tf DESC, token) AS top_tokens
          FROM (SELECT * FROM tf ORDER BY tf DESC, token LIMIT 10))
SELECT (SELECT count(*) FROM speech_index) AS n_documents, (SELECT count(*) FROM tf) AS vocabulary_size,
       (SELECT CAST(sum(tf) AS BIGINT) FROM tf) AS n_tokens, top.top_tokens FROM top
""")
def q_a15(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return D.corpus_stats(c.dtm, c.speech_index)


_GROUPS = POS.groups_of()


@register("A16_pos_group_counts", with_sql(r"""
tagged AS (
  SELECT doc_id AS document_id,
         CASE WHEN t = '.' THEN 'MAD' WHEN t = ',' THEN 'MID'
              WHEN NOT regexp_full_match(t, '[\p{L}\p{N}]+') THEN 'PAD'
              WHEN regexp_full_match(t, '[0-9]+') THEN 'RG'
              WHEN substr(t, 1, 1) <> lower(substr(t, 1, 1)) THEN 'PM' ELSE 'NN' END AS tag
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) AS t FROM documents)
),
scheme AS (SELECT * FROM (VALUES """ + ", ".join(f"('{t}', '{g}')" for t, g, _ in POS.SUC_TAGS) + """)
           AS s(tag, tag_group_name))""") + "SELECT document_id, " + ", ".join(
    f"count(*) FILTER (WHERE s.tag_group_name = '{g}') AS \"{g}\"" for g in _GROUPS) + """,
       count(*) FILTER (WHERE coalesce(s.tag_group_name, '') <> 'Delimiter') AS n_tokens
FROM tagged LEFT JOIN scheme s USING (tag) GROUP BY document_id
""")
def q_a16(spark, sf_dir):
    c = corpus(spark, sf_dir)
    toks = c.documents.select(F.col("doc_id").alias("document_id"),
                              F.explode(F.regexp_extract_all("text", F.lit(POS.TAGGED_TOKEN_PATTERN), 0)).alias("t"))
    tags = toks.select("document_id", POS.stand_in_tag(F.col("t")).alias("tag"))
    return POS.group_counts(tags, POS.scheme(spark), groups=_GROUPS)


@register("A17_vocabulary_ids", _STD + """
SELECT token, tf, row_number() OVER (ORDER BY tf DESC, token) - 1 AS token_id
FROM (SELECT token, CAST(sum(n) AS BIGINT) AS tf FROM dtm GROUP BY token)
""")
def q_a17(spark, sf_dir):
    return D.vocabulary(corpus(spark, sf_dir).dtm, with_ids=True).select("token", "tf", "token_id")


@register("A19_codify_column", _ST + """
SELECT document_id, chamber_abbrev, dense_rank() OVER (ORDER BY chamber_abbrev) - 1 AS chamber_abbrev_id
FROM speech_index
""")
def q_a19(spark, sf_dir):
    si = corpus(spark, sf_dir).speech_index.select("document_id", "chamber_abbrev")
    return D.codify_column(si, "chamber_abbrev").select("document_id", "chamber_abbrev", "chamber_abbrev_id")


# --- T: top-k and slicing ------------------------------------------------------------------------

@register("T01_top_n_words", _STD + """
SELECT token, CAST(sum(n) AS BIGINT) AS tf FROM dtm GROUP BY token ORDER BY tf DESC, token LIMIT 25
""")
def q_t01(spark, sf_dir):
    return D.top_n_words(D.term_frequency(corpus(spark, sf_dir).dtm), 25)


@register("T02_slice_by_n_top", _STD + """
SELECT * FROM dtm WHERE token IN (SELECT token FROM (SELECT token, sum(n) AS tf FROM dtm GROUP BY token)
                                  ORDER BY tf DESC, token LIMIT 20)
""")
def q_t02(spark, sf_dir):
    return D.slice_by_n_top(corpus(spark, sf_dir).dtm, 20)


@register("T05_slice_by_tf", _STD + """
SELECT * FROM dtm WHERE token IN (SELECT token FROM dtm GROUP BY token HAVING sum(n) >= 200)
                     OR token IN ('zu', 'von')
""")
def q_t05(spark, sf_dir):
    return D.slice_by_tf(corpus(spark, sf_dir).dtm, 200, keeps=["zu", "von"])


# --- U: set operations ------------------------------------------------------------------------------

@register("U01_extend_index", _ST + """
, a AS (SELECT document_name, speech_id, year FROM speech_index WHERE year < 1990)
, b AS (SELECT document_name, speech_id, year FROM speech_index WHERE chamber_abbrev = 'en')
SELECT * FROM a UNION ALL SELECT * FROM b WHERE document_name NOT IN (SELECT document_name FROM a)
""")
def q_u01(spark, sf_dir):
    si = corpus(spark, sf_dir).speech_index
    a = si.where(F.col("year") < 1990).select("document_name", "speech_id", "year")
    b = si.where(F.col("chamber_abbrev") == "en").select("document_name", "speech_id", "year")
    return D.extend_index(a, b)


_SQL_TAGGED = r"""
tagged AS (
  SELECT doc_id AS document_id,
         CASE WHEN t = '.' THEN 'MAD' WHEN t = ',' THEN 'MID'
              WHEN NOT regexp_full_match(t, '[\p{L}\p{N}]+') THEN 'PAD'
              WHEN regexp_full_match(t, '[0-9]+') THEN 'RG'
              WHEN substr(t, 1, 1) <> lower(substr(t, 1, 1)) THEN 'PM' ELSE 'NN' END AS tag
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) AS t FROM documents)
)"""


@register("U03_exclude_tags", with_sql(_SQL_TAGGED) + """
, kept AS (SELECT * FROM (VALUES """ + ", ".join(
    f"('{t}', '{g}')" for t, g, _ in POS.SUC_TAGS if g not in ("Noun", "Delimiter") and t != "AB") + """)
           AS s(tag, tag_group_name))
SELECT k.tag, k.tag_group_name, count(t.tag) AS n FROM kept k LEFT JOIN tagged t USING (tag)
GROUP BY k.tag, k.tag_group_name
""")
def q_u03(spark, sf_dir):
    c = corpus(spark, sf_dir)
    kept = POS.all_types_except(POS.scheme(spark), ["Noun", "AB"]).select("tag", "tag_group_name")
    toks = c.documents.select(F.explode(F.regexp_extract_all("text", F.lit(POS.TAGGED_TOKEN_PATTERN), 0)).alias("t"))
    counts = toks.select(POS.stand_in_tag(F.col("t")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return kept.join(counts, "tag", "left").select("tag", "tag_group_name",
                                                   F.coalesce("n", F.lit(0)).alias("n"))
