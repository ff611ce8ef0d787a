"""Further registered queries (filled in as operators are added)."""

from pyspark.sql import functions as F

from ..model import SQL_CODES, SQL_DTM, SQL_SPEECH_TOKENS, with_sql
from ..operators import codes, dtm, tokens
from ..operators.predicates import token_criteria
from ..sources import read_tables
from . import jobs
from .catalog import corpus, register

PDF_BASE = "https://pdf.example.org/records/"

# Decoded speech columns as SQL over a relation `h` that carries speech index columns.
SQL_DECODED = f"""
  pe.name, pa.party_abbrev, pa.party, g.gender, g.gender_abbrev,
  CASE WHEN pe.wiki_id = 'unknown' THEN 'Okänd' ELSE 'https://www.wikidata.org/wiki/' || pe.wiki_id END AS link,
  '{PDF_BASE}' || split_part(h.document_name, '-', 2) || '/' || split_part(h.document_name, '_', 1)
     || '.pdf#page=1' AS speech_link,
  pe.wiki_id"""
SQL_DECODE_JOINS = """
  LEFT JOIN persons pe ON h.person_id = pe.person_id
  LEFT JOIN party pa ON h.party_id = pa.party_id
  LEFT JOIN gender g ON h.gender_id = g.gender_id"""


# --- E01 KWIC -------------------------------------------------------------------------

@register("E01_kwic", with_sql(SQL_SPEECH_TOKENS, SQL_CODES) + f"""
, h AS (
  SELECT st.*, g.P FROM speech_tokens st, unnest(generate_series(1, len(st.lemma))) AS g(P)
  WHERE st.lemma[g.P] = 'the' AND st.year >= 1980 AND st.year <= 2005
)
SELECT array_to_string(list_slice(h.word, greatest(h.P - 2, 1), h.P - 1), ' ') AS left_word,
       array_to_string(list_slice(h.word, h.P, h.P), ' ') AS node_word,
       array_to_string(list_slice(h.word, h.P + 1, h.P + 2), ' ') AS right_word,
       h.year, h.person_id, h.speech_name, h.document_name, h.chamber_abbrev, h.speech_id, h.document_id,
       {SQL_DECODED}
FROM h {SQL_DECODE_JOINS}
""")
def q_e01(spark, sf_dir):
    return jobs.kwic(corpus(spark, sf_dir), "the", lemmatized=True, words_before=2, words_after=2,
                     criteria=token_criteria(from_year=1980, to_year=2005))


@register("E01_kwic_phrase", with_sql(SQL_SPEECH_TOKENS, SQL_CODES) + f"""
, h AS (
  SELECT st.*, g.P FROM speech_tokens st, unnest(generate_series(1, len(st.lemma))) AS g(P)
  WHERE lower(st.word[g.P]) = 'of' AND lower(st.word[g.P + 1]) = 'the' AND st.chamber_abbrev IN ('en')
)
SELECT array_to_string(list_slice(h.word, greatest(h.P - 3, 1), h.P - 1), ' ') AS left_word,
       array_to_string(list_slice(h.word, h.P, h.P + 1), ' ') AS node_word,
       array_to_string(list_slice(h.word, h.P + 2, h.P + 4), ' ') AS right_word,
       h.year, h.person_id, h.speech_name, h.document_name, h.chamber_abbrev, h.speech_id, h.document_id,
       {SQL_DECODED}
FROM h {SQL_DECODE_JOINS}
""")
def q_e01_phrase(spark, sf_dir):
    return jobs.kwic(corpus(spark, sf_dir), "of the", lemmatized=False, words_before=3, words_after=3,
                     criteria=token_criteria(chamber_abbrev=["EN"]))


# --- E02 n-grams -----------------------------------------------------------------------

_SQL_E02_HITS = with_sql(SQL_SPEECH_TOKENS) + """
, h AS (
  SELECT st.speech_id, st.word, g.P FROM speech_tokens st, unnest(generate_series(1, len(st.word))) AS g(P)
  WHERE lower(st.word[g.P]) = 'der'
), win AS (SELECT speech_id, list_slice(word, greatest(P - 1, 1), P + 1) AS w FROM h)
, ng AS (
  SELECT speech_id, array_to_string(list_slice(w, i, i + 2), ' ') AS ngram
  FROM win, unnest(generate_series(1, len(w) - 2)) AS s(i)
)
"""


@register("E02_ngrams", _SQL_E02_HITS + """
SELECT ngram, count(*) AS window_count, count(DISTINCT speech_id) AS n_documents
FROM ng GROUP BY ngram HAVING count(*) >= 2
""")
def q_e02(spark, sf_dir):
    return jobs.ngrams(corpus(spark, sf_dir), "der", n=3, threshold=2)


@register("E02_ngram_documents", _SQL_E02_HITS + """
SELECT DISTINCT ngram, speech_id FROM ng WHERE ngram IN (SELECT ngram FROM ng GROUP BY ngram HAVING count(*) >= 2)
""")
def q_e02_docs(spark, sf_dir):
    return jobs.ngrams(corpus(spark, sf_dir), "der", n=3, threshold=2, documents=True)


_SQL_E02_PHRASE = with_sql(SQL_SPEECH_TOKENS) + r"""
, h AS (
  SELECT st.speech_id, st.word, g.P FROM speech_tokens st, unnest(generate_series(1, len(st.lemma))) AS g(P)
  WHERE st.lemma[g.P] = 'of' AND st.lemma[g.P + 1] = 'the' AND regexp_full_match(st.lemma[g.P + 2], '(?i)[a-z]+')
), win AS (SELECT speech_id, list_slice(word, greatest(P - 1, 1), P + 3) AS w, P - greatest(P - 1, 1) AS off FROM h)
, ng AS (
  SELECT speech_id, array_to_string(list_slice(w, i, i + 2), ' ') AS ngram
  FROM win, unnest(generate_series(1, len(w) - 2)) AS s(i)
  WHERE i - 1 <= off AND off + 3 <= i - 1 + 3
)
"""


@register("E02_ngrams_contains_phrase", _SQL_E02_PHRASE + """
SELECT ngram, count(*) AS window_count, count(DISTINCT speech_id) AS n_documents FROM ng GROUP BY ngram
""")
def q_e02_phrase(spark, sf_dir):
    return jobs.ngrams(corpus(spark, sf_dir), ["of", "the", "[a-z]+"], n=3, threshold=None, search_target="lemma",
                       contains_phrase=True)


@register("E02_ngrams_left_aligned", with_sql(SQL_SPEECH_TOKENS) + """
, h AS (
  SELECT st.speech_id, st.word, g.P FROM speech_tokens st, unnest(generate_series(1, len(st.lemma))) AS g(P)
  WHERE st.lemma[g.P] = 'la'
)
SELECT array_to_string(list_slice(word, P, P + 2), ' ') AS ngram, count(*) AS window_count,
       count(DISTINCT speech_id) AS n_documents
FROM h GROUP BY 1
""")
def q_e02_left(spark, sf_dir):
    return jobs.ngrams(corpus(spark, sf_dir), "la", n=3, threshold=None, search_target="lemma", mode="left-aligned")


# --- E04 speeches with words --------------------------------------------------------------

@register("E04_speeches_with_words", with_sql(SQL_SPEECH_TOKENS, SQL_CODES) + f"""
, f AS (
  SELECT DISTINCT x.document_id, t.ord, t.token
  FROM (SELECT document_id, unnest(lemma) AS token FROM speech_tokens WHERE year BETWEEN 1990 AND 2019) x
  JOIN (VALUES (0, 'und'), (1, 'les'), (2, 'el')) AS t(ord, token) ON x.token = t.token
), w AS (SELECT document_id, string_agg(token, ',' ORDER BY ord) AS node_word FROM f GROUP BY document_id)
SELECT h.document_id, h.document_name, h.chamber_abbrev, h.year, h.speech_id, h.speech_name, h.person_id,
       w.node_word, {SQL_DECODED}
FROM speech_index h JOIN w USING (document_id) {SQL_DECODE_JOINS}
""")
def q_e04(spark, sf_dir):
    return jobs.speeches_with_words(corpus(spark, sf_dir), ["und", "les", "El"], {"year": (1990, 2019)})


# --- E05 word hits -----------------------------------------------------------------------

@register("E05_word_hits", with_sql(SQL_SPEECH_TOKENS) + r"""
SELECT token, count(*) AS tf FROM (SELECT unnest(lemma) AS token FROM speech_tokens)
WHERE regexp_full_match(token, 'ver.*')
GROUP BY token ORDER BY tf DESC, token LIMIT 5
""")
def q_e05(spark, sf_dir):
    return jobs.word_hits(corpus(spark, sf_dir), "ver*", n_hits=5)


@register("E05_word_hits_regex", with_sql(SQL_SPEECH_TOKENS) + r"""
SELECT token, count(*) AS tf FROM (SELECT unnest(lemma) AS token FROM speech_tokens)
WHERE regexp_matches(token, '^(?:th[a-z]+n)')
GROUP BY token ORDER BY tf DESC, token LIMIT 10
""")
def q_e05_regex(spark, sf_dir):
    return jobs.word_hits(corpus(spark, sf_dir), "|th[a-z]+n|", n_hits=10)


# --- E06 speeches --------------------------------------------------------------------------

@register("E06_speeches", with_sql(SQL_SPEECH_TOKENS, SQL_CODES) + f"""
SELECT h.document_id, h.document_name, h.chamber_abbrev, h.year, h.speech_id, h.speech_name, h.person_id,
       {SQL_DECODED}
FROM speech_index h {SQL_DECODE_JOINS}
WHERE h.year BETWEEN 1980 AND 1995 AND h.chamber_abbrev IN ('en', 'de') AND h.gender_id IN (1, 2)
""")
def q_e06(spark, sf_dir):
    return jobs.speeches(corpus(spark, sf_dir), {"year": (1980, 1995), "chamber_abbrev": ["en", "de"],
                                                 "gender_id": [1, 2], "unknown_column": 5, "party_id": None})


# --- E09 speakers ---------------------------------------------------------------------------

@register("E09_speakers", with_sql(SQL_CODES) + """
, sel AS (SELECT * FROM persons WHERE person_id IN (SELECT person_id FROM person_party WHERE party_id IN (1, 2)))
, lists AS (
  SELECT pp.person_id, string_agg(DISTINCT pa.party_abbrev, ', ' ORDER BY pa.party_abbrev) AS abbrevs
  FROM person_party pp LEFT JOIN party pa ON pp.party_id = pa.party_id GROUP BY pp.person_id
)
SELECT s.name, coalesce(l.abbrevs, '?') AS party_abbrev, s.year_of_birth, s.year_of_death, s.person_id
FROM sel s LEFT JOIN lists l ON s.person_id = l.person_id
""")
def q_e09(spark, sf_dir):
    return jobs.speakers(corpus(spark, sf_dir), {"party_id": [1, 2]})


@register("E09_speakers_by_chamber", with_sql(SQL_SPEECH_TOKENS, SQL_CODES) + """
, sel AS (SELECT * FROM persons WHERE person_id IN (SELECT person_id FROM speech_index WHERE lower(chamber_abbrev) = 'fr')
                                  AND gender_id IN (2))
, lists AS (
  SELECT pp.person_id, string_agg(DISTINCT pa.party_abbrev, ', ' ORDER BY pa.party_abbrev) AS abbrevs
  FROM person_party pp LEFT JOIN party pa ON pp.party_id = pa.party_id GROUP BY pp.person_id
)
SELECT s.name, coalesce(l.abbrevs, '?') AS party_abbrev, s.year_of_birth, s.year_of_death, s.person_id
FROM sel s LEFT JOIN lists l ON s.person_id = l.person_id
""")
def q_e09_chamber(spark, sf_dir):
    return jobs.speakers(corpus(spark, sf_dir), {"chamber_abbrev": ["FR"], "gender_id": [2], "party_id": []})


# --- E10 metadata lists -----------------------------------------------------------------------

@register("E10_years", with_sql(SQL_SPEECH_TOKENS) + """
SELECT min(year) AS min_year, max(year) AS max_year FROM speech_index
""")
def q_e10_years(spark, sf_dir):
    return jobs.metadata_lists(corpus(spark, sf_dir))["years"]


@register("E10_parties", with_sql(SQL_CODES) + "SELECT * FROM party ORDER BY sort_order, party")
def q_e10_parties(spark, sf_dir):
    return jobs.metadata_lists(corpus(spark, sf_dir))["parties"]


@register("E10_chambers", with_sql(SQL_SPEECH_TOKENS, SQL_CODES) + """
SELECT c.*, count(si.document_id) AS n_speeches FROM chamber c LEFT JOIN speech_index si USING (chamber_abbrev)
WHERE trim(c.chamber_abbrev) <> '' GROUP BY ALL
""")
def q_e10_chambers(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return _with_speech_counts(jobs.metadata_lists(c)["chambers"], c.speech_index, "chamber_abbrev")


def _with_speech_counts(codes_df, speech_index, key):
    n = speech_index.groupBy(key).agg(F.count(F.lit(1)).alias("n_speeches"))
    return codes_df.join(n, key, "left").withColumn("n_speeches", F.coalesce("n_speeches", F.lit(0)))


@register("E10_office_types", with_sql(SQL_CODES) + "SELECT * FROM office_type")
def q_e10_offices(spark, sf_dir):
    return jobs.metadata_lists(corpus(spark, sf_dir))["office_types"]


@register("E10_sub_office_types", with_sql(SQL_CODES) + "SELECT * FROM sub_office_type")
def q_e10_sub_offices(spark, sf_dir):
    return jobs.metadata_lists(corpus(spark, sf_dir))["sub_office_types"]


@register("E10_genders", with_sql(SQL_SPEECH_TOKENS, SQL_CODES) + """
SELECT g.*, count(si.document_id) AS n_speeches FROM gender g LEFT JOIN speech_index si USING (gender_id)
GROUP BY ALL
""")
def q_e10_genders(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return _with_speech_counts(jobs.metadata_lists(c)["genders"], c.speech_index, "gender_id")


@register("E05_word_hits_upper_glob", with_sql(SQL_SPEECH_TOKENS) + r"""
SELECT token, CAST(count(*) AS BIGINT) AS tf FROM (SELECT unnest(lemma) AS token FROM speech_tokens)
WHERE regexp_full_match(token, 'ver.*')
GROUP BY token ORDER BY tf DESC, token LIMIT 5
""")
def q_e05_upper(spark, sf_dir):
    return jobs.word_hits(corpus(spark, sf_dir), "Ver*")


# --- absent words, display values, aligned n-grams, periods with gaps ---------------------------

@register("E03_word_trends_absent_word", with_sql(SQL_SPEECH_TOKENS) + """
SELECT year, token AS label, count(*) AS n FROM (SELECT year, unnest(lemma) AS token FROM speech_tokens)
WHERE token = 'the' GROUP BY year, token
""")
def q_e03_absent(spark, sf_dir):
    return jobs.word_trends(corpus(spark, sf_dir), ["The", "qqqzzz"])


@register("E03_word_trends_absent_word_years", with_sql(SQL_SPEECH_TOKENS) + """
, t AS (
  SELECT year, token AS label, count(*) AS n
  FROM (SELECT year, unnest(lemma) AS token FROM speech_tokens WHERE year BETWEEN 1980 AND 1999)
  WHERE token IN ('the', 'der') GROUP BY year, token
)
SELECT year, label, n FROM t UNION ALL SELECT year, 'Totalt', CAST(sum(n) AS BIGINT) FROM t GROUP BY year
""")
def q_e03_absent_years(spark, sf_dir):
    return jobs.word_trends(corpus(spark, sf_dir), ["the", "der", "qqqzzz"], {"year": (1980, 1999)})


@register("R01_word_trends_wide_absent_word", with_sql(SQL_SPEECH_TOKENS) + """
SELECT year, count(*) AS the FROM (SELECT year, unnest(lemma) AS token FROM speech_tokens)
WHERE token = 'the' GROUP BY year
""")
def q_r01_absent(spark, sf_dir):
    return jobs.word_trends_wide(corpus(spark, sf_dir), ["the", "qqqzzz"])


@register("E06_speeches_display", with_sql(SQL_SPEECH_TOKENS, SQL_CODES) + f"""
, l AS (SELECT h.document_id, h.document_name, h.chamber_abbrev, h.year, h.speech_id, h.speech_name, h.person_id,
               {SQL_DECODED}
        FROM speech_index h {SQL_DECODE_JOINS} WHERE h.year BETWEEN 1980 AND 1995)
SELECT * REPLACE (CASE gender WHEN 'man' THEN 'Man' WHEN 'unknown' THEN '' ELSE gender END AS gender) FROM l
ORDER BY coalesce(name, '') = '', document_id
""")
def q_e06_display(spark, sf_dir):
    return jobs.speeches(corpus(spark, sf_dir), {"year": (1980, 1995)}, sort=True,
                         value_updates={"gender": {"man": "Man", "unknown": ""}, "no_column": {"a": "b"}})


@register("E02_ngrams_right_aligned", with_sql(SQL_SPEECH_TOKENS) + """
, h AS (
  SELECT st.speech_id, st.word, g.P FROM speech_tokens st, unnest(generate_series(1, len(st.lemma))) AS g(P)
  WHERE st.lemma[g.P] = 'la'
)
SELECT array_to_string(list_slice(word, greatest(P - 2, 1), P), ' ') AS ngram, count(*) AS window_count,
       count(DISTINCT speech_id) AS n_documents
FROM h GROUP BY 1
""")
def q_e02_right(spark, sf_dir):
    return jobs.ngrams(corpus(spark, sf_dir), "la", n=3, threshold=None, search_target="lemma", mode="right-aligned")


def _gaps_sql(step: int) -> str:
    return with_sql(SQL_SPEECH_TOKENS) + f"""
, g AS (SELECT year - year % {step} AS time_period, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, count(*) AS n_documents
        FROM speech_index WHERE year < 1980 OR year >= 2000 GROUP BY 1)
, spine AS (SELECT unnest(generate_series((SELECT min(time_period) FROM g), (SELECT max(time_period) FROM g), {step})) AS time_period)
SELECT * FROM g
UNION ALL SELECT time_period, 0, 0 FROM spine WHERE time_period NOT IN (SELECT time_period FROM g)
"""


def _gaps(spec: str, step: int):
    def q(spark, sf_dir):
        c = corpus(spark, sf_dir)
        sub = dtm.filter_documents(dtm.DTMCorpus(c.dtm, c.speech_index), (F.col("year") < 1980) | (F.col("year") >= 2000))
        index = dtm.group_by_temporal_key(sub, spec).index
        return dtm.fill_temporal_gaps(index, "time_period", [], step).select("time_period", "n_tokens", "n_documents")
    return q


register("U02_fill_gaps_lustrum", _gaps_sql(5))(_gaps("lustrum", 5))
register("U02_fill_gaps_decade", _gaps_sql(10))(_gaps("decade", 10))


# --- code tables, index checks, lists ----------------------------------------------------------

@register("S02_code_tables", """
SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def q_s02(spark, sf_dir):
    t = read_tables(spark, sf_dir, ["nation.parquet", "region.parquet"])
    n, r = t["nation.parquet"], t["region.parquet"]
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_name", "r_name")


@register("S03_slim_persons", with_sql(SQL_CODES) + """
SELECT person_id, name, CAST(coalesce(year_of_death, 0) AS INTEGER) AS year_of_death FROM persons
""")
def q_s03(spark, sf_dir):
    slim = codes.slim_table(corpus(spark, sf_dir).persons, {"year_of_death": 0}, {"year_of_death": "int"})
    return slim.select("person_id", "name", "year_of_death")


@register("S03_duplicate_keys", with_sql(SQL_CODES) + """
SELECT person_id, count(*) AS "count" FROM person_party GROUP BY person_id HAVING count(*) > 1
""")
def q_s03_duplicates(spark, sf_dir):
    return codes.duplicate_keys(corpus(spark, sf_dir).person_party, "person_id")


@register("S15_index_mismatches", with_sql(SQL_SPEECH_TOKENS, SQL_DTM) + """
SELECT document_id FROM speech_index WHERE chamber_abbrev = 'en'
UNION ALL SELECT DISTINCT document_id FROM dtm JOIN speech_index USING (document_id) WHERE chamber_abbrev = 'fr'
""")
def q_s15_mismatches(spark, sf_dir):
    """Counts of the German and French chambers against an index of the English and German ones."""
    c = corpus(spark, sf_dir)
    of = lambda *abbrevs: F.col("chamber_abbrev").isin(*abbrevs)
    counts = dtm.dtm_from_token_arrays(c.speech_tokens.where(of("de", "fr")))
    index = c.speech_index.where(of("en") | (of("de") & (F.col("n_tokens") > 0)))
    return dtm.check_index_covers(counts, index)


@register("R07_words_as_list", with_sql(SQL_SPEECH_TOKENS) + """
SELECT DISTINCT document_id, token FROM (SELECT document_id, unnest(lemma) AS token FROM speech_tokens)
WHERE token IN ('und', 'les', 'the')
""")
def q_r07(spark, sf_dir):
    found = tokens.documents_with_words(corpus(spark, sf_dir).speech_tokens, ["und", "les", "the"])
    return found.select("document_id", F.explode(tokens.documents_as_list(F.col("node_word"))).alias("token"))
