"""Registered queries for joins, windows, scalar functions, reshaping, sources and
extension points (J, W, F, R, S, X rows) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fx
from .. import sources as SRC
from ..model import SQL_CODES, SQL_DTM, SQL_SPEECH_TOKENS, with_sql
from ..operators import codes as C
from ..operators import dtm as D
from ..operators import reshape as R
from ..operators import stats as S
from ..operators import tokens as TK
from . import jobs
from .catalog import corpus, register

_ST = with_sql(SQL_SPEECH_TOKENS)
_STD = with_sql(SQL_SPEECH_TOKENS, SQL_DTM)
_STC = with_sql(SQL_SPEECH_TOKENS, SQL_CODES)
_STDC = with_sql(SQL_SPEECH_TOKENS, SQL_DTM, SQL_CODES)


def _dc(c):
    return D.DTMCorpus(c.dtm, c.speech_index)


# --- J: joins -----------------------------------------------------------------------------------

@register("J02_encode", _STC + """
SELECT si.document_id, g.gender_abbrev, g2.gender_id
FROM speech_index si LEFT JOIN gender g ON si.gender_id = g.gender_id LEFT JOIN gender g2 ON g.gender = g2.gender
""")
def q_j02(spark, sf_dir):
    c = corpus(spark, sf_dir)
    dec = C.decode(c.speech_index.select("document_id", "gender_id"), c.code_tables())
    return C.encode(dec, c.code_tables())


@register("J03_speeches_by_ids", _ST + """
SELECT document_id, document_name, chamber_abbrev, year, speech_id FROM speech_index
WHERE document_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
""")
def q_j03(spark, sf_dir):
    c = corpus(spark, sf_dir)
    ids = c.table("labels").where(F.col("toxic") == 1).select(F.col("doc_id").alias("document_id"))
    return c.speech_index.join(ids, "document_id", "left_semi") \
        .select("document_id", "document_name", "chamber_abbrev", "year", "speech_id")


@register("J07_overload_by_index", _STD + """
SELECT d.document_id, d.n_tokens, si.year, si.chamber_abbrev
FROM (SELECT document_id, CAST(sum(n) AS BIGINT) AS n_tokens FROM dtm GROUP BY 1) d JOIN speech_index si USING (document_id)
""")
def q_j07(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return D.overload_by_index(D.document_token_counts(c.dtm), c.speech_index, ["year", "chamber_abbrev", "n_tokens"])


@register("J08_consolidate_index", _ST + """
SELECT a.document_name, a.document_id, b.year, b.chamber_abbrev
FROM speech_index a LEFT JOIN (SELECT document_name, year, chamber_abbrev FROM speech_index WHERE year >= 2000) b
  USING (document_name)
""")
def q_j08(spark, sf_dir):
    si = corpus(spark, sf_dir).speech_index
    other = si.where(F.col("year") >= 2000).select("document_name", "year", "chamber_abbrev", "document_id")
    return D.consolidate_index(si.select("document_name", "document_id"), other)


@register("J09_add_attributes", _ST + """
SELECT si.document_id, si.year, l.quality, l.toxic FROM speech_index si JOIN labels l ON si.document_id = l.doc_id
""")
def q_j09(spark, sf_dir):
    c = corpus(spark, sf_dir)
    lab = c.table("labels").withColumnRenamed("doc_id", "document_id")
    return D.add_attributes(c.speech_index.select("document_id", "year"), lab)


@register("J10_update_index", _ST + """
, u AS (SELECT si.document_name, CAST(l.quality + 100 AS BIGINT) AS page_number, l.toxic
        FROM labels l JOIN speech_index si ON si.document_id = l.doc_id)
SELECT si.document_name, coalesce(u.page_number, si.page_number) AS page_number, coalesce(u.toxic, 0) AS toxic
FROM speech_index si LEFT JOIN u USING (document_name)
""")
def q_j10(spark, sf_dir):
    c = corpus(spark, sf_dir)
    names = c.speech_index.select("document_id", "document_name")
    upd = c.table("labels").join(names, names["document_id"] == F.col("doc_id")) \
        .select("document_name", (F.col("quality") + 100).cast("bigint").alias("page_number"), "toxic")
    return D.update_index(c.speech_index.select("document_name", "page_number"), upd)


@register("J11_translate_to_vocab", _STD + """
, v AS (SELECT token, row_number() OVER (ORDER BY tf DESC, token) - 1 AS token_id
        FROM (SELECT token, sum(n) AS tf FROM dtm GROUP BY token))
SELECT d.token, d.document_id, d.n, v.token_id FROM dtm d JOIN v USING (token)
""")
def q_j11(spark, sf_dir):
    c = corpus(spark, sf_dir)
    vocab = D.vocabulary(c.dtm, with_ids=True)
    return D.translate_to_vocab(c.dtm, vocab)


@register("J14_speech_info", _STC + """
SELECT si.document_id, coalesce(pe.name, CAST(si.person_id AS VARCHAR)) AS name,
       coalesce(n.speaker_note, '(introductory note not found)') AS speaker_note
FROM speech_index si LEFT JOIN persons pe ON si.person_id = pe.person_id
LEFT JOIN speaker_notes n ON si.speaker_note_id = n.speaker_note_id
""")
def q_j14(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return C.speech_info(c.speech_index, c.persons, c.speaker_notes).select("document_id", "name", "speaker_note")


@register("J15_normalize_per_year", _ST + """
, t AS (SELECT year, count(*) AS n FROM (SELECT year, unnest(lemma) AS token FROM speech_tokens) WHERE token = 'the'
        GROUP BY year)
, y AS (SELECT year, sum(n_raw_tokens) AS yt FROM speech_index GROUP BY year)
SELECT t.year, round(t.n / y.yt, 6) AS n FROM t JOIN y USING (year)
""")
def q_j15(spark, sf_dir):
    c = corpus(spark, sf_dir)
    counts = jobs.word_trends(c, ["the"]).select("year", "n")
    return D.normalize_per_year(counts, c.speech_index).withColumn("n", F.round("n", 6))


@register("J16_zero_out_by_others_zeros", _STD + """
, w AS (SELECT DISTINCT document_id, token FROM (SELECT document_id, unnest(word) AS token FROM speech_tokens))
SELECT d.* FROM dtm d WHERE (d.document_id, d.token) IN (SELECT document_id, token FROM w)
""")
def q_j16(spark, sf_dir):
    c = corpus(spark, sf_dir)
    other = D.dtm_from_token_arrays(c.speech_tokens, "word")
    return D.zero_out_by_others_zeros(c.dtm, other)


@register("J17_person_by_key", with_sql(SQL_CODES) + """
SELECT * FROM persons WHERE wiki_id = 'Q42' UNION ALL SELECT * FROM persons WHERE pid = 7
UNION ALL SELECT * FROM persons WHERE CAST(person_id AS VARCHAR) = '11'
""")
def q_j17(spark, sf_dir):
    p = corpus(spark, sf_dir).persons
    return C.person_by_key(p, "Q42").unionByName(C.person_by_key(p, 7)).unionByName(C.person_by_key(p, "11"))


# --- W: windows and sequences -------------------------------------------------------------------------

@register("W02_phrase_ngrams", r"""
WITH w AS (SELECT string_split_regex(trim(text), '\s+') AS w FROM conversations)
, ng AS (SELECT array_to_string(list_slice(w, i, i + 1), ' ') AS ngram
         FROM w, unnest(generate_series(1, len(w) - 1)) AS s(i))
SELECT ngram, count(*) AS n FROM ng GROUP BY ngram
""")
def q_w02(spark, sf_dir):
    conv = corpus(spark, sf_dir).table("conversations")
    ng = conv.select(F.explode(TK.phrase_n_grams(F.col("text"), 2)).alias("ngram"))
    return ng.groupBy("ngram").agg(F.count(F.lit(1)).alias("n"))


@register("W05_dense_ids", _ST + """
SELECT document_id, row_number() OVER (ORDER BY year, document_id) - 1 AS id FROM speech_index
""")
def q_w05(spark, sf_dir):
    si = corpus(spark, sf_dir).speech_index.select("document_id", "year")
    return D.dense_ids(si, ["year", "document_id"]).select("document_id", "id")


_SQL_W06 = _STD + """
, g AS (SELECT si.chamber_abbrev, d.token, CAST(sum(d.n) AS BIGINT) AS n FROM dtm d JOIN speech_index si USING (document_id)
        GROUP BY 1, 2)
, r AS (SELECT *, row_number() OVER (PARTITION BY chamber_abbrev ORDER BY n DESC, token) AS rank FROM g WHERE n > 0)
"""


def _w06_counts(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return c.dtm.join(c.speech_index.select("document_id", "chamber_abbrev"), "document_id") \
        .groupBy("chamber_abbrev", "token").agg(F.sum("n").alias("n"))


@register("W06_top_terms_per_category", _SQL_W06 + "SELECT chamber_abbrev, token, n, rank FROM r WHERE rank <= 5")
def q_w06(spark, sf_dir):
    return D.partitioned_top_n_words(_w06_counts(spark, sf_dir), "chamber_abbrev", 5) \
        .select("chamber_abbrev", "token", "n", F.col("rank").cast("bigint").alias("rank"))


@register("W06_top_terms_wide", _SQL_W06 + """
SELECT CAST(rank AS INTEGER) AS rank,
  coalesce(max(CASE WHEN chamber_abbrev = 'en' THEN token || '/' || CAST(n AS VARCHAR) END), '*/0') AS "en",
  coalesce(max(CASE WHEN chamber_abbrev = 'de' THEN token || '/' || CAST(n AS VARCHAR) END), '*/0') AS "de",
  coalesce(max(CASE WHEN chamber_abbrev = 'fr' THEN token || '/' || CAST(n AS VARCHAR) END), '*/0') AS "fr",
  coalesce(max(CASE WHEN chamber_abbrev = 'es' THEN token || '/' || CAST(n AS VARCHAR) END), '*/0') AS "es"
FROM r WHERE rank <= 8 GROUP BY rank
""")
def q_w06_wide(spark, sf_dir):
    return D.top_terms_wide(_w06_counts(spark, sf_dir), "chamber_abbrev", ["en", "de", "fr", "es"], 8,
                            kind="token/count")


# --- F: scalar functions --------------------------------------------------------------------------------

@register("F01_temporal_keys", _ST + """
SELECT document_id, year - year % 10 AS decade, year - year % 5 AS lustrum,
       CASE WHEN year BETWEEN 1970 AND 1979 THEN 'early' WHEN year BETWEEN 2000 AND 2019 THEN 'late' END AS period
FROM speech_index
""")
def q_f01(spark, sf_dir):
    si = corpus(spark, sf_dir).speech_index
    spec = {"early": list(range(1970, 1980)), "late": list(range(2000, 2020))}
    return si.select("document_id", fx.temporal_key(F.col("year"), "decade").alias("decade"),
                     fx.temporal_key(F.col("year"), "lustrum").alias("lustrum"),
                     fx.temporal_key(F.col("year"), spec).alias("period"))


_SQL_F03 = """
coalesce(CASE WHEN contains({n}, 'ak') OR contains({n}, 'fk') THEN
  (CASE WHEN contains({n}, 'ak') THEN 'Andra' ELSE 'Första' END) || ' kammaren ' ||
  (CASE WHEN len(string_split({n}, '-')) = 6
        THEN string_split({n}, '-')[2] || ':' || replace(string_split({n}, '-')[-1], '_', ' ')
        WHEN len(string_split({n}, '-')) > 5
        THEN string_split({n}, '-')[2] || ':' || string_split({n}, '-')[6] || ' '
             || replace(string_split({n}, '-')[-1], '_', ' ') END)
 ELSE (CASE WHEN len(string_split({n}, '-')) < 4 THEN NULL
            WHEN length(string_split({n}, '-')[2]) = 4
            THEN string_split({n}, '-')[2] || ':' || replace(string_split({n}, '-')[4], '_', ' ')
            ELSE substr(string_split({n}, '-')[2], 1, 4) || '/' || substr(string_split({n}, '-')[2], 5) || ':'
                 || replace(string_split({n}, '-')[4], '_', ' ') END) END, {n})"""


@register("F03_protocol_labels", _ST + f"""
SELECT document_id, {_SQL_F03.format(n='document_name')} AS label,
       {_SQL_F03.format(n="replace(document_name, '--' || chamber_abbrev || '--', CASE WHEN year % 2 = 0 THEN '-a-ak--' ELSE '--' END)")} AS label2
FROM speech_index
""")
def q_f03(spark, sf_dir):
    si = corpus(spark, sf_dir).speech_index
    # a second name form per speech exercising the other branches
    alt = F.replace(F.col("document_name"), F.concat(F.lit("--"), F.col("chamber_abbrev"), F.lit("--")),
                    F.when(F.col("year") % 2 == 0, F.lit("-a-ak--")).otherwise(F.lit("--")))
    return si.select("document_id", fx.format_protocol_id(F.col("document_name")).alias("label"),
                     fx.format_protocol_id(alt).alias("label2"))


@register("F06_multiple_replace", "SELECT conv_id, turn, replace(replace(replace(text, 'the', chr(1)), 'und', 'the'), chr(1), 'und') AS text "
                                  "FROM conversations")
def q_f06(spark, sf_dir):
    conv = corpus(spark, sf_dir).table("conversations")
    return conv.select("conv_id", "turn", fx.multiple_replace(F.col("text"), {"the": "und", "und": "the"}).alias("text"))


@register("F07_page_numbers", r"""
SELECT page_id, coalesce(TRY_CAST(regexp_extract(url, 'page=([^&#]*)', 1) AS INTEGER), 1) AS page_number FROM pages
""")
def q_f07(spark, sf_dir):
    pages = corpus(spark, sf_dir).table("pages")
    return pages.select("page_id", fx.page_number(F.regexp_extract("url", r"page=([^&#]*)", 1)).alias("page_number"))


@register("F08_project_to_range", _STD + """
, tf AS (SELECT token, CAST(sum(n) AS DOUBLE) AS tf FROM dtm GROUP BY token)
, m AS (SELECT max(tf) AS mx FROM tf)
SELECT token, round(0.0 + (100.0 - 0.0) * (tf / mx), 6) AS scaled,
       round(least(greatest(0.0 + (100.0 - 0.0) * (tf / mx), 10.0), 50.0), 6) AS clamped FROM tf, m
""")
def q_f08(spark, sf_dir):
    from ..session import with_scalars

    tf = D.term_frequency(corpus(spark, sf_dir).dtm)
    t = with_scalars(tf, tf.agg(F.max("tf").alias("mx")))
    scaled = fx.project_to_range(F.col("tf").cast("double"), F.col("mx"), 0.0, 100.0)
    return t.select("token", F.round(scaled, 6).alias("scaled"), F.round(fx.clamp(scaled, 10.0, 50.0), 6).alias("clamped"))


@register("F09_slim_types", with_sql(SQL_CODES) + """
SELECT person_id, CAST(coalesce(year_of_death, 0) AS INTEGER) AS year_of_death FROM persons
""")
def q_f09(spark, sf_dir):
    p = corpus(spark, sf_dir).persons.select("person_id", "year_of_death")
    return fx.as_slim_types(p, ["year_of_death"], "int")


@register("F10_path_functions", r"""
SELECT page_id, string_split(url, '/')[-1] AS basename,
       regexp_replace(string_split(url, '/')[-1], '\.[^./]*$', '') AS stem,
       regexp_replace(string_split(url, '/')[-1], '\.[^./]*$', '') || '.txt' AS txt_name
FROM pages
""")
def q_f10(spark, sf_dir):
    pages = corpus(spark, sf_dir).table("pages")
    return pages.select("page_id", fx.strip_path(F.col("url")).alias("basename"),
                        fx.strip_path_and_extension(F.col("url")).alias("stem"),
                        fx.replace_extension(fx.strip_path(F.col("url")), "txt").alias("txt_name"))


# --- R: reshaping ---------------------------------------------------------------------------------------

_SQL_TRENDS_LONG = _STC + """
, t AS (
  SELECT year, party_id, token, count(*) AS n
  FROM (SELECT year, party_id, unnest(lemma) AS token FROM speech_tokens WHERE party_id IN (5, 6, 7))
  WHERE token IN ('the', 'de') GROUP BY year, party_id, token
), l AS (SELECT t.year, t.token || ' ' || p.party_abbrev AS label, t.n FROM t LEFT JOIN party p USING (party_id))
, g AS (SELECT year, label, sum(n) AS n FROM l GROUP BY year, label)
, lt AS (SELECT * FROM g UNION ALL SELECT year, 'Totalt', sum(n) FROM g GROUP BY year)
"""


def _trends_long(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return c, jobs.word_trends(c, ["the", "de"], {"party_id": [5, 6, 7]})


@register("R01_word_trends_wide", _SQL_TRENDS_LONG + "SELECT year, " + ", ".join(
    f"CAST(coalesce(sum(n) FILTER (WHERE label = '{lab}'), 0) AS BIGINT) AS \"{lab}\""
    for lab in [f"{w} N{i}" for w in ["the", "de"] for i in (5, 6, 7)] + ["Totalt"]) + " FROM lt GROUP BY year")
def q_r01(spark, sf_dir):
    return jobs.word_trends_wide(corpus(spark, sf_dir), ["the", "de"], {"party_id": [5, 6, 7]})


@register("R02_tabular", _STD + """
, f AS (SELECT * FROM speech_index WHERE party_id IN (5, 6))
, gi AS (SELECT DISTINCT year AS time_period, party_id FROM f)
, c AS (SELECT f.year AS time_period, f.party_id, d.token, sum(d.n) AS n FROM dtm d JOIN f USING (document_id)
        WHERE d.token IN ('the', 'de') GROUP BY 1, 2, 3)
SELECT gi.time_period, gi.party_id,
       CAST(coalesce(sum(c.n) FILTER (WHERE c.token = 'the'), 0) AS BIGINT) AS "the",
       CAST(coalesce(sum(c.n) FILTER (WHERE c.token = 'de'), 0) AS BIGINT) AS "de"
FROM gi LEFT JOIN c USING (time_period, party_id) GROUP BY gi.time_period, gi.party_id
""")
def q_r02(spark, sf_dir):
    c = corpus(spark, sf_dir)
    g = D.group_by_pivot_keys(_dc(c), "year", ["party_id"], {"party_id": [5, 6]})
    return R.tabular(g.index, g.dtm, ["time_period", "party_id"], ["the", "de"])


@register("R03_n_top_frame", _STD + """
, top AS (SELECT token FROM (SELECT token, sum(n) AS tf FROM dtm GROUP BY token) ORDER BY tf DESC, token LIMIT 5)
SELECT d.token, d.document_id, CAST(sum(d.n) AS BIGINT) AS n FROM dtm d JOIN top USING (token) GROUP BY ALL
""")
def q_r03(spark, sf_dir):
    dtm = corpus(spark, sf_dir).dtm
    top = D.top_n_words(D.term_frequency(dtm), 5).select("token")
    return R.n_top_frame(dtm, top)


@register("R04_split_column", """
SELECT page_id, split_part(url, '://', 1) AS scheme, substr(url, strpos(url, '://') + 3) AS address FROM pages
""")
def q_r04(spark, sf_dir):
    pages = corpus(spark, sf_dir).table("pages").select("page_id", "url")
    return R.try_split_column(pages, "url", "://", ["scheme", "address"])


@register("R05_label_map", _SQL_TRENDS_LONG + """
SELECT year, string_agg(label || '=' || CAST(n AS VARCHAR), ';' ORDER BY label || '=' || CAST(n AS VARCHAR)) AS counts
FROM lt GROUP BY year
""")
def q_r05(spark, sf_dir):
    _, long = _trends_long(spark, sf_dir)
    return R.label_map_text(R.as_label_map(long))


@register("R06_decode_pivot_keys", _STC + """
SELECT year - year % 10 AS time_period, count(DISTINCT document_id) AS n_documents, p.party, p.party_abbrev
FROM speech_index si LEFT JOIN party p USING (party_id) WHERE chamber_abbrev IN ('de') GROUP BY 1, 3, 4, si.party_id
""")
def q_r06(spark, sf_dir):
    c = corpus(spark, sf_dir)
    gi = D.group_by_pivot_keys(_dc(c), "decade", ["party_id"], {"chamber_abbrev": ["de"]}).index
    return C.decode_pivot_keys(gi.select("time_period", "party_id", "n_documents"), c.code_tables())


# --- S: sources ------------------------------------------------------------------------------------------

@register("S07_load_and_slice", _STD + """
, g AS (SELECT si.year AS document_id, d.token, sum(d.n) AS n FROM dtm d JOIN speech_index si USING (document_id)
        GROUP BY 1, 2)
, t1 AS (SELECT * FROM g WHERE token IN (SELECT token FROM g GROUP BY token HAVING sum(n) >= 20))
, t2 AS (SELECT * FROM t1 WHERE token IN (SELECT token FROM (SELECT token, sum(n) AS tf FROM t1 GROUP BY token)
                                          ORDER BY tf DESC, token LIMIT 50))
, nr AS (SELECT document_id, sum(abs(n)) AS norm FROM t2 GROUP BY 1)
, x AS (SELECT document_id, token, n / norm AS n FROM t2 JOIN nr USING (document_id))
, f AS (SELECT (SELECT sum(n) FROM t2 WHERE document_id = (SELECT min(document_id) FROM t2))
             / (SELECT sum(n) FROM x WHERE document_id = (SELECT min(document_id) FROM t2)) AS f)
SELECT document_id AS category, token, round(n * f, 6) AS n FROM x, f
""")
def q_s07(spark, sf_dir):
    c = corpus(spark, sf_dir)
    g = D.group_by_year(_dc(c), fill_gaps=True).dtm.withColumnRenamed("category", "document_id")
    g = D.slice_by_n_top(D.slice_by_tf(g, 20), 50)
    out = S.normalize(g, axis=1, norm="l1", keep_magnitude=True)
    return out.select(F.col("document_id").alias("category"), "token", F.round("n", 6).alias("n"))


@register("S13_filename_fields", r"""
WITH f AS (SELECT page_id, replace(regexp_replace(url, '^https?://', ''), '/', '_') AS name FROM pages)
SELECT page_id, nullif(regexp_extract(name, '^(?:[^_]+_([a-z]+)_)', 1), '') AS lang,
       TRY_CAST(nullif(regexp_extract(name, '^(?:[^_]+_[a-z]+_([0-9]+))', 1), '') AS BIGINT) AS number,
       nullif(string_split(replace(name, '.', '_'), '_')[1], '') AS host
FROM f
""")
def q_s13(spark, sf_dir):
    pages = corpus(spark, sf_dir).table("pages")
    name = F.replace(F.regexp_replace("url", "^https?://", ""), F.lit("/"), F.lit("_"))
    files = pages.select("page_id", F.concat(F.lit("data_x/pages/"), name).alias("path"))  # the folders don't count
    out = SRC.extract_filename_fields(files, "path", {"lang": r"[^_]+_([a-z]+)_", "number": r"[^_]+_[a-z]+_([0-9]+)",
                                                      "host": "_:0"}, int_fields=["number"])
    return out.drop("path")


@register("S14_select_files", r"""
SELECT page_id, url FROM pages
WHERE string_split(url, '/')[-1] IN ('825', '25', '685')
   OR regexp_replace(string_split(url, '/')[-1], '\.[^./]*$', '') IN ('825', '25', '685')
""")
def q_s14(spark, sf_dir):
    pages = corpus(spark, sf_dir).table("pages").select("page_id", "url")
    return SRC.filter_by_names(pages, "url", ["825", "25", "685"])


@register("S16_bag_of_terms", _STD + """
SELECT document_id, count(*) AS n_tokens FROM (SELECT document_id, unnest(lemma) AS token FROM speech_tokens)
GROUP BY document_id
""")
def q_s16(spark, sf_dir):
    bag = D.to_bag_of_terms(corpus(spark, sf_dir).dtm)
    return bag.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_tokens"))


# --- X: extension points ---------------------------------------------------------------------------------

@register("X01_codec_function", _STC + """
SELECT si.document_id, upper(si.chamber_abbrev) AS chamber_upper, g.gender
FROM speech_index si LEFT JOIN gender g USING (gender_id)
""")
def q_x01(spark, sf_dir):
    c = corpus(spark, sf_dir)
    codecs = (C.Codec("chamber", "decode", "chamber_abbrev", "chamber_upper", fx=F.upper),
              C.Codec("gender", "decode", "gender_id", "gender"))
    si = c.speech_index.select("document_id", "chamber_abbrev", "gender_id")
    return C.decode(si, c.code_tables(), codecs=codecs)


@register("X02_hooks", with_sql(SQL_CODES) + """
, l AS (
  SELECT pp.person_id, string_agg(DISTINCT pa.party_abbrev, ', ' ORDER BY pa.party_abbrev) AS a,
         string_agg(DISTINCT CAST(pp.party_id AS VARCHAR), ',' ORDER BY CAST(pp.party_id AS VARCHAR)) AS i
  FROM person_party pp LEFT JOIN party pa USING (party_id) GROUP BY pp.person_id
)
SELECT p.person_id, coalesce(l.a, '?') AS multi_party_abbrev, coalesce(l.i, '?') AS multi_party_id
FROM persons p LEFT JOIN l USING (person_id)
""")
def q_x02(spark, sf_dir):
    c = corpus(spark, sf_dir)
    tables = C.run_hooks(c.code_tables(), [C.add_multi_party_hook, C.rename_sub_office_hook])
    return tables["persons"].select("person_id", "multi_party_abbrev", "multi_party_id")


@register("P15_kwic_custom", _STC + """
, h AS (
  SELECT st.*, g.P FROM speech_tokens st, unnest(generate_series(1, len(st.lemma))) AS g(P)
  WHERE st.lemma[g.P] = 'und'
)
SELECT h.document_id, h.year AS "Year", h.speech_id, pa.party_abbrev AS "Party abbreviation",
       array_to_string(list_slice(h.lemma, greatest(h.P - 1, 1), h.P - 1), ' ') AS left_word,
       array_to_string(list_slice(h.lemma, h.P, h.P), ' ') AS node_word,
       array_to_string(list_slice(h.lemma, h.P + 1, h.P + 1), ' ') AS right_word,
       array_to_string(list_slice(h.lemma, h.P, h.P), ' ') || '|' || array_to_string(list_slice(h.lemma, h.P + 1, h.P + 1), ' ') AS pair
FROM h LEFT JOIN party pa ON h.party_id = pa.party_id
""")
def q_p15(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return jobs.kwic_custom(c, {"target": "lemma", "value": "und"}, words_before=1, words_after=1, p_show="lemma",
                            s_show=["speech_id", "year", "party_id"],
                            rename_columns={"year": "Year", "party_abbrev": "Party abbreviation"},
                            compute_columns={"pair": F.concat_ws("|", "node_word", "right_word")},
                            display_columns=["document_id", "Year", "speech_id", "Party abbreviation", "left_word", "node_word",
                                             "right_word", "pair"])


@register("S15_index_check", _STD + """
SELECT document_id FROM (SELECT DISTINCT document_id FROM dtm) WHERE document_id NOT IN (SELECT document_id FROM speech_index)
UNION ALL
SELECT document_id FROM speech_index WHERE n_tokens > 0 AND document_id NOT IN (SELECT document_id FROM dtm)
""")
def q_s15(spark, sf_dir):
    c = corpus(spark, sf_dir)
    nonempty = c.speech_index.where(F.col("n_tokens") > 0)
    return D.check_index_covers(D.dtm_from_token_arrays(c.speech_tokens), nonempty)
