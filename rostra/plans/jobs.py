"""User-level jobs (E01-E10): compositions of the operators, one DataFrame each.

Each job takes a `Corpus` (model tables) and request parameters and returns a lazy
DataFrame in long form; wide shapes are produced only at the edge (`reshape`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Corpus, PreparedCorpus
from ..operators import codes, indexes, predicates
from ..operators.predicates import predicate

# Pivot id column -> the text column that names it in trend labels, in label order.
TREND_LABEL_COLUMNS = (("gender_id", "gender"), ("office_type_id", "office"), ("party_id", "party_abbrev"),
                       ("chamber_abbrev", "chamber_abbrev"), ("sub_office_type_id", "sub_office_type"),
                       ("person_id", "name"))
TOTAL_LABEL = "Totalt"


def _pivot_label_columns(pivot_keys: Sequence[str]) -> list[tuple[str, str]]:
    known = dict(TREND_LABEL_COLUMNS)
    text_first = [(k, k) for k in pivot_keys if k not in known]
    decoded = [(k, t) for k, t in TREND_LABEL_COLUMNS if k in pivot_keys]
    return text_first + decoded


def word_trends(corpus: Corpus, search_terms: Sequence[str], filter_opts: Mapping[str, Any] | None = None,
                normalize: bool = False, keyness: str = "tf") -> DataFrame:
    """Counts of words per year, long form (year, label, n).

    Every filter key except year also becomes a pivot key; labels are the word followed
    by the decoded pivot values; `Totalt` is the sum per year when more than one label
    is left; words that the vocabulary doesn't hold have none. `normalize` divides by the raw token count of the (year x pivots) group.

    `keyness` weights each document before grouping: "tf" (counts), "tf_normalized"
    (count / the document's raw tokens, M02) or "tf_idf" (M03 over the whole DTM).

    Lemmas are lower case, so every search term resolves to its lower-case form (P10).
    The year range is applied before grouping; the result equals the reference, which
    filters after grouping, because year is a grouping key. A prepared corpus answers from its
    trend cube, or for other filter keys from its matrix; no token array is read.
    """
    opts = dict(filter_opts or {})
    pivot_keys = [k for k, v in opts.items() if k != "year" and v is not None]
    terms = sorted({t.lower() for t in search_terms if t})
    st = corpus.speech_tokens
    st = st.where(predicate(st.columns, opts))
    keys = ["year", *pivot_keys]
    stored = corpus if isinstance(corpus, PreparedCorpus) else None
    cube = stored.cube if stored is not None and indexes.served_by_cube(dict.fromkeys(keys)) else None
    if keyness == "tf" and cube is not None:  # stored counts, sorted by token
        counts = indexes.cube_counts(cube, terms, opts, keys)
    elif keyness == "tf" and stored is not None:  # the stored matrix, sorted by token
        cells = corpus.dtm.where(F.col("token").isin(terms))
        counts = cells.join(st.select("document_id", *keys), "document_id").groupBy(*keys, "token").agg(F.sum("n").alias("n"))
    elif keyness == "tf":
        # only matching tokens are exploded (IN-set filter inside the array)
        hits = F.filter("lemma", lambda x: x.isin(terms))
        flat = st.select(*keys, F.explode(hits).alias("token"))
        counts = flat.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))
    else:
        from ..operators import stats

        if keyness == "tf_normalized":
            weights = stats.normalize_by_raw_counts(corpus.dtm, corpus.speech_index)
        elif keyness == "tf_idf":
            weights = stats.tf_idf(corpus.dtm, corpus.speech_index)
        else:
            raise ValueError(f"unknown keyness {keyness}")
        cells = weights.where(F.col("token").isin(terms))
        docs = st.select("document_id", *keys)
        counts = cells.join(docs, "document_id", "inner").groupBy(*keys, "token").agg(F.sum("n").alias("n"))
    if normalize:
        totals = st.groupBy(*keys).agg(F.sum("n_raw_tokens").alias("_raw")) if cube is None \
            else indexes.cube_counts(cube, None, opts, keys).withColumnRenamed("n", "_raw")
        counts = counts.join(totals, keys, "inner") \
            .select(*keys, "token", F.try_divide(F.col("n"), F.col("_raw")).alias("n"))
    label_cols = _pivot_label_columns(pivot_keys)
    decoded = codes.decode(counts, corpus.code_tables(), drop=True, ignores=["wiki_id", "party", "pid"])
    label = F.concat_ws(" ", F.col("token"), *[F.col(t).cast("string") for _, t in label_cols])
    trends = decoded.select(F.col("year"), label.alias("label"), F.col("n"))
    # one aggregation for both the labels (namesakes summed) and the per-year total:
    # grouping sets (year, label) and (year)
    g = trends.rollup("year", "label").agg(F.sum("n").alias("n"), F.grouping("year").alias("_gy"),
                                           F.grouping("label").alias("_gl")).where(F.col("_gy") == 0)
    if len(terms) < 2 and not pivot_keys:
        return g.where(F.col("_gl") == 0).select("year", "label", "n")
    if pivot_keys or opts.get("year") is None:
        found = g.where(F.col("_gl") == 0).agg(F.count_distinct("label").alias("n"))
    else:  # a known word without hits in these years has a column, too
        found = known_words(corpus, terms).agg(F.count(F.lit(1)).alias("n"))
    g = g.where((F.col("_gl") == 0) | (found.scalar() > 1))
    return g.select("year", F.when(F.col("_gl") == 1, F.lit(TOTAL_LABEL)).otherwise(F.col("label")).alias("label"), "n")


def known_words(corpus: Corpus, terms: Sequence[str]) -> DataFrame:
    """The lower-cased terms that the vocabulary holds: (token)."""
    words = sorted({t.lower() for t in terms if t})
    return corpus.vocab.where(F.col("token").isin(words)).select("token")


def word_trend_labels(corpus: Corpus, search_terms: Sequence[str], filter_opts: Mapping[str, Any]) -> list[str]:
    """The label columns of the wide trend table: every term that the vocabulary holds (at most
    as many rows as terms) with every combination of the requested pivot values (decoded
    through the code tables: a handful of rows each), then `Totalt` if there are several.
    Pivot keys need list values here."""
    import itertools

    opts = dict(filter_opts or {})
    pivot_keys = [k for k, v in opts.items() if k != "year" and v is not None]
    terms = sorted(r["token"] for r in known_words(corpus, search_terms).collect())
    texts = []
    tables = corpus.code_tables()
    table_of = {"gender_id": "gender", "office_type_id": "office_type", "party_id": "party",
                "sub_office_type_id": "sub_office_type", "person_id": "persons"}
    for key, text in _pivot_label_columns(pivot_keys):
        values = list(opts[key]) if isinstance(opts[key], (list, tuple, set)) else [opts[key]]
        if key == text:
            texts.append([str(v) for v in values])
            continue
        rows = tables[table_of[key]].where(F.col(key).isin(values)).select(key, text).collect()
        names = {r[key]: r[text] for r in rows}
        texts.append([str(names[v]) for v in values if v in names])
    labels = [" ".join([t, *combo]) for t in terms for combo in itertools.product(*texts)]
    return labels + ([TOTAL_LABEL] if len(labels) > 1 else [])


def word_trends_wide(corpus: Corpus, search_terms: Sequence[str], filter_opts: Mapping[str, Any] | None = None,
                     normalize: bool = False, keyness: str = "tf") -> DataFrame:
    """E03 + R01: one row per year, one column per label (missing -> 0)."""
    from ..operators import reshape

    long = word_trends(corpus, search_terms, filter_opts, normalize, keyness)
    return reshape.pivot_wide(long, ["year"], "label", word_trend_labels(corpus, search_terms, filter_opts or {}))


def speeches(corpus: Corpus, filter_opts: Mapping[str, Any] | None = None, decode: bool = True,
             value_updates: Mapping[str, Mapping[str, str]] | None = None, sort: bool = False) -> DataFrame:
    """Speech list for filters (P03 -> T06), with display values replaced by column and,
    optionally, empty names last."""
    si = predicates.speeches_by_opts(corpus.speech_index, filter_opts)
    return codes.decode_speech_index(si, corpus.code_tables(), value_updates, sort) if decode else si


def speakers(corpus: Corpus, selection: Mapping[str, Sequence[Any]]) -> DataFrame:
    """E09."""
    return codes.speakers(corpus.persons, corpus.person_party, corpus.party, corpus.speech_index, selection)


def metadata_lists(corpus: Corpus) -> dict[str, DataFrame]:
    """start/end year, parties, genders, chambers, office types, sub-office types."""
    from ..operators.dtm import year_range

    return {
        "years": year_range(corpus.speech_index),
        "parties": codes.parties_sorted(corpus.party),
        "genders": corpus.gender,
        "chambers": predicates.non_blank_chambers(corpus.chamber),
        "office_types": corpus.office_type,
        "sub_office_types": corpus.sub_office_type,
    }


# E01 --------------------------------------------------------------------------------

KWIC_COLUMNS = ["left_word", "node_word", "right_word", "year", "name", "party_abbrev", "party", "gender",
                "gender_abbrev", "person_id", "link", "speech_name", "speech_link", "document_name",
                "chamber_abbrev", "speech_id", "wiki_id", "document_id"]


def kwic(corpus: Corpus, keywords: str | Sequence[str], *, lemmatized: bool = True, words_before: int = 2,
         words_after: int = 2, p_show: str = "word", cut_off: int | None = None,
         criteria: Sequence[Mapping[str, Any]] | None = None) -> DataFrame:
    """KWIC with speaker/year criteria, lemma search by default, decoded speech
    columns. All hits, or with `cut_off` the first ones in corpus order. A prepared corpus with
    postings reads the phrase's tokens there and then the speeches that were hit."""
    from ..operators import tokens

    words = keywords.split() if isinstance(keywords, str) else list(keywords)
    target = "lemma" if lemmatized else "word"
    pattern = [{"target": target, "value": w} for w in words]
    keep = ["document_id", "document_name", "speech_id", "speech_name", "year", "chamber_abbrev", "person_id",
            "gender_id", "party_id"]
    hit_counts = None
    if isinstance(corpus, PreparedCorpus) and corpus.postings is not None:
        found, _ = indexes.phrase_hits(corpus.postings, pattern, corpus.grams)
        speeches_hit = indexes.hit_speeches(corpus.speech_tokens, found, criteria)
        hits = tokens.kwic(speeches_hit, pattern, words_before=words_before, words_after=words_after, p_show=p_show, keep=keep,
                           cut_off=cut_off, positions=F.col("starts"))
        return codes.decode_speech_index(hits, corpus.code_tables()).select(*KWIC_COLUMNS)
    if cut_off is not None and lemmatized and len(words) == 1 and isinstance(corpus, PreparedCorpus) \
            and not tokens._REGEX_META.search(words[0]):
        # one literal lemma: hits per speech are the stored DTM cells of that token (the
        # DTM is sorted by token, so only its row groups are read)
        hit_counts = corpus.dtm.where(F.col("token") == words[0].lower()) \
            .select("document_id", F.col("n").alias("h"))
    hits = tokens.kwic(corpus.speech_tokens, pattern, words_before=words_before, words_after=words_after,
                       p_show=p_show, criteria=criteria, keep=keep, cut_off=cut_off, hit_counts=hit_counts)
    decoded = codes.decode_speech_index(hits, corpus.code_tables())
    return decoded.select(*KWIC_COLUMNS)


# E02 --------------------------------------------------------------------------------

def ngrams(corpus: Corpus, search_term: str | Sequence[str], *, n: int = 3, threshold: int = 2,
           search_target: str = "word", display_target: str = "word", mode: str = "sliding",
           criteria: Sequence[Mapping[str, Any]] | None = None, documents: bool = False,
           contains_phrase: bool = False) -> DataFrame:
    """N-grams around a search phrase. With `documents` the long (ngram, speech_id)
    table is returned instead of the counts; `contains_phrase` keeps only n-grams that
    cover the whole phrase."""
    from ..operators import tokens

    terms = [search_term] if isinstance(search_term, str) else list(search_term)
    if not terms:
        raise ValueError("search_term must contain at least one term")
    pattern = [{"target": search_target, "value": t} for t in terms]
    context, compile_mode = tokens.n_gram_frame(n, len(pattern), mode)
    win = tokens.windows(corpus.speech_tokens, pattern, context=context, p_show=display_target, criteria=criteria)
    if documents:
        return tokens.ngram_documents(win, n=n, threshold=threshold, mode=compile_mode)
    return tokens.compile_n_grams(win, n=n, threshold=threshold, mode=compile_mode, contains_phrase=contains_phrase)


# E04 --------------------------------------------------------------------------------

def speeches_with_words(corpus: Corpus, terms: Sequence[str], filter_opts: Mapping[str, Any] | None = None
                        ) -> DataFrame:
    """Speeches containing any of the words, with the words found (search-term order)."""
    from ..operators import tokens

    st = corpus.speech_tokens
    st = st.where(predicate(st.columns, filter_opts or {}))
    words = [t.lower() for t in terms if t]  # lemmas are lower case (P10)
    if isinstance(corpus, PreparedCorpus):  # the stored matrix, sorted by token: at most one cell a word and speech
        found = corpus.dtm.where(F.col("token").isin(words)).groupBy("document_id").agg(F.collect_set("token").alias("lemma"))
        index = st.select(*predicates.SPEECH_LIST_COLUMNS)
        joined = tokens.documents_with_words(found.join(index, "document_id"), words, keep=predicates.SPEECH_LIST_COLUMNS)
        return codes.decode_speech_index(joined, corpus.code_tables())
    # the words found and the speech columns come from the same row: one scan, no join
    joined = tokens.documents_with_words(st, words, keep=predicates.SPEECH_LIST_COLUMNS)
    return codes.decode_speech_index(joined, corpus.code_tables())


# E05 --------------------------------------------------------------------------------

def word_hits(corpus: Corpus, search: str, n_hits: int = 5) -> DataFrame:
    """Vocabulary suggestions: the most frequent lemmas matching a literal, a `*`
    glob or a `|regex|`. The pattern is applied to tokens before they are counted."""
    from ..operators import dtm

    words = [dtm.folded(search)]  # lemmas are lower-case
    if isinstance(corpus, PreparedCorpus):
        known = dtm.matching_words(corpus.vocab, words) if corpus.grams is None else indexes.matching_words(corpus.grams, corpus.vocab, words)
        return dtm.top_n_words(known.select("token", "tf"), n_hits)
    matching = F.filter("lemma", lambda x: dtm.word_match_condition(x, words))
    flat = corpus.speech_tokens.select(F.explode(matching).alias("token"))
    tf = flat.groupBy("token").agg(F.count(F.lit(1)).alias("tf"))
    return dtm.top_n_words(tf, n_hits)


# P15 --------------------------------------------------------------------------------

def kwic_custom(corpus: Corpus, pattern, *, words_before: int = 3, words_after: int = 3, p_show: str = "word",
                s_show: Sequence[str] = ("speech_id", "year", "chamber_abbrev"),
                rename_columns: Mapping[str, str] | None = None,
                compute_columns: Mapping[str, Any] | None = None,
                display_columns: Sequence[str] | None = None, decode: bool = True,
                cut_off: int | None = None) -> DataFrame:
    """P15 (intended behaviour): KWIC with chosen speech attributes, optional decoding,
    renames, computed columns (name -> Column) and a final column selection."""
    from ..operators import tokens

    keep = ["document_id", *[c for c in s_show if c != "document_id"]]
    hits = tokens.kwic(corpus.speech_tokens, pattern, words_before=words_before, words_after=words_after,
                       p_show=p_show, keep=keep, cut_off=cut_off)
    if decode:
        hits = codes.decode(hits, corpus.code_tables(), drop=True, keeps=["person_id"], ignores=["pid"])
    for old, new in (rename_columns or {}).items():
        hits = hits.withColumnRenamed(old, new)
    for name, expr in (compute_columns or {}).items():
        hits = hits.withColumn(name, expr)
    return hits.select(*display_columns) if display_columns else hits
