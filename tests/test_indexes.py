"""Stored indexes against the scans that they replace, and their plans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rostra.model import Corpus, PreparedCorpus, prepare_corpus
from rostra.operators import dtm as D
from rostra.operators import indexes as IX
from rostra.operators import tokens as TK
from rostra.operators.predicates import token_criteria
from rostra.plans import jobs

SMALL = "/root/testdata/sf0.001"



@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    raw = Corpus(spark, SMALL)
    folder = str(tmp_path_factory.mktemp("prepared"))
    prepare_corpus(raw, folder)
    return raw, PreparedCorpus(spark, SMALL, folder)


def rows(df):
    return sorted(map(repr, df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


PATTERNS = ["the", ["of", "the"], [{"target": "word", "value": "The", "ignore_case": False}], [{"target": "lemma", "value": "d(er|ie)"}, "[a-z]+"],
            [{"target": "word", "value": ["of", "in"]}, {"target": "lemma", "value": "th.*"}], ["the", "the"], "nosuchword", ".*"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_phrases_equal_the_scan(both, pattern):
    raw, stored = both
    hits, k = IX.phrase_hits(stored.postings, pattern, stored.grams)
    got = hits.select("document_id", F.explode("starts").alias("pos"), F.lit(k).alias("k"))
    assert rows(got) == rows(TK.match_tokens(raw.speech_tokens, pattern, keep=["document_id"]))


def test_phrases_over_overlaps_and_repeats(spark):
    texts = [["a", "a", "a", "b"], ["A", "a", "B", "a", "b"], [], None, ["b"], ["a"] * 50]
    speeches = spark.createDataFrame([(i, 2000 + i, t, t and [x.lower() for x in t]) for i, t in enumerate(texts)],
                                     "document_id long, year long, word array<string>, lemma array<string>")
    stored = IX.postings(speeches)
    for pattern in (["a", "a"], ["a", "b"], ["a", "a", "a"], [{"target": "word", "value": "A", "ignore_case": False}, "a"], ["b", "a"]):
        hits, k = IX.phrase_hits(stored, pattern)
        got = {r["document_id"]: r["starts"] for r in hits.collect()}
        want = {}
        for r in TK.match_tokens(speeches.where("word is not null"), pattern, keep=["document_id"]).collect():
            want.setdefault(r["document_id"], []).append(r["pos"])
        assert got == want, pattern


def test_only_the_phrase_is_read(both):
    hits, _ = IX.phrase_hits(both[1].postings, ["of", "the"], both[1].grams)
    text = plan(hits)
    assert re.search(r"PushedFilters: \[.*In\(folded, \[of,the\]\)|PushedFilters: \[.*EqualTo\(folded", text) and "PartitionFilters: [isnotnull(attr" in text


@pytest.mark.parametrize("kw", [{}, {"cut_off": 7}, {"lemmatized": False, "words_before": 0}, {"criteria": token_criteria(from_year=1990, gender_id=[1])}])
def test_kwic_equals_the_scan(both, kw):
    for words in ("the", "of the", ["d(er|ie)", ".*"]):
        assert rows(jobs.kwic(both[1], words, **kw)) == rows(jobs.kwic(both[0], words, **kw))


TERMS = ["the", "Der", "la", "nosuchword"]


@pytest.mark.parametrize("opts", [{}, {"year": (1980, 2005)}, {"gender_id": [1, 2], "year": (1975, 2010)}, {"party_id": [5, 6], "chamber_abbrev": ["en", "de"]},
                                  {"person_id": [3, 4, 5]}, {"gender_id": 1, "office_type_id": None}])
@pytest.mark.parametrize("normalize", [False, True])
def test_trends_equal_the_scan(both, opts, normalize):
    got, want = (jobs.word_trends(c, TERMS, opts, normalize).withColumn("n", F.round("n", 9)) for c in (both[1], both[0]))
    assert rows(got) == rows(want)
    if "person_id" not in opts:
        assert not re.search(r"(lemma|word):array", plan(got))


def test_spans_and_periods_equal_sums(both):
    flat = both[0].speech_tokens.select("year", "gender_id", F.explode("lemma").alias("token")).where(F.col("token").isin("the", "der"))
    want = flat.groupBy("token", "gender_id", (F.col("year") - F.col("year") % 5).alias("period")).agg(F.count(F.lit(1)).alias("n"))
    assert rows(IX.period_counts(both[1].cube, ["the", "der"], "lustrum", ["gender_id"]).select(want.columns)) == rows(want)
    for a, b in ((1970, 1970), (1900, 1980), (1985, 2030), (2040, 2050)):
        want = flat.where(F.col("year").between(a, b)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        assert rows(IX.span_counts(both[1].cube, ["the", "der"], [(a, b)]).select("token", "n")) == rows(want)


def test_speeches_and_word_hits_equal_the_scan(both):
    for terms, opts in ((["und", "les", "The"], {"year": (1990, 2019)}), (["nosuchword"], {})):
        assert rows(jobs.speeches_with_words(both[1], terms, opts)) == rows(jobs.speeches_with_words(both[0], terms, opts))
    for search in ("*ver*", "Ver*", "|th[a-z]+n|", "the", "*a*", "s*a", "|(?:ab|cd)ion|", "|[aeiou]|"):
        assert [tuple(r) for r in jobs.word_hits(both[1], search, 9).collect()] == [tuple(r) for r in jobs.word_hits(both[0], search, 9).collect()], search


def test_runs_that_patterns_ask_for():
    assert IX.glob_runs("*ver*") == {"ver"} and IX.glob_runs("ver*") == {"\x02ve", "ver"} and IX.glob_runs("*keit") == {"kei", "eit", "it\x03"}
    assert IX.glob_runs("a*b") == set() and IX.glob_runs("ein?ge") == {"\x02ei", "ein", "ge\x03"}
    assert IX.required_runs("vers?") == {"\x02ve", "ver"} and IX.required_runs("ab|cd") == set() and IX.required_runs("(abc)+x") == {"abc"}
    assert IX.required_runs("tion", whole=False) == {"\x02ti", "tio", "ion"} and IX.required_runs("[") == set()
    assert IX.required_runs("abc(def|g)hij") == {"\x02ab", "abc", "hij", "ij\x03"} and IX.required_runs("x{0,2}abc") == {"abc", "bc\x03"}


def test_runs_lose_no_word(spark):
    """Every word that a pattern matches is found, for random words and patterns of all kinds."""
    rng = random.Random(4)
    letters = "aabbckKsSſéÉİıß"
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(1500)})
    vocab = spark.createDataFrame([(w, 1) for w in words], "token string, tf long").coalesce(2).cache()
    grams = IX.vocabulary_grams(vocab).cache()
    asked = ["*abb*", "ab*", "*bba", "a*bb*c", "|ab.b|", "|(?i)SBA|", "|(?i)ks[ab]|", "|a?bba|", "|(ab)+b|", "|ab{2}a|", "|aba$|", "|^abb|", "*ßab*", "abab", "|(?i)is|"]
    asked += ["|" + "".join(rng.choice(["a", "b", ".", "[ab]", "a?", "b+", "(ab|b)", "c"]) for _ in range(rng.randrange(1, 6))) + "|" for _ in range(25)]
    for p in asked:
        got = {r["token"] for r in IX.matching_words(grams, vocab, [p]).collect()}
        assert got == {r["token"] for r in D.matching_words(vocab, [p]).collect()}, p


def test_keys_read_few_pages_and_shuffle_nothing(spark, both, tmp_path):
    index = spark.range(30_000).select(F.col("id").alias("document_id"), (F.col("id") % 50 + 1970).alias("year"),
                                       F.format_string("prot-%05d", "id").alias("document_name"), F.format_string("i-%d", F.col("id") * 7).alias("speech_id"))
    IX.store_keys(index, str(tmp_path / "keys"), page_rows=32)
    stored = spark.read.parquet(str(tmp_path / "keys"))
    found = IX.find_keys(stored, ["i-700", "prot-00123", 77, "none"])
    assert sorted((r["key"], r["document_id"]) for r in found.collect()) == [("77", 77), ("i-700", 100), ("prot-00123", 123)]
    assert "Exchange" not in plan(found) and "PushedFilters: [In(key" in plan(found)
    leaf = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert leaf.metrics().apply("numOutputRows").value() < 900  # of 90,000
    raw, prep = both
    some = [r["speech_id"] for r in raw.speech_index.select("speech_id").limit(3).collect()]
    got = IX.speeches_by_keys(prep.speech_tokens, prep.keys, [*some, "nokey"])
    assert "Exchange" not in plan(got) and re.search(r"PartitionFilters: \[[^\]]*year", plan(got))
    assert sorted(r["key"] for r in got.select("key").collect()) == sorted(some)
    assert IX.speeches_by_keys(prep.speech_tokens, prep.keys, []).count() == 0
    with pytest.raises(ValueError, match="at most"):
        IX.speeches_by_keys(prep.speech_tokens, prep.keys, range(5), limit=4)


def test_folders_without_indexes(spark, tmp_path):
    raw = Corpus(spark, SMALL)
    prepare_corpus(raw, str(tmp_path), with_indexes=False)
    c = PreparedCorpus(spark, SMALL, str(tmp_path))
    assert c.postings is None and c.cube is None and c.grams is None
    assert rows(jobs.word_trends(c, ["the"], {"gender_id": [1]})) == rows(jobs.word_trends(raw, ["the"], {"gender_id": [1]}))
    assert rows(jobs.kwic(c, "of the")) == rows(jobs.kwic(raw, "of the"))
    assert rows(jobs.word_hits(c, "*ver*")) == rows(jobs.word_hits(raw, "*ver*"))


# One shuffle a part, parts on demand -----------------------------------------------------------------

def shuffles(df):
    """Shuffles by ranges and by hash."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("Exchange rangepartitioning"), plan.count("Exchange hashpartitioning")


def small_speeches(spark, ids=(1, 2, 3, None), lemma=None):
    words = [["The", "the", "of"], ["of", "The", "THE", "x"], [], ["the"]]
    data = [(i, 1970 + k % 2, k % 2, w, lemma[k] if lemma else [t.lower() for t in w], len(w)) for k, (i, w) in enumerate(zip(ids, words))]
    return spark.createDataFrame(data, "document_id long, year long, gender_id long, word array<string>, lemma array<string>, n_raw_tokens long")


def plain_postings(rows):
    out = {}
    for r in rows:
        for attr in ("word", "lemma"):
            for pos, t in enumerate(r[attr]):
                out.setdefault((attr, t.lower(), t, r["year"], r["document_id"]), []).append(pos)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("ids", [(1, 2, 3, None), (1, 1, 2, 2)])
@pytest.mark.parametrize("lemma", [None, [["the", "the", "o"], ["of", "The", "the", "y"], [], ["a"]]])
def test_postings_are_shuffled_once(spark, ids, lemma):
    speeches = small_speeches(spark, ids, lemma)
    df = IX.postings(speeches)
    got = {(r["attr"], r["folded"], r["token"], r["year"], r["document_id"]): r["positions"] for r in df.collect()}
    assert got == plain_postings(speeches.collect())
    assert shuffles(df) == (1, 0)


@pytest.mark.parametrize("lemma", [None, [["the", "the", "o"], ["of", "The", "the", "y"], [], ["a"]]])
def test_postings_of_distinct_ids_need_no_aggregate(spark, lemma):
    """Each form's positions went through an aggregate, which sorted them all, for the few lemmas of several forms."""
    speeches = small_speeches(spark, (1, 2, 3, 4), lemma)
    df = IX.postings(speeches)
    got = df.collect()
    assert {(r["attr"], r["folded"], r["token"], r["year"], r["document_id"]): r["positions"] for r in got} == plain_postings(speeches.collect())
    assert len(got) == len(plain_postings(speeches.collect()))
    assert shuffles(df) == (1, 0) and "Aggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_cube_is_shuffled_once(spark):
    speeches = small_speeches(spark, (1, 2, 3, 4))
    dtm = speeches.selectExpr("document_id", "explode(lemma) AS token").groupBy("document_id", "token").count().withColumnRenamed("count", "n")
    new, old = IX.trend_cube(None, speeches, ["gender_id"]), IX.trend_cube(dtm, speeches, ["gender_id"])
    assert rows(new.select(old.columns)) == rows(old) and shuffles(new) == (1, 0)
    assert IX.distinct_ids(speeches)
    assert not IX.distinct_ids(small_speeches(spark)) and not IX.distinct_ids(small_speeches(spark, (1, 1, 2, 3)))


def test_counts_of_rows(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a", None]), (1, ["a"]), (None, ["c"]), (2, []), (3, None)], "document_id long, lemma array<string>")
    got = sorted(map(str, IX.row_counts(df, "lemma", ["document_id"]).collect()))
    assert got == sorted(["Row(document_id=1, token='a', n=2)", "Row(document_id=1, token='b', n=1)", "Row(document_id=1, token=None, n=1)",
                          "Row(document_id=1, token='a', n=1)", "Row(document_id=None, token='c', n=1)"])


def test_rows_of_one_key_are_counted_together(spark):
    df = spark.createDataFrame([(1, None, ["a", "b", "a"]), (1, None, ["a", None]), (None, "x", ["c"]), (None, "x", ["c", "a"]), (1, "x", ["a"]), (2, "x", [])],
                               "k long, s string, lemma array<string>").coalesce(1)
    got = IX.row_counts(df, "lemma", ["k", "s"], together=True)
    assert rows(got) == rows(df.selectExpr("k", "s", "explode(lemma) AS token").groupBy("k", "s", "token").agg(F.count(F.lit(1)).alias("n")))


def test_ngrams_are_stored_by_the_tasks_that_cut_them(spark, tmp_path):
    vocab = spark.range(0, 70, 1, 7).selectExpr("concat('word', id) AS token", "id AS tf")
    IX.store_grams(vocab, str(tmp_path / "grams"))
    got = spark.read.parquet(str(tmp_path / "grams"))
    assert rows(got) == rows(IX.vocabulary_grams(vocab))
    files = list((tmp_path / "grams").glob("*.parquet"))
    assert len(files) == 7  # the vocabulary's parts, not those of a shuffle
    for f in files:
        keys = [(r["gram"], r["token"]) for r in spark.read.parquet(str(f)).coalesce(1).collect()]
        assert keys == sorted(keys)


def test_a_query_stores_the_parts_that_it_reads(spark, tmp_path, monkeypatch):
    from rostra.plans import catalog_indexes as CI

    monkeypatch.setattr(CI, "scratch_path", lambda s, name: str(tmp_path / name))
    monkeypatch.setattr(CI, "_STORED", {})
    found = lambda: sorted(p.name for p in tmp_path.glob("prepared-*/*"))
    c = CI.prepared(spark, SMALL, "vocab")
    assert found() == ["vocab"] and c.cube is None
    assert rows(c.vocab) == rows(Corpus(spark, SMALL).vocab)
    CI.prepared(spark, SMALL, "vocab", "dtm")
    assert found() == ["dtm", "vocab"]
