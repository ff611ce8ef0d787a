"""Mini document-term matrix fixture: documents with words, filters, grouping, top-k."""

import pytest
from pyspark.sql import functions as F

from rostra.operators import dtm as D
from rostra.operators import tokens as TK
from rostra.operators.predicates import predicate

INDEX = [(0, "doc1", "ek", 2000, "s1", "speech1", 101, 1, 10),
         (1, "doc2", "fk", 2001, "s2", "speech2", 102, 2, 20),
         (2, "doc3", "ak", 2002, "s3", "speech3", 103, 1, 30)]
INDEX_SCHEMA = ("document_id long, document_name string, chamber_abbrev string, year int, speech_id string, "
                "speech_name string, person_id int, gender_id int, party_id int")
CELLS = [(0, "x", 1), (0, "z", 1), (1, "y", 1), (2, "x", 1), (2, "y", 1)]


@pytest.fixture()
def corpus(spark):
    index = spark.createDataFrame(INDEX, INDEX_SCHEMA)
    dtm = spark.createDataFrame(CELLS, "document_id long, token string, n long")
    return D.DTMCorpus(dtm, index)


def _words(spark, corpus, terms, opts=None):
    index = corpus.index.where(predicate(corpus.index.columns, opts or {}))
    arrays = corpus.dtm.join(index.select("document_id"), "document_id", "left_semi") \
        .groupBy("document_id").agg(F.collect_list("token").alias("lemma"))
    return {r["document_id"]: r["node_word"] for r in TK.documents_with_words(arrays, terms).collect()}


@pytest.mark.parametrize("terms,opts,expected", [
    (["x"], None, {0: "x", 2: "x"}),
    (["x", "z"], None, {0: "x,z", 2: "x"}),
    (["x", "y", "z"], None, {0: "x,z", 1: "y", 2: "x,y"}),
    (["x", "z"], {"year": [2000, 2002]}, {0: "x,z", 2: "x"}),
    (["x", "z"], {"year": 2000}, {0: "x,z"}),
    (["w"], None, {}),
])
def test_documents_with_words(spark, corpus, terms, opts, expected):
    assert _words(spark, corpus, terms, opts) == expected


def test_term_frequency_and_counts(corpus):
    assert {r["token"]: r["tf"] for r in D.term_frequency(corpus.dtm).collect()} == {"x": 2, "y": 2, "z": 1}
    assert {r["document_id"]: r["n_tokens"] for r in D.document_token_counts(corpus.dtm).collect()} == \
        {0: 2, 1: 1, 2: 2}


def test_group_by_year_fill_gaps_and_mean(spark):
    index = spark.createDataFrame([(0, 2000, 4, 4), (1, 2000, 2, 2), (2, 2003, 1, 1)],
                                  "document_id long, year int, n_tokens long, n_raw_tokens long")
    dtm = spark.createDataFrame([(0, "a", 4), (1, "a", 2), (2, "b", 1)], "document_id long, token string, n long")
    g = D.group_by_year(D.DTMCorpus(dtm, index), aggregate="mean")
    cells = {(r["category"], r["token"]): r["n"] for r in g.dtm.collect()}
    assert cells == {(2000, "a"): 3.0, (2003, "b"): 1.0}  # mean over the documents of the group
    idx = {r["category"]: (r["n_documents"], r["document_name"]) for r in g.index.collect()}
    assert idx == {2000: (2, "2000"), 2001: (0, "2001"), 2002: (0, "2002"), 2003: (1, "2003")}


def test_top_n_ties_by_token(spark):
    tf = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5), ("d", 1)], "token string, tf long")
    assert [r["token"] for r in D.top_n_words(tf, 3).collect()] == ["c", "a", "b"]


def test_dense_ids_are_dense(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"))
    out = D.dense_ids(df, ["k"], "rid")
    assert D.is_strictly_increasing(out, "rid").first()["ok"]
    assert [r["k"] for r in out.orderBy("rid").limit(3).collect()] == [0, 1, 2]


def test_matching_words(spark):
    vocab = spark.createDataFrame([(w,) for w in ["information", "inform", "propaganda", "informera", "x"]],
                                  "token string")
    got = lambda c: sorted(r["token"] for r in D.matching_words(vocab, c).collect())
    assert got(["inform*"]) == ["inform", "information", "informera"]
    assert got(["|inf.r|"]) == ["inform", "information", "informera"]  # prefix-anchored
    assert got(["x", "missing"]) == ["x"]
    assert got(["inform?"]) == []  # '?' only counts with a '*'


def test_words_in_vocabulary(spark):
    vocab = spark.createDataFrame([("Sverige",), ("skola",)], "token string")
    terms = D.terms_frame(spark, ["Sverige", "SKOLA", "nope"])
    assert [(r["ord"], r["token"]) for r in D.words_in_vocabulary(terms, vocab).orderBy("ord").collect()] == \
        [(0, "Sverige"), (1, "skola")]


def test_fill_temporal_gaps_one_row_per_missing_period(spark):
    gi = spark.createDataFrame([(1970, 5, 1, "1970_1"), (1970, 6, 1, "1970_2"), (1973, 5, 1, "1973_1")],
                               "time_period int, party_id int, n_documents long, document_name string")
    out = D.fill_temporal_gaps(gi, "time_period", ["party_id"])
    missing = sorted((r["time_period"], r["document_name"]) for r in out.where("n_documents = 0").collect())
    assert missing == [(1971, "1971_0"), (1972, "1972_0")]


def test_compress_vocabulary_and_extend(spark):
    vocab = spark.createDataFrame([("a", 0, 5), ("b", 1, 1), ("c", 2, 3), ("d", 3, 1)],
                                  "token string, token_id long, tf long")
    new, mapping = D.compress_vocabulary(vocab, threshold=3, keeps=["d"])
    assert sorted((r["token"], r["token_id"]) for r in new.collect()) == [("a", 0), ("c", 1), ("d", 2)]
    assert sorted((r["old_id"], r["new_id"]) for r in mapping.collect()) == [(0, 0), (2, 1), (3, 2)]
    idx = spark.createDataFrame([("x",), ("y",)], "document_name string")
    other = spark.createDataFrame([("y",), ("z",)], "document_name string")
    assert sorted(r[0] for r in D.extend_index(idx, other).collect()) == ["x", "y", "z"]
    with pytest.raises(ValueError):
        D.extend_index(idx, other, ignore_if_exists=False)


def test_cells_of_own_ids_are_not_shuffled(spark):
    """Counted within a row; ids that repeat or are null are still added up."""
    rows = [(1, ["a", "b", "a"]), (2, ["b", None]), (3, []), (4, None)]
    schema = "document_id long, lemma array<string>"
    own = D.dtm_from_token_arrays(spark.createDataFrame(rows, schema))
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
    want = {(1, "a", 2), (1, "b", 1), (2, "b", 1), (2, None, 1)}
    assert {tuple(r) for r in own.collect()} == want and own.count() == len(want)
    again = D.dtm_from_token_arrays(spark.createDataFrame([*rows, (1, ["a"]), (None, ["c"]), (None, ["c"])], schema))
    assert {tuple(r) for r in again.collect()} == want - {(1, "a", 2)} | {(1, "a", 3), (None, "c", 2)}
