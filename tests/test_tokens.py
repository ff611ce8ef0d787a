"""Token pattern matching and KWIC on tiny arrays, plus the window-form cross-check."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rostra.operators import tokens as TK


@pytest.fixture()
def speeches(spark):
    rows = [(0, "s0", ["Information", "och", "propaganda", "mot", "England"]),
            (1, "s1", ["propaganda"]),
            (2, "s2", []),
            (3, "s3", ["PROPAGANDA", "information"])]
    df = spark.createDataFrame(rows, "document_id long, speech_id string, word array<string>")
    return df.withColumn("lemma", F.transform("word", F.lower))


def test_list_value_is_or_any_case(speeches):
    hits = TK.match_tokens(speeches, {"target": "word", "value": ["information", "propaganda"]}, keep=["document_id"])
    assert sorted((r["document_id"], r["pos"]) for r in hits.collect()) == [(0, 0), (0, 2), (1, 0), (3, 0), (3, 1)]


def test_regex_value_full_match(speeches):
    hits = TK.match_tokens(speeches, {"target": "lemma", "value": "prop.*"}, keep=["document_id"])
    assert sorted(r["document_id"] for r in hits.collect()) == [0, 1, 3]
    none = TK.match_tokens(speeches, {"target": "lemma", "value": "prop"}, keep=["document_id"])
    assert none.count() == 0


def test_case_sensitive_option(speeches):
    hits = TK.match_tokens(speeches, {"target": "word", "value": "PROPAGANDA", "ignore_case": False},
                           keep=["document_id"])
    assert [r["document_id"] for r in hits.collect()] == [3]


def test_kwic_context_clipped_at_speech_edges(speeches):
    out = TK.kwic(speeches, [{"target": "lemma", "value": "propaganda"}], words_before=2, words_after=2,
                  keep=["document_id", "speech_id"]).orderBy("document_id", "pos").collect()
    got = [(r["left_word"], r["node_word"], r["right_word"]) for r in out]
    assert got == [("Information och", "propaganda", "mot England"), ("", "propaganda", ""),
                   ("", "PROPAGANDA", "information")]


def test_multi_token_match_never_crosses_speeches(speeches):
    pat = [{"target": "lemma", "value": "propaganda"}, {"target": "lemma", "value": "information"}]
    hits = TK.match_tokens(speeches, pat, keep=["document_id"])
    assert [(r["document_id"], r["pos"]) for r in hits.collect()] == [(3, 0)]
    assert TK.match_tokens(speeches, pat + pat, keep=["document_id"]).count() == 0  # longer than any speech


def test_kwic_cut_off(speeches):
    out = TK.kwic(speeches, "propaganda", cut_off=2)
    assert [(r["document_id"], r["pos"]) for r in out.collect()] == [(0, 2), (1, 0)]


def test_array_form_equals_window_form(spark):
    """Cross-check: KWIC from arrays equals KWIC from a flat token table with windows."""
    from rostra.model import Corpus

    st = Corpus(spark, "/root/testdata/sf0.001").speech_tokens
    arr = TK.kwic(st, [{"target": "lemma", "value": "the"}], words_before=2, words_after=2)
    flat = st.select("document_id", F.posexplode("word").alias("pos", "w"))
    flat = flat.join(st.select("document_id", F.posexplode("lemma").alias("pos", "l")), ["document_id", "pos"])
    w = Window.partitionBy("document_id").orderBy("pos")
    win = flat.select("document_id", "pos", "l", "w",
                      F.collect_list("w").over(w.rowsBetween(-2, -1)).alias("lw"),
                      F.collect_list("w").over(w.rowsBetween(1, 2)).alias("rw"))
    ref = win.where(F.col("l") == "the").select("document_id", "pos", F.array_join("lw", " ").alias("left_word"),
                                                F.col("w").alias("node_word"),
                                                F.array_join("rw", " ").alias("right_word"))
    cols = ["document_id", "pos", "left_word", "node_word", "right_word"]
    assert arr.select(*cols).exceptAll(ref).count() == 0
    assert ref.exceptAll(arr.select(*cols)).count() == 0


def test_invariants_on_small_corpus(spark):
    """KWIC node count = lemma frequency; Σ n-gram counts = Σ windows x (len - n + 1)."""
    from rostra.model import Corpus

    st = Corpus(spark, "/root/testdata/sf0.001").speech_tokens
    hits = TK.kwic(st, [{"target": "lemma", "value": "and"}]).count()
    tf = st.select(F.explode("lemma").alias("t")).where(F.col("t") == "and").count()
    assert hits == tf
    win = TK.windows(st, [{"target": "lemma", "value": "and"}], context=4)
    expected = win.select(F.greatest(F.size("tokens") - 2 + 1, F.lit(0)).alias("k")).agg(F.sum("k")).first()[0]
    got = TK.compile_n_grams(win, n=2).agg(F.sum("window_count")).first()[0]
    assert got == expected


def test_cut_off_equals_global_first_hits(spark):
    """The bucketed search gives exactly the first n hits in corpus order."""
    from rostra.model import Corpus

    st = Corpus(spark, "/root/testdata/sf0.001").speech_tokens
    pat = [{"target": "lemma", "value": "the"}]
    full = [(r["document_id"], r["pos"]) for r in TK.kwic(st, pat).orderBy("document_id", "pos").collect()]
    for n in (7, len(full), 10 ** 9):
        got = [(r["document_id"], r["pos"]) for r in TK.kwic(st, pat, cut_off=n).orderBy("document_id", "pos")
               .collect()]
        assert got == full[:n]
    kept, _ = TK.first_hits(st, TK.match_positions(pat)[0], 7, buckets=3)
    assert kept.count() < st.count()


def test_first_hits_refinement_is_exact(spark):
    """Several refinement steps (7 buckets per step) still give exactly the first n hits."""
    from rostra.model import Corpus

    st = Corpus(spark, "/root/testdata/sf0.001").speech_tokens
    pat = [{"target": "lemma", "value": "the"}]
    positions = TK.match_positions(pat)[0]
    full = [(r["document_id"], r["p"]) for r in
            st.select("document_id", F.explode(positions).alias("p")).orderBy("document_id", "p").collect()]
    for n in (1, 250, len(full) - 1):
        kept, pos = TK.first_hits(st, positions, n, buckets=7)
        got = [(r["document_id"], r["p"]) for r in
               kept.select("document_id", F.explode(pos).alias("p")).orderBy("document_id", "p").collect()]
        assert got == full[:n], n
