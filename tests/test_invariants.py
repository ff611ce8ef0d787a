"""Invariants from the reference's test strategy, on the smallest driver tables."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rostra.model import Corpus
from rostra.operators import dtm as D
from rostra.operators import tokens as TK

SMALL = "/root/testdata/sf0.001"


def test_sum_over_periods_equals_global_tf(spark):
    c = Corpus(spark, SMALL)
    corpus = D.DTMCorpus(c.dtm, c.speech_index)
    for spec in ("year", "lustrum", "decade"):
        g = D.group_by_temporal_key(corpus, spec).dtm.groupBy("token").agg(F.sum("n").alias("tf"))
        diff = g.exceptAll(D.term_frequency(c.dtm))
        assert diff.count() == 0, spec


def test_index_group_sums_equal_totals(spark):
    c = Corpus(spark, SMALL)
    g = D.index_group_by_column(c.speech_index, "chamber_abbrev")
    a = g.agg(F.sum("n_tokens"), F.sum("n_documents")).first()
    b = c.speech_index.agg(F.sum("n_tokens"), F.count(F.lit(1))).first()
    assert tuple(a) == tuple(b)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c"]), min_size=0, max_size=7), min_size=1, max_size=5),
       st.integers(min_value=1, max_value=4))
def test_ngram_counts_sum_to_windows_times_grams(spark, arrays, n):
    """Σ n-gram window counts = Σ over windows of max(len - n + 1, 0)."""
    rows = [(i, f"s{i}", " ".join(a), a) for i, a in enumerate(arrays)]
    win = spark.createDataFrame(rows, "document_id long, speech_id string, window string, tokens array<string>")
    expected = sum(max(len(a) - n + 1, 0) for a in arrays)
    got = TK.compile_n_grams(win, n=n).agg(F.sum("window_count")).first()[0] or 0
    assert got == expected
