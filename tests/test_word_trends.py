"""Word trends on a hand-made corpus: label regression and request mapping."""

from pyspark.sql import functions as F

from rostra.model import Corpus
from rostra.operators.predicates import token_criteria
from rostra.plans import jobs

SMALL = "/root/testdata/sf0.001"


def _corpus(spark):
    rows = [(0, 1990, 5, 1, ["skola", "och", "skola"], 3), (1, 1990, 6, 2, ["skola"], 1),
            (2, 1991, 5, 1, ["hem"], 1), (3, 1991, 7, 1, ["skola"], 1)]
    st = spark.createDataFrame(rows, "document_id long, year long, party_id long, gender_id long, "
                                     "lemma array<string>, n_raw_tokens long")
    party = spark.createDataFrame([(5, "Social", "S", 1), (6, "Moderate", "M", 2), (7, "Other", "O", 3)],
                                  "party_id long, party string, party_abbrev string, sort_order long")
    return Corpus.from_frames(spark, SMALL, speech_tokens=st.withColumn("word", F.col("lemma")), party=party)


def test_from_frames_rejects_unknown_tables(spark):
    import pytest

    with pytest.raises(ValueError):
        Corpus.from_frames(spark, SMALL, no_such_table=spark.range(1))


def test_party_labels_and_total(spark):
    c = _corpus(spark)
    out = {(r["year"], r["label"]): r["n"] for r in jobs.word_trends(c, ["skola"], {"party_id": [5, 6]}).collect()}
    assert out == {(1990, "skola S"): 2, (1990, "skola M"): 1, (1990, "Totalt"): 3}
    wide = jobs.word_trends_wide(c, ["skola"], {"party_id": [5, 6]})
    assert wide.columns == ["year", "skola S", "skola M", "Totalt"]


def test_single_word_without_pivots_has_no_total(spark):
    c = _corpus(spark)
    out = {(r["year"], r["label"]): r["n"] for r in jobs.word_trends(c, ["Skola"]).collect()}
    assert out == {(1990, "skola"): 3, (1991, "skola"): 1}


def test_normalized_by_group_raw_tokens(spark):
    c = _corpus(spark)
    out = {(r["year"], r["label"]): r["n"] for r in
           jobs.word_trends(c, ["skola"], {"party_id": [5]}, normalize=True).collect()}
    assert out[(1990, "skola S")] == 2 / 3


def test_request_years_to_one_criterion():
    crit = token_criteria(from_year=2000, to_year=2020)
    assert crit == [{"key": "year", "values": (2000, 2020)}]
    assert token_criteria(chamber_abbrev=["AK"], party_id=[0]) == [
        {"key": "party_id", "values": [0]}, {"key": "chamber_abbrev", "values": ["ak"]}]
