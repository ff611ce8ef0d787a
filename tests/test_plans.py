"""Physical plan checks on the prepared corpus: pushdown, pruning, join strategies."""

import os

import pytest

from rostra.model import Corpus, prepare_corpus
from rostra.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def prepared(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("prepared"))
    prepare_corpus(Corpus(spark, SMALL), os.path.join(folder, "p"))
    catalog.use_prepared(SMALL, os.path.join(folder, "p"))
    yield
    catalog.use_prepared(SMALL, None)


def _plan(spark, name):
    df = catalog.queries()[name](spark, SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


def test_speech_filters_reach_the_scan(spark, prepared):
    plan = _plan(spark, "E06_speeches")
    # year prunes the year folders, the other criteria are pushed into the parquet reader
    assert "PartitionFilters: [isnotnull(year" in plan and ">= 1980" in plan and "<= 1995" in plan
    assert "PushedFilters: [In(chamber_abbrev, [de,en]" in plan
    assert "SortMergeJoin" not in plan


def test_word_trends_read_only_needed_columns(spark, prepared):
    plan = _plan(spark, "E03_word_trends_by_party")
    # the stored counts, sorted by token: no token array, and only the asked tokens' row groups
    assert "lemma:array" not in plan and "word:array" not in plan
    assert "ReadSchema: struct<token:string,party_id:bigint,year:bigint,n:bigint>" in plan
    assert "In(party_id, [5,6,7])" in plan and "In(token, [de,the])" in plan


def test_kwic_cut_off_needs_no_sort(spark, prepared):
    plan = _plan(spark, "E01_kwic")
    # the first hits are selected per speech (first_hits), not by a global top-k
    assert "TakeOrderedAndProject" not in plan and "Sort " not in plan
    assert "SortMergeJoin" not in plan
    assert "posexplode" not in plan


def test_co_occurrence_has_no_self_join(spark, prepared):
    plan = _plan(spark, "J12_co_occurrence")
    assert "FlatMapGroupsInArrow" in plan
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    # documents to lists, documents to blocks, blocks' shares; pairs are not shuffled or aggregated
    assert plan.count("Exchange hashpartitioning") <= 3 and "HashAggregate" not in plan


def test_top_terms_limit_before_shuffle(spark, prepared):
    plan = _plan(spark, "W06_top_terms_per_category")
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_significance_uses_scalar_subqueries_and_broadcasts(spark, prepared):
    plan = _plan(spark, "M04_ppmi")
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan and "SortMergeJoin" not in plan
    assert "Subquery" in plan


def test_kwic_cut_off_from_stored_counts_equals_raw(spark, prepared):
    """On the prepared corpus the cut-off histogram comes from the stored DTM cells; the
    hits must equal those found from the raw tables."""
    from rostra.model import Corpus, PreparedCorpus
    from rostra.plans import jobs

    raw = Corpus(spark, SMALL)
    prep = catalog.corpus(spark, SMALL)
    assert isinstance(prep, PreparedCorpus)
    for n in (1, 37, 400):
        a = jobs.kwic(raw, "the", cut_off=n).select("document_id", "left_word", "node_word", "right_word")
        b = jobs.kwic(prep, "the", cut_off=n).select("document_id", "left_word", "node_word", "right_word")
        assert a.count() == min(n, a.count()) and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
