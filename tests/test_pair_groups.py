"""Pair sums by pivots against plain Python: groups of every size, over steps, tasks and blocks."""

import random
from collections import Counter

import pytest

from rostra.operators import pair_groups as PG
from rostra.operators import stats as S


def rows():
    rng = random.Random(2)
    out = [(g, [f"t{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randrange(25))]) for g in range(30) for _ in range(rng.randrange(5))]
    out += [(100, [f"t{rng.randrange(90)}" for _ in range(30)]) for _ in range(60)]  # a large group
    return out + [(None, ["a", "b", "a"]), (None, ["b", "a"]), (7, ["é", "\U0001F600", "", "t1"]), (8, []), (9, ["one"]), (101, [f"w{i}" for i in range(300)])]


def plain(docs):
    """Pairs, row sums by first token, totals and word counts by group."""
    pairs, words = Counter(), Counter()
    for g, d in docs:
        n = Counter(d)
        for t in n:
            words[g, t] += n[t]
        names = sorted(n)
        for i, a in enumerate(names):
            for b in names[i + 1:]:
                pairs[g, a, b] += n[a] * n[b]
    sums, total = Counter(), Counter()
    for (g, a, _), n in pairs.items():
        sums[g, a] += n
        total[g] += n
    return pairs, sums, total, words


@pytest.fixture(scope="module")
def speeches(spark):
    return spark.createDataFrame([(i, g, d) for i, (g, d) in enumerate(rows())], "document_id long, g long, lemma array<string>").repartition(3)


@pytest.mark.parametrize("kw", [{}, {"chunk": 40}, {"chunk": 1, "block_pairs": 10**9}, {"block_pairs": 200, "chunk": 90}, {"block_pairs": 20, "task_pairs": 500}])
def test_equals_plain_python(spark, speeches, kw):
    pairs, sums, total, words = plain(rows())
    docs = speeches.selectExpr("g", "lemma AS toks", "CAST(NULL AS array<double>) AS ns")
    got = PG.pair_sums(docs, ["g"], **kw).collect()
    assert {(r["g"], r["w1"], r["w2"]): r["n"] for r in got} == pairs and len(got) == len(pairs)
    counts = spark.createDataFrame([(g, t, float(n)) for (g, t), n in words.items() if g != 7], "g long, token string, value double")
    got = PG.pair_sums(docs, ["g"], counts, **kw).collect()
    value = lambda g, t: None if g == 7 else words[g, t]
    all_of = Counter()
    for (g, _), n in words.items():
        all_of[g] += n if g != 7 else 0
    assert sorted((tuple(r) for r in got), key=repr) == sorted(
        ((g, a, b, n, value(g, a), value(g, b), all_of[g]) for (g, a, b), n in pairs.items()), key=repr)


def test_row_sums_need_no_pairs(speeches):
    _, sums, _, _ = plain(rows())
    docs = speeches.selectExpr("g", "lemma AS toks", "CAST(NULL AS array<double>) AS ns")
    got = {(r["g"], r["token"]): r["value"] for r in PG.row_sums(docs, ["g"]).collect()}
    assert {k: v for k, v in got.items() if v} == sums


def test_margins_and_counts_travel_with_the_documents(spark, speeches):
    """The pairs aren't joined or aggregated: the old forms did both, with a shuffle of all pairs each."""
    t = S.co_occurrence_from_tokens(speeches, pivots=["g"])
    with_margins = S.co_occurrence_from_tokens(speeches, pivots=["g"], with_margins=True)
    a, b = (sorted(tuple(r) for r in S.margins(x, ["g"]).collect()) for x in (t, with_margins))
    assert a == b and None not in {r[0] for r in b}
    nw = speeches.selectExpr("g", "explode(lemma) AS token").groupBy("g", "token").agg(S.F.count("*").alias("nw_x"))
    old = S.hal_cwr(t, nw, "g")
    new = S.hal_cwr(S.co_occurrence_from_tokens(speeches, pivots=["g"], counts=nw), key="g")
    assert sorted((tuple(r) for r in old.collect()), key=repr) == sorted((tuple(r) for r in new.collect()), key=repr)
    for df in (S.significance(with_margins, "ppmi", pivots=["g"]), new):
        plan = df._jdf.queryExecution().executedPlan().toString()
        above = plan[:plan.index("MapInArrow")]
        assert "Exchange" not in above and "Join" not in above and "Aggregate" not in above


def test_counts_with_pivots_from_a_matrix(spark):
    cells = [(1, "a", 2), (1, "b", 1), (1, "c", 3), (2, "a", 1), (2, "c", 1), (3, "a", 5), (3, "b", 1)]
    dtm = spark.createDataFrame(cells, "document_id long, token string, n long")
    index = spark.createDataFrame([(1, 1900), (2, 1900), (3, 1901)], "document_id long, year int")
    got = {tuple(r) for r in S.co_occurrence(dtm, pivots=["year"], index=index).collect()}
    assert got == {(1900, "a", "b", 2.0), (1900, "a", "c", 7.0), (1900, "b", "c", 3.0), (1901, "a", "b", 5.0)}
