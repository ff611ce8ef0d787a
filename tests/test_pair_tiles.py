"""The tiled product against plain Python, for tiles of every kind."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rostra.operators import pair_tiles as PT
from rostra.operators import stats as S


def documents():
    rng = random.Random(1)
    out = [[f"t{int(rng.paretovariate(0.7)) % 200}" for _ in range(rng.randrange(60))] for _ in range(200)]
    return out + [[], ["one"], ["same"] * 9, [f"long{i}" for i in range(700)], ["t1", "é", "\U0001F600", "", "t1"]] + [["x", "y"]] * 40


def plain(docs):
    want = Counter()
    for d in docs:
        n = Counter(d)
        names = sorted(n)
        for i, a in enumerate(names):
            for b in names[i + 1:]:
                want[a, b] += n[a] * n[b]
    return want


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(d, None) for d in documents()], "toks array<string>, ns array<double>").repartition(3)


@pytest.mark.parametrize("kw", [{}, {"limit": 20, "least": 2, "list_pairs": 500, "block_pairs": 3000}, {"limit": 3, "least": 10**6},
                                {"limit": 10**6, "least": 1}, {"list_pairs": 100}])
def test_equals_plain_python(frame, kw):
    want = plain(documents())
    rows = PT.pair_sums(frame, side=16, **kw).collect()
    assert {(r["w1"], r["w2"]): r["n"] for r in rows} == want and len(rows) == len(want)


def test_counts_and_small_steps(spark):
    docs = [dict(a=2, b=1, c=1), dict(a=1, c=3), dict(b=2, c=1), dict(d=5), dict(zip("abcdefghij", range(1, 11)))]
    frame = spark.createDataFrame([(list(d), [float(n) for n in d.values()]) for d in docs], "toks array<string>, ns array<double>")
    want = plain([[t for t, n in d.items() for _ in range(n)] for d in docs])
    for least in (1, 3, 100):
        got = PT.pair_sums(frame, least=least, side=3, step_tokens=10, chunk=7).collect()
        assert {(r["w1"], r["w2"]): r["n"] for r in got} == want


def test_heavy_list_is_bounded(frame):
    for limit in (1, 5, 50):
        names, theta = PT.heavy_tokens(frame, limit=limit, least=1)
        assert len(names) <= limit and theta >= 1


def test_empty_table_and_plan(spark, frame):
    empty = spark.createDataFrame([], "toks array<string>, ns array<double>")
    assert PT.pair_sums(empty).count() == 0
    text = PT.pair_sums(frame)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in text  # sums end in the tiles: pairs aren't shuffled


def test_a_vocabulary_cuts_in_place(spark):
    docs = documents()
    keep = {f"t{i}" for i in range(50)}
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "document_id long, lemma array<string>")
    vocab = spark.createDataFrame([(t,) for t in sorted(keep)] * 2, "token string")
    rows = S.co_occurrence_from_tokens(frame, vocab).collect()
    assert {(r["w1"], r["w2"]): r["n"] for r in rows} == plain([[t for t in d if t in keep] for d in docs])


def test_wide_rows_stay_in_the_shuffle(spark, frame):
    """Rows of many tokens aren't written to files, whose reader decodes thousands of them at once."""
    plan = PT.pair_sums(frame)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line or "Scan parquet" in line]
    assert scans and all("codes" not in line and "owned" not in line for line in scans)


def test_rows_are_narrow(spark):
    """Heavy tokens go by number, a code takes two bytes and a count one; wider values keep theirs."""
    toks = [[f"t{i % 50}" for i in range(k, k + 40)] for k in range(400)]
    batch = pa.RecordBatch.from_pydict({"toks": toks, "ns": pa.nulls(400, pa.list_(pa.float64()))})
    heavy = pa.array([f"t{i}" for i in range(48)])
    rows = list(PT._dealt(batch, heavy, 1, np.ones(1, np.int64), 0, 64, True))
    got = PT._unpacked(PT._table(PT._ROWS, rows), 0)
    assert len(rows) == 1 and sorted(got[0].to_pylist()) == ["t48", "t49"]
    assert sum(len(x) for x in rows[0][2:]) < 5 * len(got[1])
    for ns in ([1000.0, 0.5, -2.0], [1.0, 255.0, 256.0]):
        wide = pa.RecordBatch.from_pydict({"toks": [["a", "b", "c"]], "ns": pa.array([ns], pa.list_(pa.float64()))})
        (row,) = PT._dealt(wide, pa.array([], pa.string()), 1, np.ones(1, np.int64), 0, 64, True)
        assert sorted(PT._unpacked(PT._table(PT._ROWS, [row]), 0)[2]) == sorted(ns)


@pytest.mark.parametrize("kw", [{}, {"limit": 20, "least": 2, "list_pairs": 5000, "block_pairs": 3000}])
def test_margins_travel_with_the_names(spark, frame, kw):
    """Row sums were taken from stored pairs and joined to them: a table of all pairs, beyond a million tokens two shuffles of them."""
    pairs = plain(documents())
    rows, total = Counter(), sum(pairs.values())
    for (a, _), n in pairs.items():
        rows[a] += n
    got = PT.pair_sums(frame, side=16, with_margins=True, **kw)
    have = {(r["w1"], r["w2"]): (r["n"], r["zr_i"], r["zr_j"], r["z"]) for r in got.collect()}
    assert have == {(a, b): (n, rows[a], rows[b], total) for (a, b), n in pairs.items()}


def test_significance_stores_and_joins_no_pairs(spark, monkeypatch):
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(documents())], "document_id long, lemma array<string>")
    old = sorted(tuple(r) for r in S.significance(S.co_occurrence_from_tokens(frame), "ppmi").collect())
    monkeypatch.setattr(S, "stored", None)  # nothing of the pairs is stored
    weights = S.significance(S.co_occurrence_from_tokens(frame, with_margins=True), "ppmi")
    new = sorted(tuple(r) for r in weights.collect())
    assert [r[:2] for r in old] == [r[:2] for r in new] and np.allclose([r[2] for r in old], [r[2] for r in new], rtol=1e-12)
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # the total is a scalar
    empty = frame.limit(0)
    assert S.co_occurrence_from_tokens(empty, with_margins=True).columns == ["w1", "w2", "n", "zr_i", "zr_j", "z"]
    assert S.co_occurrence_from_tokens(empty, with_margins=True).count() == 0
