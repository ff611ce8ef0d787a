"""Cells packed for the joins of J11 and J16, against the plain joins; rows are made here."""
import random

import pytest

from rostra.operators import dtm as D
from rostra.operators import packed_cells as P

CELLS = "document_id long, token string, n long"


@pytest.fixture(scope="module")
def dtm(spark):
    rows = [(d, w, 1 + (d * i) % 3) for d in range(40) for i, w in enumerate(("the", f"w{d % 7}", "å", "", f"only{d}")) if (d + i) % 5]
    rows += [(3, "the", 9), (3, "the", 9), (None, "the", 1), (4, None, 2), (None, None, None), (5, "w5", None), (99, "nowhere", 1)]
    return spark.createDataFrame(rows, CELLS).repartition(3)


@pytest.fixture(scope="module")
def other(spark):
    rows = [(d, w, n) for d in range(0, 40, 2) for w, n in (("the", 1), (f"w{d % 7}", 0), ("å", 2), (f"only{d}", 1), ("", 1))]
    return spark.createDataFrame([*rows, (4, "the", 3), (None, "the", 1), (4, None, 1), (5, "w5", None)], CELLS).repartition(4)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_translation_is_the_plain_join(spark, dtm):
    vocab = spark.createDataFrame([("the", 0), ("å", 1), ("", 2), ("w5", 3), ("w5", 4), (None, 5), ("absent", 6)], "token string, token_id long")
    got = D.translate_to_vocab(dtm, vocab)
    assert got.columns == ["token", "document_id", "n", "token_id"]
    assert _rows(got) == _rows(dtm.join(vocab, "token", "inner"))
    assert "MapInArrow" in _plan(got)  # no cell goes into the shuffle by itself


def test_held_cells_are_the_semi_join(spark, dtm, other):
    got = D.zero_out_by_others_zeros(dtm, other)
    assert got.columns == ["document_id", "token", "n"]
    assert _rows(got) == _rows(dtm.join(other.where("n > 0"), ["document_id", "token"], "left_semi"))
    assert "MapInArrow" in _plan(got)  # nor here


@pytest.mark.parametrize("step", [1, 500, 1 << 20])
def test_steps_of_any_size(spark, dtm, other, step, monkeypatch):
    monkeypatch.setattr(P, "_OUT", 2)
    vocab = spark.createDataFrame([("the", 0), ("w5", 3), ("w5", 4), ("", None), ("absent", 6)], "token string, token_id long").repartition(3)
    for buckets in (1, 5, 4096):
        monkeypatch.setattr(P, "_BUCKETS", buckets)
        assert _rows(P.cells_with_ids(dtm, vocab, step_bytes=step)) == _rows(dtm.join(vocab, "token", "inner"))
    got = P.held_cells(dtm, other.where("n > 0"), step_bytes=step)
    assert _rows(got) == _rows(dtm.join(other.where("n > 0"), ["document_id", "token"], "left_semi"))


def test_empty_sides(spark, dtm):
    none = spark.createDataFrame([], CELLS)
    assert D.zero_out_by_others_zeros(dtm, none).count() == D.zero_out_by_others_zeros(none, dtm).count() == 0
    assert D.translate_to_vocab(none, dtm.selectExpr("token", "n AS token_id")).count() == 0


def test_pairs_get_their_ids_packed(spark):
    """M07's pairs were shuffled three times as rows: for the distinct ones, for their order and for the join."""
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), f"a{rng.randrange(20)}", rng.choice(["", "é", "\U0001F600", "x", "y"]), float(k)) for k in range(400)]
    rows += [(1, None, "x", 0.0), (1, "a1", None, 0.0), (3, "only", "x", 1.0)]
    frame = spark.createDataFrame(rows, "g long, w1 string, w2 string, n double").repartition(5)
    lists = P.distinct_lists(frame, step_bytes=500)
    got = lists.collect()
    whole = [r for r in rows if r[1] is not None and r[2] is not None]
    assert {r["w1"]: r["w2"] for r in got} == {a: sorted({r[2] for r in whole if r[1] == a}, key=str.encode) for a in {r[1] for r in whole}}
    assert len(got) == len({r[1] for r in whole})
    firsts = D.dense_ids(lists.selectExpr("w1", "size(w2) AS n"), ["w1"], id_col="first", width="n").select("w1", "first")
    mapping = lists.join(firsts, "w1").selectExpr("w1", "first", "posexplode(w2) AS (at, w2)").selectExpr("w1", "w2", "first + at AS pair_id")
    order = sorted({(r[1], r[2]) for r in whole}, key=lambda p: (p[0].encode(), p[1].encode()))
    assert {(r["w1"], r["w2"]): r["pair_id"] for r in mapping.collect()} == {p: i for i, p in enumerate(order)}
    joined = P.cells_with_ids(frame, mapping.where("pair_id % 3 > 0"), ["w1", "w2"], "pair_id", step_bytes=500)
    want = [(r[1], r[2], r[0], r[3], order.index((r[1], r[2]))) for r in whole]
    assert joined.columns == ["w1", "w2", "g", "n", "pair_id"]
    assert sorted((tuple(r) for r in joined.collect()), key=repr) == sorted([r for r in want if r[4] % 3], key=repr)
    assert P.distinct_lists(frame.limit(0)).count() == 0
