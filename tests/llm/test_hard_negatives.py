"""Hard negatives against plain Python; intervals hold their scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostra.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, score double, anchor string, row int"


def plain(rows, every, positives=5, negatives=3):
    good = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    key = lambda x: (-x[1], x[0] is None, x[0] or 0)
    out = []
    for i, v, label in good:
        if i is None or i % every:
            continue
        scored = [(j, sum(a * b for a, b in zip(v, w)), m) for j, w, m in good if len(w) == len(v) and not (j == i and w is v)]
        pos = sorted((x for x in scored if x[2] == label and x[0] != i), key=key)[:positives]
        for j, p, _ in pos:
            hard = sorted((x for x in scored if x[2] != label and 50 * p <= 100 * x[1] <= 95 * p), key=key)[:negatives]
            out += [(i, j, k + 1, n, p, s) for k, (n, s, _) in enumerate(hard)]
    return sorted(out, key=repr)


def mined(spark, rows, every, **kw):
    docs = spark.createDataFrame([(i, v, m, 0.5, "mine", 3) for i, v, m in rows], SCHEMA).repartition(3)
    got = hn.mine(docs, F.col("vec_id") % every == 0, **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 24))
    out = [(i, (centres[rng.integers(6)] + 0.6 * rng.standard_normal(24)).tolist(), int(rng.integers(3))) for i in range(400)]
    out += [(1000 + i, out[10][1], i % 3) for i in range(40)]  # one vector many times: ties
    out += [(2000, None, 1), (2001, [1.0] * 23 + [None], 1), (2002, [float("nan")] + [1.0] * 23, 1), (2003, [float("inf")] * 24, 2),
            (2004, out[0][1], None), (2005, [0.0] * 24, 1), (None, out[0][1], 0), (None, out[0][1], 1), (20, out[3][1], 0), (20, out[4][1], 0),
            (3000, [1.0, 0.5], 0), (3001, [1.0, 0.25], 0), (3002, [0.5, 0.25], 1), (3020, [], 0), (3021, [], 0), (3022, [], 1)]
    return out


def test_equals_plain_python(spark, rows):
    want = plain(rows, 20)
    assert len(want) > 100
    assert mined(spark, rows, 20, block=32) == want
    assert mined(spark, rows, 20) == want


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(8) * 2e5).tolist(), i % 2) for i in range(60)]
    assert mined(spark, rows, 10) == plain(rows, 10)


def test_a_score_beyond_a_long_raises(spark):
    with pytest.raises(Exception, match="doesn't fit a long"):
        mined(spark, [(0, [1e30], 0), (1, [1e30], 0), (2, [1e30], 1)], 10)


def test_other_numbers_and_empty_tables(spark, rows):
    assert mined(spark, rows, 50, positives=2, negatives=7, block=64) == plain(rows, 50, 2, 7)
    assert mined(spark, [], 50) == []
    assert mined(spark, [(1, [1.0], 0)], 50) == []
    assert mined(spark, [(50, [1.0], 0), (51, [1.0], 1)], 50) == []


@pytest.mark.parametrize("dim", [1, 7, 64, 100])
def test_intervals_hold_the_scores(dim):
    rng = np.random.default_rng(dim)
    v = hn.whole(np.concatenate([rng.standard_normal((300, dim)), np.zeros((1, dim)), np.ones((1, dim))]))
    words, align, rest, length = hn.encode(v)
    q = hn.Queries(v[:40])
    estimate, off = q.intervals(slice(0, 40), words, align, rest, length)
    exact = v[:40] @ v.T
    assert (np.abs(exact - estimate) <= off + 1e-6).all()
    if dim == 64:  # four codes leave an eighth of the length
        assert np.median(off / np.maximum(np.outer(q.length, length), 1)) < 0.25
