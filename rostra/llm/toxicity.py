"""Toxicity by maximum-scoring segments.

Training takes a bounded sample of labelled rows (`TRAIN_ROWS`, by hash order) and counts,
per class, the documents that hold a word. A word's score is its log-odds between the
classes under a Dirichlet prior whose mean is the class share of the words with the same
first `PREFIX` letters (itself drawn towards the overall share), less `DRIFT`, so that
clean text drifts downwards. One linear scan over a text's word scores finds all maximal
scoring segments. Under clean text the top segment of n words follows an extreme-value law
P(S >= s) = 1 - exp(-K n exp(-lambda s)); lambda solves sum p exp(lambda s) = 1 over the
clean word scores, K comes from the top segments of clean sample texts. A text's evidence
is -ln P of its top segment plus that of its other significant segments; a logistic curve,
fitted on a part of the sample that had no share in the counts, turns it into the score.

Defined results: a null or empty text has no segment and gets the score of no evidence;
null labels and null ids aren't trained on; several labels of one id count as toxic if one
is; without labels of both classes the score is the toxic share (0 without labels); rows
are scored one by one, so ties, repeats and other columns (also of the output's names,
which are replaced) don't matter. Texts are scanned whole."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, texts, without

TRAIN_ROWS = 20_000
PREFIX = 4
PRIOR = 4.0
DRIFT = 2.0
SIGNIFICANT = 0.05
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 400_000
PASSAGES = "array<struct<first_word: long, n_words: long, score: double, p_value: double>>"


@dataclass
class Model:
    """Word and prefix scores (drift included), extreme-value and logistic parameters."""
    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    intercept: float = -1e9

    def probability(self, evidence: float) -> float:
        z = self.slope * math.log1p(evidence) + self.intercept
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, end, score) of all maximal scoring segments, in one pass (Ruzzo and Tompa). Each
    segment keeps the last one before it that starts at a lower sum; searches go along these, so
    that each segment is passed over once."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.cumsum(scores)
    before, after = (total[up] - scores[up]).tolist(), total[up].tolist()
    out: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum at the end, the lower one before
    for i, lo, hi in zip(up.tolist(), before, after):
        first, j = i, len(out) - 1
        while j >= 0 and out[j][2] >= lo:
            j = out[j][4]
        while j >= 0 and out[j][3] < hi:  # joins the segment j and all between
            first, lo, low = out[j][0], out[j][2], out[j][4]
            del out[j:]
            j = low
        out.append((first, i + 1, lo, hi, j))
    return [(a, b, hi - lo) for a, b, lo, hi, _ in out]


class _Scorer:
    def __init__(self, model: Model):
        self.model, self.cache = model, {}

    def _score(self, word: str) -> float:
        s = self.cache.get(word)
        if s is None:
            s = self.model.words.get(word)
            if s is None:
                s = self.model.prefixes.get(word[:PREFIX], -DRIFT)
            if len(self.cache) >= _CACHE:
                self.cache.clear()
            self.cache[word] = s
        return s

    def __call__(self, text: str) -> tuple[float, list[dict], np.ndarray]:
        words = _WORD.findall(text.lower())
        get, score = self.cache.get, self._score
        scores = np.array([s if (s := get(w)) is not None else score(w) for w in words], float)
        found, n = [], max(len(words), 1)
        for a, b, s in segments(scores):
            e = self.model.k * n * math.exp(-min(self.model.decay * s, 700))
            found.append({"first_word": a, "n_words": b - a, "score": s, "p_value": max(-math.expm1(-e), 1e-300)})
        found.sort(key=lambda x: -x["score"])
        keep = [x for x in found if x["p_value"] <= SIGNIFICANT]
        evidence = sum(-math.log(x["p_value"]) for x in (keep or found[:1]))
        return evidence, sorted(keep, key=lambda x: x["first_word"]), scores


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """doc_id, text, toxic, part (0-2 count, 3 calibrates) of at most `rows` labelled rows."""
    picked = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id")
              .agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    picked = picked.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4)).cast("int"))
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .join(F.broadcast(picked), "doc_id"))  # at most `rows` rows of 16 bytes


def _counts(sample: DataFrame) -> DataFrame:
    """Documents that hold a word, by class and part; and at the empty word their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for t, x, p in zip(texts(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist()):
                n.update((w, x, p == 3) for w in {"", *_WORD.findall(t.lower())})
        keys = list(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
             pa.array([k[2] for k in keys], pa.bool_()), pa.array([n[k] for k in keys], pa.int64())],
            names=["word", "toxic", "late", "n"])
    c = F.col
    raw = sample.select("text", "toxic", "part").mapInArrow(run, "word string, toxic int, late boolean, n long")
    return raw.groupBy("word").agg(*[F.sum(F.when((c("toxic") == x) & (c("late") == late), c("n")).otherwise(0)).alias(a)
                                     for a, x, late in (("t", 1, False), ("c", 0, False), ("t2", 1, True), ("c2", 0, True))])


def _scores(words: list, prefixes: list, n: tuple[float, float], late: bool) -> tuple[dict, dict]:
    """Scores from the counts without (late false) or with the calibration part."""
    base = n[0] / (n[0] + n[1])
    tilt = math.log(n[1] / n[0])
    got = lambda r: (r["t"] + late * r["t2"], r["c"] + late * r["c2"])
    share = {}
    for r in prefixes:
        y, x = got(r)
        share[r["prefix"]] = (y + PRIOR * base) / (y + x + PRIOR)
    pre = {g: math.log(s / (1 - s)) + tilt - DRIFT for g, s in share.items()}
    out = {}
    for r in words:
        y, x = got(r)
        s = share.get(r["word"][:PREFIX], base)
        out[r["word"]] = math.log((y + PRIOR * s) / (x + PRIOR * (1 - s))) + tilt - DRIFT
    return out, pre


def _scan(sample: DataFrame, model: Model) -> list:
    """(toxic, part, words, score of the top segment) of the sample texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _Scorer(model)
        for b in batches:
            rows = []
            for t in texts(b.column(0)):
                s = score(t)[2]
                top = max((x[2] for x in segments(s)), default=0.0)
                rows.append((len(s), top))
            cols = list(zip(*rows)) if rows else [()] * 2
            yield pa.RecordBatch.from_arrays(
                [b.column(1), b.column(2), *[pa.array(x, pa.float64()) for x in cols]],
                names=["toxic", "part", "n", "top"])
    return sample.select("text", "toxic", "part").mapInArrow(run, "toxic int, part int, n double, top double").collect()


def _decay(clean: np.ndarray, values: np.ndarray) -> float:
    """lambda > 0 with sum clean * exp(lambda * values) = 1."""
    if not (values > 0).any():
        return 1.0
    lo, hi = 1e-3, 20.0
    f = lambda x: float(np.sum(clean * np.exp(np.minimum(x * values, 700)))) - 1
    if f(hi) < 0:
        return hi
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _calibrate(model: Model, words: list, n_clean: float, n_words: float, scan: list) -> None:
    """lambda and K from clean text."""
    values = np.array([model.words[r["word"]] for r in words] + [-DRIFT])
    seen = np.array([r["c"] for r in words], float) + 0.5
    rest = max(n_words - seen.sum(), seen.sum())
    p = np.append(seen, rest)
    model.decay = _decay(p / p.sum(), values)
    tops = [model.decay * r["top"] - math.log(max(r["n"], 1)) for r in scan if r["toxic"] == 0 and r["n"] > 0]
    model.k = math.exp(float(np.mean(tops)) - 0.5772) if tops else 1.0


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept with a small ridge, by Newton steps; targets drawn in by one row."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.array([0.0, math.log((n1 + 1) / (n0 + 1))])
    a = np.stack([x, np.ones(len(x))], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - t) + np.array([1e-3 * w[0], 0])
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.eye(2) * 1e-3
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.0), float(w[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          train_rows: int = TRAIN_ROWS) -> Model:
    """labels: doc_id, toxic (0/1). What comes to the driver is bounded by the sample."""
    sample = materialise(_sample(docs, labels, id_col, text_col, train_rows))
    counts = materialise(_counts(sample))
    every = counts.where("word = ''").first()
    if every is None or not (every["t"] and every["c"]):
        total = sum(every[k] for k in ("t", "c", "t2", "c2")) if every else 0
        share = (every["t"] + every["t2"]) / total if total else 0.0
        return Model(intercept=math.log(share / (1 - share)) if 0 < share < 1 else (1e9 if share else -1e9))
    counts = counts.where("word <> ''")
    words = counts.where("t + t2 >= 2").collect()
    prefixes = counts.groupBy(F.substring("word", 1, PREFIX).alias("prefix")).agg(
        *[F.sum(k).alias(k) for k in ("t", "c", "t2", "c2")]).where("t + t2 >= 2").collect()
    early = Model(*_scores(words, prefixes, (every["t"], every["c"]), False))
    scan = _scan(sample, early)
    n_words = sum(r["n"] for r in scan if r["toxic"] == 0)
    _calibrate(early, words, every["c"], n_words, scan)
    late = score(sample.where("part = 3"), early).select("toxic", "evidence").collect()
    x, y = np.array([r["evidence"] for r in late]), np.array([r["toxic"] for r in late])
    model = Model(*_scores(words, prefixes, (every["t"] + every["t2"], every["c"] + every["c2"]), True),
                  decay=early.decay, k=early.k)
    if len(x):
        model.slope, model.intercept = _logistic(np.log1p(x), y)
    else:
        model.slope, model.intercept = 1.0, -5.0
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with evidence, score, predicted (score >= 0.5) and passages (significant segments)."""
    base = without(docs, "evidence", "score", "predicted", "passages")
    at = base.columns.index(text_col)
    schema = T.StructType([*base.schema.fields, T.StructField("evidence", T.DoubleType()), T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType()),
                           T.StructField("passages", T._parse_datatype_string(PASSAGES))])
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for b in batches:
            got = [scorer(t) for t in texts(b.column(at))]
            p = [model.probability(g[0]) for g in got]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([g[0] for g in got], pa.float64()), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()),
                 pa.array([g[1] for g in got], kind)],
                names=[*b.schema.names, "evidence", "score", "predicted", "passages"])
    return base.mapInArrow(run, schema)


def held_out(id_column: str) -> Column:
    """Whether a row is kept out of training: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0
