"""Hard-negative mining with rotated one-bit codes and certain intervals.

A vector's integer form v is floor(256 x) of its components; a score is the integer inner
product of two such vectors. Each v is stored with a stack of one-bit codes: code l is the
sign of the l-th fixed random rotation of what the codes before it left of v / |v|, kept with
its alignment (the inner product of that rest with the code's unit vector) and, at the end, the
length of what no code covers. The inner product with a query is estimated from popcounts of
the codes with the bit planes of the rotated, rounded query. By Cauchy and Schwarz it lies
within the uncovered length plus each alignment times the query's rounding error of the
estimate; so every pair has an interval that surely holds its score.

1. Positives: within its label, an anchor first scores the rows of the best estimates; rows
   whose interval ends below the worst score needed are dropped, all others are scored in
   integers.
2. Negatives: for each positive's score p, rows of other labels whose interval misses
   [p / 2, 0.95 p] are dropped, then those whose interval ends below the worst negative
   needed; the rest are scored in integers.

Anchors and rows are dealt into blocks of `BLOCK` at random; a task holds one block of each
and returns at most a fixed number of rows an anchor, so a label with a third of all rows
or any number of ties is spread like all others. Pairs are never rows.

Defined results: rows with a null label, a null vector or a null or non-finite component take
no part; a row with a null id is no anchor, and in ties comes after those with ids; rows that
repeat an id count one by one, but none is a positive of an anchor with its own id; vectors
of different lengths are never compared; a vector of zeros scores 0 with all; an anchor
without positives or negatives gives no row; scores beyond a long raise an error; other
columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

CODES = 4
PLANES = 6
BLOCK = 8192
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # per cent of the positive's score
TRY = 16  # best estimates scored first
_STEP = 1 << 19  # pairs held at once
_SLACK = 1e-9  # rounding of doubles, against the product of the lengths


@functools.lru_cache(16)
def _rotation(dim: int, level: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng((dim, level)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    n, d = bits.shape
    words = np.zeros((n, -(-d // 64) * 8), np.uint8)
    words[:, :-(-d // 8)] = np.packbits(bits, axis=1, bitorder="little")
    return words.view(np.uint64)


def whole(x: np.ndarray) -> np.ndarray:
    return np.floor(256 * x.astype(np.float64))


def encode(v: np.ndarray, codes: int = CODES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code words, alignments, uncovered length, length) of integer vectors."""
    n, d = v.shape
    length = np.linalg.norm(v, axis=1)
    rest = v / np.where(length > 0, length, 1)[:, None]
    words, align = np.zeros((n, codes, -(-d // 64)), np.uint64), np.zeros((n, codes))
    for k in range(codes if d else 0):
        turn = _rotation(d, k)
        bits = rest @ turn > 0
        unit = np.where(bits, 1.0, -1.0) @ turn.T / np.sqrt(d)
        align[:, k] = np.einsum("ij,ij->i", rest, unit)
        rest = rest - align[:, k, None] * unit
        words[:, k] = _pack(bits)
    return words, align, np.linalg.norm(rest, axis=1), length


class Queries:
    """Bit planes of rotated queries, for estimates against stored codes."""

    def __init__(self, v: np.ndarray, codes: int = CODES, planes: int = PLANES):
        d = v.shape[1]
        self.length, self.dim = np.linalg.norm(v, axis=1), d
        unit = v / np.where(self.length > 0, self.length, 1)[:, None]
        self.levels = []
        for k in range(codes if d else 0):
            q = unit @ _rotation(d, k)
            low = q.min(1, initial=0)
            step = np.maximum((q.max(1, initial=0) - low) / ((1 << planes) - 1), 1e-300)
            u = np.rint((q - low[:, None]) / step[:, None]).astype(np.int64)
            error = np.linalg.norm(q - (low[:, None] + step[:, None] * u), axis=1)
            self.levels.append((low, step, u.sum(1), [_pack((u >> b & 1).astype(bool)) for b in range(planes)], error))

    def intervals(self, i: slice, words: np.ndarray, align: np.ndarray, rest: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated scores of queries `i` with coded rows, and how far off they may be."""
        n = len(self.length[i])
        estimate = np.zeros((n, len(length)))
        off = np.broadcast_to(rest, estimate.shape) + _SLACK
        for k, (low, step, total, planes, error) in enumerate(self.levels):
            code = words[:, k]
            ones = np.bitwise_count(code).sum(1, dtype=np.int64)
            sums = np.zeros((n, len(length)), np.int32)
            for b, plane in enumerate(planes):
                for w in range(code.shape[1]):
                    sums += np.bitwise_count(plane[i, None, w] & code[None, :, w]).astype(np.int32) << b
            inner = low[i, None] * (2 * ones - self.dim) + step[i, None] * (2 * sums - total[i, None])
            estimate += inner * (align[:, k] / np.sqrt(self.dim))
            off = off + error[i, None] * np.abs(align[:, k])
        size = self.length[i, None] * length
        return estimate * size, off * size


def _dots(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of rows with one query, exact."""
    top = np.abs(v).max(initial=0) * np.abs(q).max(initial=0) * max(v.shape[1], 1)
    if top < 1 << 53:
        return (v @ q).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(x, q)) for x in v]
    if any(abs(x) >= 1 << 63 for x in exact):
        raise ValueError("a score doesn't fit a long")
    return np.array(exact, np.int64)


class _Block:
    """Vectors and stored codes of one side of a task, sorted by label."""

    def __init__(self, t: pa.Table, codes: int):
        order = np.argsort(t.column("label").to_numpy(), kind="stable")
        t = t.take(order)
        n = t.num_rows
        self.label = t.column("label").to_numpy()
        no_id = np.asarray(t.column("vec_id").is_null())
        self.ids = t.column("vec_id").fill_null(np.iinfo(np.int64).max).to_numpy()
        self.no_id, self.t = no_id, t
        flat = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.v = whole(flat.reshape(n, -1)) if n else np.zeros((0, 0))
        self.words = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint64).reshape(n, codes, -(-self.v.shape[1] // 64))
        self.align = np.array(t.column("align").combine_chunks().flatten()).reshape(n, codes)
        self.rest, self.length = t.column("rest").to_numpy(), t.column("length").to_numpy()

    def coded(self, at: slice) -> tuple:
        return self.words[at], self.align[at], self.rest[at], self.length[at]

    def first(self, rows: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
        """Places of the first n rows: higher scores, then smaller ids, those without last."""
        return np.lexsort((self.no_id[rows], self.ids[rows], -score))[:n]


def _bounds(p: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores s with low p <= 100 s <= high p."""
    return -(-low * p // 100), high * p // 100


def _best(block: _Block, q: np.ndarray, rows: np.ndarray, estimate: np.ndarray, off: np.ndarray, least: int | None, most: int | None,
          n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n of `rows` by score within [least, most], and their scores."""
    if least is not None:
        may = (estimate + off >= least) & (estimate - off <= most)
        rows, estimate, off = rows[may], estimate[may], off[may]
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    inside = lambda s: (s >= least) & (s <= most) if least is not None else np.ones(len(s), bool)
    if len(rows) > TRY:
        likely = estimate if most is None else np.where(estimate > most, 2 * most - estimate, estimate)
        known = _dots(block.v[rows[np.argpartition(-likely, TRY)[:TRY]]], q)
        known = np.sort(known[inside(known)])[::-1]
        if len(known) >= n:
            may = estimate + off >= known[n - 1]
            rows = rows[may]
    score = _dots(block.v[rows], q)
    ok = inside(score)
    rows, score = rows[ok], score[ok]
    top = block.first(rows, score, n)
    return rows[top], score[top]


def store(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", codes: int = CODES) -> DataFrame:
    """The rows that take part with their codes, alignments and lengths, as a written table."""
    vector = F.col("embedding")
    known = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # NaN is above infinity
    good = (rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"),
                        F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("embedding"))
            .where(F.col("label").isNotNull() & vector.isNotNull()).where(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("embedding")
            sizes = np.diff(lists.offsets.to_numpy()) if b.num_rows else np.zeros(0, int)
            for d in np.unique(sizes):
                part = b.take(pa.array(np.flatnonzero(sizes == d)))
                flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False)
                words, align, rest, length = encode(whole(flat.reshape(part.num_rows, d)), codes)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.full(part.num_rows, d, np.int32)), pa.array([x.tobytes() for x in words], pa.binary()),
                     pa.array(list(align), pa.list_(pa.float64())), pa.array(rest), pa.array(length)],
                    names=[*part.schema.names, "dim", "codes", "align", "rest", "length"])
    kind = good.schema["embedding"].dataType.simpleString()
    return materialise(good.mapInArrow(run, f"row long, vec_id long, label long, embedding {kind}, dim int, codes binary, align array<double>, "
                                            "rest double, length double"))


def _meet(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, block: int, run, schema: str) -> DataFrame:
    """run(anchor block, row block) for every pair of blocks of one vector length."""
    i, j = -(-n_anchors // block), -(-n_rows // block)
    parts = min(i * j, 10_000)

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        got = df.toDF(*df.columns).withColumn(own, F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        return got.repartition(parts, "dim", "i", "j").groupBy("dim", "i", "j")
    return dealt(anchors, "i", i, "j", j).cogroup(dealt(rows, "j", j, "i", i)).applyInArrow(run, schema)


def mine(rows: DataFrame, is_anchor, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES,
         negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, codes: int = CODES, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. `is_anchor`:
    a condition over the column vec_id."""
    stored = store(rows, id_col, vector_col, label_col, codes)
    asked = stored.where(is_anchor & F.col("vec_id").isNotNull())
    n_rows, n_anchors = stored.count(), asked.count()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_anchors:
        return rows.sparkSession.createDataFrame([], out)

    def near(a: pa.Table, t: pa.Table) -> pa.Table:
        found = {"row": [], "id": [], "score": []}
        if a.num_rows and t.num_rows:
            q, r = _Block(a, codes), _Block(t, codes)
            keys = q.t.column("row").to_numpy()
            for label in np.unique(q.label):
                lo, hi = np.searchsorted(r.label, [label, label + 1])
                mine_ = np.flatnonzero(q.label == label)
                if lo == hi:
                    continue
                asks, step = Queries(q.v[mine_], codes), max(1, _STEP // (hi - lo))
                for s in range(0, len(mine_), step):
                    est, off = asks.intervals(slice(s, s + step), *r.coded(slice(lo, hi)))
                    for k, e, o in zip(mine_[s:s + step], est, off):
                        others = np.flatnonzero((r.ids[lo:hi] != q.ids[k]) | r.no_id[lo:hi])
                        got, score = _best(r, q.v[k], others + lo, e[others], o[others], None, None, positives)
                        found["row"].append(np.full(len(got), keys[k]))
                        found["id"].append(got)
                        found["score"].append(score)
        return _result(found, t)

    def _result(found: dict, t: pa.Table, extra: tuple = ()) -> pa.Table:
        order = np.argsort(t.column("label").to_numpy(), kind="stable") if t.num_rows else np.zeros(0, np.int64)
        at = {k: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for k, x in found.items()}
        ids = t.column("vec_id").take(pa.array(order[at.pop("id")]))
        return pa.table([pa.array(at["row"]), *[pa.array(at[k]) for k in extra], ids, pa.array(at["score"])], names=["anchor", *extra, "id", "score"])

    def hard(a: pa.Table, t: pa.Table) -> pa.Table:
        found = {"row": [], "k": [], "id": [], "score": []}
        if a.num_rows and t.num_rows:
            q, r = _Block(a, codes), _Block(t, codes)
            keys, wanted = q.t.column("row").to_numpy(), q.t.column("scores").to_pylist()
            asks, step = Queries(q.v, codes), max(1, _STEP // t.num_rows)
            for s in range(0, len(keys), step):
                est, off = asks.intervals(slice(s, s + step), *r.coded(slice(None)))
                for k, e, o in zip(range(s, len(keys)), est, off):
                    others = np.flatnonzero(r.label != q.label[k])
                    for n, p in enumerate(wanted[k]):
                        got, score = _best(r, q.v[k], others, e[others], o[others], *_bounds(p, low, high), negatives)
                        found["row"].append(np.full(len(got), keys[k]))
                        found["k"].append(np.full(len(got), n))
                        found["id"].append(got)
                        found["score"].append(score)
        return _result(found, t, ("k",))

    first = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    pos = (_meet(asked, stored, n_anchors, n_rows, block, near, "anchor long, id long, score long")
           .withColumn("k", F.row_number().over(first) - 1).where(F.col("k") < positives))
    pos = materialise(pos)
    lists = pos.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "score"))), lambda x: x["score"]).alias("scores"))
    again = asked.join(lists.withColumnRenamed("anchor", "row"), "row")  # at most `positives` scores an anchor
    neg = _meet(again, stored, n_anchors, n_rows, block, hard, "anchor long, k long, id long, score long")
    best = Window.partitionBy("anchor", "k").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    neg = neg.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    named = pos.select("anchor", "k", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (neg.join(named, ["anchor", "k"]).join(ids, "anchor")
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
