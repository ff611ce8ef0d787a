"""Corpus statistics.

Co-occurrence (DᵀD, strict upper triangle) runs as a tiled product (`pair_tiles`): documents
are dealt to tiles and pair sums end inside a tile; with pivots, where the documents of a group
meet (`pair_groups`). Over a vocabulary of at most `_DENSE_TOKENS`, every Arrow batch is reduced to
partial sums instead, which are shuffled: by one matrix product where a step holds few distinct
tokens, else as sparse pairs in chunks of bounded size, documents of many distinct tokens dealt to
several tasks by blocks of their first token.

Significance formulas follow the reference literally (`literal=True`): row sums of the
upper triangle as marginals, Dunning's -2 on the first term only; NaN and +-inf -> 0
(Spark: null from try_divide -> 0), zero weights dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import BROADCAST_ROW_LIMIT, bounded_broadcast, stored, with_scalars
from . import pair_groups, pair_tiles

# Tokens that a task reads into one step (a longer document makes a step of its own).
_STEP_TOKENS = 2_000_000
# Distinct tokens of a step up to which one dense matrix product sums its pairs.
_DENSE_TOKENS = 2048
# Distinct tokens of a document that one task pairs with the rest of the document.
_BLOCK_TOKENS = 4096
# Row sums that reach the pairs by broadcast (about 100 bytes each in an executor): a row a token, so that they
# grow much slower than the pairs, which a join would shuffle twice.
_BROADCAST_SUMS = 1_000_000
# Pairs that a task holds at once on the sparse way; cells of a dense block of rows.
_CHUNK_PAIRS = 4_000_000
# Smoothing of the KL divergence (fixed value of the reference).
KLD_EPSILON = 0.00001
# Lower clip of logarithm arguments in LLR (fixed value of the reference).
LN_CLIP = 1e-10


def _dense_sums(rows: np.ndarray, cols: np.ndarray, weights: np.ndarray, n_rows: int, k: int):
    """(i, j, sum) of all pairs i < j of a batch by matrix products over blocks of rows."""
    acc = np.zeros((k, k))
    step = max(1, _CHUNK_PAIRS // k)
    bounds = np.searchsorted(rows, np.arange(0, n_rows + step, step))
    for base, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
        x = np.zeros((step, k))
        np.add.at(x, (rows[lo:hi] - base * step, cols[lo:hi]), weights[lo:hi])
        acc += x.T @ x
    ii, jj = np.nonzero(np.triu(acc, 1))
    yield ii, jj, acc[ii, jj]


def _sparse_sums(rows: np.ndarray, cols: np.ndarray, weights: np.ndarray, block: np.ndarray, k: int,
                 block_tokens: int, chunk: int):
    """The same as pairs of each document, summed and passed on by chunks. Of a document
    dealt in blocks only the pairs whose first token lies in the row's block."""
    cell, at = np.unique(rows * k + cols, return_inverse=True)
    n = np.bincount(at, weights)
    rows, cols = cell // k, cell % k
    starts = np.searchsorted(rows, np.arange(len(block) + 1))
    keys: list[np.ndarray] = []
    sums: list[np.ndarray] = []
    held = 0

    def total():
        pair, where = np.unique(np.concatenate(keys), return_inverse=True)
        return pair // k, pair % k, np.bincount(where, np.concatenate(sums))

    for r, b in enumerate(block):
        u, w = cols[starts[r]:starts[r + 1]], n[starts[r]:starts[r + 1]]
        lo, end = b * block_tokens, min(len(u), (b + 1) * block_tokens)
        while lo < end:
            hi = min(end, lo + max(1, chunk // len(u)))
            size = len(u) - 1 - np.arange(lo, hi)
            first = np.repeat(np.arange(lo, hi), size)
            second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(size) - size, size)
            keys.append(u[first] * k + u[second])
            sums.append(w[first] * w[second])
            held += len(first)
            lo = hi
            if held >= chunk:
                yield total()
                keys, sums, held = [], [], 0
    if held:
        yield total()


def _steps(lists: pa.ListArray, limit: int = _STEP_TOKENS):
    """Row ranges of at most `limit` tokens."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(ends):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield lo, hi
        lo = hi


def _step_sums(toks: pa.ListArray, ns: pa.ListArray, block: np.ndarray, block_tokens: int,
               dense: int = _DENSE_TOKENS, chunk: int = _CHUNK_PAIRS):
    """(w1, w2, n) arrays of the pairs of some documents, w1 < w2 in token order; `ns` null:
    every token counts once. Tokens stay in Arrow, arithmetic runs on their ranks."""
    rows = pc.list_parent_indices(toks).to_numpy()
    if len(rows) == 0:
        return
    coded = toks.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    names, k = coded.dictionary.take(order), len(order)
    rank = np.empty(k, np.int64)
    rank[order.to_numpy()] = np.arange(k)
    cols = rank[coded.indices.to_numpy()]
    weights = ns.flatten().to_numpy() if ns.null_count == 0 else np.ones(len(rows))
    # below a block's size no document has been dealt
    sums = _dense_sums(rows, cols, weights, len(toks), k) if k <= min(dense, block_tokens) \
        else _sparse_sums(rows, cols, weights, block, k, block_tokens, chunk)
    for ii, jj, n in sums:
        yield names.take(pa.array(ii)), names.take(pa.array(jj)), pa.array(n, pa.float64())


def _pair_sums(docs: DataFrame, block_tokens: int) -> DataFrame:
    """docs: (toks, ns), a row a document, to (w1, w2, n)."""
    docs = docs.withColumn("_nb", F.ceil(F.size(F.array_distinct("toks")) / block_tokens).cast("int"))
    short = docs.where("_nb = 1").withColumn("blk", F.lit(0))
    long = docs.where("_nb > 1").withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = short.unionByName(long.repartition(n_parts, F.xxhash64("toks", "blk"))).drop("_nb")
    names = ["w1", "w2", "n"]

    def run(batches):
        for batch in batches:
            for lo, hi in _steps(batch["toks"]):
                part = batch.slice(lo, hi - lo)
                for sums in _step_sums(part["toks"], part["ns"], part["blk"].to_numpy(), block_tokens):
                    yield pa.RecordBatch.from_arrays(list(sums), names=names)

    partial = rows.select("toks", "ns", "blk").mapInArrow(run, "w1 string, w2 string, n double")
    return partial.groupBy("w1", "w2").agg(F.sum("n").alias("n"))


def _sums(docs: DataFrame, pivots: Sequence[str], words: list[str] | None, block_tokens: int, counts: DataFrame | None = None,
          with_margins: bool = False) -> DataFrame:
    if pivots:
        pv, known = list(pivots), None
        if with_margins:
            docs = stored(docs.dropna(subset=pv))
            known = pair_groups.row_sums(docs, pv)
        elif counts is not None:
            known = counts.dropna(subset=pv).select(*pv, "token", F.col("nw_x").alias("value"))
        t = pair_groups.pair_sums(docs, pv, known)
        if with_margins:
            return t.select(*pv, "w1", "w2", "n", *[F.coalesce(f"value_{i}", F.lit(0.0)).alias(f"zr_{c}") for i, c in ((1, "i"), (2, "j"))],
                            F.col("total").alias("z"))
        return t.select(*pv, "w1", "w2", "n", F.col("value_1").alias("nw_x"), F.col("value_2").alias("nw_y")) if counts is not None else t
    if words is not None and len(words) <= _DENSE_TOKENS and not with_margins:
        return _pair_sums(docs, block_tokens)
    return pair_tiles.pair_sums(docs, with_margins=with_margins)


def _short(vocab: DataFrame | None) -> list[str] | None:
    """The tokens of a vocabulary of at most BROADCAST_ROW_LIMIT; None beyond."""
    rows = [] if vocab is None else vocab.select("token").distinct().limit(BROADCAST_ROW_LIMIT + 1).collect()
    return None if vocab is None or len(rows) > BROADCAST_ROW_LIMIT else sorted(r["token"] for r in rows)


def _kept(docs: DataFrame, words: list[str]) -> DataFrame:
    """Documents (..., toks, ns null) with the tokens of a bounded list only, without a shuffle."""
    def run(batches):
        known = pa.array(words, pa.string())
        for b in batches:
            lists = b.column("toks")
            tokens, at = lists.flatten(), pc.list_parent_indices(lists)
            keep = pc.is_in(tokens, value_set=known)
            sizes = np.bincount(at.filter(keep).to_numpy(), minlength=b.num_rows)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            cut = pa.ListArray.from_arrays(pa.array(ends), tokens.filter(keep))
            yield b.set_column(b.schema.get_field_index("toks"), "toks", cut)
    return docs.mapInArrow(run, docs.schema)


def co_occurrence(dtm: DataFrame, vocab: DataFrame | None = None, pivots: Sequence[str] = (),
                  index: DataFrame | None = None, block_tokens: int = _BLOCK_TOKENS) -> DataFrame:
    """J12 (M05 with pivots) on a stored DTM: Σ_d n(d,w1)·n(d,w2) for w1 < w2 over the
    tokens of `vocab` (all tokens if None). dtm: (document_id, token, n); with pivots, `index`
    supplies them. Result: (pivots..., w1, w2, n) with w1 < w2 in token order."""
    cells = dtm if vocab is None else dtm.join(vocab.select("token"), "token", "left_semi")
    if pivots:
        cells = cells.join(index.select("document_id", *pivots), "document_id", "inner")
    # one list, so that tokens and counts keep one order; a document's tokens are one row in memory
    docs = cells.groupBy("document_id", *pivots).agg(
        F.collect_list(F.struct("token", F.col("n").cast("double").alias("n"))).alias("c"))
    return _sums(docs.select(*pivots, F.col("c.token").alias("toks"), F.col("c.n").alias("ns")), pivots, _short(vocab), block_tokens)


def co_occurrence_from_tokens(speeches: DataFrame, vocab: DataFrame | None = None, array_col: str = "lemma",
                              pivots: Sequence[str] = (), block_tokens: int = _BLOCK_TOKENS, counts: DataFrame | None = None,
                              with_margins: bool = False) -> DataFrame:
    """J12 straight from token arrays (one row a speech). Without `vocab` the arrays are used
    as they are; a vocabulary of at most BROADCAST_ROW_LIMIT tokens cuts them in place; beyond, the
    tokens that it holds are shuffled by speech.

    Pairs can carry what they would be joined to: `with_margins` adds the columns of `margins` (null pivots have none and are
    dropped); with pivots, `counts` (pivots..., token, nw_x), one row a token of a group, adds nw_x and nw_y for `hal_cwr`."""
    if counts is not None and (not pivots or with_margins):
        raise ValueError("counts travel with the documents of pivots, without margins")
    no_counts = F.lit(None).cast("array<double>").alias("ns")
    toks = F.filter(array_col, lambda t: t.isNotNull()).alias("toks")
    words = _short(vocab)
    if vocab is None:
        return _sums(speeches.select(*pivots, toks, no_counts), pivots, None, block_tokens, counts, with_margins)
    if words is not None:
        return _sums(_kept(speeches.select(*pivots, toks, no_counts), words), pivots, words, block_tokens, counts, with_margins)
    tokens = speeches.select("document_id", *pivots, F.explode(array_col).alias("token"))
    tokens = tokens.join(vocab.select("token"), "token", "left_semi")
    docs = tokens.groupBy("document_id", *pivots).agg(F.collect_list("token").alias("toks"))
    return _sums(docs.select(*pivots, "toks", no_counts), pivots, None, block_tokens, counts, with_margins)


# --------------------------------------------------------------------------------
# Significance
# --------------------------------------------------------------------------------

METRICS = ("ppmi", "dice", "llr", "llr_z", "llr_n", "hal_cwr")


def _ln(x: Column) -> Column:
    return F.ln(F.greatest(x, F.lit(LN_CLIP)))


def _dunning_l(k: Column, n: Column, x: Column) -> Column:
    return _ln(x) * k + _ln(F.lit(1.0) - x) * (n - k)


def _signed_sum(terms: list[tuple[Column, ...]], value) -> Column:
    """The sum of value(term) in order; one small expression, as long ones aren't compiled."""
    rows = F.array(*[F.struct(*[x.alias(n) for x, n in zip(t, "abcd")]) for t in terms])
    return F.aggregate(F.transform(rows, value), F.lit(0.0), lambda acc, x: acc + x)


def margins(ttm: DataFrame, pivots: Sequence[str] = ()) -> DataFrame:
    """(pivots..., w1, w2, n, zr_i, zr_j, z): each pair with its tokens' row sums of the upper triangle
    and the total. Pairs that carry them are taken as they are. Else the pairs are stored once; row sums of at most
    _BROADCAST_SUMS tokens reach them by broadcast, so that the pairs aren't shuffled."""
    pv = list(pivots)
    if {"zr_i", "zr_j", "z"} <= set(ttm.columns):
        return ttm.select(*pv, "w1", "w2", "n", "zr_i", "zr_j", "z")
    ttm = stored(ttm)
    rows = stored(ttm.groupBy(*pv, "w1").agg(F.sum("n").alias("zr")))
    total = rows.groupBy(*pv).agg(F.sum("zr").alias("z"))
    side = bounded_broadcast(rows, _BROADCAST_SUMS)
    zi = side.select(*pv, "w1", F.col("zr").alias("zr_i"))
    zj = side.select(*pv, F.col("w1").alias("w2"), F.col("zr").alias("zr_j"))
    t = ttm.join(zi, [*pv, "w1"], "left").join(zj, [*pv, "w2"], "left")
    t = t.join(total, pv, "inner") if pv else with_scalars(t, total.select("z"))
    return t.select(*pv, "w1", "w2", F.col("n").cast("double").alias("n"), F.coalesce("zr_i", F.lit(0.0)).alias("zr_i"),
                    F.coalesce("zr_j", F.lit(0.0)).alias("zr_j"), F.col("z").cast("double").alias("z"))


def weight(metric: str, *, normalize: bool = False, n_words: float | None = None) -> Column:
    """The weight of a row of `margins`; NaN and infinities count as 0."""
    if metric not in METRICS:
        raise ValueError("metric is not applicable in current context")
    cij, zr_i, zr_j, z = (F.col(c) for c in ("n", "zr_i", "zr_j", "z"))
    if metric == "ppmi":
        v = F.ln(F.try_divide(cij * z, zr_i * zr_j))
        if normalize:
            v = F.try_divide(v, -F.ln(cij * z))
        v = F.greatest(F.lit(0.0), v)
    elif metric == "dice":
        v = F.try_divide(2.0 * cij, zr_i + zr_j)
    elif metric == "llr":
        signs = [(1, z), (-1, zr_i), (-1, zr_j), (1, cij), (1, z - zr_i - zr_j + cij), (1, zr_i - cij), (1, zr_j - cij), (-1, z - zr_i),
                 (-1, z - zr_j)]
        v = 2.0 * _signed_sum([(F.lit(float(s)), x) for s, x in signs], lambda t: t["b"] * _ln(t["b"]) * t["a"])
    elif metric in ("llr_z", "llr_n"):
        zz = z if metric == "llr_z" else F.lit(float(n_words))
        p = F.try_divide(zr_j, zz)
        pi = F.try_divide(cij, zr_i)
        pj = F.try_divide(zr_j - cij, zz - zr_i)
        signs = [(-2, cij, zr_i, p), (1, zr_j - cij, zz - zr_i, p), (-1, cij, zr_i, pi), (-1, zr_j - cij, zz - zr_i, pj)]
        v = _signed_sum([(F.lit(float(s)), *x) for s, *x in signs], lambda t: t["a"] * _dunning_l(t["b"], t["c"], t["d"]))
    else:  # hal_cwr
        v = F.try_divide(cij, zr_i + zr_j - cij)
    finite = lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(F.coalesce(x, F.lit(0.0)))
    return F.transform(F.array(v), finite)[0]  # bound by the lambda: computed once


def significance(ttm: DataFrame, metric: str, *, pivots: Sequence[str] = (), normalize: bool = False,
                 n_words: float | None = None) -> DataFrame:
    """Weight per pair from Cij, Z (total) and Zr (row sums of the upper
    triangle). Returns (pivots..., w1, w2, value) without zero weights."""
    value = weight(metric, normalize=normalize, n_words=n_words)
    # a generated column: conditions on it don't compute it again
    return margins(ttm, pivots).select(*pivots, "w1", "w2", F.explode(F.array(value)).alias("value")).where(F.col("value") != 0)


def significance_ratio(a: DataFrame, b: DataFrame, pivots: Sequence[str] = ()) -> DataFrame:
    """A / B on B's non-zero cells, for weights of two co-occurrences."""
    bb = b.where(F.col("value") != 0).select(*pivots, "w1", "w2", F.col("value").alias("_b"))
    return a.join(bb, [*pivots, "w1", "w2"], "inner") \
        .select(*pivots, "w1", "w2", (F.col("value") / F.col("_b")).alias("value"))


def metric_ratio(ttm: DataFrame, metric: str, base: str, pivots: Sequence[str] = ()) -> DataFrame:
    """M06 for two metrics of one co-occurrence: both weights lie on a row, so nothing is joined."""
    both = F.array(F.struct(weight(metric).alias("a"), weight(base).alias("b")))
    rows = margins(ttm, pivots).select(*pivots, "w1", "w2", F.explode(both).alias("x")).where("x.a <> 0 AND x.b <> 0")
    return rows.select(*pivots, "w1", "w2", (F.col("x.a") / F.col("x.b")).alias("value"))


# --------------------------------------------------------------------------------
# HAL common windows ratio
# --------------------------------------------------------------------------------

def hal_cwr(co_occurrences: DataFrame, nw_x: DataFrame | None = None, key: str = "document_id", keep: Sequence[str] = ()) -> DataFrame:
    """cwr = nw_xy / (nw_x + nw_y - nw_xy) per (key, w1, w2); null -> 0, negative -> 0.

    co_occurrences: (key, w1, w2, n); nw_x: (key, token, nw_x), or None where the pairs carry nw_x and nw_y. `keep` names further
    columns of the pairs that come back."""
    t = co_occurrences
    if nw_x is not None:
        x = nw_x.select(key, F.col("token").alias("w1"), F.col("nw_x"))
        y = nw_x.select(key, F.col("token").alias("w2"), F.col("nw_x").alias("nw_y"))
        t = t.join(x, [key, "w1"], "left").join(y, [key, "w2"], "left")
    cwr = F.try_divide(F.col("n"), F.col("nw_x") + F.col("nw_y") - F.col("n"))
    return t.select(key, "w1", "w2", *keep, F.greatest(F.coalesce(cwr, F.lit(0.0)), F.lit(0.0)).alias("cwr"))


def hal_cwr_by_mapping(nw_xy: DataFrame, nw_x: DataFrame | None, pair_mapping: DataFrame, key: str = "document_id"
                       ) -> DataFrame:
    """nw_xy as (key, pair_id, n) with a mapping table (pair_id, w1, w2), by which nw_x (key, token, nw_x) is looked up. nw_x None:
    nw_xy carries w1, w2, nw_x and nw_y from the join that gave it pair ids, and isn't joined again."""
    co = nw_xy if nw_x is None else nw_xy.join(pair_mapping, "pair_id", "inner")
    return hal_cwr(co, nw_x, key, keep=["pair_id"]).select(key, "pair_id", "cwr")


# --------------------------------------------------------------------------------
# Normalising and weighting
# --------------------------------------------------------------------------------

def normalize(dtm: DataFrame, axis: int = 1, norm: str = "l1", keep_magnitude: bool = False) -> DataFrame:
    """Divide each row (axis=1, per document) or column (axis=0, per token) by its
    l1 / l2 / max norm. Zero rows stay zero. keep_magnitude multiplies everything by
    sum(row 0) / sum(normalised row 0), row 0 = the lowest document_id (literal)."""
    key = "document_id" if axis == 1 else "token"
    agg = {"l1": F.sum(F.abs("n")), "l2": F.sqrt(F.sum(F.col("n") * F.col("n"))), "max": F.max(F.abs("n"))}[norm]
    norms = dtm.groupBy(key).agg(agg.alias("_norm"))
    out = dtm.join(norms, key, "inner") \
        .select("document_id", "token", F.coalesce(F.try_divide(F.col("n"), F.col("_norm")), F.lit(0.0)).alias("n"))
    if keep_magnitude:
        first = dtm.agg(F.min("document_id").alias("document_id"))
        raw = dtm.join(first, "document_id", "left_semi").agg(F.sum("n").alias("_raw"))
        new = out.join(first, "document_id", "left_semi").agg(F.sum("n").alias("_new"))
        factor = with_scalars(raw, new).select(F.try_divide(F.col("_raw"), F.col("_new")).alias("_f"))
        out = with_scalars(out, factor).select("document_id", "token", (F.col("n") * F.col("_f")).alias("n"))
    return out


def normalize_by_raw_counts(dtm: DataFrame, index: DataFrame) -> DataFrame:
    """Divide each row by the document's n_raw_tokens; NaN/inf -> 0."""
    if "n_raw_tokens" not in index.columns:
        raise ValueError("document index has no n_raw_tokens column")
    raw = index.select("document_id", "n_raw_tokens")
    return dtm.join(raw, "document_id", "left").select(
        "document_id", "token",
        F.when(F.col("n_raw_tokens") > 0, F.col("n") / F.col("n_raw_tokens")).otherwise(F.lit(0.0)).alias("n"))


def tf_idf(dtm: DataFrame, index: DataFrame, norm: str | None = "l2", use_idf: bool = True,
           smooth_idf: bool = True) -> DataFrame:
    """As sklearn's TfidfTransformer: idf = ln((1+N)/(1+df)) + 1 (smooth) or
    ln(N/df) + 1; N counts every document of the index, empty ones too; then row norm."""
    if use_idf:
        n_docs = index.agg(F.count(F.lit(1)).cast("double").alias("_N"))
        dfreq = dtm.where(F.col("n") != 0).groupBy("token").agg(F.count(F.lit(1)).cast("double").alias("_df"))
        idf = with_scalars(dfreq, n_docs)
        if smooth_idf:
            idf = idf.select("token", (F.ln((F.col("_N") + 1) / (F.col("_df") + 1)) + 1).alias("_idf"))
        else:
            idf = idf.select("token", (F.ln(F.col("_N") / F.col("_df")) + 1).alias("_idf"))
        w = dtm.join(idf, "token", "inner").select("document_id", "token", (F.col("n") * F.col("_idf")).alias("n"))
    else:
        w = dtm.select("document_id", "token", F.col("n").cast("double").alias("n"))
    return normalize(w, axis=1, norm=norm) if norm else w


# --------------------------------------------------------------------------------
# Distribution over periods
# --------------------------------------------------------------------------------

def _period_spine_stats(periods: DataFrame, key: str) -> DataFrame:
    return periods.agg(F.count(F.lit(1)).cast("double").alias("d"), F.sum(F.col(key).cast("double")).alias("sx"),
                       F.sum(F.col(key).cast("double") ** 2).alias("sxx"),
                       F.min(key).alias("x1"), F.max(key).alias("x2"))


# --- p-values: regularised incomplete gamma and beta functions (per-row helpers) -------

def _gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma Q(a, x) (series below a+1, continued fraction above)."""
    import math

    if x <= 0:
        return 1.0
    log_front = -x + a * math.log(x) - math.lgamma(a)
    if x < a + 1:
        term = total = 1.0 / a
        ap = a
        for _ in range(10_000):
            ap += 1
            term *= x / ap
            total += term
            if abs(term) < abs(total) * 1e-16:
                break
        return max(0.0, 1.0 - total * math.exp(log_front))
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-16:
            break
    return math.exp(log_front) * h


def _beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) by its continued fraction."""
    import math

    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))

    def cf(a_, b_, x_):
        tiny = 1e-300
        qab, qap, qam = a_ + b_, a_ + 1, a_ - 1
        c, d = 1.0, 1 - qab * x_ / qap
        d = 1 / (tiny if abs(d) < tiny else d)
        h = d
        for m in range(1, 10_000):
            m2 = 2 * m
            aa = m * (b_ - m) * x_ / ((qam + m2) * (a_ + m2))
            d = 1 + aa * d
            d = 1 / (tiny if abs(d) < tiny else d)
            c = 1 + aa / c
            c = tiny if abs(c) < tiny else c
            h *= d * c
            aa = -(a_ + m) * (qab + m) * x_ / ((a_ + m2) * (qap + m2))
            d = 1 + aa * d
            d = 1 / (tiny if abs(d) < tiny else d)
            c = 1 + aa / c
            c = tiny if abs(c) < tiny else c
            delta = d * c
            h *= delta
            if abs(delta - 1) < 1e-16:
                break
        return h

    if x < (a + 1) / (a + b + 2):
        return front * cf(a, b, x) / a
    return 1 - front * cf(b, a, 1 - x) / b


def chi2_p_value(chi2: Column, d: Column) -> Column:
    """P(X >= chi2) for X ~ chi-square with d - 1 degrees of freedom (goodness of fit to
    the mean over d periods)."""

    @F.pandas_udf("double")
    def sf(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([float("nan") if (pd.isna(v) or pd.isna(n) or n < 2) else _gamma_q((n - 1) / 2, v / 2)
                          for v, n in zip(x, k)])

    return sf(chi2, d)


def slope_p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of an OLS slope from the correlation r over n points
    (t = r sqrt((n-2) / (1-r^2)), Student t with n - 2 degrees of freedom)."""

    @F.pandas_udf("double")
    def p(rs: pd.Series, ns: pd.Series) -> pd.Series:
        out = []
        for rv, nv in zip(rs, ns):
            df = nv - 2
            if pd.isna(rv) or pd.isna(nv) or df <= 0:
                out.append(float("nan"))
            elif abs(rv) >= 1:
                out.append(0.0)
            else:
                t2 = rv * rv * df / (1 - rv * rv)
                out.append(_beta_i(df / 2, 0.5, df / (df + t2)))
        return pd.Series(out)

    return p(r, n)


def goodness_of_fit(counts: DataFrame, periods: DataFrame, key: str = "year", with_p: bool = False) -> DataFrame:
    """Per token, distance of its distribution over the completed periods from
    uniform. Zero cells are accounted for analytically (d = number of periods), so no
    token x period grid is materialised.

    counts: (token, key, n) non-zero cells; periods: one row per period (column key).
    Columns: l2_norm (scaled), chi2 (to the mean), emd (to the mean), entropy (relative
    entropy to uniform, normalised), kld (to the mean, 1e-5 smoothing); with `with_p`
    also chi2_p (chi-square survival function, d - 1 degrees of freedom)."""
    sp = _period_spine_stats(periods, key).select("d")
    g = counts.groupBy("token").agg(F.sum("n").cast("double").alias("s"),
                                    F.sum(F.col("n") * F.col("n")).cast("double").alias("ss"),
                                    F.count(F.lit(1)).cast("double").alias("nnz"),
                                    F.collect_list(F.col("n").cast("double")).alias("_vals"))
    g = with_scalars(g, sp)
    d, s, ss, nnz = F.col("d"), F.col("s"), F.col("ss"), F.col("nnz")
    mean = s / d
    l2 = F.sqrt(ss)
    l2s = F.try_divide(l2 * F.sqrt(d) - 1, F.sqrt(d) - 1)
    chi2 = F.try_divide(ss - 2 * mean * s + d * mean * mean, mean)
    abs_dev = F.aggregate("_vals", F.lit(0.0), lambda acc, v: acc + F.abs(v - mean))
    emd = (abs_dev + (d - nnz) * mean) / d
    plogp = F.aggregate("_vals", F.lit(0.0), lambda acc, v: acc + (v / s) * F.ln(v / s))
    ent = plogp + F.ln(d)
    e = KLD_EPSILON
    kld_nz = F.aggregate("_vals", F.lit(0.0), lambda acc, v: acc + (v + e) * F.ln((v + e) / (mean + e)))
    kld = kld_nz + (d - nnz) * e * F.ln(F.lit(e) / (mean + e))
    out = g.select("token", l2s.alias("l2_norm"), chi2.alias("chi2"), emd.alias("emd"), ent.alias("entropy"),
                   kld.alias("kld"), d.alias("_d"))
    if with_p:
        out = out.withColumn("chi2_p", chi2_p_value(F.col("chi2"), F.col("_d")))
    return out.drop("_d")


def fit_trends(counts: DataFrame, periods: DataFrame, key: str = "year", with_p: bool = False) -> DataFrame:
    """Ordinary least squares of counts over the periods (zeros included) per token:
    intercept, slope, corr, and the fitted end points. Sums over zero cells are known
    from the period spine, so only non-zero cells are aggregated."""
    sp = _period_spine_stats(periods, key)
    g = counts.groupBy("token").agg(F.sum(F.col("n").cast("double")).alias("sy"),
                                    F.sum(F.col("n").cast("double") * F.col(key)).alias("sxy"),
                                    F.sum(F.col("n").cast("double") ** 2).alias("syy"))
    g = with_scalars(g, sp)
    d, sx, sxx, sy, sxy, syy = (F.col(c) for c in ("d", "sx", "sxx", "sy", "sxy", "syy"))
    sxx_c = d * sxx - sx * sx
    slope = F.try_divide(d * sxy - sx * sy, sxx_c)
    intercept = (sy - slope * sx) / d
    corr = F.try_divide(d * sxy - sx * sy, F.sqrt(sxx_c * (d * syy - sy * sy)))
    out = g.select("token", intercept.alias("intercept"), slope.alias("slope"), corr.alias("corr"),
                   F.col("x1"), F.col("x2"), (intercept + slope * F.col("x1")).alias("y1"),
                   (intercept + slope * F.col("x2")).alias("y2"), d.alias("_d"))
    if with_p:
        out = out.withColumn("p", slope_p_value(F.col("corr"), F.col("_d")))
    return out.drop("_d")


def fit_polynomial(counts: DataFrame, periods: Sequence[int], key: str = "year", deg: int = 2) -> DataFrame:
    """M09 degree > 1: least squares over the completed period list (a short, fixed list: one value per
    period) by normal equations: the periods' side is one small matrix, so a token's coefficients are sums
    over its non-zero cells. (token, coefficients), highest degree first; fewer periods than
    coefficients raise an error."""
    xs = np.asarray(sorted(set(periods)), dtype=np.float64)
    if len(xs) <= deg:
        raise ValueError("more periods than the degree are needed")
    centre, scale = xs.mean(), max(np.abs(xs - xs.mean()).max(), 1e-300)
    powers = np.vander((xs - centre) / scale, deg + 1, increasing=True)
    inverse = np.linalg.inv(powers.T @ powers)
    # back from powers of (x - centre) / scale to powers of x
    raw = np.zeros((deg + 1, deg + 1))
    for j in range(deg + 1):
        for i, c in enumerate(np.atleast_1d(np.polynomial.polynomial.polypow([-centre / scale, 1 / scale], j)) if j else [1.0]):
            raw[i, j] = c
    solve = raw @ inverse
    u = (F.col(key).cast("double") - float(centre)) / float(scale)
    y = F.col("n").cast("double")
    sums = counts.where(F.col(key).isin([int(x) for x in xs])).groupBy("token").agg(*[F.sum(y * u ** j).alias(f"_s{j}") for j in range(deg + 1)])
    rows = [sum((F.col(f"_s{j}") * float(solve[i, j]) for j in range(deg + 1)), F.lit(0.0)) for i in reversed(range(deg + 1))]
    return sums.select("token", F.array(*rows).alias("coefficients"))
