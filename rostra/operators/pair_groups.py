"""Co-occurrence by pivots (M05, J13, M07): pair sums that end inside a task.

A document's tokens are shuffled by its pivots, its pairs are not: the pairs of one group of pivots are summed where its
documents meet. A group of more than `BLOCK_PAIRS` pairs is dealt over several blocks; a pair belongs to
the block of its first token, and a block gets the documents that hold one of its tokens. What the pairs'
tokens need (word counts, row sums) goes with the documents of a group, so that no pair is joined afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import BROADCAST_ROW_LIMIT, bounded_broadcast, stored
from .pair_tiles import _OUT, _cells, _named, _order, _runs
from .pair_tiles import _steps as _token_steps

# Pairs, as documents hold them, that a block has; pairs that a task sums at once; pairs of a task.
BLOCK_PAIRS = 8_000_000
CHUNK = 2_000_000
TASK_PAIRS = 8_000_000
STEP_TOKENS = 500_000
_MAX_TASKS = 4096


def row_sums(docs: DataFrame, pivots: Sequence[str]) -> DataFrame:
    """(pivots..., token, value): the pairs' sums by first token, of documents (pivots..., toks, ns) and without their pairs:
    a token counts with all tokens behind it."""
    schema = T.StructType([*[docs.schema[p] for p in pivots], T.StructField("token", T.StringType()), T.StructField("value", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _token_steps(batches, STEP_TOKENS):
            names, doc, rank, weight = _ranked(b)
            if not len(doc):
                continue
            upto = np.cumsum(weight)
            last = np.searchsorted(doc, doc, "right") - 1
            row = pa.array(doc)
            yield pa.RecordBatch.from_arrays([*[b.column(p).take(row) for p in pivots], names.take(pa.array(rank)),
                                              pa.array(weight * (upto[last] - upto))], names=schema.names)
    cells = docs.select(*pivots, "toks", "ns").mapInArrow(run, schema)
    return cells.groupBy(*pivots, "token").agg(F.sum("value").alias("value"))


def _ranked(b: pa.RecordBatch) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """(names in code point order, document, name's number, weight), by document and name."""
    names, doc, code, weight = _cells(b.column("toks"), b.column("ns"))
    order = pc.sort_indices(names).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    by = np.lexsort((rank[code], doc))
    return names.take(pa.array(order)), doc[by], rank[code][by], weight[by]


def _same(pivots: Sequence[str]) -> Column:
    """Equal pivots of "l" and "r"; nulls are equal."""
    out = F.lit(True)
    for p in pivots:
        out = out & F.col(f"l.{p}").eqNullSafe(F.col(f"r.{p}"))
    return out


def pair_sums(docs: DataFrame, pivots: Sequence[str], counts: DataFrame | None = None, block_pairs: int = BLOCK_PAIRS,
              chunk: int = CHUNK, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """(pivots..., w1, w2, n) with w1 < w2 of documents (pivots..., toks, ns), a row each; `ns` null: every token counts once.
    With `counts` (pivots..., token, value), one row a token of a group, also value_1 and value_2, its values of the pair's tokens
    (null: none), and total, the group's sum."""
    pv = list(pivots)
    docs = stored(docs.select(*pv, "toks", "ns").where(F.size("toks") > 1))  # read for the groups' sizes and to be dealt
    k = F.size(F.array_distinct("toks")).cast("double")
    need = stored(docs.groupBy(*pv).agg(F.sum(k * (k - 1) / 2).alias("pairs")))
    pairs = need.agg(F.sum("pairs").alias("n")).first()["n"] or 0
    tasks = int(min(_MAX_TASKS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // task_pairs))))
    large = need.where(F.col("pairs") > block_pairs).select(*pv, F.ceil(F.col("pairs") / block_pairs).cast("int").alias("_nb"))
    large = bounded_broadcast(large, BROADCAST_ROW_LIMIT)

    def with_blocks(rows: DataFrame) -> DataFrame:
        joined = rows.alias("l").join(large.alias("r"), _same(pv), "left")
        return joined.select(*[F.col(f"l.{c}").alias(c) for c in rows.columns], F.coalesce("r._nb", F.lit(1)).alias("_nb"))

    def dealt(rows: DataFrame, kind: int, owners: Column) -> DataFrame:
        rows = rows.withColumn("own", F.when(F.col("_nb") > 1, owners)).withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
        if kind:
            rows = rows.where(F.col("own").isNull() | F.array_contains("own", F.col("blk")))
        return rows.select(*pv, "blk", F.lit(kind).alias("kind"), "toks", "ns", "own")

    owner = lambda t: F.pmod(F.xxhash64(t), F.col("_nb")).cast("int")
    rows = dealt(with_blocks(docs), 1, F.transform("toks", owner))
    if counts is not None:
        known = with_blocks(counts.where("token IS NOT NULL").select(*pv, "token", F.col("value").cast("double").alias("value")))
        # a row a group, or as many as it has blocks
        known = known.groupBy(*pv, "_nb", owner(F.col("token")).alias("_at")).agg(F.collect_list(F.struct("token", "value")).alias("c"))
        known = known.select(*pv, "_nb", F.col("c.token").alias("toks"), F.col("c.value").alias("ns"))
        rows = dealt(known, 0, F.lit(None).cast("array<int>")).unionByName(rows)
    fields = [*[docs.schema[p] for p in pv], T.StructField("w1", T.StringType()), T.StructField("w2", T.StringType()), T.StructField("n", T.DoubleType())]
    if counts is not None:
        fields += [T.StructField(c, T.DoubleType()) for c in ("value_1", "value_2", "total")]
    schema, with_values = T.StructType(fields), counts is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sums(batches, pv, schema.names, with_values, chunk)
    return rows.repartition(tasks, *pv, "blk").sortWithinPartitions(*pv, "blk", "kind").mapInArrow(run, schema)


class _Group:
    """A group that reaches beyond a step: its names, its values and its pairs so far."""

    def __init__(self, key: tuple, row: list[pa.Array], chunk: int):
        self.key, self.row, self.chunk = key, row, chunk
        self.known: dict[str, int] = {}
        self.values: dict[str, float] = {}
        self.pairs: list[np.ndarray] = []
        self.sums: list[np.ndarray] = []
        self.held = 0

    def add(self, names: pa.Array, first: np.ndarray, second: np.ndarray, n: np.ndarray) -> None:
        used, at = np.unique(np.concatenate([first, second]), return_inverse=True)
        number = np.array([self.known.setdefault(t, len(self.known)) for t in names.take(pa.array(used)).to_pylist()], np.int64)[at]
        a, b = number[:len(first)], number[len(first):]
        self.pairs.append(np.minimum(a, b) << 32 | np.maximum(a, b))
        self.sums.append(n)
        self.held += len(n)
        if self.held > self.chunk:
            self.merge()
            self.held = 0  # a block's distinct pairs stay, new ones come on top

    def merge(self) -> None:
        pair, at = np.unique(np.concatenate(self.pairs), return_inverse=True)
        self.pairs, self.sums = [pair], [np.bincount(at, np.concatenate(self.sums), len(pair))]

    def batches(self, columns: Sequence[str], with_values: bool) -> Iterator[pa.RecordBatch]:
        if not self.pairs:
            return
        self.merge()
        words, order = _order(list(self.known))
        total = float(sum(v for v in self.values.values() if v is not None))
        for lo in range(0, len(self.pairs[0]), _OUT):
            p = self.pairs[0][lo:lo + _OUT]
            got = _named(words, order, p >> 32, p & 0xFFFFFFFF, self.sums[0][lo:lo + _OUT])
            out = [*[v.take(pa.array(np.zeros(len(p), np.int64))) for v in self.row], *got.columns]
            if with_values:
                values = pa.array([self.values.get(w) for w in self.known], pa.float64())
                swap = order[p >> 32] > order[p & 0xFFFFFFFF]
                out += [values.take(pa.array(np.where(swap, p & 0xFFFFFFFF, p >> 32))), values.take(pa.array(np.where(swap, p >> 32, p & 0xFFFFFFFF))),
                        pa.array(np.full(len(p), total))]
            yield pa.RecordBatch.from_arrays(out, names=list(columns))


def _row_steps(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most `chunk` pairs and STEP_TOKENS tokens (a longer row by itself)."""
    for b in _token_steps(batches, STEP_TOKENS):
        size = pc.list_value_length(b.column("toks")).to_numpy(zero_copy_only=False).astype(np.int64)
        size = np.where(b.column("kind").to_numpy() == 1, size * (size - 1) // 2, 0)
        ends, lo = np.cumsum(size), 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + chunk, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def _pairs(doc: np.ndarray, rank: np.ndarray, weight: np.ndarray, owned: np.ndarray, group: np.ndarray, k: int, chunk: int):
    """(group, first, second, sum) of the pairs whose first token is owned, summed by chunks; cells by document and name."""
    ends = np.searchsorted(doc, doc, "right")
    at = np.flatnonzero(owned)
    behind = ends[at] - at - 1
    cut = np.searchsorted(np.cumsum(behind), np.arange(chunk, int(behind.sum()) + chunk, chunk), "left") + 1
    for lo, hi in zip([0, *cut[:-1]], cut):
        one, n = at[lo:hi], behind[lo:hi]
        other = _runs(one + 1, n)
        one = np.repeat(one, n)
        cell, where = np.unique((group[doc[one]] * k + rank[one]) * k + rank[other], return_inverse=True)
        pair = cell % (k * k)
        yield cell // (k * k), pair // k, pair % k, np.bincount(where, weight[one] * weight[other], len(cell))


def _sums(batches: Iterator[pa.RecordBatch], pivots: list[str], columns: Sequence[str], with_values: bool, chunk: int) -> Iterator[pa.RecordBatch]:
    """The pairs of the groups of one task; rows by group, a group's values before its documents."""
    held: _Group | None = None
    for b in _row_steps(batches, chunk):
        keys = list(zip(*[_comparable(b.column(c)) for c in (*pivots, "blk")]))
        starts = np.array([i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]])
        group = np.repeat(np.arange(len(starts)), np.diff([*starts, len(keys)]))
        if held is not None and held.key != keys[0]:
            yield from held.batches(columns, with_values)
            held = None
        if held is None and len(starts) == 1:
            held = _Group(keys[0], [b.column(p).take(pa.array([0])) for p in pivots], chunk)
        joined = held is not None  # the step's first group is held's
        last = len(starts) - 1
        new = held if last == 0 else _Group(keys[-1], [b.column(p).take(pa.array([len(keys) - 1])) for p in pivots], chunk)
        beyond = ({0: held} if joined else {}) | {last: new}
        whole = np.ones(len(starts), bool)
        whole[-1], whole[0] = False, last > 0 and not joined
        kind = b.column("kind").to_numpy()
        at = pa.array(np.flatnonzero(kind == 1))
        rows, of = b.take(at), group[kind == 1]
        names, doc, rank, weight = _ranked(rows) if len(rows) else (pa.array([], pa.string()), *[np.zeros(0, np.int64)] * 3)
        k = max(len(names), 1)
        owned = _owned(rows, names, doc, rank)
        if with_values:
            facts = b.take(pa.array(np.flatnonzero(kind == 0)))
            lists = pa.concat_arrays([facts.column("toks")])
            tokens, value = lists.flatten(), pa.concat_arrays([facts.column("ns")]).flatten()
            of_value = group[kind == 0][pc.list_parent_indices(lists).to_numpy()]
            for g, h in beyond.items():
                mine = pa.array(of_value == g)
                h.values.update(zip(tokens.filter(mine).to_pylist(), value.filter(mine).to_pylist()))
            totals = np.bincount(of_value, pc.fill_null(value, 0.0).to_numpy(), len(starts)) if len(of_value) else np.zeros(len(starts))
            code = pc.fill_null(pc.index_in(tokens, value_set=names), -1).to_numpy().astype(np.int64)
            use = np.flatnonzero(code >= 0)
            use = use[np.argsort(of_value[use] * k + code[use])]
            cells, value = of_value[use] * k + code[use], value.take(pa.array(use))

            def value_of(g: np.ndarray, token: np.ndarray) -> pa.Array:
                want = g * k + token
                place = np.searchsorted(cells, want)
                hit = place < len(cells)
                hit[hit] = cells[place[hit]] == want[hit]
                return value.take(pa.array(np.where(hit, place, 0), mask=~hit))
        # whole groups are summed together, documents in as many steps as a chunk needs
        inside = whole[of[doc]] if len(doc) else np.zeros(0, bool)
        parts = list(_pairs(doc[inside], rank[inside], weight[inside], owned[inside], of, k, 2 * chunk))
        if parts:
            g, first, second, n = (np.concatenate(x) for x in zip(*parts))
            if len(parts) > 1:
                cell, where = np.unique((g * k + first) * k + second, return_inverse=True)
                g, first, second, n = cell // (k * k), cell % (k * k) // k, cell % k, np.bincount(where, n, len(cell))
            for lo in range(0, len(g), _OUT):
                s = slice(lo, lo + _OUT)
                row = pa.array(starts[g[s]])
                out = [*[b.column(p).take(row) for p in pivots], names.take(pa.array(first[s])), names.take(pa.array(second[s])), pa.array(n[s], pa.float64())]
                if with_values:
                    out += [value_of(g[s], first[s]), value_of(g[s], second[s]), pa.array(totals[g[s]])]
                yield pa.RecordBatch.from_arrays(out, names=list(columns))
        for g, h in beyond.items():
            mine = of[doc] == g if len(doc) else np.zeros(0, bool)
            for _, first, second, n in _pairs(doc[mine], rank[mine], weight[mine], owned[mine], of, k, chunk):
                h.add(names, first, second, n)
        if held is not None and new is not held:
            yield from held.batches(columns, with_values)
        held = new
    if held is not None:
        yield from held.batches(columns, with_values)


def _comparable(column: pa.Array) -> list:
    """A column's values, NaN equal to itself."""
    values = column.to_pylist()
    return ["NaN" if v != v else v for v in values] if pa.types.is_floating(column.type) else values


def _owned(rows: pa.RecordBatch, names: pa.Array, doc: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which cells are first tokens of this block's pairs."""
    owned = np.ones(len(doc), bool)
    some = np.flatnonzero(rows.column("own").is_valid().to_numpy(zero_copy_only=False))
    if len(some):
        part = rows.take(pa.array(some))
        lists = pa.concat_arrays([part.column("own")])
        row = pc.list_parent_indices(lists).to_numpy()
        token = pc.index_in(pa.concat_arrays([part.column("toks")]).flatten(), value_set=names).to_numpy()
        mine = lists.flatten().to_numpy() == part.column("blk").to_numpy()[row]
        k = max(len(names), 1)
        cells = np.unique(some[row[mine]] * k + token[mine])
        owned = np.isin(doc * k + rank, cells) | ~np.isin(doc, some)
    return owned
