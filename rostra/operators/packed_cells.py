"""Cells of a DTM and pairs of tokens packed for a shuffle.

A join of all cells sends a row a cell: the token as text with each of them, and eight bytes for every number and
header. Packed, the cells of one document, or of one bucket of tokens, that a task reads in one step are one row
with a compressed record batch; what is equal is found where the rows of both sides meet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .indexes import _alike, _coded

# Bytes of cells that a task packs at once.
_STEP_BYTES = 64 * 1024 ** 2
# Buckets of a token's hash; a bucket's words are held by one task.
_BUCKETS = 1024
# Cells that are passed on at once (a longer document by itself).
_OUT = 1 << 16


def _steps(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of batches of about `limit` bytes, each as one batch."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _squeezed(cells: DataFrame, key: str, step_bytes: int, by: str | None = None) -> DataFrame:
    """(key, size, cells): the cells of a step with the same key are one row, without a shuffle, their other columns one
    compressed record batch (equal values of `by` together). A key has as many rows as steps that hold it."""
    rest = [c for c in cells.columns if c != key]

    def run(batches):
        for b in _steps(batches, step_bytes):
            group = _alike(b, [key])
            heads, sizes = np.unique(group, return_counts=True)
            order = np.argsort(group, kind="stable") if by is None else np.lexsort((_coded(b.column(by))[1], group))
            there = b.select(rest).take(pa.array(order))
            ends = np.cumsum(sizes)
            raw = [there.slice(hi - n, n).serialize() for hi, n in zip(ends.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(heads)), pa.array([r.size for r in raw], pa.int64()),
                                              pa.array([pa.compress(r, "zstd", asbytes=True) for r in raw], pa.binary())], names=[key, "size", "cells"])
    return cells.mapInArrow(run, T.StructType([cells.schema[key], T.StructField("size", T.LongType()), T.StructField("cells", T.BinaryType())]))


def _batch(size: int, raw: bytes, schema: pa.Schema) -> pa.RecordBatch:
    return pa.ipc.read_record_batch(pa.decompress(raw, size, "zstd"), schema)


def _arrow(df: DataFrame, columns: Sequence[str]) -> pa.Schema:
    return to_arrow_schema(T.StructType([df.schema[c] for c in columns]))


def _one(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from pa.Table.from_batches(batches).combine_chunks().to_batches()


def held_cells(cells: DataFrame, other: DataFrame, key: str = "document_id", item: str = "token",
               step_bytes: int = _STEP_BYTES) -> DataFrame:
    """The cells whose (key, item) is a row of `other`, as a left semi join returns them. Both sides are sent by key, compressed,
    and compared within it; a key's items in `other` are in memory at once."""
    both = F.col(key).isNotNull() & F.col(item).isNotNull()
    rest = [c for c in cells.columns if c not in (key, item)]
    schema = T.StructType([cells.schema[c] for c in (key, item, *rest)])
    mine, theirs = _arrow(cells, [item, *rest]), _arrow(other, [item])
    there = _squeezed(other.where(both).select(key, item), key, step_bytes) \
        .groupBy(key).agg(F.collect_list(F.struct("size", "cells")).alias("there"))
    rows = _squeezed(cells.where(both).select(key, item, *rest), key, step_bytes).join(there, key)

    def run(batches):
        for b in batches:
            held, at, n = [], [], 0
            for i in range(b.num_rows):
                one = _batch(b.column("size")[i].as_py(), b.column("cells")[i].as_py(), mine)
                have = pa.concat_arrays([_batch(x["size"], x["cells"], theirs).column(0) for x in b.column("there")[i].as_py()])
                held.append(one.filter(pc.is_in(one.column(0), value_set=have)))
                at.append(np.full(held[-1].num_rows, i))
                n += held[-1].num_rows
                if n >= _OUT or i + 1 == b.num_rows:
                    for out in pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=max(n, 1)):
                        yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(np.concatenate(at))), *out.columns], names=schema.names)
                    held, at, n = [], [], 0
    return rows.select(key, "size", "cells", "there").mapInArrow(run, schema)


def cells_with_ids(cells: DataFrame, words: DataFrame, item: str | Sequence[str] = "token", value: str = "token_id",
                   step_bytes: int = _STEP_BYTES) -> DataFrame:
    """The inner join of cells with words (item, value) on the item, or on several (pairs of tokens). Both sides are sent by buckets of
    the first item's hash, compressed, a bucket's words before its cells, which then pass one step at a time; a bucket's words are in
    memory at once."""
    items = [item] if isinstance(item, str) else list(item)
    rest = [c for c in cells.columns if c not in items]
    schema = T.StructType([*[cells.schema[c] for c in (*items, *rest)], words.schema[value]])
    mine, theirs = _arrow(cells, [*items, *rest]), _arrow(words, [*items, value])
    known = reduce(Column.__and__, [F.col(i).isNotNull() for i in items])
    sides = [_squeezed(df.where(known).select(_bucket(items[0]), *items, *columns), "_bucket", step_bytes, items[0]).withColumn("side", F.lit(k))
             for k, (df, columns) in enumerate(((words, [value]), (cells, rest)))]
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sides[0].unionByName(sides[1]).repartition(parts, "_bucket").sortWithinPartitions("_bucket", "side")

    def run(batches):
        at, held, names = None, [], None
        for b in batches:
            out, n = [], 0
            for i, (key, side) in enumerate(zip(b.column("_bucket").to_pylist(), b.column("side").to_pylist())):
                if key != at:
                    at, held, names = key, [], None
                one = _batch(b.column("size")[i].as_py(), b.column("cells")[i].as_py(), mine if side else theirs)
                if not side:
                    held.append(one)
                    continue
                if not held:
                    continue
                if names is None:  # a word that comes twice has all its values
                    coded = [_coded(pa.concat_arrays([w.column(k) for w in held])) for k in range(len(items))]
                    names = [x for x, _ in coded]
                    words_at, code = np.unique(_joined([c for _, c in coded], names), return_inverse=True)
                    ids = pa.concat_arrays([w.column(len(items)) for w in held]).take(pa.array(np.argsort(code, kind="stable")))
                    count = np.bincount(code, minlength=len(words_at))
                    start = np.cumsum(count) - count
                place = [pc.index_in(one.column(k), value_set=x) for k, x in enumerate(names)]
                there = np.logical_and.reduce([x.is_valid().to_numpy(zero_copy_only=False) for x in place])
                asked = _joined([pc.fill_null(x, 0).to_numpy().astype(np.int64) for x in place], names)
                found = np.minimum(np.searchsorted(words_at, asked), len(words_at) - 1)
                hit = np.flatnonzero(there & (words_at[found] == asked))
                found = found[hit]
                times = count[found]
                cell = pa.array(np.repeat(hit, times))
                which = np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(start[found], times)
                out.append(pa.RecordBatch.from_arrays([*one.take(cell).columns, ids.take(pa.array(which))], names=schema.names))
                n += len(cell)
                if n >= _OUT:
                    yield from _one(out)
                    out, n = [], 0
            if out:
                yield from _one(out)
    return rows.select("_bucket", "side", "size", "cells").mapInArrow(run, schema)


def _bucket(item: str) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(_BUCKETS)).alias("_bucket")


def _joined(codes: Sequence[np.ndarray], names: Sequence[pa.Array]) -> np.ndarray:
    """One number for the codes of each row's items."""
    return reduce(lambda a, k: a * len(names[k]) + codes[k], range(1, len(codes)), codes[0])


def distinct_lists(pairs: DataFrame, first: str = "w1", second: str = "w2", step_bytes: int = _STEP_BYTES) -> DataFrame:
    """(first, second): a row for each value of `first` with the distinct values of `second` beside it, ascending. Pairs that come twice
    in a step are sent once, all of them compressed by buckets of the first value; a bucket's pairs are in memory at once."""
    schema = T.StructType([pairs.schema[first], T.StructField(second, T.ArrayType(pairs.schema[second].dataType))])
    there = _arrow(pairs, [first, second])

    def once(b: pa.RecordBatch) -> pa.RecordBatch:
        """The distinct pairs, in order."""
        coded = [_coded(c) for c in b.columns]
        order = [pc.sort_indices(names).to_numpy() for names, _ in coded]
        rank = [np.argsort(o)[code] for o, (_, code) in zip(order, coded)]
        key = np.unique(rank[0] * len(order[1]) + rank[1])
        a, c = key // len(order[1]), key % len(order[1])
        return pa.RecordBatch.from_arrays([names.take(pa.array(o[x])) for (names, _), o, x in zip(coded, order, (a, c))], names=b.schema.names)

    def sent(batches):
        for b in _steps(batches, step_bytes):
            yield once(b)

    def run(batches):
        at, held = None, []

        def lists():
            b = once(next(_one(held)))
            _, start = np.unique(_coded(b.column(0))[1], return_index=True)
            ends = np.append(start, b.num_rows).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(start)), pa.ListArray.from_arrays(pa.array(ends), b.column(1))], names=schema.names)
        for b in batches:
            for i, key in enumerate(b.column("_bucket").to_pylist()):
                if key != at and held:
                    yield from lists()
                    held = []
                at = key
                held.append(_batch(b.column("size")[i].as_py(), b.column("cells")[i].as_py(), there))
        if held:
            yield from lists()
    some = pairs.select(first, second).where(F.col(first).isNotNull() & F.col(second).isNotNull())
    rows = _squeezed(some.mapInArrow(sent, some.schema).select(_bucket(first), first, second), "_bucket", step_bytes, first)
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "_bucket").sortWithinPartitions("_bucket").select("_bucket", "size", "cells").mapInArrow(run, schema)
