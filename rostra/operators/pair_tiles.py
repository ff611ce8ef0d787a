"""Co-occurrence (J12) as a tiled product: pair sums that end inside a task.

D'D over documents x tokens is cut into tiles, and a document is sent to the tiles that need
it, as codes into a short list of names. A pair of tokens belongs to exactly one tile, so its
sum is never shuffled; what is shuffled are documents, a few times each.

* Heavy tokens, in at least `theta` documents, are at most `HEAVY` (theta is the documents'
  tokens over HEAVY, so the list has a fixed bound). Pairs of two heavy tokens are summed in
  dense blocks of `SIDE` x `SIDE`, one for each pair of sides; the documents of a block are
  dealt over as many tasks as its products need, and the tasks' blocks are added.
* All other pairs belong to their light token (of two light ones, to that with the smaller
  hash). Light tokens are dealt into `lists` by hash; a list gets each document that
  holds one of its tokens, with all tokens that pair there. A light token has fewer than theta
  documents, so no list grows with the corpus; their number does (`LIST_PAIRS` each).

A dealt row holds a step's cells for one tile: heavy tokens by their numbers, light ones by numbers into the
row's names, two bytes a code and one a count where they fit. Rows go straight into the shuffle by tile:
read back from files, thousands of such wide rows would be decoded at once.

With margins, a token's row sum goes with its name into the tiles (`with_row_sums`), so that no pair is stored or joined.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored, with_scalars

HEAVY = 8192
LEAST_THETA = 64
SIDE = 2048
LIST_PAIRS = 3_000_000
BLOCK_PAIRS = 200_000_000
STEP_TOKENS = 500_000
CHUNK = 2_000_000  # pairs that a list's task sums at once
_OUT = 1 << 18  # pairs that a task returns in one batch
_PAIRS, _MARGINS = "w1 string, w2 string, n double", ", zr_i double, zr_j double"
_ROWS = "tile long, part long, names binary, lengths binary, codes binary, weights binary, sizes binary, owned binary, values binary"


def _text(names: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The names' sizes in bytes and their bytes in a row."""
    ends = np.frombuffer(names.buffers()[1], np.int32)[names.offset:names.offset + len(names) + 1] if len(names) else np.zeros(1, np.int32)
    data = names.buffers()[2]
    return np.diff(ends), np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)


def _hash(names: pa.StringArray) -> np.ndarray:
    """Fixed 64-bit hashes of some names."""
    size, data = _text(names)
    size, data = size.astype(np.int64), data.astype(np.uint64)
    place = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
    mixed = _mix(data + (place.astype(np.uint64) << np.uint64(8)))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
    ends = np.cumsum(size)
    return _mix(sums[ends] - sums[ends - size])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cells(toks: pa.ListArray, ns: pa.ListArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, document, name's number, weight) of the distinct tokens of each document."""
    rows = pc.list_parent_indices(toks).to_numpy()
    coded = toks.flatten().dictionary_encode()
    names = coded.dictionary
    weights = ns.flatten().to_numpy() if ns.null_count == 0 else np.ones(len(rows))
    cell, at = np.unique(rows * max(len(names), 1) + coded.indices.to_numpy(), return_inverse=True)
    return names, cell // max(len(names), 1), cell % max(len(names), 1), np.bincount(at, weights, len(cell))


def _steps(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about `limit` tokens (a longer document is one by itself)."""
    for b in batches:
        sizes = pc.fill_null(pc.list_value_length(b.column("toks")), 0).to_numpy(zero_copy_only=False)
        ends, lo = np.cumsum(sizes), 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each run."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _ranks(names: pa.StringArray, heavy: pa.StringArray) -> np.ndarray:
    """The names' places in the list of heavy tokens; -1: a light one."""
    return pc.fill_null(pc.index_in(names, value_set=heavy), -1).to_numpy().astype(np.int64)


def _least(x: np.ndarray, kind: type, wide: type) -> bytes:
    """Numbers in a narrow type that holds them all, else in the wide one; the reader tells by the size."""
    narrow = x.astype(kind)
    return (narrow if (narrow == x).all() else x.astype(wide)).tobytes()


def _dealt(batch: pa.RecordBatch, heavy: pa.StringArray, lists: int, parts: np.ndarray, salt: int, side_tokens: int,
           light: bool) -> Iterator[tuple]:
    """Rows of _ROWS: the step's documents for each list, or for each block, that needs them."""
    names, doc, code, weight = _cells(batch.column("toks"), batch.column("ns"))
    if not len(doc):
        return
    rank = _ranks(names, heavy)
    value = None
    if "zs" in batch.schema.names:  # a token's value is the same in each document
        first = batch.column("toks").flatten().dictionary_encode().indices.to_numpy()
        value = np.zeros(len(names))
        value[first] = batch.column("zs").flatten().to_numpy()

    def row(tile: int, part: int, cells: np.ndarray, owned: np.ndarray) -> tuple:
        _, size = np.unique(doc[cells], return_counts=True)
        codes = rank[code[cells]]
        own = codes < 0
        used, at = np.unique(code[cells][own], return_inverse=True)
        codes[own] = len(heavy) + at
        lengths, text = _text(names.take(pa.array(used)))
        return (tile, part, text.tobytes(), lengths.astype(np.int32).tobytes(), _least(codes, np.uint16, np.int32),
                _least(weight[cells], np.uint8, np.float64), size.astype(np.int32).tobytes(), np.packbits(owned).tobytes(),
                b"" if value is None else _least(value[used], np.uint32, np.float64))
    if light:  # within a document by hash, so that what pairs with a token follows it
        some = np.flatnonzero(rank[code] < 0)
        if not len(some):
            return
        place = _hash(names) >> np.uint64(1)
        place[rank >= 0] = np.iinfo(np.uint64).max  # heavy tokens pair with every light one
        by_doc = np.lexsort((code, place[code], doc))
        bounds = np.searchsorted(doc[by_doc], np.arange(doc[-1] + 2))
        mine = place[code] % np.uint64(lists)
        key = np.unique(mine[some].astype(np.int64) * (doc[-1] + 1) + doc[some])
        where, who = key // (doc[-1] + 1), key % (doc[-1] + 1)
        tiles, starts = np.unique(where, return_index=True)
        for tile, lo, hi in zip(tiles, starts, [*starts[1:], len(who)]):
            docs = who[lo:hi]
            cells = by_doc[_runs(bounds[docs], bounds[docs + 1] - bounds[docs])]
            owned = (rank[code[cells]] < 0) & (mine[cells] == np.uint64(tile))
            first = np.full(len(bounds), np.iinfo(np.int64).max)  # nothing before a document's first owned token pairs here
            at = np.flatnonzero(owned)
            np.minimum.at(first, doc[cells[at]], at)
            keep = np.arange(len(cells)) >= first[doc[cells]]
            yield row(int(tile), 0, cells[keep], owned[keep])
        return
    # blocks: tokens of the two sides
    sides = -(-len(heavy) // side_tokens)
    side = np.where(rank[code] >= 0, rank[code] // side_tokens, -1)
    for i in range(sides):
        for j in range(i, sides):
            both = np.flatnonzero((side == i) | (side == j))
            if i != j:
                a, b = (np.isin(doc[both], doc[side == s]) for s in (i, j))
                both = both[a & b]
            if len(both):
                tile = i * sides + j
                yield row(-1 - tile, salt % int(parts[tile]), both, np.zeros(len(both), bool))


def _table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])


def _unpacked(b: pa.RecordBatch, i: int):
    raw = {n: b.column(n)[i].as_py() for n in ("names", "lengths", "codes", "weights", "sizes", "owned", "values")}
    size = np.frombuffer(raw["sizes"], np.int32).astype(np.int64)
    n = int(size.sum())
    codes = np.frombuffer(raw["codes"], np.uint16 if len(raw["codes"]) == 2 * n else np.int32).astype(np.int64)
    weight = np.frombuffer(raw["weights"], np.uint8 if len(raw["weights"]) == n else np.float64).astype(np.float64)
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(raw["lengths"], np.int32))]).astype(np.int32)
    names = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw["names"]))
    values = np.frombuffer(raw["values"], np.uint32 if len(raw["values"]) == 4 * len(names) else np.float64).astype(np.float64)
    return names, codes, weight, size, np.unpackbits(np.frombuffer(raw["owned"], np.uint8), count=n).astype(bool), values


def _order(names: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """The names and their places in code point order."""
    words = pa.array(names, pa.string())
    order = np.empty(len(names), np.int64)
    order[pc.sort_indices(words).to_numpy()] = np.arange(len(names))
    return words, order


def _named(words: pa.StringArray, order: np.ndarray, first: np.ndarray, second: np.ndarray, n: np.ndarray,
           values: np.ndarray | None = None) -> pa.RecordBatch:
    """(w1, w2, n), w1 < w2 in code point order; with the words' `values`, also zr_i and zr_j."""
    swap = order[first] > order[second]
    a, b = np.where(swap, second, first), np.where(swap, first, second)
    out = {"w1": words.take(pa.array(a)), "w2": words.take(pa.array(b)), "n": pa.array(n, pa.float64())}
    if values is not None:
        out |= {"zr_i": pa.array(values[a]), "zr_j": pa.array(values[b])}
    return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def _list_sums(batches: Iterator[pa.RecordBatch], heavy: list[str], chunk: int, heavy_values: list[float] | None = None) -> Iterator[pa.RecordBatch]:
    """The pairs of one list: its tokens with those behind them in each document."""
    known: dict[str, int] = {}  # light tokens; their numbers follow the heavy ones'
    value_of: dict[int, float] = {}
    heavy_numbers = np.arange(len(heavy))
    keys, sums, held = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        pair, at = np.unique(np.concatenate(keys), return_inverse=True)
        return pair, np.bincount(at, np.concatenate(sums), len(pair))
    for b in batches:
        for i in range(b.num_rows):
            names, codes, weight, size, owned, values = _unpacked(b, i)
            light = np.array([known.setdefault(n, len(heavy) + len(known)) for n in names.to_pylist()], np.int64)
            value_of.update(zip(light.tolist(), values.tolist()))
            number = np.concatenate([heavy_numbers, light])[codes]
            ends = np.repeat(np.cumsum(size), size)
            at = np.flatnonzero(owned)
            behind = ends[at] - at - 1
            cut = np.searchsorted(np.cumsum(behind), np.arange(chunk, int(behind.sum()) + chunk, chunk), "left") + 1
            for lo, hi in zip([0, *cut[:-1]], cut):
                one, n = at[lo:hi], behind[lo:hi]
                other = _runs(one + 1, n)
                one = np.repeat(one, n)
                low, high = np.minimum(number[one], number[other]), np.maximum(number[one], number[other])
                keys.append(low << 32 | high)
                sums.append(weight[one] * weight[other])
                held += len(one)
                if held > chunk:
                    pair, n = merged()
                    keys, sums = [pair], [n]
                    held = 0  # a list's distinct pairs stay, new ones come on top
    if keys:
        pair, n = merged()
        words, order = _order([*heavy, *known])
        of = None if heavy_values is None else np.array([*heavy_values, *[value_of[k] for k in known.values()]])
        for lo in range(0, len(pair), _OUT):
            p = pair[lo:lo + _OUT]
            yield _named(words, order, p >> 32, p & 0xFFFFFFFF, n[lo:lo + _OUT], of)


def _block_sums(batches: Iterator[pa.RecordBatch], sides: int, side: int) -> Iterator[pa.RecordBatch]:
    """One task's share of a dense block: its cells that aren't zero."""
    total = tile = part = None
    for b in batches:
        for i in range(b.num_rows):
            if total is None:
                tile, part = b.column("tile")[i].as_py(), b.column("part")[i].as_py()
                total = np.zeros((side, side))
            left, right = divmod(-1 - tile, sides)
            _, number, weight, size, *_ = _unpacked(b, i)
            doc = np.repeat(np.arange(len(size)), size)
            step = max(1, (1 << 22) // side)
            for lo in range(0, len(size), step):
                here = (doc >= lo) & (doc < lo + step)
                x = [np.zeros((min(step, len(size) - lo), side)) for _ in range(1 + (left != right))]
                for m, which in zip(x, (left, right)):
                    at = np.flatnonzero(here & (number // side == which))
                    m[doc[at] - lo, number[at] % side] = weight[at]
                total += x[0].T @ x[-1]
    if total is not None:
        full = np.triu(total, 1) if left == right else total
        at = np.flatnonzero(full)
        yield _table("tile long, part long, cells binary, sums binary", [(tile, part, at.astype(np.int32).tobytes(), full.ravel()[at].tobytes())])


def _added(batches: Iterator[pa.RecordBatch], names: list[str], side: int, values: list[float] | None = None) -> Iterator[pa.RecordBatch]:
    """The tasks' shares of one block, added."""
    total = tile = None
    sides = -(-len(names) // side)
    for b in batches:
        for i in range(b.num_rows):
            total = np.zeros(side * side) if total is None else total
            tile = b.column("tile")[i].as_py()
            np.add.at(total, np.frombuffer(b.column("cells")[i].as_py(), np.int32), np.frombuffer(b.column("sums")[i].as_py(), np.float64))
    if total is not None:
        left, right = divmod(-1 - tile, sides)
        at = np.flatnonzero(total)
        words, order = _order(names)
        of = None if values is None else np.array(values)
        for lo in range(0, len(at), _OUT):
            cell = at[lo:lo + _OUT]
            yield _named(words, order, left * side + cell // side, right * side + cell % side, total[cell], of)


def _ordered(batches: Iterator[pa.RecordBatch]):
    return (b for b in batches if b.num_rows)


def heavy_tokens(docs: DataFrame, limit: int = HEAVY, least: int = LEAST_THETA) -> tuple[list[str], int]:
    """Tokens in at least theta documents, most documents first, and theta: at most `limit`, as theta is
    all documents' distinct tokens over the limit."""
    df = stored(docs.select(F.explode(F.array_distinct("toks")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")))
    total = df.agg(F.sum("df").alias("n")).first()["n"] or 0
    theta = max(least, -(-total // limit))
    rows = df.where(F.col("df") >= theta).orderBy(F.desc("df"), "token").collect()  # at most `limit`
    return [r["token"] for r in rows], theta


def with_row_sums(docs: DataFrame, step_tokens: int = STEP_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Documents (toks, ns) with `zs`, the row sums of their distinct tokens: a token's sum over its pairs with later tokens. And the
    row sums (token, value). Cells meet their token's sum by buckets of tokens and their document again; pairs aren't needed."""
    from .packed_cells import cells_with_ids
    from .pair_groups import row_sums

    docs = stored(docs.select(F.monotonically_increasing_id().alias("row"), "toks", "ns"))
    sums = stored(row_sums(docs, []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _steps(batches, step_tokens):
            names, doc, code, weight = _cells(b.column("toks"), b.column("ns"))
            if len(doc):
                yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(doc)), names.take(pa.array(code)), pa.array(weight)],
                                                 names=["row", "token", "n"])
    cells = cells_with_ids(docs.mapInArrow(run, "row long, token string, n double"), sums, "token", "value")
    back = cells.groupBy("row").agg(F.collect_list(F.struct("token", "n", "value")).alias("c"))  # a document's tokens are one row in memory
    return back.select(F.col("c.token").alias("toks"), F.col("c.n").alias("ns"), F.col("c.value").alias("zs")), sums


def pair_sums(docs: DataFrame, limit: int = HEAVY, least: int = LEAST_THETA, list_pairs: int = LIST_PAIRS,
              block_pairs: int = BLOCK_PAIRS, side: int = SIDE, chunk: int = CHUNK, step_tokens: int = STEP_TOKENS,
              with_margins: bool = False) -> DataFrame:
    """(w1, w2, n) with w1 < w2 of documents (toks, ns), a row each; `ns` null: every token counts once. With margins also
    zr_i, zr_j and z: the words' sums over pairs by first word, and the total."""
    docs, sums = docs.select("toks", "ns").where(F.size("toks") > 1), None
    if with_margins:
        docs, sums = with_row_sums(docs, step_tokens)
    docs = stored(docs)  # read for the list, the products and both kinds of tiles
    names, _ = heavy_tokens(docs, limit, least)
    values, schema = None, _PAIRS
    if with_margins:
        known = {r["token"]: r["value"] for r in sums.where(F.col("token").isin(names)).collect()} if names else {}
        values, schema = [known[t] for t in names], _PAIRS + _MARGINS
    sides = -(-len(names) // side)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of the lists, and of each block."""
        light, blocks, heavy = 0, np.zeros((sides, sides), np.int64), pa.array(names, pa.string())
        for b in _steps(batches, step_tokens):
            words, doc, code, _ = _cells(b.column("toks"), b.column("ns"))
            rank = _ranks(words, heavy)[code]
            n = np.bincount(doc, minlength=b.num_rows)
            h = np.stack([np.bincount(doc[rank // side == s], minlength=b.num_rows) for s in range(sides)] or [0 * n])
            every = h.sum(0)
            light += int((n * (n - 1) // 2 - every * (every - 1) // 2).sum())
            if sides:
                blocks += h @ h.T
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(sides * sides)]), pa.array([light, *blocks.ravel().tolist()])], names=["tile", "n"])
    need = {r["tile"]: r["n"] for r in docs.mapInArrow(products, "tile long, n long").groupBy("tile").agg(F.sum("n").alias("n")).collect()}
    lists = max(1, -(-need.get(-1, 0) // list_pairs))
    parts = np.array([max(1, -(-need.get(t, 0) // block_pairs)) for t in range(sides * sides)] or [1], np.int64)

    def dealt(light: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext
            salt = int(_mix(np.array([TaskContext.get().partitionId()], np.uint64))[0] % np.uint64(1 << 30))
            heavy = pa.array(names, pa.string())
            for k, b in enumerate(_steps(batches, step_tokens)):
                for row in _dealt(b, heavy, lists, parts, salt + k, side, light):
                    yield _table(_ROWS, [row])
        return docs.mapInArrow(run, _ROWS)
    light = (dealt(True).repartition(min(lists, 4096), "tile").groupBy("tile")
             .applyInArrow(_iterated(functools.partial(_list_sums, heavy=names, chunk=chunk, heavy_values=values)), schema))
    z = None if sums is None else sums.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("z"))
    if not sides:
        return light if z is None else with_scalars(light, z)
    share = (dealt(False).repartition(min(int(parts.sum()), 4096), "tile", "part").groupBy("tile", "part")
             .applyInArrow(_iterated(functools.partial(_block_sums, sides=sides, side=side)), "tile long, part long, cells binary, sums binary"))
    blocks = share.groupBy("tile").applyInArrow(_iterated(functools.partial(_added, names=names, side=side, values=values)), schema)
    every = light.unionByName(blocks)
    return every if z is None else with_scalars(every, z)


def _iterated(fn):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(_ordered(batches))
    return run
