"""Substring deduplication with a count-min prefilter.

A window is `window` consecutive words of one text. Words covered by a window that also
starts in a text with a smaller id are removed; windows are judged on the input.

1. Texts are dealt into units by row number. Each unit sketches its windows: the sorted
   cells of a count-min row (`cells_per_window` cells for each window of the corpus), each
   counted once a document, cut into blocks of 2^24 cells.
2. All units' sketches of a block are merged by adding. A merged count never falls short
   of the true one, so a window in a cell counted once is certainly not repeated. Each unit
   gets one bit for each of its cells back.
3. Second pass: of windows in repeated cells only, the unit sends the BLAKE2b digest (128
   bits) of the words and the smallest id; they are grouped by digest, and each unit gets a
   bit back: does a smaller id hold this window? The cells' own hash is quick, not
   collision-free; it only ever adds windows to this pass.
4. Third pass: words under such windows go.

A sketch of a unit and block is one row, and nothing is broadcast. What a task holds is
bounded by the unit, the block or one long text; a block's task holds a window once for
each unit that has it. With very many units a row holds few cells: `unit_bytes` should
then grow with the root of the corpus. The texts are shuffled once, by unit; the passes reuse that
shuffle.

Defined results: null and empty texts have no words; a row without id neither removes nor
loses words; rows that repeat an id never remove each other's words (their ids aren't
smaller) but act on larger ids; repeats within one text stay; other columns are kept, and
replaced where they bear an output's name; empty tables give empty results."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, utf8, without
from .words import SPACE, spans, window_hashes, word_hashes

WINDOW = 13
CELLS_PER_WINDOW = 32
UNIT_BYTES = 4 << 20
BLOCK_BITS = 24
OUTPUTS = ("n_words", "n_removed", "kept_text")
_SEED = 11


def _unpack(blob: bytes) -> np.ndarray:
    """Increasing integers from their differences."""
    wide = np.uint16 if blob[:1] == b"2" else np.uint32
    return np.cumsum(np.frombuffer(blob, wide, offset=1), dtype=np.int64)


def _pack(values: np.ndarray) -> bytes:
    steps = np.diff(values, prepend=0)
    wide = b"2" if not len(steps) or steps.max() < 1 << 16 else b"4"
    return wide + steps.astype(np.uint16 if wide == b"2" else np.uint32).tobytes()


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


class _Unit:
    """Windows of a unit's texts: per text range, hashes and ids."""

    def __init__(self, table: pa.Table, id_at: int, text_at: int, window: int, cell_bits: int):
        self.ids = table.column(id_at).combine_chunks()
        self.valid = np.asarray(self.ids.is_valid())
        self.id = self.ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.data, self.off = utf8(table.column(text_at))
        self.window, self.shift = window, np.uint64(64 - cell_bits)

    def ranges(self):
        """(rows, bytes, starts, ends, first, windows' word numbers, rows, hash)."""
        for lo, hi in chunks(self.off):
            data = self.data[self.off[lo]:self.off[hi]]
            starts, ends, first = spans(data, self.off[lo:hi + 1] - self.off[lo])
            h = window_hashes(word_hashes(data, starts, ends, _SEED), self.window, _SEED)
            owner = np.repeat(np.arange(lo, hi), np.diff(first))
            n = len(h)
            ok = (owner[:n] == owner[self.window - 1:]) & self.valid[owner[:n]] if n else np.zeros(0, bool)
            at = np.flatnonzero(ok)
            yield lo, hi, data, starts, ends, first, at, owner[at], h[at]

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct cells in order, and whether more than one id of the unit counts there."""
        cell, doc = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for *_, rows, h in self.ranges():
            c, d = h >> self.shift, self.id[rows]
            cell.append(c)
            doc.append(d)
        cell, doc = np.concatenate(cell), np.concatenate(doc)
        order = np.argsort(cell, kind="stable")
        cell, doc = cell[order], doc[order]
        if not len(cell):
            return cell, np.zeros(0, bool)
        new = np.append(True, cell[1:] != cell[:-1])
        begin = np.flatnonzero(new)
        many = np.maximum.reduceat(doc, begin) != np.minimum.reduceat(doc, begin)
        return cell[begin], many

    def repeated(self, hot: np.ndarray):
        """Windows in hot cells: distinct digests (two halves) in order with the smallest id; and for each
        range of rows the windows' word numbers, rows and places among the digests."""
        halves, doc, places = [np.zeros((0, 2), np.uint64)], [np.zeros(0, np.int64)], []
        for _, _, data, starts, ends, _, at, rows, h in self.ranges():
            keep = _among(h >> self.shift, hot)
            at, rows = at[keep], rows[keep]
            halves.append(_digests(data, starts[at], ends[at + self.window - 1]))
            doc.append(self.id[rows])
            places.append((at, rows))
        halves, doc = np.concatenate(halves), np.concatenate(doc)
        order = np.lexsort((doc, halves[:, 1], halves[:, 0]))
        a, b, doc = halves[order, 0], halves[order, 1], doc[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
        number = np.empty(len(a), np.int64)
        number[order] = np.cumsum(new) - 1
        cut = np.cumsum([0, *(len(at) for at, _ in places)])
        return a[new], b[new], doc[new], [(at, rows, number[i:j]) for (at, rows), i, j in zip(places, cut, cut[1:])]


def _digests(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of each byte range with one space between words, as two columns."""
    if not len(begin):
        return np.zeros((0, 2), np.uint64)
    space = SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    flat = np.where(space, np.uint8(32), data)[keep].tobytes()
    moved = np.concatenate([[0], np.cumsum(keep)])
    digest = hashlib.blake2b
    raw = b"".join([digest(flat[i:j], digest_size=16).digest() for i, j in zip(moved[begin].tolist(), moved[end].tolist())])
    return np.frombuffer(raw, np.uint64).reshape(-1, 2)


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return ordered[at] == x


def _by_block(values: np.ndarray, bits: int, block_bits: int):
    """(block, slice) of ordered values of so many bits."""
    if not len(values):
        return
    block = values >> np.uint64(max(bits - block_bits, 0)) if bits > block_bits else np.zeros(len(values), np.uint64)
    cut = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    for a, b in zip(cut, np.append(cut[1:], len(values))):
        yield int(block[a]), slice(int(a), int(b))


_SKETCH = "unit long, block long, cells binary, many binary"
_BACK = "unit long, block long, second boolean, bits binary"
_EXACT = "unit long, block long, h binary, h2 binary, doc binary"


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], names=[f[0] for f in fields])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   cells_per_window: int = CELLS_PER_WINDOW, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """`docs` with n_words, n_removed and kept_text (kept words joined by one space)."""
    docs = without(docs, *OUTPUTS)
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    total = size["b"] or 0
    units = max(1, math.ceil(total / unit_bytes))
    cell_bits = max(16, math.ceil(math.log2(max(total / 6, 1) * cells_per_window)))  # about 6 bytes a word
    blocks_bits = max(cell_bits - BLOCK_BITS, 0)
    names = docs.columns
    id_at, text_at = names.index(id_col) + 1, names.index(text_col) + 1
    dealt = docs.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(units)).alias("__unit"),
                        *[F.col(id_col).cast("long").alias(id_col) if c == id_col else F.col(c) for c in names]).repartition("__unit")

    def sketch(t: pa.Table) -> pa.Table:
        u = t.column(0)[0].as_py()
        cell, many = _Unit(t, id_at, text_at, window, cell_bits).cells()
        base = np.uint64((1 << min(BLOCK_BITS, cell_bits)) - 1)
        return _rows(_SKETCH, [(u, b, _pack((cell[s] & base).astype(np.int64)), _bits(many[s]))
                               for b, s in _by_block(cell, cell_bits, blocks_bits)])

    def merge(t: pa.Table) -> pa.Table:
        count = np.zeros(1 << min(BLOCK_BITS, cell_bits), np.uint8)  # saturates at 2
        cells = [_unpack(x.as_py()) for x in t.column(2)]
        for c, m in zip(cells, t.column(3)):
            count[c] = np.minimum(count[c] + 1 + _flags(m.as_py(), len(c)), 2)
        block = t.column(1)[0].as_py()
        return _rows(_BACK, [(u.as_py(), block, False, _bits(count[c] > 1)) for u, c in zip(t.column(0), cells)])

    def hot_cells(unit: _Unit, back: pa.Table) -> np.ndarray:
        cell, _ = unit.cells()
        bits = {b.as_py(): x.as_py() for b, s, x in zip(back.column(1), back.column(2), back.column(3)) if not s.as_py()}
        got = [cell[s][_flags(bits[b], s.stop - s.start)] for b, s in _by_block(cell, cell_bits, blocks_bits) if b in bits]
        return np.concatenate(got) if got else cell[:0]

    def exact(t: pa.Table, back: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _rows(_EXACT, [])
        unit = _Unit(t, id_at, text_at, window, cell_bits)
        h, h2, doc, _ = unit.repeated(hot_cells(unit, back))
        narrow = len(doc) and doc.min() >= 0 and doc.max() < 1 << 32
        return _rows(_EXACT, [(t.column(0)[0].as_py(), b, h[s].tobytes(), h2[s].tobytes(),
                               (doc[s].astype(np.uint32) if narrow else doc[s]).tobytes())
                              for b, s in _by_block(h, 64, blocks_bits)])

    def group(t: pa.Table) -> pa.Table:
        h = [np.frombuffer(x.as_py(), np.uint64) for x in t.column(2)]
        h2 = [np.frombuffer(x.as_py(), np.uint64) for x in t.column(3)]
        doc = [np.frombuffer(x.as_py(), np.uint32 if len(x.as_py()) == 4 * len(y) else np.int64).astype(np.int64)
               for x, y in zip(t.column(4), h)]
        sizes = [len(x) for x in h]
        h, h2, doc = np.concatenate(h), np.concatenate(h2), np.concatenate(doc)
        order = np.lexsort((doc, h2, h))
        a, b = h[order], h2[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        least = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        later = np.empty(len(h), bool)
        later[order] = doc[order] > least
        block = t.column(1)[0].as_py()
        cut = np.cumsum(sizes)
        return _rows(_BACK, [(u.as_py(), block, True, _bits(later[e - n:e])) for u, n, e in zip(t.column(0), sizes, cut)])

    out = T.StructType([f if f.name != id_col else T.StructField(id_col, T.LongType()) for f in docs.schema.fields]
                       + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                          T.StructField("kept_text", T.StringType())])

    def finish(t: pa.Table, back: pa.Table) -> pa.Table:
        unit = _Unit(t, id_at, text_at, window, cell_bits)
        h, h2, doc, places = unit.repeated(hot_cells(unit, back))
        bits = {b.as_py(): x.as_py() for b, s, x in zip(back.column(1), back.column(2), back.column(3)) if s.as_py()}
        later = np.zeros(len(h), bool)
        for b, s in _by_block(h, 64, blocks_bits):
            later[s] = _flags(bits[b], s.stop - s.start)
        n_words, n_removed, kept = [], [], []
        for (lo, hi, data, starts, ends, first, *_), (at, rows, k) in zip(unit.ranges(), places):
            gone = np.zeros(len(starts) + 1, np.int64)
            hit = at[later[k] | (unit.id[rows] > doc[k])]
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + window, -1)
            removed = np.cumsum(gone)[:-1] > 0
            raw = data.tobytes()
            for i in range(hi - lo):
                a, b = first[i], first[i + 1]
                keep = ~removed[a:b]
                n_words.append(int(b - a))
                n_removed.append(int(b - a - keep.sum()))
                kept.append(b" ".join([raw[p:q] for p, q in zip(starts[a:b][keep].tolist(), ends[a:b][keep].tolist())]))
        return pa.table([*[t.column(i) for i in range(1, t.num_columns)], pa.array(n_words, pa.int64()),
                         pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                        names=[f.name for f in out.fields])

    # one plan, in which all three passes take the same columns and so share one exchange
    hot = (dealt.groupBy("__unit").applyInArrow(sketch, _SKETCH).groupBy("block").applyInArrow(merge, _BACK))
    later = (dealt.groupBy("__unit").cogroup(hot.groupBy("unit")).applyInArrow(exact, _EXACT)
             .groupBy("block").applyInArrow(group, _BACK))
    return dealt.groupBy("__unit").cogroup(hot.unionByName(later).groupBy("unit")).applyInArrow(finish, out)
