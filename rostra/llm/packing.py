"""Best-fit packing with certified bounds.

Each text's token ids plus an end id are cut into pieces of at most `capacity` tokens; full
pieces are sequences of their own. The rest is dealt at random by row number (ids may be null
or repeat) into partitions, each packed best-fit decreasing. Dual feasible functions (Fekete and Schepers' u(k), and Martello and
Toth's bound over all thresholds) give lower bounds on any packing of given pieces. One bound
is taken of the whole corpus, from its numbers of pieces by length (at most `capacity` rows
on the driver), and one of each partition's pieces, which certifies its bin count. While the
corpus takes more sequences than its bound, pieces are exchanged: full bins stay, a certified
partition gives back its emptiest bin, any other partition all bins that aren't full; what
comes back is dealt anew and packed again. If that saves no sequence, all bins that aren't
full come back once. This ends when the bound is met or such a round saves none, too; rounds
that saved none are not kept.

Tokenising is a narrow scan: the pre-tokeniser drops white space and splits within what is
between, so the ids of a run without white space don't depend on its neighbours, nor do those
of its units (runs of letters, digits, runs of other signs), and each worker keeps the ids of
the runs and units it has seen, up to a fixed number. Runs with characters beyond the plain
Latin ones go through the tokenizer one by one; texts with one of the file's added tokens, or with control characters that only some call white space, go through the
tokenizer whole, and so do all texts if the file's steps are others than these.

Defined results: null and empty texts are one piece of the end id; rows that repeat an id
or have none are packed each; other columns are ignored; an empty table gives an empty
result. Texts are read whole."""

from __future__ import annotations

import functools
import json
import math
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdPool, byte_letters, materialise, texts

CAPACITY = 4096
END_ID = 1
PART_PIECES = 25_000
_CACHE = 400_000
_GROUP = 200
_ODD = re.compile(r"[\x1c-\x1f]")
# The steps of a tokenizer file whose runs between white space are independent
_NORMALIZERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _independent(steps: dict) -> bool:
    """Whether ids of runs without white space don't depend on their neighbours."""
    form = steps.get("normalizer") or {"type": "Sequence", "normalizers": []}
    cut = steps.get("pre_tokenizer") or {}
    parts = cut.get("pretokenizers", [])
    return (form.get("type") == "Sequence" and all(x in _NORMALIZERS for x in form["normalizers"]) and len(parts) == 2
            and parts[0] == {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}
            and parts[1].get("type") == "ByteLevel" and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex")
            and not steps.get("truncation") and not steps.get("padding") and steps["model"].get("dropout") is None)


# Letters and signs of which each is one code point in composed form, with one lower-case form
_PLAIN = re.compile(r"[\n!-~À-ÖØ-öø-ÿŒœ«»–—’‘“”„…€§¡¿]*")
_UNIT = re.compile(r"\n|'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿœ]+|[0-9]|[^\sa-zß-öø-ÿœ0-9]+")


class UnitTokens:
    """Token ids of texts, from the ids of their runs between white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        steps = json.loads(self.tok.to_str())
        self.independent = _independent(steps)
        self.added = [t["content"] for t in steps["added_tokens"]]
        self.letters = {b: c for c, b in byte_letters().items()}
        self.runs, self.units = IdPool(), IdPool()

    def _whole(self, text: str) -> bool:
        return not self.independent or any(a in text for a in self.added) or _ODD.search(text) is not None

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn_units(self, new: list[str]) -> None:
        if new:  # what the steps before the model make of a unit is its bytes' letters
            model, letters = self.tok.model, self.letters
            ids = [[t.id for t in model.tokenize(u.encode().decode("latin-1").translate(letters))] for u in new]
            self.units.add(new, np.fromiter(chain.from_iterable(ids), np.uint32), np.array(list(map(len, ids))))

    def _learn(self, new: list[str]) -> None:
        row = "\n".join(new)
        odd = [] if _PLAIN.fullmatch(row) else [r for r in new if not _PLAIN.fullmatch(r)]
        if odd:
            ids = [self._encode(r) for r in odd]
            self.runs.add(odd, np.concatenate(ids), np.array(list(map(len, ids))))
            new = [r for r in new if _PLAIN.fullmatch(r)]
            row = "\n".join(new)
        if not new:
            return
        if len(self.units.at) > _CACHE:
            self.units = IdPool()
        units = _UNIT.findall(row.lower())
        self.units.at.setdefault("\n", -1)
        self._learn_units([u for u in dict.fromkeys(units) if u not in self.units.at])
        number = np.array(list(map(self.units.at.__getitem__, units)), np.int64)
        real = number >= 0
        size = np.bincount(np.cumsum(~real)[real], self.units.size[number[real]], len(new)).astype(np.int64)
        self.runs.add(new, self.units.gather(number[real]), size)

    def __call__(self, some: list[str]) -> list[np.ndarray]:
        whole = [self._whole(t) for t in some]
        split = [[] if w else t.split() for t, w in zip(some, whole)]
        flat = list(chain.from_iterable(split))
        if len(self.runs.at) > _CACHE:
            self.runs = IdPool()
        get = self.runs.at.get
        number = np.array([get(r, -1) for r in flat], np.int64)
        new = np.flatnonzero(number < 0).tolist()
        if new:
            missed = [flat[i] for i in new]
            self._learn(list(dict.fromkeys(missed)))
            number[new] = list(map(self.runs.at.__getitem__, missed))
        size = np.concatenate([[0], np.cumsum(self.runs.size[number])])
        ends = size[np.cumsum(list(map(len, split)))][:-1]
        out = [self._encode(t) if w else ids for t, w, ids in zip(some, whole, np.split(self.runs.gather(number), ends))]
        if sum(map(len, (flat[i] for i in new))) > 8 << 20:  # long runs aren't kept
            self.runs, self.units = IdPool(), IdPool()
        return out


_TOKENS: dict[str, UnitTokens] = {}


def shared_tokens(path: str) -> UnitTokens:
    """One instance a worker process, kept from task to task."""
    if path not in _TOKENS:
        _TOKENS[path] = UnitTokens(path)
    return _TOKENS[path]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared_tokens(tokenizer)
        for b in batches:
            for lo in range(0, b.num_rows, _GROUP):
                part = b.slice(lo, _GROUP)
                ids = [np.append(x, np.uint32(end_id)).astype("<u4", copy=False) for x in tokens(list(texts(part.column(1))))]
                size = np.array(list(map(len, ids)))
                n = -(-size // capacity)
                row = np.repeat(np.arange(len(ids)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                cut = [ids[i][s:s + capacity] for i, s in zip(row.tolist(), start.tolist())]
                arrays = [part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                          pa.array(np.minimum(size[row] - start, capacity), pa.int64()), pa.array([zlib.crc32(x) for x in cut], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([y.astype(np.int32) for y in cut], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * with_ids)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def lower_bound(n: np.ndarray, capacity: int) -> int:
    """The best of the dual feasible functions' bounds on the bins for n[s] pieces of size s."""
    s = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((n * s).sum()) // capacity)
    for k in range(1, 101):  # u(k): (k + 1) x / capacity rounded down, unless whole, over k
        up = (k + 1) * s
        value = np.where(up % capacity == 0, s * k, up // capacity * capacity)
        best = max(best, -(-int((n * value).sum()) // (capacity * k)))
    count, total = np.cumsum(n), np.cumsum(n * s)
    e = np.arange(1, capacity // 2 + 1)  # over capacity - e: a bin each; e and more: their size
    large = count[-1] - count[capacity - e]
    middle = total[capacity - e] - total[e - 1]
    return max(best, int((large + -(-middle // capacity)).max(initial=0)))


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and each bin's fill."""
    bins, offsets, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    free = 0  # bit r: some bin has r free
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        fits = free >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free ^= 1 << r
        else:
            b, r = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if r > n:
            room[r - n].append(b)
            free |= 1 << (r - n)
    return bins, offsets, np.array(fill, np.int64)


_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]
_PACKED = ("row long, doc_id long, piece int, start long, length long, ids_crc32 long, part long, bin long, offset long, "
           "settled boolean, full boolean")


def _round(rows: DataFrame, parts: int, salt: int, capacity: int) -> DataFrame:
    """Packs each partition. A bin is settled if it is full, or if the partition's bound
    certifies its count and another bin is emptier."""
    def run(t: pa.Table) -> pa.Table:
        size = t.column("length").to_numpy()
        order = np.lexsort((t.column("piece").to_numpy(), t.column("doc_id").fill_null(-1).to_numpy()))
        t, size = t.take(order), size[order]
        bins, offset, fill = best_fit_decreasing(size, capacity)
        settled = fill == capacity
        full = settled.copy()
        if len(fill) == lower_bound(np.bincount(size, minlength=capacity + 1), capacity):
            settled |= np.arange(len(fill)) != np.argmin(fill)
        extra = [pa.array(bins), pa.array(offset), pa.array(settled[bins]), pa.array(full[bins])]
        return pa.table([t.column("row"), *[t.column(c) for c in _PIECE], t.column("part"), *extra],
                        names=["row", *_PIECE, "part", "bin", "offset", "settled", "full"])
    dealt = rows.select("row", *_PIECE, F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(parts)).alias("part"))
    return materialise(dealt.groupBy("part").applyInArrow(run, _PACKED))


def _bound(rows: DataFrame, capacity: int) -> int:
    """The bound on the sequences of all pieces; at most `capacity` rows come to the driver."""
    by_size = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():
        by_size[r["length"]] = r["count"]
    return lower_bound(by_size, capacity)


def _bins(packed: DataFrame) -> int:
    return packed.where("offset = 0").count()


def _numbered(rows: DataFrame, k: int) -> DataFrame:
    """sequence_id from round, partition and bin."""
    number = F.lit(k << 54) + F.shiftleft(F.col("part"), 24) + F.col("bin")
    return rows.select(*_PIECE, number.alias("sequence_id"), "offset")


def pack(rows: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES) -> DataFrame:
    """`pieces` with sequence_id and offset."""
    rows = materialise(rows.select(*_PIECE).withColumn("row", F.monotonically_increasing_id()))
    result = rows.where(F.col("length") == capacity).select(
        *_PIECE, (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = rows.where(F.col("length") < capacity)
    number = left.count()
    if not number:
        return result
    bound = _bound(left, capacity)
    now, k, all_back = _round(left, math.ceil(number / part_pieces), 0, capacity), 0, False
    kept: list[tuple[DataFrame, int]] = []  # packed rows that stay, and their round
    at, total = 0, _bins(now)
    while total > bound:
        if all_back:
            stay, back = [(x.where("full"), i) for x, i in [*kept, (now, at)]], [x.where("not full") for x, _ in [*kept, (now, at)]]
        else:
            stay, back = [*kept, (now.where("settled"), at)], [now.where("not settled")]
        gaps = functools.reduce(DataFrame.unionByName, back)
        pieces_back, bins = gaps.agg(F.count(F.lit(1)), F.sum((F.col("offset") == 0).cast("long"))).first()
        k += 1
        again = _round(gaps, math.ceil(pieces_back / part_pieces), k, capacity) if pieces_back else None
        saved = bins - _bins(again) if pieces_back else 0
        if saved > 0:
            kept, now, at, total, all_back = stay, again, k, total - saved, False
        elif all_back:
            break
        else:
            all_back = True
    return functools.reduce(DataFrame.unionByName, [_numbered(x, i) for x, i in [*kept, (now, at)]], result)
