"""SentencePiece encoding and decoding by weighted finite-state transducers.

The model file is compiled into three machines: a normaliser (spaces become the sign U+2581,
one is put in front), the pieces as paths of characters, and a byte fallback for characters
without a piece. An input is composed with them into a lattice over its positions, and the
encoding is the shortest path in the tropical semiring. For a unigram model an arc weighs
minus its piece's score. A BPE model's scores are merge ranks, which don't add up along a
path; there the pieces are composed with a machine that weighs a pair of neighbouring
pieces 0 if merging their joined text by rank yields just this pair, and infinity
otherwise. A sequence of pieces is the BPE encoding if and only if all its neighbours agree
so, hence one path is left finite at each position and the state is the position alone.

Positions that no piece spans cut the input into independent units (found at compile time:
before a space sign that follows another sign, and around line ends), whose shortest paths
workers keep, up to a fixed number.

Defined results: null and empty texts have no ids; rows are independent, so repeats, ties
and null ids don't matter; other columns are ignored; texts are encoded whole. Models with
a character map beyond identity are refused."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdPool, texts

SPACE = "▁"
_CACHE = 800_000
_PAIRS = 1_500_000
_GROUP = 200
# Model and piece types of the model file
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(blob: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = blob[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value
    while i < len(blob):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if tag & 7 == 2 else 4 if tag & 7 == 5 else 8
            yield tag >> 3, blob[i:i + n]
            i += n


class Model:
    """The compiled machines of a model file's bytes."""

    def __init__(self, blob: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.type, self.prefix, self.squeeze, self.fallback = UNIGRAM, True, True, False
        for number, value in _fields(blob):
            if number == 1:
                got = dict(_fields(value))
                self.pieces.append(got.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(got[2], "<f4")[0]) if 2 in got else 0.0)
                self.kinds.append(got.get(3, NORMAL))
            elif number == 2:
                got = dict(_fields(value))
                self.type, self.fallback = got.get(3, UNIGRAM), bool(got.get(35, 0))
            elif number == 3:
                got = dict(_fields(value))
                self.prefix, self.squeeze = bool(got.get(3, 1)), bool(got.get(4, 1))
                if got.get(2) or got.get(6):
                    raise ValueError("only models with the identity character map are supported")
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER)]
        self.ids = {self.pieces[i]: i for i in usable}
        self.longest = max(map(len, self.ids), default=1)
        # the pieces' machine: texts of paths from its start; -1 where no piece ends
        self.arcs = {p[:n]: -1 for p in self.ids for n in range(1, len(p))} | self.ids
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        line = any("\n" in p and len(p) > 1 for p in self.ids)
        self.units = None if inner or line else re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.pairs: dict[int, bool] = {}
        raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else p.replace(SPACE, " ").encode()
               for p, k in zip(self.pieces, self.kinds)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        text = text.replace(" ", SPACE)
        return SPACE + text if self.prefix else text

    def _merged(self, text: str) -> list[str]:
        """The parts that merging by rank ends with."""
        parts = list(text)
        while True:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and self.scores[k] > best:
                    best, at = self.scores[k], i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _weight(self, left: str, right: str, code: int) -> bool:
        """Whether the pair of neighbours weighs 0."""
        ok = self._merged(left + right) == ([left, right] if left else [right])
        if len(self.pairs) >= _PAIRS:
            self.pairs.clear()
        self.pairs[code] = ok
        return ok

    def shortest_path(self, unit: str) -> list[int]:
        """Ids along the shortest path of the lattice of a unit."""
        n = len(unit)
        ids, pairs, count = self.ids, self.pairs, len(self.pieces) + 1
        if self.type == BPE:
            last: list = [None] * (n + 1)  # at each position: (start, id or -1, text) of the one finite path
            last[0] = (0, count - 1, "")
            arcs, weight = self.arcs, pairs.get
            for s in range(n):
                _, before, left = last[s]
                if before < 0:  # characters without a piece: named by their code point
                    before = count + ord(left)
                base = before * count
                for e in range(s + 1, n + 1):
                    k = arcs.get(unit[s:e])
                    if k is None:
                        break
                    if k >= 0 and last[e] is None:
                        ok = weight(base + k)
                        if ok or ok is None and self._weight(left, unit[s:e], base + k):
                            last[e] = (s, k, unit[s:e])
                if last[s + 1] is None and unit[s] not in ids:  # no piece for the character: byte fallback
                    last[s + 1] = (s, -1, unit[s])
            step = lambda e: last[e][:2]
        else:
            cost, back = [0.0] + [math.inf] * n, [(0, -1)] * (n + 1)
            worst = 10 - min(self.scores)
            for s in range(n):
                for e in range(s + 1, min(n, s + self.longest) + 1):
                    k = ids.get(unit[s:e])
                    if k is not None and cost[s] - self.scores[k] < cost[e]:
                        cost[e], back[e] = cost[s] - self.scores[k], (s, k)
                if unit[s] not in ids and cost[s] + worst < cost[s + 1]:
                    cost[s + 1], back[s + 1] = cost[s] + worst, (s, -1)
            step = back.__getitem__
        out: list[int] = []
        e = n
        while e:
            s, k = step(e)
            if k >= 0:
                out.append(k)
            elif self.fallback:
                out += [self.bytes[x] for x in reversed(unit[s:e].encode())]
            else:
                if not (out and out[-1] == self.unknown):
                    out.append(self.unknown)
            e = s
        return out[::-1]

    def split(self, text: str) -> list[str]:
        text = self.normalise(text)
        return self.units.findall(text) if self.units else [text] if text else []

    def encode(self, text: str) -> list[int]:
        return [k for u in self.split(text) for k in self.shortest_path(u)]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        size = self.raw_size[ids]
        end = np.cumsum(size)
        n = int(end[-1]) if len(end) else 0
        raw = self.raw[np.repeat(self.raw_at[ids] - (end - size), size) + np.arange(n)].tobytes()
        return raw[1:] if self.prefix and raw[:1] == b" " else raw

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


class Encoder:
    """Keeps the ids of the units it has seen."""

    def __init__(self, model: Model):
        self.model, self.seen = model, IdPool()

    def __call__(self, some: list[str]) -> list[np.ndarray]:
        if len(self.seen.at) > _CACHE:
            self.seen = IdPool()
        units = [self.model.split(t) for t in some]
        new = list({x for v in units for x in v if x not in self.seen.at})
        ids = [self.model.shortest_path(u) for u in new]
        self.seen.add(new, np.array([k for x in ids for k in x], np.uint32), np.array([len(x) for x in ids], np.int64))
        return [self.seen.ids(u).astype(np.int32) for u in units]


_ENCODERS: dict[str, Encoder] = {}


def shared_encoder(path: str) -> Encoder:
    """One instance a worker process, kept from task to task."""
    if path not in _ENCODERS:
        with open(path, "rb") as f:
            _ENCODERS[path] = Encoder(Model(f.read()))
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit), n_fallback (byte ids),
    round_trip (the ids decode to the text) and, if asked for, ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path)
        model = encoder.model
        is_byte = np.array([k == BYTE for k in model.kinds])
        for b in batches:
            for lo in range(0, b.num_rows, _GROUP):
                part = b.slice(lo, _GROUP)
                some = list(texts(part.column(1)))
                ids = encoder(some)
                cols = [part.column(0), pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()),
                        pa.array([model.decode_bytes(x) == t.replace(SPACE, " ").encode() for x, t in zip(ids, some)], pa.bool_())]
                names = ["doc_id", "n_ids", "ids_crc32", "n_fallback", "round_trip"]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=names + ["ids"] * with_ids)
    schema = "doc_id long, n_ids long, ids_crc32 long, n_fallback long, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of rows with ids; a null list is the empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared_encoder(path).model
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([model.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])
    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
