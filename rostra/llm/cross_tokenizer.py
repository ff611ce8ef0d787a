"""Cross-tokenizer alignment with corpus-wide counts of id pairs.

Two tokenizers, A (byte-level BPE) and B (SentencePiece), encode the same bytes. Offsets
where a token of both ends cut them into groups; an occurrence of A's token and one of B's are
linked if their byte ranges overlap. How often a pair of ids is linked in the whole corpus
is then looked up for each link.

1. First pass: texts are cut into parts of at most `PART_BYTES` (or one text), encoded and
   aligned. Written are, for a part, the ids of its distinct words and its pairs with partial
   counts, and for a text its words' numbers.
2. The distinct pairs are dealt into shards of about `SHARD_KEYS`. Each shard's pairs get a
   minimal perfect hash: levels of bit tables in which a pair that is alone at its place
   stays and the others go on, numbered by the bits before. Beside it lie the pairs by
   number, so that an unknown pair is noticed.
3. The partial counts of a shard are added into dense vectors indexed by the hash, by
   branches first, and the branches' vectors in a tree of `FAN` at a time.
4. Second pass: each part asks the shards for its pairs' counts, aligns the ids of its words
   again and looks the counts of their links up. The largest count of each id of B is a vector as long as B's
   vocabulary; only this goes through the driver.

A space between two characters that aren't white space ends tokens of both (checked for B on
its pieces, given for A by its pattern), so alignment works on such words, and workers keep
those they have seen, up to a fixed number. Other tokenizers' texts are aligned whole.

Defined results: null and empty texts, and texts whose joined token bytes aren't a space and
the text, have no tokens: zeros and an empty groups string; rows are aligned one by one, so
repeated rows, ties and null ids each give a row and count; other columns are ignored; texts
are read whole; an empty table gives an empty result."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_letters, materialise
from .words import mix

PART_BYTES = 8 << 20
SHARD_KEYS = 1 << 17
GROUP_KEYS = 1 << 20
FAN = 16
_CACHE = 300_000
_OFTEN = 3
_LONGEST = 80
_STEP = 1 << 20
_CUT = re.compile(r"(?<=\S) (?=\S)")
_WHITE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
_B_BITS = np.int64(24)  # a pair is A's id above B's


class Pair:
    """Both tokenizers, and the alignments of the words a worker has seen."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        added = {v: k for k, v in vocabulary.items()}
        self.bytes_a = [bytes(letters.get(c, 63) for c in added.get(i, "")) for i in range(max(added) + 1)]
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        before = json.loads(self.a.to_str())
        step = before["pre_tokenizer"] or {}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        # words end tokens: A's pattern opens a token at such a space, and no piece of B holds one further in
        self.words = (before["normalizer"] is None and step.get("type") == "ByteLevel" and step.get("use_regex") is True
                      and not any("▁" in p.lstrip("▁") for p in pieces) and self._keeps_spaces())
        self.span = max(len(self.bytes_a), len(self.bytes_b))
        self.signs = [f"{i}{s}" for s in ",|;" for i in range(self.span)]
        self.clear()

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        return b"" if self.b.is_control(i) or self.b.is_unknown(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    def _keeps_spaces(self) -> bool:
        """Whether B adds one space in front and leaves the others and letter forms as they are."""
        probe = " a  ﬁ É\n b "
        return b"".join(self.bytes_b[i] for i in self.b.encode(probe)) == (" " + probe).encode()

    def split(self, text: str) -> list[str]:
        """Words at spaces between two characters that aren't white space."""
        if not self.words:
            return [text]
        if "  " in text or text[0] == " " or text[-1] == " " or any(w in text and (w + " " in text or " " + w in text) for w in _WHITE):
            return _CUT.split(text)
        return text.split(" ")

    def learn(self, units: list[str]) -> None:
        """Aligns new units and keeps them."""
        for lo in range(0, len(units), 4096):
            self._learn(units[lo:lo + 4096])

    def _encoded(self, units: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of both for each unit, and whether both spell it; units that don't align have none."""
        a = [e.ids for e in self.a.encode_batch([" " + u for u in units], add_special_tokens=False)]
        b = self.b.encode(units, num_threads=1)
        ok = [b"".join(map(self.bytes_a.__getitem__, x)) == (" " + u).encode() == b"".join(map(self.bytes_b.__getitem__, y))
              for x, y, u in zip(a, b, units)]
        return [x if k else [] for x, k in zip(a, ok)], [x if k else [] for x, k in zip(b, ok)], ok

    def _run(self, units: list[str]) -> tuple | None:
        """Ids of units encoded in a row, and their numbers, of both; None if the row isn't spelt."""
        text = " ".join(units)
        ids_a, ids_b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        raw = (" " + text).encode()
        if not b"".join(map(self.bytes_a.__getitem__, ids_a)) == raw == b"".join(map(self.bytes_b.__getitem__, ids_b)):
            return None
        ends = np.cumsum([len(u.encode()) + 1 for u in units])
        ids = [np.array(x, np.int64) for x in (ids_a, ids_b)]
        at = [np.searchsorted(np.cumsum(size[x]), ends, "right") for size, x in zip((self.size_a, self.size_b), ids)]
        return ids[0], ids[1], np.diff(at[0], prepend=0), np.diff(at[1], prepend=0)

    def _learn(self, units: list[str]) -> None:
        plain = [u for u in units if self.words and u and not u[0].isspace() and not u[-1].isspace()]
        got = self._run(plain) if plain else None
        if got is not None:
            self._keep(plain, *got, [True] * len(plain))
            units = [u for u in units if u not in self.at] if len(plain) < len(units) else []
        if units:
            a, b, ok = self._encoded(units)
            ids = [np.fromiter((i for x in t for i in x), np.int64) for t in (a, b)]
            self._keep(units, *ids, *(np.array(list(map(len, t)), np.int64) for t in (a, b)), ok)

    def linked(self, ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of ids of units in a row, the number of links of each unit (n_a: its ids of A), and
        both tokens' ends in bytes."""
        ids_a, ids_b = ids_a.astype(np.int64), ids_b.astype(np.int64)
        end_a, end_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        # from B's token that ends after A's starts to the one that starts before A's ends
        lo = np.searchsorted(end_b, end_a - self.size_a[ids_a], "right")
        hi = np.searchsorted(end_b, end_a, "left") + 1
        links = hi - lo
        from_a = np.repeat(np.arange(len(ids_a)), links)
        to_b = np.arange(len(from_a)) + np.repeat(lo - (np.cumsum(links) - links), links)
        total = np.concatenate([[0], np.cumsum(links)])[np.concatenate([[0], np.cumsum(n_a)])]
        return (ids_a[from_a] << _B_BITS) | ids_b[to_b], np.diff(total), end_a, end_b

    def _keep(self, units: list[str], ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, ok: list[bool]) -> None:
        n, have = len(units), len(self.at)
        keys, n_links, end_a, end_b = self.linked(ids_a, ids_b, n_a)
        at = np.searchsorted(end_b, end_a)
        last_a = end_b[np.minimum(at, len(end_b) - 1)] == end_a if len(end_b) else np.zeros(0, bool)
        last_b = np.zeros(len(end_b), bool)
        last_b[at[last_a]] = True
        n_groups = np.diff(np.concatenate([[0], np.cumsum(last_a)])[np.concatenate([[0], np.cumsum(n_a)])])
        shared = end_a[last_a]
        # A's tokens of a group, then B's
        order = np.argsort(np.concatenate([2 * np.searchsorted(shared, end_a), 2 * np.searchsorted(shared, end_b) + 1]), kind="stable")
        sign = np.concatenate([ids_a + last_a * self.span, ids_b + last_b * (2 * self.span)])[order]
        words = list(map(self.signs.__getitem__, sign.tolist()))
        ends = np.cumsum(n_a + n_b).tolist()
        self.text += ["".join(words[s:e])[:-1] for s, e in zip([0, *ends], ends)]
        self.numbers.append(np.array([n_a, n_b, n_groups, n_links, ~np.array(ok, bool)], np.int32))
        self.keys.append(keys)
        self.ids_a.append(ids_a.astype(np.int32))
        self.ids_b.append(ids_b.astype(np.int32))
        self.at.update(zip(units, range(have, have + n)))

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.text: list[str] = []
        self.numbers: list[np.ndarray] = []  # n_a, n_b, n_groups, n_links, bad
        self.keys: list[np.ndarray] = []
        self.ids_a: list[np.ndarray] = []
        self.ids_b: list[np.ndarray] = []

    def known(self) -> np.ndarray:
        """n_a, n_b, n_groups, n_links and bad of all units, by number."""
        if len(self.numbers) != 1:
            self.numbers = [np.concatenate(self.numbers, axis=1) if self.numbers else np.zeros((5, 0), np.int32)]
        return self.numbers[0]

    def picked(self, units: np.ndarray, what: str) -> np.ndarray:
        """The entries of some units of one of the pools keys, ids_a and ids_b, in a row."""
        pool = getattr(self, what)
        if len(pool) != 1:
            pool[:] = [np.concatenate(pool) if pool else np.zeros(0, np.int64)]
        return _ranges(pool[0], self.known()[{"ids_a": 0, "ids_b": 1, "keys": 3}[what]], units)

    def documents(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each text's units. Texts that don't align have none."""
        split = [self.split(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(split))
        get = self.at.get
        units = np.array([get(u, -1) for u in flat], np.int64)
        new = np.flatnonzero(units < 0).tolist()
        if new:
            missed = [flat[i] for i in new]
            self.learn(list(dict.fromkeys(missed)))
            units[new] = list(map(self.at.__getitem__, missed))
        ends = np.cumsum(list(map(len, split)))[:-1] if split else []
        bad = self.known()[4]
        return [u[:0] if bad[u].any() else u for u in np.split(units, ends)] if split else []

    def close(self, units: np.ndarray, n: np.ndarray) -> None:
        """Between parts: if there are many units or long ones, keeps only those short ones that
        the last part held `_OFTEN` times (n: how often it held `units`)."""
        if len(self.at) <= _CACHE and sum(map(len, self.at)) <= 32 * _CACHE:
            return
        names = list(self.at)
        keep = units[n >= _OFTEN]
        keep = keep[[len(names[i]) <= _LONGEST for i in keep.tolist()]] if len(keep) else keep
        keep = keep[:_CACHE // 2]
        pools = {k: [self.picked(keep, k)] for k in ("keys", "ids_a", "ids_b")}
        self.numbers, self.text = [self.known()[:, keep]], [self.text[i] for i in keep.tolist()]
        self.at = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.keys, self.ids_a, self.ids_b = pools["keys"], pools["ids_a"], pools["ids_b"]


def _ranges(pool: np.ndarray, size: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The entries of some units in a pool that holds size[i] of unit i, one unit after another."""
    start, n = (np.cumsum(size, dtype=np.int64) - size)[units], size[units].astype(np.int64)
    ends = np.cumsum(n)
    return pool[np.repeat(start - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


_PAIRS: dict[tuple[str, str], Pair] = {}


def shared_pair(path_a: str, path_b: str) -> Pair:
    """One instance a worker process, kept from task to task."""
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


class PerfectHash:
    """Numbers distinct 64-bit keys 0 to n - 1, from about three bits a key."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # bits of each level, one byte each
        self.before = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in levels]
        self.base = np.concatenate([[0], np.cumsum([b[-1] for b in self.before])]).astype(np.int64)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            place = cls._place(keys, len(levels), 2 * len(keys))
            alone = np.bincount(place, minlength=2 * len(keys)) == 1
            levels.append(alone)
            keys = keys[~alone[place]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers; any number or -1 for keys that weren't built in."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            place = self._place(keys[left], k, len(bits))
            hit = bits[place]
            out[left[hit]] = self.base[k] + self.before[k][place[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out

    def dump(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], np.int64)
        return sizes.tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, blob: bytes) -> PerfectHash:
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        sizes, at, levels = np.frombuffer(blob, np.int64, n, 8).tolist(), 8 * (n + 1), []
        for size in sizes:
            step = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, step, at), count=size).astype(bool))
            at += step
        return cls(levels)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    every, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(every), np.int64)
    np.add.at(total, back, np.concatenate(counts))
    return every, total


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _longs(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.int64)


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])


_PART = "part long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, units binary, words binary, keys binary, counts binary"


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2^32 with their low bytes first, then the higher ones: these compress well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _dump(arrays: list[np.ndarray]) -> bytes:
    return np.array([len(x) for x in arrays], np.int64).tobytes() + b"".join(map(_planes, arrays))


def _load(blob: bytes, n: int) -> list[np.ndarray]:
    sizes, at = np.frombuffer(blob, np.int64, n).tolist(), 8 * n
    out = []
    for size in sizes:
        out.append(_numbers(blob[at:at + 4 * size]))
        at += 4 * size
    return out


def _parts(docs: DataFrame, path_a: str, path_b: str, part_bytes: int, with_groups: bool) -> DataFrame:
    """A row for each text, and one for each part with its words and its pairs' partial counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = shared_pair(path_a, path_b)
        number, held, seen = TaskContext.get().partitionId() << 32, 0, []

        def part_row() -> pa.RecordBatch:
            nonlocal number, held, seen
            units, n = np.unique(np.concatenate(seen), return_counts=True)
            size = pair.known()[:, units]
            keys, back = np.unique(pair.picked(units, "keys"), return_inverse=True)
            counts = np.bincount(back, np.repeat(n, size[3]), len(keys)).astype(np.int64)
            words = _dump([units, size[0], size[1], pair.picked(units, "ids_a"), pair.picked(units, "ids_b")])
            row = _table(_PART, [(number, *[None] * 8, words, keys.tobytes(), counts.tobytes())])
            number, held, seen = number + 1, 0, []
            pair.close(units, n)
            return row.to_batches()[0]
        for b in batches:
            texts = b.column(1).to_pylist()
            sizes = [len(x.encode()) if x else 0 for x in texts]
            lo = 0
            while lo < len(texts):
                hi, n = lo, 0
                while hi < len(texts) and (hi == lo or n + sizes[hi] <= min(_STEP, part_bytes - held)):
                    n += sizes[hi]
                    hi += 1
                if seen and held + n > part_bytes:
                    yield part_row()
                    continue
                units = pair.documents(texts[lo:hi])
                seen.append(np.concatenate(units))
                held += n
                edge = np.cumsum([0, *map(len, units)])
                per = np.concatenate([np.zeros((4, 1), np.int64), np.cumsum(pair.known()[:4, seen[-1]], axis=1, dtype=np.int64)], axis=1)[:, edge]
                groups = [";".join(map(pair.text.__getitem__, u.tolist())) for u in units]
                none = pa.nulls(hi - lo, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(hi - lo, number)), b.column(0).slice(lo, hi - lo), *map(pa.array, np.diff(per, axis=1)),
                     pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string()),
                     pa.array(groups if with_groups else [None] * len(groups), pa.string()), pa.array(list(map(_planes, units)), pa.binary()),
                     none, none, none], names=[f.split()[0] for f in _PART.split(", ")])
                lo = hi
        if seen:
            yield part_row()
    return materialise(docs.mapInArrow(run, _PART))


def _hashes(pairs: DataFrame, shards: int) -> DataFrame:
    """shard, hash, keys (by their numbers) of the distinct pairs."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_shard(keys, shards)), b.column(0)], names=["shard", "key"])

    def build(t: pa.Table) -> pa.Table:
        keys = t.column("key").to_numpy()
        made = PerfectHash.build(keys)
        by_number = np.zeros(len(keys), np.int64)
        by_number[made(keys)] = keys
        return _table("shard long, hash binary, keys binary", [(t.column("shard")[0].as_py(), made.dump(), by_number.tobytes())])
    dealt = pairs.mapInArrow(deal, "shard long, key long")
    return materialise(dealt.groupBy("shard").applyInArrow(build, "shard long, hash binary, keys binary"))


def _distinct(partial: DataFrame) -> DataFrame:
    """The distinct pairs of all parts, merged within tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for x in b.column(0).to_pylist():
                held.append(_longs(x))
                n += len(held[-1])
                if n > GROUP_KEYS:
                    held = [np.unique(np.concatenate(held))]
                    if len(held[0]) * 2 > GROUP_KEYS:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0])], names=["key"])
                        held = []
                    n = sum(map(len, held))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)))], names=["key"])
    return materialise(partial.select("keys").mapInArrow(run, "key long").distinct())


def _counts(partial: DataFrame, hashes: DataFrame, shards: int, branches: int) -> DataFrame:
    """shard, counts: dense vectors by the hash's numbers."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, n, chunk = TaskContext.get().partitionId(), [], 0, 0

        def out() -> pa.RecordBatch:
            nonlocal held, n, chunk
            keys, counts = _merged([x for x, _ in held], [y for _, y in held])
            shard = _shard(keys, shards)
            order = np.argsort(shard, kind="stable")
            keys, counts, shard = keys[order], counts[order], shard[order]
            which, at = np.unique(shard, return_index=True)
            ends = [*at[1:].tolist(), len(keys)]
            branch = int(mix(np.array([task << 20 | chunk], np.uint64))[0] % np.uint64(branches))
            rows = [(int(s), branch, keys[i:j].tobytes(), counts[i:j].tobytes()) for s, i, j in zip(which, at.tolist(), ends)]
            held, n, chunk = [], 0, chunk + 1
            return _table("shard long, branch long, keys binary, counts binary", rows).combine_chunks().to_batches()[0]
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(x):
                    held.append((_longs(x), _longs(y)))
                    n += len(held[-1][0])
                if n > GROUP_KEYS:
                    yield out()
        if n:
            yield out()

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        h = right.to_pylist()[0]
        number, keys = PerfectHash.load(h["hash"]), _longs(h["keys"])
        total = np.zeros(len(keys), np.int64)
        for x, y in zip(left.column("keys").to_pylist(), left.column("counts").to_pylist()):
            at = number(_longs(x))
            if not np.array_equal(keys[at], _longs(x)):
                raise ValueError("a pair that the hash doesn't hold")
            total[at] += _longs(y)
        return _table("shard long, branch long, counts binary", [(h["shard"], h["branch"], total.tobytes())])

    def tree(t: pa.Table) -> pa.Table:
        total = sum(_longs(x) for x in t.column("counts").to_pylist())
        return _table("shard long, branch long, counts binary", [(t.column("shard")[0].as_py(), t.column("branch")[0].as_py(), total.tobytes())])
    schema = "shard long, branch long, counts binary"
    dealt = partial.select("keys", "counts").mapInArrow(deal, "shard long, branch long, keys binary, counts binary")
    spread = hashes.withColumn("branch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(branches - 1).cast("long"))))
    sums = dealt.groupBy("shard", "branch").cogroup(spread.groupBy("shard", "branch")).applyInArrow(add, schema)
    while branches > 1:
        branches = -(-branches // FAN)
        sums = sums.withColumn("branch", F.expr(f"branch div {FAN}")).groupBy("shard", "branch").applyInArrow(tree, schema)
    return materialise(sums.drop("branch"))


def _largest(totals: DataFrame, n_b: int) -> np.ndarray:
    """The largest count of each id of B: as many rows as B's vocabulary holds, at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros(n_b, np.int64)
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                np.maximum.at(top, _longs(x) & ((1 << _B_BITS) - 1), _longs(y))
        some = np.flatnonzero(top)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(top[some])], names=["b", "n"])
    top = np.zeros(n_b, np.int64)
    for r in totals.select("keys", "counts").mapInArrow(run, "b long, n long").groupBy("b").agg(F.max("n").alias("n")).collect():
        top[r["b"]] = r["n"]
    return top


def _answers(partial: DataFrame, totals: DataFrame, shards: int, branches: int) -> DataFrame:
    """part, keys, counts: the corpus-wide counts of each part's pairs, a row a shard."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys = _longs(x)
                shard = _shard(keys, shards)
                order = np.argsort(shard, kind="stable")
                which, at = np.unique(shard[order], return_index=True)
                branch = int(mix(np.array([part], np.uint64))[0] % np.uint64(branches))
                rows = [(int(s), branch, part, keys[order[i:j]].tobytes()) for s, i, j in zip(which, at.tolist(), [*at[1:].tolist(), len(keys)])]
                yield from _table("shard long, branch long, part long, keys binary", rows).to_batches()

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        h = right.to_pylist()[0]
        number, known, counts = PerfectHash.load(h["hash"]), _longs(h["keys"]), _longs(h["counts"])
        rows = []
        for part, x in zip(left.column("part").to_pylist(), left.column("keys").to_pylist()):
            at = number(_longs(x))
            if not np.array_equal(known[at], _longs(x)):
                raise ValueError("a pair that the hash doesn't hold")
            rows.append((part, x, counts[at].tobytes()))
        return _table("part long, keys binary, counts binary", rows)
    asked = partial.select("part", "keys").mapInArrow(ask, "shard long, branch long, part long, keys binary")
    spread = totals.withColumn("branch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(branches - 1).cast("long"))))
    return asked.groupBy("shard", "branch").cogroup(spread.groupBy("shard", "branch")).applyInArrow(answer, "part long, keys binary, counts binary")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False,
          part_bytes: int = PART_BYTES, shard_keys: int = SHARD_KEYS, group_keys: int = GROUP_KEYS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups)."""
    parts = _parts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), path_a, path_b, part_bytes, with_groups)
    partial = parts.where(F.col("keys").isNotNull()).select("part", "keys", "counts")
    pairs = _distinct(partial)
    shards = max(1, -(-pairs.count() // shard_keys))
    held = partial.agg(F.sum(F.length("keys") / 8).alias("n")).first()["n"] or 0
    branches = max(1, int(-(-held // (shards * group_keys))))
    hashes = _hashes(pairs, shards)
    counts = _counts(partial, hashes, shards, branches)
    totals = materialise(hashes.join(counts, "shard"))
    import sentencepiece
    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    top = _largest(totals, n_b)
    answers = _answers(partial, totals, shards, branches)
    schema = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
              + ", groups string" * with_groups)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        pair = shared_pair(path_a, path_b)
        known, count = (np.concatenate([_longs(x) for x in right.column(c).to_pylist()] or [np.zeros(0, np.int64)]) for c in ("keys", "counts"))
        order = np.argsort(known)
        known, count = known[order], count[order]
        whole = np.asarray(left.column("words").is_valid())
        words = left.column("words").filter(pa.array(whole)).to_pylist()
        docs = left.filter(pa.array(~whole))
        units, n_a, _, ids_a, ids_b = _load(words[0], 5)
        keys, links, *_ = pair.linked(ids_a, ids_b, n_a)
        at = np.searchsorted(known, keys)
        if len(keys) and not (at.max() < len(known) and np.array_equal(known[at], keys)):
            raise ValueError("a pair without a count")
        got = count[at]
        ends = np.concatenate([[0], np.cumsum(links)])
        each = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in (got == top[keys & ((1 << _B_BITS) - 1)], got)]
        best, sums = [], []
        for x in docs.column("units"):
            some = np.searchsorted(units, _numbers(x.as_py()))
            best.append(int(each[0][some].sum()))
            sums.append(int(each[1][some].sum()))
        names = [f.split()[0] for f in schema.split(", ")]
        new = {"n_best": pa.array(best, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
        return pa.table([new.get(n, docs.column(n) if n not in new else None) for n in names], names=names)
    asked = parts.select("part", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "units", "words")
    return asked.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(finish, schema)
