"""Near-duplicates by SimHash and a generalised pigeonhole search in Hamming space.

A fingerprint is the bitwise majority of the XXH64 (seed 42) of a text's word shingles.
The 64 bits are grouped into m parts, correlated bits together. If the thresholds t_i >= -1
of the parts sum up to d - m + 1, two fingerprints at distance <= d agree on some part i
but for t_i bits. m and the t_i are chosen by dynamic programming over the candidates that
each (part, threshold) is expected to give, from bit counts over all fingerprints. A part
with threshold t is probed by masking out every choice of t of its bits; fingerprints with
equal masked values meet in a bucket, where the distance is verified.

Equal fingerprints are merged first. Of the links in buckets only spanning stars leave the
task. A bucket with more than `BUCKET_ROWS` fingerprints is split again by the pigeonhole
principle on the bits it doesn't agree on, over as many tasks, until it is small enough
(12 free bits leave at most 4,096 fingerprints), so no link is lost.

Defined results: null and empty texts and texts without words have fingerprint zero and
link like others; rows that repeat an id or have none each get a row; component_id is
the smallest id that is not null; an empty table gives an empty result."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, connected_components, contract, long_schema, materialise, utf8
from .words import LOWER, SPACE, spans

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
BUCKET_ROWS = 4096
_LANES = np.uint64(0x0001000100010001)


def _shingle_hashes(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles of the texts, and each text's number of shingles."""
    data = LOWER[data]
    starts, ends, first = spans(data, off)
    hashes, counts = [], np.zeros(len(off) - 1, np.int64)
    digest = xxhash.xxh64_intdigest
    # each space character becomes 0x20, and only the first of a run stays: shingles are slices
    space = SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    flat = np.where(space, np.uint8(32), data)[keep].tobytes()
    moved = np.concatenate([[0], np.cumsum(keep)])
    b, e = moved[starts], moved[ends]
    for i in range(len(off) - 1):
        lo, hi = first[i], first[i + 1]
        n = hi - lo
        if n == 0:
            continue
        if n < k:
            counts[i] = 1
            hashes.append(digest(flat[b[lo]:e[hi - 1]], 42))
        else:
            counts[i] = n - k + 1
            hashes += [digest(flat[x:y], 42) for x, y in zip(b[lo:hi - k + 1].tolist(), e[lo + k - 1:hi].tolist())]
    return np.array(hashes, np.uint64), counts


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The majority bits of each text's hashes, from 16-bit counters of four bits at a time."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    begin = np.concatenate([[0], np.cumsum(n)[:-1]])
    pieces = [np.arange(b, b + c, 65535) for b, c in zip(begin, n)] if n.max() > 65535 else None
    cuts = np.concatenate(pieces) if pieces else begin
    owner = np.repeat(np.arange(len(n)), [len(p) for p in pieces]) if pieces else np.arange(len(n))
    for shift in range(16):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, cuts)
        for lane in range(4):
            c = ((lanes >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64)
            total = np.bincount(owner, c, len(n)).astype(np.int64) if pieces else c
            out[some] |= (2 * total > n).astype(np.uint64) << np.uint64(16 * lane + shift)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE_WORDS, row_col: str | None = None) -> DataFrame:
    """Per row: doc_id, fp (the 64 bits as a long), and its number if `row_col` names one."""
    row = [F.col(row_col).cast("long").alias("row")] if row_col else []
    names = ["doc_id", "fp"] + ["row"] * len(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(1))
            got = [_majority(*_shingle_hashes(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], shingle))
                   for lo, hi in chunks(off)]
            fp = np.concatenate(got) if got else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], names=names)
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *row)
            .mapInArrow(run, "doc_id long, fp long" + ", row long" * len(row)))


# Parts and thresholds -----------------------------------------------------------------------

def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both bits i and j set, over all of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((64, 64), np.int64)
        for b in batches:
            x = b.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(x), 1 << 16):
                bits = ((x[lo:lo + (1 << 16), None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
                both += (bits.T @ bits).astype(np.int64)
                n += len(bits)
        i, j = np.divmod(np.arange(64 * 64), 64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(both.ravel(), n))],
            names=["i", "j", "n"])
    rows = fps.select("fp").mapInArrow(run, long_schema("i", "j", "n")).groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((64, 64)), 0
    for r in rows:
        if r["i"] < 0:
            n = r["n"]
        else:
            both[r["i"], r["j"]] = r["n"]
    return n, both


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of 64 / m bits: each takes the free bit of most variance, then the free bits
    most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    free, out = set(range(64)), []
    for g in range(m):
        size = 64 // m + (g < 64 % m)
        part = [max(sorted(free), key=lambda b: sd[b])]
        free.discard(part[0])
        while len(part) < size:
            b = max(sorted(free), key=lambda x: corr[x, part].sum())
            part.append(b)
            free.discard(b)
        out.append(sorted(part))
    return out


def allocate(n: int, both: np.ndarray, distance: int = MAX_DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part used, at the least expected work: masked values written
    plus pairs compared."""
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    best: tuple[float, list] = (math.inf, [])
    for m in range(1, distance + 2):
        parts = group_bits(n, both, m)
        cost = []
        for bits in parts:
            at = np.zeros(distance + 2)
            at[0] = 1.0  # chance that two fingerprints differ in so many bits of the part
            for b in bits:
                at[1:] = at[1:] * (1 - differ[b]) + at[:-1] * differ[b]
                at[0] *= 1 - differ[b]
            cost.append([0.0] + [n * math.comb(len(bits), t) + n * n / 2 * at[:t + 1].sum() for t in range(distance + 1)])
        # table[s]: least cost and thresholds of the parts so far, that sum up to s - m
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in cost:
            new: dict[int, tuple[float, list[int]]] = {}
            for s, (x, ts) in table.items():
                for t in range(-1, distance + 1):
                    key, val = s + t + 1, (x + c[t + 1], ts + [t])
                    if key <= distance + 1 and (key not in new or val[0] < new[key][0]):
                        new[key] = val
            table = new
        total, ts = table[distance + 1]
        if total < best[0]:
            best = (total, [(bits, t) for bits, t in zip(parts, ts) if t >= 0])
    return best[1]


def _as_long(bits) -> int:
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def masks_of(parts: list[tuple[list[int], int]]) -> list[int]:
    return [_as_long(set(bits) - set(out)) for bits, t in parts for out in combinations(bits, t)]


def _split(mask: int, distance: int) -> list[int]:
    """Masks that split a bucket of `mask` further: its free bits dealt into distance + 1 parts."""
    free = [b for b in range(64) if not (mask >> b) & 1]
    held = [b for b in range(64) if (mask >> b) & 1]
    return [_as_long(held + free[i::distance + 1]) for i in range(distance + 1)]


# Probe and verify ---------------------------------------------------------------------------

def _bucket_links(mask: np.ndarray, key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links of the sorted rows: neighbours k = 1, 2, ... rows on, while in one bucket."""
    a, b = [], []
    at = np.arange(len(fp) - 1)
    k = 1
    while len(at):
        at = at[at + k < len(fp)]
        at = at[(mask[at] == mask[at + k]) & (key[at] == key[at + k])]
        hit = at[np.bitwise_count(fp[at] ^ fp[at + k]) <= distance]
        a.append(fp[hit])
        b.append(fp[hit + k])
        k += 1
        if sum(map(len, a)) > 1 << 20:
            x, y = contract(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))
            a, b = [x.view(np.uint64)], [y.view(np.uint64)]
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return contract(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))


def _verify(rows: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) within buckets; rows: mask, key, fp. Buckets arrive sorted, so a batch holds
    whole buckets but for its last one, which waits for the next batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait = [np.zeros(0, np.int64)] * 3
        for batch in _and_end(batches):
            if batch is not None:
                cols = [np.concatenate([w, batch.column(i).to_numpy()]) for i, w in enumerate(wait)]
                if not len(cols[0]):
                    continue
                same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
                cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
                wait = [c[cut:] for c in cols]
                cols = [c[:cut] for c in cols]
            else:
                cols, wait = wait, [np.zeros(0, np.int64)] * 3
            x, y = _bucket_links(cols[0], cols[1], cols[2].view(np.uint64), distance)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
    dealt = rows.repartition("mask", "key").sortWithinPartitions("mask", "key")
    return dealt.select("mask", "key", "fp").mapInArrow(run, long_schema("a", "b"))


def _and_end(batches):
    yield from batches
    yield None


def link_fingerprints(fps: DataFrame, distance: int = MAX_DISTANCE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that join all that lie within
    `distance` bits: star links of each bucket, not all pairs."""
    n, both = bit_counts(fps)
    masks = masks_of(allocate(n, both, distance))
    rows = fps.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
    rows = rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    parts = []
    while True:
        sizes = rows.groupBy("mask", "key").count()
        big = materialise(sizes.where(F.col("count") > bucket_rows).select("mask", "key"))
        found = [r["mask"] for r in big.select("mask").distinct().collect()]  # masks, never keys
        if not found:
            parts.append(_verify(rows, distance))
            break
        parts.append(_verify(rows.join(big, ["mask", "key"], "left_anti"), distance))
        finer = F.create_map(*[x for m in found for x in (F.lit(m).cast("long"), F.array(*[F.lit(s).cast("long") for s in _split(m, distance)]))])
        rows = materialise(rows.join(big, ["mask", "key"], "left_semi")
                           .select("fp", F.explode(finer[F.col("mask")]).alias("mask"))
                           .select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp").distinct())
    links = parts[0]
    for p in parts[1:]:
        links = links.unionByName(p)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS,
                    distance: int = MAX_DISTANCE, row_col: str | None = None) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable over
    links of at most `distance` bits). With `row_col` (distinct numbers of the rows) also row and
    kept: one row of each component stays, of those with the smallest id the first."""
    prints = materialise(fingerprints(docs, id_col, text_col, shingle, row_col))
    row = F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")) if row_col else F.lit(None)
    first = [F.struct(F.min(F.col("doc_id").isNull()).alias("none"), F.min("doc_id").alias("id"), row.alias("row")).alias("first")]
    classes = materialise(prints.groupBy("fp").agg(*first))
    comp = connected_components(link_fingerprints(classes.select("fp"), distance))
    rooted = classes.join(comp, classes["fp"] == comp["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("least")), "root").select("fp", "least")
    extra = ["row", (F.col("row") == F.col("least.row")).alias("kept")] if row_col else []
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.id").alias("component_id"), *extra)
