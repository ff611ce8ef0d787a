"""Exact duplicates by deterministic block naming.

A text, A-Z lower-cased, is cut into fixed-size blocks. Sorting the distinct blocks gives
each an integer name; adjacent names are paired and the distinct pairs sorted and named
again, until one integer is left for a text. Equal texts, and only they, end with equal
(number of blocks, name).

Blocks are sorted by a 64-bit hash instead of their bytes; that the hash tells all blocks
of this corpus apart is proved first by grouping (hash, bytes), and another seed is taken
if it doesn't. So the text is shuffled once, after map-side merging of copies, and the
rounds above move integers only.

Defined results: a null text is the empty text; a null id never stays if another row of
the group has an id; exactly one row of a group stays, also of rows that repeat its id or
have none (the first by row number), and each counts in group_size; an empty table gives
an empty result; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, utf8
from .words import LOWER

BLOCK_BYTES = 16384


def _blocks(text: bytes, size: int) -> list[bytes]:
    return [text[i:i + size] for i in range(0, len(text), size)] or [b""]


def _hashed(docs: DataFrame, size: int, seed: int) -> DataFrame:
    """Per row: id, its number, sha256 of the normalised text, hash of each block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(1))
            raw = LOWER[data].tobytes()
            sha, names = [], []
            for i in range(b.num_rows):
                t = raw[off[i]:off[i + 1]]
                sha.append(hashlib.sha256(t).hexdigest())
                names.append([xxhash.xxh64_intdigest(x, seed) - (1 << 63) for x in _blocks(t, size)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(sha, pa.string()), pa.array(names, pa.list_(pa.int64()))],
                names=["doc_id", "row", "text_sha256", "names"])
    return docs.mapInArrow(run, "doc_id long, row long, text_sha256 string, names array<long>")


def _clash(docs: DataFrame, size: int, seed: int) -> bool:
    """Whether two different blocks have one hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(1))
            raw = LOWER[data].tobytes()
            for lo in range(0, b.num_rows, 256):
                part = {x for i in range(lo, min(lo + 256, b.num_rows)) for x in _blocks(raw[off[i]:off[i + 1]], size)}
                part = list(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh64_intdigest(x, seed) - (1 << 63) for x in part], pa.int64()),
                     pa.array(part, pa.binary())], names=["h", "block"])
    blocks = docs.mapInArrow(run, "h long, block binary")
    return not blocks.distinct().groupBy("h").count().where("count > 1").isEmpty()


def _integer_names(keys: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct keys sorted over the cluster; `name` grows in their order."""
    return materialise(keys.select(*cols).distinct().repartitionByRange(*cols).sortWithinPartitions(*cols)
                       .withColumn("name", F.monotonically_increasing_id()))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
               seed: int = 0, row_col: str | None = None) -> DataFrame:
    """Per row of `docs`: doc_id, row, text_sha256, n_blocks, name; (n_blocks, name) is the identity. `row_col`:
    distinct numbers of the rows, else they are numbered."""
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row.alias("row"))
    while _clash(src, block_bytes, seed):
        seed += 1
    rows = materialise(_hashed(src, block_bytes, seed))
    done = None
    level = rows.select("row", F.size("names").alias("left"), F.posexplode("names").alias("pos", "key"))
    keys = ["key"]
    while True:
        named = _integer_names(level, keys)
        on = F.lit(True)
        for k in keys:
            on = on & level[k].eqNullSafe(named[k])
        level = materialise(level.join(named, on).select("row", "left", "pos", "name"))
        last = level.where("left = 1").select("row", "name")
        done = last if done is None else done.unionByName(last)
        rest = level.where("left > 1")
        if rest.isEmpty():
            break
        keys = ["a", "b"]
        level = (rest.groupBy("row", "left", F.floor(F.col("pos") / 2).alias("half"))
                 .agg(F.min_by("name", "pos").alias("a"), F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("b"))
                 .select("row", F.ceil(F.col("left") / 2).cast("int").alias("left"), F.col("half").alias("pos"), "a", "b"))
    return rows.join(done, "row").select("doc_id", "row", "text_sha256", F.size("names").alias("n_blocks"), "name")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     block_bytes: int = BLOCK_BYTES, row_col: str | None = None) -> DataFrame:
    """Per row: doc_id, keep_id (largest id of the equal texts), group_size, kept, text_sha256, row."""
    named = materialise(identities(docs, id_col, text_col, block_bytes, row_col=row_col))
    groups = named.groupBy("n_blocks", "name").agg(
        F.max(F.struct("doc_id", (-F.col("row")).alias("back"))).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    return named.join(groups, ["n_blocks", "name"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == -F.col("keep.back")).alias("kept"), "text_sha256", "row")
