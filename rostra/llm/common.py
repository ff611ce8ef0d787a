"""Helpers of the training-data operators: tables, written intermediate tables, Arrow
text buffers, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

# Bytes of text that one vectorised step holds at once (arrays of 8 bytes a byte follow).
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` as a Parquet table in the shared checkpoint folder and read it back: cuts
    the lineage and survives lost executors. Used for tables that are small against the
    text (ids, hashes, links)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rostra-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` without columns that would clash with an operator's outputs (any case)."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null reads as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def texts(column) -> Iterator[str]:
    """The texts of an Arrow string column as Python strings, null as ''."""
    for x in column:
        v = x.as_py()
        yield v if v is not None else ""


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes (a longer text makes a range of its own)."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable ones stand for
    themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class IdPool:
    """Token ids of the units (words) seen so far, in one growing array."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def add(self, units: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        """New units, their ids one after another, and how many each has."""
        have, n = len(self.at), len(ids)
        while self.used + n > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while have + len(units) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.pool[self.used:self.used + n] = ids
        self.size[have:have + len(units)] = size
        self.start[have:have + len(units)] = self.used + np.cumsum(size) - size
        self.at.update(zip(units, range(have, have + len(units))))
        self.used += n

    def ids(self, units: list[str]) -> np.ndarray:
        """The ids of known units in a row."""
        return self.gather(np.array(list(map(self.at.__getitem__, units)), np.int64))

    def gather(self, i: np.ndarray) -> np.ndarray:
        """The ids of the units with some numbers, in a row."""
        size = self.size[i]
        end = np.cumsum(size)
        n = int(end[-1]) if len(end) else 0
        return self.pool[np.repeat(self.start[i] - (end - size), size) + np.arange(n)]


def long_schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


# Connected components ---------------------------------------------------------------------

def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its part) of one batch of links."""
    nodes, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = idx[:len(a)], idx[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _stamp(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")).first()
    return r["n"], r["h"]


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node that has a link, with the smallest node of its component.

    Alternating large and small stars: every round hangs nodes on smaller neighbours with
    grouped minima (partial sums before the shuffle) and joins that Spark can split by
    skew; links stay distributed and each round's links are a written table. The rounds
    grow with the logarithm of the longest chain. Empty links give an empty result."""
    e = (links.where(F.col(a) != F.col(b))
         .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    e = materialise(e)
    stamp = _stamp(e)
    while stamp[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        hang = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = low2.select("u", F.col("m").alias("v")).unionByName(hang).distinct()
        e = materialise(small)
        new = _stamp(e)
        if new == stamp:
            break
        stamp = new
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
