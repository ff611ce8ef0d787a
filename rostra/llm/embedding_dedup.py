"""Near-duplicate vectors by a forest of random-projection trees.

Vectors are compared within one label and dimension. Equal vectors are merged first. Each
tree splits its nodes recursively at the median of the projection on a random direction
(one a tree and level; medians over all vectors of the node, by Spark for large nodes and within
a task for those of at most `GATHER` vectors); vectors within `spill` standard deviations that a
pair at the threshold may differ by go to both sides.
Within leaves all cosines are computed in double precision; a pair that shares several
leaves counts in the smallest of them only, so counts need no pair rows. Of the links only
spanning stars leave a task; components are their union over the cluster.

A node that splits can't make smaller (near-copies that spill to both sides) becomes a large
leaf: its vectors are dealt into blocks, and each pair of blocks is a task of its own, so
no pair is lost and no task holds more than two blocks.

Defined results: a vector that is null, empty, zero or holds null or non-finite values, a
null label or a null id has no links and is its own component; rows that repeat a vector
or an id count as vectors; other columns are ignored; empty tables give empty results."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, contract, materialise

THRESHOLD = 0.98
TREES = 4
LEAF = 1000
SPILL = 1.0
BLOCK = 1000
MAX_DEPTH = 40
GIVEN_UP = 0.9  # the share of a node on one side at which it is a leaf
GATHER = 100_000  # vectors of a node that one task splits
MOST_AHEAD = 16  # levels that projections are taken for at once


def directions(tree: int, level: int, dim: int) -> np.ndarray:
    v = np.random.default_rng([tree, level, dim]).standard_normal(dim)
    return v / np.linalg.norm(v)


def _lists(column) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(off[:-1], off[1:])]


def _matrix(column) -> list[np.ndarray]:
    return [x.astype(np.float64) for x in _lists(column)]


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit rows in double precision, scaled first so that squares stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _classes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their class's smallest id, rows that link with nothing)."""
    v = F.col("vec")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)
                      & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))
    return rows.where(good), rows.where(~good)


def _project(rows: DataFrame, level: int, depth: int) -> DataFrame:
    """Rows (label, dim, tree, node, rep, size, vec) with `p` for `vec`: the projections on their tree's directions of `depth` levels."""
    names = ["label", "dim", "tree", "node", "rep", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vec"))
            dim, tree = b.column("dim").to_numpy(), b.column("tree").to_numpy()
            p = np.zeros((len(x), depth), np.float32)
            for d, t in set(zip(dim.tolist(), tree.tolist())):
                at = np.flatnonzero((dim == d) & (tree == t))
                p[at] = _unit(np.stack([x[i] for i in at])) @ np.stack([directions(t, level + k, d) for k in range(depth)], 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * depth), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], lists], names=[*names, "p"])
    schema = T.StructType([*[rows.schema[c] for c in names], T.StructField("p", T.ArrayType(T.FloatType()))])
    return rows.select(*names, "vec").mapInArrow(run, schema)


def _split(p: np.ndarray, node: int, leaf: int, margin: float, room: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(node, its rows, whether it is a leaf): a node's parts after at most as many splits as `p` has columns, at the median."""
    open_ = [(node, 0, np.arange(len(p)))]
    while open_:
        node, at, rows = open_.pop()
        if len(rows) <= leaf or at == room:
            yield node, rows, True
        elif at == p.shape[1]:
            yield node, rows, False
        else:
            x = p[rows, at]
            half = (len(rows) - 1) // 2
            mid = np.partition(x, half)[half]
            low, high = x <= mid + margin, x > mid - margin
            if max(low.sum(), high.sum()) >= GIVEN_UP * len(rows):
                yield node, rows, True
            else:
                open_ += [(2 * node, at + 1, rows[low]), (2 * node + 1, at + 1, rows[high])]


def _leaves(classes: DataFrame, threshold: float, trees: int, leaf: int, spill: float, gather: int) -> DataFrame:
    """(rep, leaf): each class in its leaves of all trees. Rows carry their projections of the next levels. Nodes of more than
    `gather` vectors are split by Spark, a level at a time; a smaller one within a task, by as many levels as it has projections of."""
    node = ["label", "dim", "tree", "node"]
    sized = classes.select("label", F.size("vec").alias("dim"), "rep", "vec")
    sized = sized.join(sized.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size")), ["label", "dim"])
    key = F.xxhash64(*node).alias("leaf")
    root = F.lit(1).cast("long").alias("node")
    reach = spill * math.sqrt(2 - 2 * threshold)  # over the root of dim: what a pair differs by, typically
    # where one leaf holds all, further trees hold it again
    done = sized.where(F.col("size") <= leaf).select("label", "dim", F.lit(0).alias("tree"), root, "rep").select("rep", key)
    rows = sized.where(F.col("size") > leaf).select("label", "dim", F.explode(F.array(*map(F.lit, range(trees)))).alias("tree"), root, "rep", "size", "vec")
    largest, level = rows.agg(F.max("size")).first()[0], 0
    while largest is not None:
        # a side holds about 0.6 of its node, with what spills
        depth = min(MOST_AHEAD, MAX_DEPTH - level, max(1, math.ceil(math.log(largest / leaf, 1 / 0.6)) + 1))
        rows = materialise(_project(rows, level, depth))
        ready = []
        for at in range(depth + 1):
            ready.append(rows.where(F.col("size") <= gather).withColumn("at", F.lit(at)))
            rows = rows.where(F.col("size") > gather)
            if largest <= gather or at == depth:
                break
            p = F.col("p")[at]
            mid = rows.groupBy(*node).agg(F.percentile_approx(p, F.lit(0.5), F.lit(1000)).alias("mid"))
            m = F.lit(reach) / F.sqrt("dim")
            dealt = materialise(rows.join(mid, node).select(*node, "rep", "size", "p", (p <= F.col("mid") + m).alias("low"), (p > F.col("mid") - m).alias("high")))
            sides = dealt.groupBy(*node).agg(F.sum(F.col("low").cast("long")).alias("n_low"), F.sum(F.col("high").cast("long")).alias("n_high"))
            dealt = dealt.join(sides, node)
            # a split that leaves nine tenths on a side is given up: the node is a large leaf
            worth = F.greatest("n_low", "n_high") < GIVEN_UP * F.col("size")
            done = done.unionByName(dealt.where(~worth).select("rep", key))
            side = F.explode(F.filter(F.array(F.when(F.col("low"), F.struct(F.lit(0).alias("bit"), F.col("n_low").alias("size"))),
                                              F.when(F.col("high"), F.struct(F.lit(1).alias("bit"), F.col("n_high").alias("size")))),
                                      lambda x: x.isNotNull())).alias("side")
            rows = dealt.where(worth).select(*node, "rep", "p", side).select(
                "label", "dim", "tree", (F.col("node") * 2 + F.col("side.bit")).alias("node"), "rep", F.col("side.size").alias("size"), "p")
            largest = rows.agg(F.max("size")).first()[0] or 0
        schema = T.StructType([*[rows.schema[c] for c in (*node, "rep", "size")], T.StructField("leaf", T.BooleanType())])

        room = MAX_DEPTH - level

        def run(t: pa.Table) -> pa.Table:
            dim, first, at = (t.column(c)[0].as_py() for c in ("dim", "node", "at"))
            p = np.stack(_lists(t.column("p")))[:, at:]
            parts = list(_split(p, first, leaf, reach / math.sqrt(dim), room - at))
            size = np.array([len(r) for _, r, _ in parts])
            picked = t.select(["label", "dim", "tree", "rep"]).take(pa.array(np.concatenate([r for _, r, _ in parts])))
            each = lambda x, kind: pa.array(np.repeat(np.array(x), size), kind)
            out = dict(zip(picked.column_names, picked.columns)) | {
                "node": each([x for x, _, _ in parts], pa.int64()), "size": each(size, pa.int64()), "leaf": each([x for _, _, x in parts], pa.bool_())}
            return pa.table([out[c] for c in schema.names], names=schema.names)
        ready = functools.reduce(DataFrame.unionByName, ready)
        split = materialise(ready.groupBy(*node, "at").applyInArrow(run, schema))
        done = done.unionByName(split.where("leaf").select("rep", key))
        left = split.where("NOT leaf").drop("leaf").unionByName(rows.select(*node, "rep", "size"))
        level += depth
        if level >= MAX_DEPTH:
            return done.unionByName(left.select("rep", key))
        largest = left.agg(F.max("size")).first()[0]
        rows = left.join(classes.select("rep", "vec"), "rep")
    return done


def _near(x: np.ndarray, threshold: float, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs a < b of unit rows whose cosine reaches the threshold in double precision; single precision, with room for its
    error, picks them."""
    single, slack = x.astype(np.float32), 1e-6 + x.shape[1] * 2.0 ** -22
    found = [(np.zeros(0, np.int64),) * 2]
    for lo in range(0, len(x), step):
        a, b = np.nonzero(single[lo:lo + step] @ single[lo:].T >= threshold - slack)
        a, b = a[a < b] + lo, b[a < b] + lo
        for i in range(0, len(a), 1 << 16):
            u, v = a[i:i + (1 << 16)], b[i:i + (1 << 16)]
            keep = np.einsum("ij,ij->i", x[u], x[v]) >= threshold
            found.append((u[keep], v[keep]))
    a, b = (np.concatenate(c) for c in zip(*found))
    return a, b


def _compare(classes: DataFrame, leaves: DataFrame, threshold: float, block: int) -> DataFrame:
    """(a, b, w): star links (a, b, null) and, b null, w vectors linked with a."""
    keys = leaves.groupBy("rep").agg(F.array_sort(F.collect_set("leaf")).alias("keys"))  # a few a tree: they are the rows, too
    blocks = leaves.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    rows = (keys.join(classes.select("rep", "n", "vec"), "rep").withColumn("leaf", F.explode("keys")).join(blocks, "leaf").withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "n", "vec", "keys"))

    def run(t: pa.Table) -> pa.Table:
        leaf, i, j = (t.column(c)[0].as_py() for c in ("leaf", "i", "j"))
        own, rep, n = (t.column(c).to_numpy() for c in ("own", "rep", "n"))
        x = _unit(t.column("vec").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(rep), -1))  # one dimension a leaf
        keys = t.column("keys").combine_chunks()
        off, flat = keys.offsets.to_numpy(), keys.values.to_numpy()
        width = int(np.diff(off).max())
        pad = flat[np.minimum(off[:-1, None] + np.arange(width), off[1:, None] - 1)]
        a, b = _near(x, threshold)
        if i != j:
            a, b = (c[own[a] != own[b]] for c in (a, b))
        first = np.zeros(len(a), bool)
        for lo in range(0, len(a), 1 << 14):
            u, v = pad[a[lo:lo + (1 << 14)]], pad[b[lo:lo + (1 << 14)]]
            shared = np.where((u[:, :, None] == v[:, None, :]).any(axis=2), u, np.iinfo(np.int64).max)
            first[lo:lo + (1 << 14)] = shared.min(axis=1) == leaf
        w = np.bincount(a[first], n[b[first]], len(rep)) + np.bincount(b[first], n[a[first]], len(rep))
        some = np.flatnonzero(w)
        p, q = contract(rep[a], rep[b])
        return pa.table([pa.array(np.append(p, rep[some])), pa.array([*q.tolist(), *[None] * len(some)], pa.int64()),
                         pa.array([*[None] * len(p), *w[some].astype(np.int64).tolist()], pa.int64())], names=["a", "b", "w"])
    return rows.groupBy("leaf", "i", "j").applyInArrow(run, "a long, b long, w long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL,
                    block: int = BLOCK, gather: int = GATHER) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    good, alone = _classes(vectors, id_col, vec_col, label_col)
    classes = materialise(good.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
                          .select("label", "vec", F.col("rep"), "n"))
    # classes of different labels may share their smallest id where ids repeat: a number each
    classes = materialise(classes.withColumnRenamed("rep", "least").withColumn("rep", F.monotonically_increasing_id()))
    leaves = materialise(_leaves(classes, threshold, trees, leaf, spill, gather))
    found = materialise(_compare(classes, leaves, threshold, block))
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("w").alias("w"))
    comp = connected_components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("rep"), "root")
    rooted = classes.drop("vec").join(comp, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(rooted.join(least, "root").join(counts, "rep", "left")
                        .select("rep", (F.col("n") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"), "component_id"))
    by_class = classes.select("label", "vec", "rep").join(named, "rep")
    linked = good.join(by_class, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    own = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(own).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
