"""Chat formatting with a prefix tree.

Conversations that share initial turns share nodes: a node is named by the chained hash of
the turns from the start. A node belongs to the smallest conversation through it, so the
nodes that a conversation owns are the tail of its path, its branch. Branches in the order
of their paths (owner after owner) are the depth-first order of the tree; each branch is
emitted once, at the running sum of the sizes before it. Every node carries its place in
the tree's sequence (`at`), the position ids of its place in the conversation (from
`position`), and the intervals of the sequence that it may attend to: its ancestors' and its
own branch up to itself; intervals that touch are one. Units are code points of the formatted text.

A turn is <|im_start|>role, newline, text, <|im_end|>, newline. Control strings of this and
other templates inside texts get a backslash after their first sign, and those that already
have backslashes there one more, so that taking one away gives the text back.

Turns are streamed in order within a partition, a conversation at a time, holding hashes
only, so a very long conversation is no group in memory. Running sums go by range
partitions first and totals then.

Defined results: a null text or role is empty; rows without conv_id form one conversation
without id; rows that repeat a turn number follow each other, ordered by role and text; identical
conversations share all nodes; other columns are ignored; empty tables give empty results."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

# Control strings of common chat templates, without their first sign
_CONTROL = r"(\|[A-Za-z_0-9]+\|>|/?s>|/?INST\]|</?SYS>>)"
_ESCAPE = re.compile(r"(<|\[)(\\*)" + _CONTROL)
_UNESCAPE = re.compile(r"(<|\[)\\(\\*)" + _CONTROL)
START, END = "<|im_start|>", "<|im_end|>"
NO_ID = -(1 << 63)
ASSISTANT = "assistant"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where its text lies in it."""
    head = START + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    body = escape(text)
    return head + body + END + "\n", len(head), len(head) + len(body)


def parse_turn(turn: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    role, _, rest = turn[len(START):].partition("\n")
    role = re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))
    return role, unescape(rest[:len(rest) - len(END) - 1])


_TURNS = ("cid long, depth int, key binary, root binary, start long, n long, turn string, loss_from long, loss_to long")


def _chain(turns: DataFrame) -> DataFrame:
    """Formatted turns with their node's name and place in the conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, root, depth, start = None, b"", b"", 0, 0
        for b in batches:
            rows = []
            for cid, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if cid != now:
                    now, key, root, depth, start = cid, b"", b"", 0, 0
                turn, lo, hi = format_turn(role, text)
                key = hashlib.blake2b(key + turn.encode(), digest_size=16).digest()
                root = root or key
                loss = (lo, hi) if role == ASSISTANT else (0, 0)
                rows.append((cid, depth, key, root, start, len(turn), turn, *loss))
                depth, start = depth + 1, start + len(turn)
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            cols = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=[f.split()[0] for f in _TURNS.split(", ")])
    return turns.repartition("cid").sortWithinPartitions("cid", "turn", "role", "text").select("cid", "role", "text").mapInArrow(run, _TURNS)


def prefix_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of conversations (conv_id, turn, role, text).

    nodes: tree, owner, depth, at, position, n, turn, loss_from, loss_to, attend.
    members: conv_id (cid: the same, never null), tree, runs of (owner, from_depth, nodes):
    the conversation is the first nodes of these owners' branches, one after another."""
    c = conversations
    turns = materialise(_chain(c.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("cid"), "turn",
                                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    owners = turns.groupBy("key").agg(F.min("cid").alias("owner"))
    path = turns.select("cid", "depth", "key", "root", "start", "n").join(owners, "key")
    runs = materialise(path.groupBy("cid", "owner").agg(
        F.min("depth").alias("from_depth"), F.count(F.lit(1)).alias("nodes"), F.min("start").alias("start"),
        F.sum("n").alias("size"), F.first("root").alias("tree")))
    way = runs.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("from_depth", "owner", (-F.col("nodes")).alias("short")))).alias("way"))
    branches = (runs.where("cid = owner").join(way, "cid")
                .select("cid", "tree", "start", "size", F.transform("way", lambda x: F.struct(x["owner"], x["short"])).alias("way")))
    dealt = materialise(branches.repartitionByRange("tree", "way").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("tree", "part").orderBy("way").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("tree", "part").agg(F.sum("size").alias("total"))  # a row a tree and partition
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("tree", "part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    branch = materialise(dealt.withColumn("inner", F.coalesce(F.sum("size").over(before), F.lit(0))).join(base, ["tree", "part"])
                         .select(F.col("cid").alias("owner"), "tree", "start", (F.col("base") + F.col("inner")).alias("at")))
    above = (runs.where("cid <> owner").select("cid", "owner", "from_depth", "size").join(branch.select("owner", "at"), "owner")
             .groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("from_depth", "at", "size"))).alias("above")))
    own = (turns.drop("root").join(owners, "key").where("cid = owner").drop("key", "cid").withColumnRenamed("start", "position")
           .join(branch, "owner").join(above.withColumnRenamed("cid", "owner"), "owner", "left"))
    here = F.col("at") + F.col("position") - F.col("start")
    spans = F.transform(F.coalesce("above", F.array().cast("array<struct<from_depth:int,at:bigint,size:bigint>>")),
                        lambda x: F.struct(x["at"].alias("lo"), (x["at"] + x["size"]).alias("hi")))
    whole = F.concat(spans, F.array(F.struct(F.col("at").alias("lo"), (here + F.col("n")).alias("hi"))))
    nodes = own.select(F.lower(F.hex("tree")).alias("tree"), "owner", "depth", here.alias("at"), "position", "n", "turn",
                       "loss_from", "loss_to", _joined(whole).alias("attend"))
    members = runs.groupBy("cid").agg(
        F.first(F.lower(F.hex("tree"))).alias("tree"),
        F.sort_array(F.collect_list(F.struct("from_depth", "owner", F.col("nodes").cast("int").alias("nodes")))).alias("runs"))
    return nodes, members.select(F.when(F.col("cid") != NO_ID, F.col("cid")).alias("conv_id"), "cid", "tree", "runs")


def _joined(spans: Column) -> Column:
    """Intervals (lo, hi) in order, those that touch as one."""
    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["lo"].alias("lo"), x["hi"].alias("hi"))))
        return F.when((F.size(done) > 0) & (last["hi"] == x["lo"]), longer).otherwise(F.concat(done, F.array(x)))
    return F.aggregate(spans, F.array().cast("array<struct<lo:bigint,hi:bigint>>"), add)


def places(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Per conversation its tree and runs, and of its own branch (zeros and nulls if it owns no
    node): nodes, start in the tree's sequence and in the conversation, sums of the nodes'
    places and position ids, number, summed starts and summed length of their intervals."""
    def total(of):
        return F.sum(F.aggregate("attend", F.lit(0).cast("long"), of))
    own = nodes.groupBy(F.col("owner").alias("cid")).agg(
        F.count(F.lit(1)).alias("own_nodes"), F.min("at").alias("own_at"), F.min("position").alias("own_position"),
        F.sum("at").alias("sum_at"), F.sum("position").alias("sum_position"), F.sum(F.size("attend")).alias("n_intervals"),
        total(lambda s, x: s + x["lo"]).alias("sum_lo"), total(lambda s, x: s + x["hi"] - x["lo"]).alias("attended"))
    return (members.withColumn("n_runs", F.size("runs")).join(own, "cid", "left").na.fill(0, ["own_nodes"])
            .select("conv_id", "tree", "n_runs", *own.columns[1:]))


_DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
           "n_shared long")


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from the tree's formatted nodes."""
    places = members.select("cid", F.explode("runs").alias("r")).select(
        "cid", F.col("r.owner").alias("owner"),
        F.explode(F.sequence(F.col("r.from_depth"), F.col("r.from_depth") + F.col("r.nodes") - 1)).alias("depth"))
    turns = places.join(nodes.select("owner", "depth", "turn", "loss_from", "loss_to"), ["owner", "depth"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        done: list[tuple] = []

        def close():
            if state:
                n, turns_sha, loss, loss_sha, size, shared = state
                done.append((None if now == NO_ID else now, n, turns_sha.hexdigest(), loss, loss_sha.hexdigest(), size, shared))

        def out():
            cols = list(zip(*done)) if done else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                               names=[f.split()[0] for f in _DIGEST.split(", ")])
            done.clear()
            return batch
        for b in batches:
            for cid, turn, lo, hi, owner in zip(*(b.column(i).to_pylist() for i in range(5))):
                if state is None or cid != now:
                    close()
                    now, state = cid, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, text = parse_turn(turn)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if hi > lo:
                    part = unescape(turn[lo:hi])
                    state[2] += len(part)
                    state[3].update(part.encode())
                state[4] += len(turn)
                state[5] += owner != cid
            yield out()
        close()
        yield out()
    return (turns.repartition("cid").sortWithinPartitions("cid", "depth")
            .select("cid", "turn", "loss_from", "loss_to", "owner").mapInArrow(run, _DIGEST))
