"""Exact top-n tokens (T01, T02, A15) without a shuffle of the vocabulary.

First pass: each task keeps a Space-Saving summary of at most `size` tokens. A token's count in a
summary is at least its true one and too high by at most its error; a token that isn't there has at most
the summary's least count. Summed over the tasks' summaries that gives every token a lower and an upper
bound. Second pass: tokens whose upper bound reaches the n-th largest lower bound are counted
exactly. If the n-th exact count is not above what any other token can have, the passes run again with
summaries of double size, at most until they hold all tokens. What is shuffled is bounded by summaries
and candidates, not by the vocabulary.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

SIZE = 20_000


class Summary:
    """Space-Saving: the token with the least count gives its place, and its count as error, to a new one."""

    def __init__(self, size: int):
        self.size, self.counts, self.errors, self.heap = size, {}, {}, []

    def add(self, token: str, n: int) -> None:
        counts = self.counts
        if token in counts:
            counts[token] += n
        elif len(counts) < self.size:
            counts[token], self.errors[token] = n, 0
            heapq.heappush(self.heap, (n, token))
        else:
            while True:  # entries of the heap are lower than the counts, or right
                low, old = self.heap[0]
                now = counts[old]
                if now == low:
                    break
                heapq.heapreplace(self.heap, (now, old))
            del counts[old], self.errors[old]
            counts[token], self.errors[token] = low + n, low
            heapq.heapreplace(self.heap, (low + n, token))

    @property
    def rest(self) -> int:
        """What a token that isn't held may have at most."""
        return min(self.counts.values()) if len(self.counts) >= self.size else 0


def summaries(tokens: DataFrame, size: int = SIZE) -> DataFrame:
    """(part, token, high, low) of each task, and at the token null its rest. tokens: token, n."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        kept = Summary(size)
        for b in batches:
            some = Counter()
            for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t is not None and n:
                    some[t] += n
            for t, n in some.items():
                kept.add(t, n)
        names = list(kept.counts)
        high = [kept.counts[t] for t in names]
        low = [kept.counts[t] - kept.errors[t] for t in names]
        part = [TaskContext.get().partitionId()] * (len(names) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([*names, None], pa.string()), pa.array([*high, kept.rest], pa.int64()),
                                          pa.array([*low, 0], pa.int64())], names=["part", "token", "high", "low"])
    return tokens.select("token", F.col("n").cast("long").alias("n")).mapInArrow(run, "part int, token string, high long, low long")


def bounds(held: DataFrame) -> tuple[DataFrame, int]:
    """(token, low, high) over all tasks, and what a token in no summary has at most."""
    rest = held.where("token IS NULL").agg(F.sum("high").alias("n")).first()["n"] or 0
    own = held.where("token IS NULL").select("part", F.col("high").alias("rest"))  # one row a task
    sums = held.where("token IS NOT NULL").join(own, "part").groupBy("token").agg(
        F.sum("low").alias("low"), F.sum(F.col("high") - F.col("rest")).alias("over"))
    return sums.select("token", "low", (F.col("over") + F.lit(rest)).alias("high")), rest


def top_n_exact(tokens: DataFrame, n: int, size: int = SIZE) -> DataFrame:
    """The n most frequent tokens (token, tf), ties by token; tokens: (token, n) rows, repeats added. At most n rows and
    the candidates' counts leave their tasks."""
    if n <= 0:
        return tokens.sparkSession.createDataFrame([], "token string, tf long")
    size = max(size, n)
    while True:
        held = stored(summaries(tokens, size))
        every, rest = bounds(held)
        every = stored(every)
        least = every.orderBy(F.desc("low")).limit(n).agg(F.min("low").alias("low"), F.count(F.lit(1)).alias("k")).first()
        floor = least["low"] if least["k"] == n else 0
        asked = every.where(F.col("high") >= floor)
        exact = stored(tokens.join(asked.select("token"), "token", "left_semi").groupBy("token").agg(F.sum("n").cast("long").alias("tf")))
        top = exact.orderBy(F.desc("tf"), "token").limit(n)
        last = top.agg(F.min("tf").alias("tf"), F.count(F.lit(1)).alias("k")).first()
        # tokens in no summary have at most `rest`; in a tie the smaller token counts, so it has to be below
        if rest == 0 or last["k"] == n and last["tf"] > rest:
            return top
        size *= 2
