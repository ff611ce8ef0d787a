"""F06 with many terms: one Aho-Corasick machine, compiled once a worker and run over Arrow batches.

A text is read once, whatever the number of terms: at each place the longest term that starts first is
replaced, and reading goes on behind it. `whole_words` replaces only what isn't part of a longer run of
letters and digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TERMS = 500_000


class Machine:
    """Terms with their replacements; with `ignore_case` terms and texts are compared in lower case."""

    def __init__(self, table: dict[str, str], ignore_case: bool = False, whole_words: bool = False):
        import ahocorasick

        self.fold, self.whole = ignore_case, whole_words
        self.machine = ahocorasick.Automaton()
        for term, new in table.items():
            if term:
                term = _lower(term) if ignore_case else term
                self.machine.add_word(term, (len(term), new))
        self.empty = len(self.machine) == 0
        if not self.empty:
            self.machine.make_automaton()

    def _found(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, new) of all terms at any place."""
        for last, (n, new) in self.machine.iter(text):
            start, end = last - n + 1, last + 1
            if not self.whole or not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum()):
                yield start, end, new

    def __call__(self, text: str) -> str:
        if self.empty or not text:
            return text
        out, at = [], 0
        # the term that starts first, of these the longest; then on behind it
        for start, _, end, new in sorted((a, -b, b, n) for a, b, n in self._found(_lower(text) if self.fold else text)):
            if start >= at:
                out += [text[at:start], new]
                at = end
        return "".join([*out, text[at:]])


def _lower(text: str) -> str:
    """Lower case with as many characters."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


_MACHINES: dict[tuple, Machine] = {}


def replace_terms(df: DataFrame, text_col: str, substitutions: DataFrame, ignore_case: bool = False, whole_words: bool = False,
                  limit: int = TERMS) -> DataFrame:
    """`df` with the terms of `substitutions` (term, replacement) replaced in a text column. At most `limit` terms (checked);
    more raise an error, as a token-level join (`substitute_tokens`) has no such bound. Of a term that repeats (or
    folds to another) the smallest replacement counts. Null texts stay null."""
    rows = substitutions.select("term", "replacement").where("term <> ''").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} terms")
    table: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["term"], r["replacement"] or ""), reverse=True):
        table[_lower(r["term"]) if ignore_case else r["term"]] = r["replacement"] or ""
    shared = df.sparkSession.sparkContext.broadcast(table)  # at most `limit` rows
    at = df.columns.index(text_col)
    key = (shared.id if hasattr(shared, "id") else id(shared), ignore_case, whole_words)
    schema = T.StructType([T.StructField(f.name, T.StringType()) if i == at else f for i, f in enumerate(df.schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _MACHINES.get(key)
        if machine is None:
            _MACHINES.clear()
            machine = _MACHINES[key] = Machine(shared.value, ignore_case, whole_words)
        for b in batches:
            new = [None if x is None else machine(x) for x in b.column(at).to_pylist()]
            yield b.set_column(at, text_col, pa.array(new, pa.string()))
    return df.mapInArrow(run, schema)
