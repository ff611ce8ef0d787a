"""Reshaping long results at the edge (R01-R05). Long form is the default output;
pivots always take an explicit value list (from a small code table or the request)."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def pivot_wide(long: DataFrame, row_keys: Sequence[str], column: str, values: Sequence[Any],
               value: str = "n", fill: Any = 0) -> DataFrame:
    """Long -> wide: rows by `row_keys`, one column per value of `column`, missing -> 0.
    Duplicate (row, column) cells are summed (namesakes)."""
    wide = long.groupBy(*row_keys).pivot(column, list(values)).agg(F.sum(value))
    return wide.fillna(fill, subset=[str(v) for v in values])


def tabular(groups: DataFrame, counts: DataFrame, keys: Sequence[str], words: Sequence[str],
            value: str = "n") -> DataFrame:
    """One column per word next to the group keys, a row for every group (zeros kept).
    groups: one row per group (keys); counts: (keys..., token, n)."""
    cells = counts.where(F.col("token").isin(list(words)))
    wide = cells.groupBy(*keys).pivot("token", list(words)).agg(F.sum(value))
    return groups.select(*keys).join(wide, list(keys), "left").fillna(0, subset=list(words))


def n_top_frame(dtm: DataFrame, tokens: DataFrame, documents: Sequence[Any] | None = None) -> DataFrame:
    """The cells (token, document_id, n) of the given (top) tokens, of all documents or
    the given ones; long, as the number of documents has no bound."""
    cells = dtm.join(tokens.select("token"), "token", "left_semi")
    if documents is not None:
        cells = cells.where(F.col("document_id").isin(list(documents)))
    return cells.groupBy("token", "document_id").agg(F.sum("n").alias("n"))


def try_split_column(df: DataFrame, source: str, sep: str, targets: Sequence[str], drop_source: bool = True) -> DataFrame:
    """Split `source` in two at the first `sep`, row by row: a row that doesn't look like
    `x{sep}y` has nulls in both targets (keep the source then to see it)."""
    if source not in df.columns:
        return df
    fits = F.col(source).rlike(f".+{_re_escape(sep)}\\w+")
    parts = F.split(F.col(source), _re_escape(sep), 2)
    out = df.withColumn(targets[0], F.when(fits, F.get(parts, 0))).withColumn(targets[1], F.when(fits, F.get(parts, 1)))
    if drop_source and source not in targets:
        out = out.drop(source)
    return out


def _re_escape(s: str) -> str:
    import re

    return re.escape(s)


def as_label_map(long: DataFrame, key: str = "year", label: str = "label", value: str = "n") -> DataFrame:
    """Key -> map(label -> value). One map per key, bounded by the number of labels."""
    return long.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(label, F.col(value).cast("double"))))
                                 .alias("counts"))


def label_map_text(maps: DataFrame, key: str = "year") -> DataFrame:
    """R05 rendered as text 'label=value;...' sorted by label (for comparison and export)."""
    entries = F.array_sort(F.transform(F.map_entries("counts"),
                                       lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("bigint").cast("string"))))
    return maps.select(key, F.array_join(entries, ";").alias("counts"))


def drop_implicit_pivots(df: DataFrame, markers: Sequence[str] = ("gender_abbrev", "chamber_abbrev")) -> DataFrame:
    """Remove columns whose name contains an implicit pivot marker."""
    return df.drop(*[c for c in df.columns if any(m in c for m in markers)])
