"""Token-sequence operators: pattern match, keyword in context, windows, n-grams,
documents with words (P06, P15, W01-W03, A11-A13, R07).

Tokens live in arrays on the speech row (`word`, `lemma`, optional `pos`; offset =
position). A match is found with `filter(sequence(0, size-k), i -> p0(t[i]) AND ...)`
on each row, so matching, KWIC slices and n-gram generation are narrow (no shuffle);
only the final grouping shuffles, after partial aggregation.

Matching never crosses a speech: each speech is one array. Context is clipped at the
speech edge.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import criteria_predicate

_REGEX_META = re.compile(r"[\\.^$|?*+()\[\]{}]")

TokenSpec = Mapping[str, Any]


def _value_predicate(x: Column, value: Any, ignore_case: bool) -> Column:
    """One token against a value: a literal or a (Java) regex, full match; a list is OR."""
    values = list(value) if isinstance(value, (list, tuple, set)) else [value]
    conds = []
    literals = [v for v in values if not _REGEX_META.search(str(v))]
    regexes = [v for v in values if _REGEX_META.search(str(v))]
    if literals:
        if ignore_case == "lower":  # the attribute is lower case already (lemmas)
            conds.append(x.isin([str(v).lower() for v in literals]))
        elif ignore_case:
            conds.append(F.lower(x).isin([str(v).lower() for v in literals]))
        else:
            conds.append(x.isin([str(v) for v in literals]))
    if regexes:
        flags = "(?iu)" if ignore_case in (True, "lower") else "(?u)"
        conds.append(x.rlike(flags + "^(?:" + "|".join(str(v) for v in regexes) + ")$"))
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def normalize_pattern(pattern: str | TokenSpec | Sequence[TokenSpec | str]) -> list[dict[str, Any]]:
    """A word, one spec or a list of specs -> list of {target, value, ignore_case}.
    A bare string means the default attribute `word`; empty values are not allowed."""
    if isinstance(pattern, (str, Mapping)):
        pattern = [pattern]
    specs = []
    for p in pattern:
        if isinstance(p, str):
            p = {"target": "word", "value": p}
        target = p.get("target") or "word"
        value = p.get("value")
        if value is None and target not in ("word", "lemma", "pos"):
            target, value = "word", target  # bare word given as target
        if value is None or (isinstance(value, (list, tuple)) and not value):
            raise ValueError("token pattern needs a value")
        specs.append({"target": target, "value": value, "ignore_case": p.get("ignore_case", True)})
    if not specs:
        raise ValueError("empty token pattern")
    return specs


def match_positions(pattern: str | TokenSpec | Sequence[TokenSpec | str]) -> tuple[Column, int]:
    """Array of 0-based start positions where the token pattern matches, and k."""
    specs = normalize_pattern(pattern)
    k = len(specs)
    first = specs[0]["target"]
    n = F.size(F.col(first))

    def case_mode(spec):
        # lemmas are stored lower-cased: a case-insensitive literal compares directly
        return "lower" if spec["ignore_case"] is True and spec["target"] == "lemma" else spec["ignore_case"]

    def hit(i: Column) -> Column:
        return reduce(lambda a, b: a & b, [
            F.coalesce(_value_predicate(F.get(F.col(s["target"]), i + j), s["value"], case_mode(s)),
                       F.lit(False))
            for j, s in enumerate(specs)])

    starts = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, hit), k


def match_tokens(speeches: DataFrame, pattern, criteria: Sequence[Mapping[str, Any]] | None = None,
                 keep: Sequence[str] = ()) -> DataFrame:
    """P06 as an operator: one row per match with its start `pos` and length `k`.

    Speech-level criteria are applied before the token scan (filter pushdown). Hit rows
    carry only `keep` columns, never the token arrays."""
    positions, k = match_positions(pattern)
    s = speeches.where(criteria_predicate(criteria)) if criteria else speeches
    return s.select(*keep, F.explode(positions).alias("pos")).withColumn("k", F.lit(k))


def _context(arr: Column, pos: Column, k: int, before: int, after: int) -> tuple[Column, Column, Column]:
    left = F.slice(arr, F.greatest(pos - before, F.lit(0)) + 1, F.least(F.lit(before), pos))
    node = F.slice(arr, pos + 1, F.lit(k))
    right = F.slice(arr, pos + k + 1, F.lit(after))
    return left, node, right


def _per_hit(speeches: DataFrame, pattern, criteria, keep: Sequence[str], make,
             positions: Column | None = None) -> DataFrame:
    """Explode one small struct per match, built inside the speech row by `make(pos)`,
    so the token arrays are read once per speech and never copied per hit."""
    if positions is None:
        positions, _ = match_positions(pattern)
    s = speeches.where(criteria_predicate(criteria)) if criteria else speeches
    hits = F.transform(positions, make)
    return s.select(*keep, F.explode(hits).alias("_h")).select(*keep, "_h.*")


def kwic(speeches: DataFrame, pattern, *, words_before: int = 3, words_after: int = 3, p_show: str = "word",
         criteria: Sequence[Mapping[str, Any]] | None = None, keep: Sequence[str] = ("document_id", "speech_id"),
         cut_off: int | None = None, hit_counts: DataFrame | None = None, positions: Column | None = None) -> DataFrame:
    """Left / node / right text of each match; with `cut_off`, exactly the first
    `cut_off` hits in corpus order (document_id, pos), the reference's hit cap.
    `hit_counts` (document_id, h) may supply the per-speech hit counts for the cut-off
    (e.g. from a stored DTM); they must count the same matches. `positions`: the starts of the
    matches, where postings have them. Empty results keep the columns."""
    k = len(normalize_pattern(pattern))
    arr = F.col(p_show)

    def make(p: Column) -> Column:
        left, node, right = _context(arr, p, k, words_before, words_after)
        return F.struct(p.alias("pos"), F.array_join(left, " ").alias("left_word"),
                        F.array_join(node, " ").alias("node_word"), F.array_join(right, " ").alias("right_word"))

    if cut_off is not None:
        speeches = speeches.where(criteria_predicate(criteria)) if criteria else speeches
        criteria = None
        counts = None if hit_counts is None else hit_counts.join(speeches.select("document_id"), "document_id",
                                                                 "left_semi")
        starts = match_positions(pattern)[0] if positions is None else positions
        speeches, positions = first_hits(speeches, starts, cut_off, counts=counts)
    return _per_hit(speeches, pattern, criteria, keep, make, positions)


# Buckets of document ids per refinement step when locating the n-th hit.
CUT_OFF_BUCKETS = 4096


def first_hits(speeches: DataFrame, positions: Column, n: int, buckets: int = CUT_OFF_BUCKETS,
               counts: DataFrame | None = None) -> tuple[DataFrame, Column]:
    """The speeches and match positions that hold exactly the first `n` hits in corpus
    order (document_id, then position), without sorting the hits.

    Hit counts per document-id bucket (a narrow `size` per speech, at most `buckets`
    rows to the driver per step) locate the bucket holding the n-th hit; the bucket is
    refined until it is one document d. Earlier speeches keep all their hits, d keeps
    its first r positions (positions are ascending), later speeches are filtered out
    (the filter reaches the scan). When there are at most n hits, nothing is cut."""
    doc = F.col("document_id")
    # per-speech hit counts: given (one row per speech with hits) or from the positions
    hits = counts.select("document_id", F.col("h")) if counts is not None \
        else speeches.select("document_id", F.size(positions).alias("h"))
    hits = hits.where(F.col("h") > 0)
    # the id range needs no matching: read it from the speech (or count) rows
    ranged = counts if counts is not None else speeches
    bounds = ranged.agg(F.min("document_id").alias("lo"), F.max("document_id").alias("hi")).first()
    if bounds is None or bounds["lo"] is None:
        return speeches, positions
    start, end, before = int(bounds["lo"]), int(bounds["hi"]) + 1, 0
    while True:
        width = -(-(end - start) // buckets)
        part = hits.where((doc >= start) & (doc < end))
        hist = part.select(F.floor((doc - start) / width).alias("b"), "h") \
            .groupBy("b").agg(F.sum("h").alias("h")).collect()
        found = None
        for row in sorted(hist, key=lambda r: r["b"]):
            if before + row["h"] >= n:
                found = int(row["b"])
                break
            before += row["h"]
        if found is None:  # at most n hits in total
            return speeches, positions
        start, end = start + found * width, min(end, start + (found + 1) * width)
        if width == 1:
            break
    d, r = start, n - before
    kept = speeches.where(doc <= d)
    return kept, F.when(doc < d, positions).otherwise(F.slice(positions, 1, r))


def windows(speeches: DataFrame, pattern, *, context: int | tuple[int, int], p_show: str = "word",
            criteria: Sequence[Mapping[str, Any]] | None = None) -> DataFrame:
    """A11 input: one row per match with its window tokens (`tokens` array and `window`
    text) and speech id. An int context c gives c // 2 on both sides."""
    before, after = (context // 2, context // 2) if isinstance(context, int) else context
    k = len(normalize_pattern(pattern))
    arr = F.col(p_show)

    def make(p: Column) -> Column:
        start = F.greatest(p - before, F.lit(0))
        length = (p - start) + F.lit(k) + F.least(F.lit(after), F.size(arr) - p - k)
        return F.struct(p.alias("pos"), F.slice(arr, start + 1, length).alias("tokens"),
                        (p - start).alias("offset"), F.lit(k).alias("k"))

    hits = _per_hit(speeches, pattern, criteria, ("document_id", "speech_id"), make)
    return hits.withColumn("window", F.array_join("tokens", " "))


def keyword_windows(win: DataFrame) -> DataFrame:
    """Identical windows grouped (case-sensitive): count and number of speeches.
    The speeches of each window are `window_documents` (long form)."""
    return win.groupBy("window").agg(F.count(F.lit(1)).alias("window_count"),
                                      F.count_distinct("speech_id").alias("n_documents"))


def window_documents(win: DataFrame) -> DataFrame:
    """A11 documents, long form: distinct (window, speech_id)."""
    return win.select("window", "speech_id").distinct()


def n_grams_of(arr: Column, n: int) -> Column:
    """All contiguous n-grams of a token array as text; none when shorter than n."""
    cnt = F.size(arr) - n + 1
    idx = F.when(cnt > 0, F.sequence(F.lit(1), cnt)).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, lambda i: F.array_join(F.slice(arr, i, n), " "))


def phrase_n_grams(phrase: Column, n: int) -> Column:
    """W02 on a phrase (split on whitespace)."""
    return n_grams_of(F.split(F.trim(phrase), r"\s+"), n)


def n_grams_covering(arr: Column, n: int, offset: Column, k: Column) -> Column:
    """The n-grams of `arr` whose span covers the match [offset, offset + k)."""
    cnt = F.size(arr) - n + 1
    idx = F.when(cnt > 0, F.sequence(F.lit(1), cnt)).otherwise(F.array().cast("array<int>"))
    idx = F.filter(idx, lambda i: (i - 1 <= offset) & (offset + k <= i - 1 + n))
    return F.transform(idx, lambda i: F.array_join(F.slice(arr, i, n), " "))


def ngram_rows(win: DataFrame, n: int, mode: str = "sliding", contains_phrase: bool = False) -> DataFrame:
    """One row per (match, n-gram occurrence): a repeated n-gram inside one window counts
    each time. Locked mode: the window is the n-gram. With `contains_phrase` only n-grams
    that cover the whole match are kept (a phrase with sliding context otherwise also
    yields n-grams holding only part of it)."""
    if mode == "sliding":
        grams = n_grams_covering(F.col("tokens"), n, F.col("offset"), F.col("k")) if contains_phrase \
            else n_grams_of(F.col("tokens"), n)
        return win.select("speech_id", F.explode(grams).alias("ngram"))
    return win.select("speech_id", F.col("window").alias("ngram"))


def compile_n_grams(win: DataFrame, *, n: int = 2, threshold: int | None = None, mode: str = "sliding",
                    contains_phrase: bool = False) -> DataFrame:
    """N-grams with window_count (sum of window counts, repeats counted) and the
    number of distinct speeches; `threshold` keeps window_count >= threshold."""
    rows = ngram_rows(win, n, mode, contains_phrase)
    g = rows.groupBy("ngram").agg(F.count(F.lit(1)).alias("window_count"),
                                  F.count_distinct("speech_id").alias("n_documents"))
    if threshold:
        g = g.where(F.col("window_count") >= threshold)
    return g


def ngram_documents(win: DataFrame, *, n: int = 2, threshold: int | None = None, mode: str = "sliding") -> DataFrame:
    """A12 documents, long form: distinct (ngram, speech_id) of n-grams passing the
    threshold. This is the `documents` list of the reference, one row per element."""
    rows = ngram_rows(win, n, mode)
    pairs = rows.select("ngram", "speech_id").distinct()
    if threshold:
        keep = rows.groupBy("ngram").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= threshold).select("ngram")
        pairs = pairs.join(keep, "ngram", "left_semi")
    return pairs


def n_gram_frame(n: int, k: int, mode: str) -> tuple[int | tuple[int, int], str]:
    """Context for the n-gram mode and the compile mode."""
    if mode == "sliding":
        return n, "sliding"
    if n - k < 0:
        raise ValueError("n must be at least the number of query terms")
    if mode.startswith("left"):
        return (0, n - k), "locked"
    if mode.startswith("right"):
        return (n - k, 0), "locked"
    raise ValueError(f"unknown n-gram mode {mode}")


def n_grams(speeches: DataFrame, pattern, *, n: int = 2, p_show: str = "word", threshold: int | None = None,
            mode: str = "sliding", criteria: Sequence[Mapping[str, Any]] | None = None) -> DataFrame:
    """W03 + A11 + A12: n-grams around the matches of a pattern."""
    k = len(normalize_pattern(pattern))
    context, compile_mode = n_gram_frame(n, k, mode)
    win = windows(speeches, pattern, context=context, p_show=p_show, criteria=criteria)
    return compile_n_grams(win, n=n, threshold=threshold, mode=compile_mode)


def with_document_lists(grouped: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Edge formatter for small results: attach the sorted, ','-joined speech ids.
    Only for results whose groups are known to be small (it collects per group)."""
    lists = documents.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("speech_id")), ",")
                                       .alias("documents"))
    return grouped.join(lists, key, "left")


def documents_as_list(documents: Column) -> Column:
    """The ','-joined documents text as an array."""
    return F.split(documents, ",")


def documents_with_words(speeches: DataFrame, terms: Sequence[str], array_col: str = "lemma",
                         keep: Sequence[str] = ("document_id",)) -> DataFrame:
    """Per document, the searched terms it contains, ','-joined in search-term order.

    One narrow expression per row: `array_intersect(terms, tokens)` keeps the order of the
    term list, drops duplicates and uses a hash set of the row's tokens - no explode, no
    shuffle."""
    ordered = list(dict.fromkeys(t for t in terms if t))
    wanted = F.array(*[F.lit(t) for t in ordered]) if ordered else F.array().cast("array<string>")
    found = F.array_intersect(wanted, F.col(array_col))
    return speeches.select(*keep, found.alias("_found")).where(F.size("_found") > 0) \
        .select(*keep, F.array_join("_found", ",").alias("node_word"))
