"""Document-term matrix operators on long tables.

A corpus is two tables: `dtm(document_id, token, n)` (sparse cells only, zeros are
absent) and `index(document_id, ...)` (one row per document). Every operator returns
new DataFrames; nothing is collected except label lists of small code tables.

Rows covered: A01-A10, A14, A15, A17, A19, A20, T01-T03, T05, U01, U02, J07-J11,
J15, J16, P08, P10-P12, S15, S16, W05, W06.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import temporal_key
from ..session import BROADCAST_ROW_LIMIT, stored, with_scalars
from .indexes import distinct_ids, row_counts
from .packed_cells import cells_with_ids, held_cells
from .predicates import predicate

COUNT_COLUMNS = ("n_tokens", "n_raw_tokens", "tokens")


@dataclass(frozen=True)
class DTMCorpus:
    dtm: DataFrame
    index: DataFrame
    key: str = "document_id"

    def with_dtm(self, dtm: DataFrame) -> "DTMCorpus":
        return DTMCorpus(dtm, self.index, self.key)


# --------------------------------------------------------------------------------
# Building (S15, S16, A17, W05)
# --------------------------------------------------------------------------------

def dtm_from_tokens(tokens: DataFrame, *, doc_col: str = "document_id", token_col: str = "token", min_tf: int = 1,
                    max_tokens: int | None = None) -> DataFrame:
    """(document_id, token) rows -> (document_id, token, n). `min_tf` keeps tokens that occur so
    often in all, `max_tokens` then the most frequent ones (ties by token)."""
    cells = tokens.groupBy(doc_col, token_col).agg(F.count(F.lit(1)).alias("n"))
    return _cut(cells, doc_col, token_col, min_tf, max_tokens)


def _cut(cells: DataFrame, doc_col: str, token_col: str, min_tf: int, max_tokens: int | None) -> DataFrame:
    if min_tf <= 1 and max_tokens is None:
        return cells
    cells = stored(cells)  # read for the frequencies and for the cells
    tf = cells.groupBy(token_col).agg(F.sum("n").alias("tf")).where(F.col("tf") >= min_tf)
    if max_tokens is not None:
        tf = tf.orderBy(F.desc("tf"), token_col).limit(max_tokens)
    return cells.join(tf.select(token_col), token_col, "left_semi").select(doc_col, token_col, "n")


def dtm_from_token_arrays(speeches: DataFrame, array_col: str = "lemma", min_tf: int = 1, max_tokens: int | None = None) -> DataFrame:
    """S15 of a token array a row. Where each row has an id of its own, cells are counted within the row and aren't shuffled; ids
    that repeat or are null are added up by a shuffle."""
    if distinct_ids(speeches):
        return _cut(row_counts(speeches, array_col, ["document_id"]), "document_id", "token", min_tf, max_tokens)
    return dtm_from_tokens(speeches.select("document_id", F.explode(array_col).alias("token")), min_tf=min_tf, max_tokens=max_tokens)


def to_bag_of_terms(dtm: DataFrame) -> DataFrame:
    """One row per token occurrence (integer counts only)."""
    return dtm.select("document_id", F.explode(F.array_repeat("token", F.col("n").cast("int"))).alias("token"))


def dense_ids(df: DataFrame, order: Sequence[str | Column], id_col: str = "id", start: int = 0, width: str | None = None) -> DataFrame:
    """Dense ids start..start+n-1 in `order`, without a global unpartitioned window. `width` names a column of how many ids a
    row takes: it gets the first of them.

    Range-partition and sort, checkpoint (so ids stay stable if tasks are recomputed),
    count rows per partition, and join each row with its partition's offset: a running sum
    over one small row per partition.
    """
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).checkpoint(eager=True)
    mid = F.monotonically_increasing_id()
    tagged = ordered.withColumn("_mid", mid).withColumn("_part", F.shiftright("_mid", 33))
    counts = tagged.groupBy("_part").agg((F.count(F.lit(1)) if width is None else F.sum(width)).alias("_c"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"))
    row_in_part = F.col("_mid") - F.shiftleft("_part", 33)
    if width is not None:
        row_in_part = F.coalesce(F.sum(width).over(Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a shuffle partition
    return tagged.join(F.broadcast(offsets), "_part") \
        .withColumn(id_col, (F.col("_offset") + row_in_part + start).cast("bigint")).drop("_mid", "_part", "_offset")


def is_strictly_increasing(df: DataFrame, col: str = "document_id", start: int = 0) -> DataFrame:
    """W05 check: ids are exactly start..start+n-1. One row with a boolean `ok`."""
    return df.agg(
        ((F.min(col) == start) & (F.max(col) == F.count(F.lit(1)) + start - 1)
         & (F.count_distinct(col) == F.count(F.lit(1)))).alias("ok"))


def vocabulary(dtm: DataFrame, with_ids: bool = False) -> DataFrame:
    """Vocabulary with tf; ids (optional) ordered by (tf desc, token)."""
    vocab = dtm.groupBy("token").agg(F.sum("n").alias("tf"))
    if with_ids:
        vocab = dense_ids(vocab, [F.col("tf").desc(), F.col("token")], id_col="token_id")
    return vocab


def frequencies(items: DataFrame, col: str) -> DataFrame:
    """A17 `frequencies`: count of each item."""
    return items.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------------
# Sums (A09, A10, A14, A15, A20)
# --------------------------------------------------------------------------------

def term_frequency(dtm: DataFrame, vocab_override: DataFrame | None = None) -> DataFrame:
    """(token, tf); with an override table (token, override_tf) its values win."""
    tf = dtm.groupBy("token").agg(F.sum("n").alias("tf"))
    if vocab_override is not None:
        tf = tf.join(vocab_override.select("token", "override_tf"), "token", "left") \
            .select("token", F.coalesce("override_tf", "tf").alias("tf"))
    return tf


def word_vector(dtm: DataFrame, index: DataFrame, word: str) -> DataFrame:
    """A09 `get_word_vector`: a word's count in every document, zeros included."""
    cells = dtm.where(F.col("token") == word).select("document_id", "n")
    return index.select("document_id").join(cells, "document_id", "left") \
        .select("document_id", F.coalesce("n", F.lit(0)).alias("n"))


def document_token_counts(dtm: DataFrame) -> DataFrame:
    """A10: row sums."""
    return dtm.groupBy("document_id").agg(F.sum("n").alias("n_tokens"))


def update_counts_by_corpus(index: DataFrame, dtm: DataFrame) -> DataFrame:
    """A10: fill n_tokens / n_raw_tokens from row sums when the index lacks them."""
    if "n_tokens" in index.columns and "n_raw_tokens" in index.columns:
        return index
    sums = document_token_counts(dtm)
    out = index.join(sums.withColumnRenamed("n_tokens", "_rs"), "document_id", "left")
    for c in ("n_tokens", "n_raw_tokens"):
        if c not in index.columns:
            out = out.withColumn(c, F.coalesce("_rs", F.lit(0)).cast("bigint"))
    return out.drop("_rs")


def year_range(index: DataFrame) -> DataFrame:
    """(min_year, max_year)."""
    return index.agg(F.min("year").alias("min_year"), F.max("year").alias("max_year"))


def corpus_stats(dtm: DataFrame, index: DataFrame, n_top: int = 10) -> DataFrame:
    """Documents, vocabulary size, total count and the n most frequent tokens."""
    tf = term_frequency(dtm)
    top = top_n_words(tf, n_top).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("tf") * -1, "token"))),
                                 lambda x: x["token"]), " ").alias("top_tokens"))
    totals = tf.agg(F.count(F.lit(1)).alias("vocabulary_size"), F.sum("tf").alias("n_tokens"))
    docs = index.agg(F.count(F.lit(1)).alias("n_documents"))
    # three single-row aggregates side by side
    return with_scalars(with_scalars(docs, totals), top)


def documents_count(co_occurrences: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Distinct documents behind (a partition of) a co-occurrence table."""
    return co_occurrences.groupBy(*group_cols).agg(F.count_distinct("document_id").alias("n_documents"))


# --------------------------------------------------------------------------------
# Grouping (A01-A08, U02)
# --------------------------------------------------------------------------------

def _index_aggregates(index: DataFrame, keys: Sequence[str]) -> list[Column]:
    aggs = [F.sum(c).cast("bigint").alias(c) for c in COUNT_COLUMNS if c in index.columns]
    if "year" in index.columns and "year" not in keys:
        aggs.append(F.min("year").alias("year"))
    if "n_documents" in index.columns:
        aggs.append(F.sum("n_documents").cast("bigint").alias("n_documents"))
    else:
        aggs.append(F.count_distinct("document_id").alias("n_documents"))
    return aggs


def _group(corpus: DataFrame, cell_index: DataFrame, keys: list[str], aggregate: str,
           gindex: DataFrame) -> DataFrame:
    cells = corpus.join(cell_index, "document_id", "inner")
    g = cells.groupBy(*keys, "token").agg(F.sum("n").alias("n"))
    if aggregate == "mean":
        g = g.join(gindex.select(*keys, "n_documents"), keys, "inner") \
            .select(*keys, "token", (F.col("n") / F.col("n_documents")).alias("n"))
    elif aggregate != "sum":
        raise ValueError(f"aggregate must be sum or mean, not {aggregate}")
    return g


def group_by_keys(corpus: DTMCorpus, keys: Sequence[str], aggregate: str = "sum",
                  filter_opts: Mapping[str, Any] | None = None, key_exprs: Mapping[str, Column] | None = None
                  ) -> DTMCorpus:
    """A01/A02/A04 core: sum (or mean over all documents of the group, zeros included)
    of term counts per group key; the index side gets count sums, min year, n_documents
    and a document_name of the keys joined by '_'.

    The filter is always applied (the reference applies it only with pivot keys).
    """
    keys = list(keys)
    index = corpus.index
    if filter_opts:
        index = index.where(predicate(index.columns, filter_opts))
    for name, expr in (key_exprs or {}).items():
        index = index.withColumn(name, expr)
    gindex = index.groupBy(*keys).agg(*_index_aggregates(index, keys))
    gindex = gindex.withColumn("document_name", F.concat_ws("_", *[F.col(k).cast("string") for k in keys]))
    cell_index = index.select("document_id", *keys)
    g = _group(corpus.dtm, cell_index, keys, aggregate, gindex)
    return DTMCorpus(g, gindex, key=",".join(keys))


def group_by_pivot_keys(corpus: DTMCorpus, temporal_key_spec: Any = "year", pivot_keys: Sequence[str] = (),
                        filter_opts: Mapping[str, Any] | None = None, aggregate: str = "sum",
                        fill_gaps: bool = False, target: str = "time_period") -> DTMCorpus:
    """Group by (temporal key x pivot keys)."""
    g = group_by_keys(corpus, [target, *pivot_keys], aggregate, filter_opts,
                      key_exprs={target: temporal_key(F.col("year"), temporal_key_spec)})
    if fill_gaps:
        step = {"lustrum": 5, "decade": 10}.get(temporal_key_spec, 1) if isinstance(temporal_key_spec, str) else 1
        g = DTMCorpus(g.dtm, fill_temporal_gaps(g.index, target, list(pivot_keys), step), g.key)
    return g


def group_by_column(corpus: DTMCorpus, column: str, aggregate: str = "sum", fill_gaps: bool = False,
                    fill_steps: int = 1, target: str = "category") -> DTMCorpus:
    """A02 (A03 with column='year', fill_gaps=True)."""
    g = group_by_keys(corpus, [target], aggregate, key_exprs={target: F.col(column)})
    if fill_gaps:
        g = DTMCorpus(g.dtm, fill_temporal_gaps(g.index, target, [], fill_steps), g.key)
    return g


def group_by_year(corpus: DTMCorpus, aggregate: str = "sum", fill_gaps: bool = True,
                  target: str = "category") -> DTMCorpus:
    """A03."""
    return group_by_column(corpus, "year", aggregate, fill_gaps, 1, target)


def group_by_temporal_key(corpus: DTMCorpus, spec: Any, aggregate: str = "sum", fill_gaps: bool = False,
                          target: str = "time_period") -> DTMCorpus:
    """Year / lustrum / decade / dict / Column function."""
    if fill_gaps and spec != "year":
        raise ValueError("fill_gaps is only supported for temporal key 'year'")
    return group_by_pivot_keys(corpus, spec, (), None, aggregate, fill_gaps, target)


def group_by_mapping(corpus: DTMCorpus, mapping: DataFrame, aggregate: str = "sum") -> DTMCorpus:
    """Mapping table (group_id, document_id); a document may belong to several groups."""
    index = corpus.index.join(mapping, "document_id", "inner")
    gindex = index.groupBy("group_id").agg(*_index_aggregates(index, ["group_id"]))
    g = _group(corpus.dtm, mapping.select("document_id", "group_id"), ["group_id"], aggregate, gindex)
    return DTMCorpus(g, gindex, key="group_id")


def fill_temporal_gaps(gindex: DataFrame, key: str, pivot_keys: Sequence[str], step: int = 1) -> DataFrame:
    """One zero row per missing period between min and max (not per pivot value)."""
    bounds = gindex.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    spine = bounds.select(F.explode(F.sequence("lo", "hi", F.lit(step).cast(
        gindex.schema[key].dataType))).alias(key))
    missing = spine.join(gindex.select(key).distinct(), key, "left_anti")
    sep = "_" if pivot_keys else ""
    fill = {}
    for f in gindex.schema.fields:
        if f.name == key:
            continue
        if f.name == "document_name":
            fill[f.name] = F.concat(F.col(key).cast("string"), F.lit(sep + sep.join(["0"] * len(pivot_keys))))
        else:
            fill[f.name] = F.lit(0).cast(f.dataType) if f.dataType.simpleString() != "string" else F.lit("0")
    rows = missing.select(F.col(key), *[v.alias(k) for k, v in fill.items()])
    return gindex.unionByName(rows)


def index_group_by_column(index: DataFrame, column: str, transformer: Column | None = None,
                          index_values: DataFrame | None = None, target: str = "category") -> DataFrame:
    """Index-only grouping: count sums, year min/max, n_documents; with a value
    domain (`index_values` one column `target`) missing values come back with nulls."""
    keyed = index.withColumn(target, transformer if transformer is not None else F.col(column))
    aggs = [F.sum(c).cast("bigint").alias(c) for c in COUNT_COLUMNS if c in index.columns]
    if "year" in index.columns:
        aggs += [F.min("year").alias("year_from"), F.max("year").alias("year_to")]
    aggs.append(F.count(F.lit(1)).alias("n_documents"))
    g = keyed.groupBy(target).agg(*aggs)
    if index_values is not None:
        g = index_values.select(target).join(g, target, "left")
    return g


def index_group_by_temporal_key(index: DataFrame, spec: Any, source: str = "year",
                                target: str = "time_period") -> tuple[DataFrame, DataFrame]:
    """A06 by period plus the members of each group, as a long table
    (time_period, document_id) instead of a list column: a period may hold a large
    share of all documents."""
    keyed = index.withColumn(target, temporal_key(F.col(source), spec))
    return index_group_by_column(keyed, target), keyed.select(target, "document_id")


def count_documents_by_pivot(index: DataFrame, attribute: str) -> DataFrame:
    """Documents per value, ordered by value."""
    return index.groupBy(attribute).agg(F.count(F.lit(1)).alias("n_documents")).orderBy(attribute)


def codify_column(index: DataFrame, column: str, id_column: str | None = None) -> DataFrame:
    """Integer code per distinct value in sorted order; null -> -1."""
    id_column = id_column or f"{column}_id"
    values = index.select(column).where(F.col(column).isNotNull()).distinct()
    codes = dense_ids(values, [column], id_col=id_column)
    return index.join(codes, column, "left") \
        .withColumn(id_column, F.coalesce(F.col(id_column), F.lit(-1)).cast("bigint"))


# --------------------------------------------------------------------------------
# Top-k and slicing
# --------------------------------------------------------------------------------

def top_n_words(tf: DataFrame, n: int) -> DataFrame:
    """The n most frequent tokens, ties by token (TakeOrderedAndProject)."""
    return tf.orderBy(F.col("tf").desc(), F.col("token")).limit(n)


def slice_by_n_top(dtm: DataFrame, n_top: int) -> DataFrame:
    """Restrict to the n most frequent tokens; broadcast if n is within the bound for that."""
    top = top_n_words(term_frequency(dtm), n_top).select("token")
    return dtm.join(F.broadcast(top) if n_top <= BROADCAST_ROW_LIMIT else top, "token", "left_semi")


def slice_by_tf(dtm: DataFrame, threshold: int, keeps: Sequence[str] = ()) -> DataFrame:
    """Keep tokens with tf >= threshold or listed in `keeps`."""
    tf = term_frequency(dtm)
    keep = tf.where((F.col("tf") >= threshold) | F.col("token").isin(list(keeps))).select("token")
    return dtm.join(keep, "token", "left_semi")


def zero_out_by_tf(dtm: DataFrame, threshold: int, keeps: Sequence[str] = ()) -> DataFrame:
    """T05 `zero_out`: same cells removed (a zero is an absent cell in long form)."""
    return slice_by_tf(dtm, threshold, keeps)


def slice_by_tokens(dtm: DataFrame, tokens: DataFrame) -> DataFrame:
    """Keep the given tokens (a one-column frame)."""
    return dtm.join(tokens.select("token").distinct(), "token", "left_semi")


def slice_by_predicate(dtm: DataFrame, px: Callable[[Column], Column]) -> DataFrame:
    """Keep tokens for which `px(token)` holds."""
    return dtm.where(px(F.col("token")))


def translate_to_vocab(dtm: DataFrame, vocab: DataFrame) -> DataFrame:
    """Keep tokens present in another vocabulary (token, token_id) and take its ids. Both are sent to the token's bucket packed."""
    return cells_with_ids(dtm, vocab.select("token", "token_id"))


def zero_out_by_others_zeros(dtm: DataFrame, other: DataFrame) -> DataFrame:
    """J16 (intended behaviour): keep cells that are non-zero in `other`. Both are sent to their document packed."""
    return held_cells(dtm, other.where(F.col("n") > 0).select("document_id", "token"))


def terms_frame(spark, terms: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "ord int, term string")


def words_in_vocabulary(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """P10: each term as its exact vocabulary form, else its lower-case form, else dropped."""
    asked = terms.select(F.explode(F.array("term", F.lower("term"))).alias("token")).distinct()
    v = vocab.select("token").join(asked, "token", "left_semi").distinct()  # the vocabulary shrinks to the terms first
    exact = terms.join(v, terms["term"] == v["token"], "left").select("ord", "term", F.col("token").alias("_e"))
    low = exact.join(v, F.lower(exact["term"]) == v["token"], "left") \
        .select("ord", "term", F.coalesce("_e", "token").alias("token"))
    return low.where(F.col("token").isNotNull()).select("ord", "term", "token")


def glob_to_regex(pattern: str) -> str:
    """fnmatch translation (driver side, one pattern): Java regex anchored at both ends."""
    rx = fnmatch.translate(pattern)  # '(?s:...)\\Z'
    return "^" + rx.replace("\\Z", "$")


def word_match_condition(token: Column, candidates: Sequence[str]) -> Column:
    """P11 condition on a token column: literal words, `*` globs (`?`/`[..]` only count
    when a `*` is present) and `|regex|` (matched at the start, like `re.match`)."""
    literals, regexes = [], []
    for w in candidates:
        if len(w) > 2 and w.startswith("|") and w.endswith("|"):
            regexes.append("^(?:" + w[1:-1] + ")")
        elif "*" in w:
            regexes.append(glob_to_regex(w))
        else:
            literals.append(w)
    cond = token.isin(literals) if literals else F.lit(False)
    for rx in regexes:
        cond = cond | token.rlike(rx)
    return cond


def matching_words(vocab: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Vocabulary rows whose token matches any candidate (see word_match_condition)."""
    return vocab.where(word_match_condition(F.col("token"), candidates))


def folded(search: str) -> str:
    """A search term in lower case; a `|regex|` ignores case instead, as lowering its text
    would turn classes such as \\W into others."""
    if len(search) > 1 and search.startswith("|") and search.endswith("|"):
        return "|(?i)" + search[1:]
    return search.lower()


def word_hits(tf: DataFrame, search: str, n_hits: int = 5) -> DataFrame:
    """The n most frequent vocabulary matches; a term that isn't literally in the
    vocabulary (globs included) is looked up in lower case."""
    if search == folded(search):
        return top_n_words(matching_words(tf, [search]), n_hits)
    exact = tf.where(F.col("token") == search)
    known = exact.agg(F.count(F.lit(1)).alias("n")).scalar()  # 0 or 1, computed once
    return top_n_words(exact.unionByName(matching_words(tf, [folded(search)]).where(known == 0)), n_hits)


def partitioned_top_n_words(dtm: DataFrame, category: str, n_top: int = 100) -> DataFrame:
    """Top n tokens (count > 0) per category with their rank; ties by token.

    `row_number() <= n` lets Spark place a partial window group limit before the shuffle,
    so even a category holding a large share of all rows sends at most n rows per map
    partition (checked with explain: WindowGroupLimit Partial / Final)."""
    w = Window.partitionBy(category).orderBy(F.col("n").desc(), F.col("token"))
    return dtm.where(F.col("n") > 0).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_top)


def top_terms_wide(dtm: DataFrame, category: str, categories: Sequence[Any], n_top: int = 100,
                   kind: str = "token", pad: str = "*") -> DataFrame:
    """W06 wide form: one row per rank that occurs, one column per category (`token`, or `token/count` text), or
    with `token+count` two, `c` and `c/Count`; shorter lists are padded with (`pad`, 0). `categories` is the
    explicit pivot value list. Columns are in name order behind the rank."""
    top = partitioned_top_n_words(dtm, category, n_top)
    if kind not in ("token", "token/count", "token+count"):
        raise ValueError(kind)
    names = sorted({str(c) for c in categories})
    token = F.concat_ws("/", "token", F.col("n").cast("string")) if kind == "token/count" else F.col("token")
    here = F.col(category).cast("string")
    columns = {c: F.coalesce(F.first(F.when(here == c, token), ignorenulls=True), F.lit(f"{pad}/0" if kind == "token/count" else pad)) for c in names}
    if kind == "token+count":
        columns |= {f"{c}/Count": F.coalesce(F.first(F.when(here == c, F.col("n")), ignorenulls=True), F.lit(0)) for c in names}
    wide = top.where(here.isin(names)).groupBy("rank").agg(*[columns[c].alias(c) for c in sorted(columns)])
    return wide.orderBy("rank")


# --------------------------------------------------------------------------------
# Filtering documents and index joins
# --------------------------------------------------------------------------------

def filter_documents(corpus: DTMCorpus, px: Mapping[str, Any] | Column) -> DTMCorpus:
    """Keep documents matching a predicate (opts dict or Column); ids are kept
    (dense renumbering on request with `dense_ids`)."""
    cond = px if isinstance(px, Column) else predicate(corpus.index.columns, px)
    index = corpus.index.where(cond)
    return DTMCorpus(corpus.dtm.join(index.select("document_id"), "document_id", "left_semi"), index, corpus.key)


def overload_by_index(df: DataFrame, index: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Add index columns missing in `df` (inner join on document_id)."""
    cols = [c for c in (columns or index.columns) if c not in df.columns and c != "document_id"]
    return df.join(index.select("document_id", *cols), "document_id", "inner")


def consolidate_index(index: DataFrame, other: DataFrame, on: str = "document_name") -> DataFrame:
    """Add only the columns of `other` that are new (left join on the name)."""
    new = [c for c in other.columns if c not in index.columns]
    return index.join(other.select(on, *new), on, "left")


def add_attributes(index: DataFrame, other: DataFrame) -> DataFrame:
    """Inner merge of extra attributes on document_id."""
    return index.join(other, "document_id", "inner")


def update_index(index: DataFrame, updates: DataFrame, on: str = "document_name", default: Any = 0) -> DataFrame:
    """overwrite/add columns from `updates` keyed by `on`; non-null new values win,
    new columns default to `default`."""
    cols = [c for c in updates.columns if c != on]
    renamed = updates.select(on, *[F.col(c).alias(f"_new_{c}") for c in cols])
    out = index.join(renamed, on, "left")
    for c in cols:
        if c in index.columns:
            out = out.withColumn(c, F.coalesce(F.col(f"_new_{c}"), F.col(c)))
        else:
            out = out.withColumn(c, F.coalesce(F.col(f"_new_{c}"), F.lit(default)))
    return out.drop(*[f"_new_{c}" for c in cols])


def normalize_per_year(counts: DataFrame, index: DataFrame, value: str = "n") -> DataFrame:
    """Divide yearly counts by the year's total raw tokens."""
    per_year = index.groupBy("year").agg(F.sum("n_raw_tokens").alias("_year_tokens"))
    return counts.join(per_year, "year", "inner") \
        .withColumn(value, F.try_divide(F.col(value), F.col("_year_tokens"))).drop("_year_tokens")


def extend_index(index: DataFrame, other: DataFrame, on: str = "document_name",
                 ignore_if_exists: bool = True) -> DataFrame:
    """Append rows of `other` whose name is new (ids are kept; renumber with
    dense_ids). With `ignore_if_exists=False` an existing name raises ValueError
    (one semi-join count)."""
    if not ignore_if_exists and other.join(index.select(on), on, "left_semi").limit(1).count():
        raise ValueError("documents already in the index")
    new = other.join(index.select(on), on, "left_anti")
    return index.unionByName(new, allowMissingColumns=True)


def compress_vocabulary(vocab: DataFrame, threshold: int = 1, keeps: Sequence[str] = ()
                        ) -> tuple[DataFrame, DataFrame]:
    """W05 `compress`: keep tokens with tf >= threshold or listed in `keeps`, renumber
    them densely in old-id order; returns (new vocabulary, mapping old_id -> new_id)."""
    kept = vocab.where((F.col("tf") >= threshold) | F.col("token").isin(list(keeps)))
    renumbered = dense_ids(kept.withColumnRenamed("token_id", "old_id"), ["old_id"], id_col="token_id")
    mapping = renumbered.select("old_id", F.col("token_id").alias("new_id"))
    return renumbered.drop("old_id"), mapping


def check_index_covers(dtm: DataFrame, index: DataFrame) -> DataFrame:
    """S15 check: documents present on one side only (should be empty)."""
    a = dtm.select("document_id").distinct()
    b = index.select("document_id")
    return a.join(b, "document_id", "left_anti").unionByName(b.join(a, "document_id", "left_anti"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
