"""Stored indexes of a prepared corpus: positional postings, n-grams of the vocabulary, and
counts with running sums along the years.

* Postings (P06, W01, E01): per attribute and token form the documents with the token's
  positions, sorted by the folded (lower-case) form and document, positions delta-coded by
  Parquet. A phrase is a merge: the postings of place j are moved back by j, and the starts
  that all places agree on are the matches. Only the phrase's tokens are read.
* Character n-grams (P11, T03, E05): every run of `GRAM` characters of a folded token between
  boundary signs, with the token and its frequency, sorted by the run in each file. A glob or regular expression
  requires some runs; the tokens that have them all are verified against the pattern.
* Trend cube (E03, A01, A03): token x pivots x year with the count and the running sum along the
  years of one (token, pivots), so that any span of years is a difference of two sums.
* Keys (J14, J03): speech ids, document names and document ids with the document and its year, sorted by
  key in small pages with a Bloom filter for each row group; a few keys read a few pages, and the speeches then
  few years' folders.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import temporal_key
from ..session import bounded_broadcast
from .predicates import criteria_predicate, predicate
from .tokens import _REGEX_META, normalize_pattern

ATTRIBUTES = ("lemma", "word")
GRAM = 3
START, END = "\x02", "\x03"  # boundary signs: no token holds them
_ALIKE = ("İſı", "isi")  # letters that patterns without case take for ASCII ones
# Values of a document by which the cube is cut; None: kept as a key of its own.
CUBE_KEYS = ("gender_id", "party_id", "chamber_abbrev", "office_type_id", "sub_office_type_id")
# Settings under which sorted tokens and ascending positions are stored as differences.
DELTA = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "compression": "zstd"}
# Tokens of rows that are counted at once (a longer row by itself).
_STEP_TOKENS = 500_000


# Counting within a row ------------------------------------------------------------------------

def _pieces(batches, lists: str):
    """Runs of rows of about _STEP_TOKENS tokens, with their list column."""
    for b in batches:
        sizes = pc.fill_null(pc.list_value_length(b.column(lists)), 0).to_numpy(zero_copy_only=False)
        ends, lo = np.cumsum(sizes), 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _STEP_TOKENS, side="right")))
            part = b.slice(lo, hi - lo)
            yield part, pa.concat_arrays([part.column(lists)])
            lo = hi


def _coded(tokens: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct tokens (null is one) and each token's number."""
    coded = tokens.dictionary_encode(null_encoding="encode")
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def _alike(part: pa.RecordBatch, keep: Sequence[str]) -> np.ndarray:
    """For each row the first row of the batch with the same values (null is one)."""
    code = np.zeros(part.num_rows, np.int64)
    for k in keep:
        names, one = _coded(part.column(k))
        code = np.unique(code * max(len(names), 1) + one, return_inverse=True)[1]
    _, first, at = np.unique(code, return_index=True, return_inverse=True)
    return first[at]


def row_counts(rows: DataFrame, lists: str, keep: Sequence[str], together: bool = False) -> DataFrame:
    """(keep..., token, n): the distinct tokens of each row's array with their counts, without a shuffle. `together`: rows with
    the same `keep` that are read in one step are counted as one."""
    schema = T.StructType([*[rows.schema[k] for k in keep], T.StructField("token", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches):
        for part, arrays in _pieces(batches, lists):
            at = pc.list_parent_indices(arrays).to_numpy()
            if len(at):
                at = _alike(part, keep)[at] if together else at
                names, code = _coded(arrays.flatten())
                cell, n = np.unique(at * len(names) + code, return_counts=True)
                row = pa.array(cell // len(names))
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(row) for k in keep], names.take(pa.array(cell % len(names))), pa.array(n)],
                                                 names=schema.names)
    return rows.select(*keep, lists).mapInArrow(run, schema)


# Postings -------------------------------------------------------------------------------------

def _row_postings(speeches: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """(document_id, year, attr, folded, token, positions, both): the token forms of each row, without a shuffle. `both`: the row's
    lemmas are its folded words, and no other form has the word's, so that its positions are the lemma's, too, and aren't a row of
    their own."""
    rows = speeches.select("document_id", "year", *[F.col(a).alias(f"t_{a}") for a in attributes],
                           *[F.transform(a, F.lower).alias(f"f_{a}") for a in attributes])
    schema = T.StructType([rows.schema["document_id"], rows.schema["year"], *[T.StructField(c, T.StringType()) for c in ("attr", "folded", "token")],
                           T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("both", T.BooleanType())])
    derived = {"lemma", "word"} <= set(attributes)

    def run(batches):
        for part, _ in _pieces(batches, f"t_{attributes[0]}"):
            both = derived and part.column("f_word").equals(part.column("t_lemma")) and part.column("f_lemma").equals(part.column("t_lemma"))
            for attr in attributes:
                arrays = pa.concat_arrays([part.column(f"t_{attr}")])
                at = pc.list_parent_indices(arrays).to_numpy()
                if not len(at) or both and attr == "lemma":
                    continue
                names, code = _coded(arrays.flatten())
                folded = pa.concat_arrays([part.column(f"f_{attr}")]).flatten()
                place = np.arange(len(at)) - np.searchsorted(at, at)

                def found(attr: str, key: np.ndarray, of: np.ndarray, tokens: pa.Array, common: np.ndarray | None = None) -> pa.RecordBatch:
                    """A row for each distinct key of some tokens."""
                    order = of[np.argsort(key[of], kind="stable")]
                    _, first = np.unique(key[order], return_index=True)
                    one, row = pa.array(order[first]), pa.array(at[order[first]])
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
                    shared = np.zeros(len(one), bool) if common is None else common[order[first]]
                    return pa.RecordBatch.from_arrays(
                        [part.column("document_id").take(row), part.column("year").take(row), pa.array([attr] * len(one), pa.string()), folded.take(one),
                         tokens.take(one), lists, pa.array(shared)], names=schema.names)
                key, every = at * len(names) + code, np.arange(len(at))
                if not both:
                    yield found(attr, key, every, arrays.flatten())
                    continue
                forms, form = _coded(folded)
                form = at * len(forms) + form
                _, one = np.unique(key, return_index=True)
                lemmas, times = np.unique(form[one], return_counts=True)
                single = times[np.searchsorted(lemmas, form)] == 1
                yield found(attr, key, every, arrays.flatten(), single)
                yield found("lemma", form, np.flatnonzero(~single), folded)
    return rows.mapInArrow(run, schema)


def postings(speeches: DataFrame, attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """(attr, folded, token, year, document_id, positions): a row for each token form of a document. Rows are shuffled once, by
    ranges of (folded, document_id), and lemmas made of folded words afterwards. Only documents that are several rows are put together."""
    parts = int(speeches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the range key holds the document, so that no token is one task
    dealt = _row_postings(speeches, attributes).repartitionByRange(parts, "folded", "document_id")
    lemma = F.struct(F.lit("lemma").alias("attr"), F.col("folded").alias("token"))
    own = F.struct("attr", "token")
    each = dealt.select("folded", "year", "document_id", "positions", F.explode(F.when(F.col("both"), F.array(own, lemma)).otherwise(F.array(own))).alias("s"))
    each = each.select(F.col("s.attr").alias("attr"), "folded", F.col("s.token").alias("token"), "year", "document_id", "positions")
    return each if distinct_ids(speeches) else (
        each.groupBy("attr", "folded", "token", "year", "document_id")
        .agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions")))


def store_postings(speeches: DataFrame, path: str, attributes: Sequence[str] = ATTRIBUTES) -> None:
    (postings(speeches, attributes).sortWithinPartitions("attr", "folded", "document_id")
     .write.mode("overwrite").options(**DELTA).partitionBy("attr").parquet(path))


def _condition(spec: Mapping[str, Any], grams: DataFrame | None) -> Column:
    """The rows of postings that a place of the pattern takes; literals become a condition on `folded`
    that Parquet prunes by, regular expressions the tokens found by their n-grams."""
    values = spec["value"] if isinstance(spec["value"], (list, tuple, set)) else [spec["value"]]
    literal = [str(v) for v in values if not _REGEX_META.search(str(v))]
    regexes = [str(v) for v in values if _REGEX_META.search(str(v))]
    cond = F.lit(False)
    if literal:
        cond = F.col("folded").isin([v.lower() for v in literal])
        if not spec["ignore_case"]:
            cond = cond & F.col("token").isin(literal)
    if regexes:
        rx = ("(?iu)" if spec["ignore_case"] else "(?u)") + "^(?:" + "|".join(regexes) + ")$"
        found = None
        if grams is not None and (asked := [required_runs(r) for r in regexes]) and all(asked):
            some = [r["token"] for r in _candidates(grams, asked).limit(_NAMED + 1).collect()]
            found = some if len(some) <= _NAMED else None
        cond = cond | ((F.col("folded").isin(found) if found is not None else F.lit(True)) & F.col("token").rlike(rx))
    return (F.col("attr") == spec["target"]) & cond


def _moved(j: int) -> Column:
    return F.transform("positions", lambda p: p - j)


_NAMED = 2000  # tokens that a condition may name; beyond, the pattern itself is read along the postings


def phrase_hits(stored: DataFrame, pattern, grams: DataFrame | None = None) -> tuple[DataFrame, int]:
    """P06 by postings: (year, document_id, starts) of the documents that match, and the pattern's length."""
    specs = normalize_pattern(pattern)
    unknown = {s["target"] for s in specs} - set(ATTRIBUTES)
    if unknown:
        raise ValueError(f"no postings of {sorted(unknown)}")
    conds = [_condition(s, grams) for s in specs]
    if len(specs) == 1 and specs[0]["target"] == "lemma" and isinstance(specs[0]["value"], str) and not _REGEX_META.search(specs[0]["value"]):
        # lemmas are lower case: one row a document
        return stored.where(conds[0]).select("year", "document_id", F.col("positions").alias("starts")), 1
    read = stored.where(reduce(lambda a, b: a | b, conds))
    places = [F.when(c, _moved(j)).alias(f"p{j}") for j, c in enumerate(conds)]
    each = read.select("year", "document_id", *places)
    one = each.groupBy("year", "document_id").agg(*[F.flatten(F.collect_list(f"p{j}")).alias(f"p{j}") for j in range(len(specs))])
    starts = reduce(F.array_intersect, [F.col(f"p{j}") for j in range(len(specs))])
    return one.select("year", "document_id", F.array_sort(starts).alias("starts")).where(F.size("starts") > 0), len(specs)


def hit_speeches(speeches: DataFrame, hits: DataFrame, criteria: Sequence[Mapping[str, Any]] | None = None) -> DataFrame:
    """The speeches that were hit, with `starts`. The year is a part of the join, so that folders of years without hits
    aren't read; hits of a checked size are broadcast."""
    s = speeches.where(criteria_predicate(criteria)) if criteria else speeches
    return s.join(bounded_broadcast(hits), ["year", "document_id"])


# N-grams of the vocabulary -----------------------------------------------------------------------

def vocabulary_grams(vocab: DataFrame, size: int = GRAM) -> DataFrame:
    """(gram, token, tf): the runs of each folded token, boundary signs included. vocab: token, tf."""
    text = F.concat(F.lit(START), F.lower(F.translate("token", *_ALIKE)), F.lit(END))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substring(text, i, size))
    return vocab.select(F.explode(F.array_distinct(runs)).alias("gram"), "token", "tf")


def store_grams(vocab: DataFrame, path: str) -> None:
    """Each task's part of the vocabulary is a file sorted by n-gram, of which a request reads the pages with its n-grams: ten
    rows a token aren't shuffled."""
    (vocabulary_grams(vocab).sortWithinPartitions("gram", "token")
     .write.mode("overwrite").options(**DELTA).parquet(path))


def _cut(runs: Sequence[str], size: int = GRAM) -> set[str]:
    return {r[i:i + size] for r in runs for i in range(len(r) - size + 1)}


def _literal_runs(tree) -> list[str]:
    """Runs of characters that every match of a parsed expression holds, anchors as boundary signs."""
    from re import _constants as sre

    runs, now = [], ""

    def end() -> None:
        nonlocal now
        if now:
            runs.append(now)
        now = ""
    for op, arg in tree:
        if op is sre.LITERAL:
            now += chr(arg)
        elif op is sre.AT and arg in (sre.AT_BEGINNING, sre.AT_BEGINNING_STRING):
            end()
            now = START
        elif op is sre.AT and arg in (sre.AT_END_STRING, sre.AT_END):
            now += END
            end()
        elif op is sre.SUBPATTERN and not arg[1] and not arg[2]:
            inner = list(arg[3])
            if all(o is sre.LITERAL for o, _ in inner):
                now += "".join(chr(a) for _, a in inner)
            else:
                end()
                runs += _literal_runs(inner)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            end()
            runs += [r for r in _literal_runs(arg[2])]
        else:
            end()
    end()
    return runs


def _needs(runs: Sequence[str]) -> set[str]:
    """The n-grams of runs, cut at letters that aren't ASCII: their case may fold otherwise in a pattern."""
    return _cut([p for r in runs for p in re.split(r"[^\x00-\x7f]", r.lower())])


def required_runs(pattern: str, whole: bool = True) -> set[str]:
    """N-grams that each folded token matching a regular expression holds; empty if it asks for none. `whole`: the
    expression has to match the whole token, else from its start."""
    try:
        tree = re._parser.parse(pattern)
    except re.error:  # Java's syntax differs: nothing is known
        return set()
    from re import _constants as sre
    end = [(sre.AT, sre.AT_END_STRING)] if whole else []
    return _needs(_literal_runs([(sre.AT, sre.AT_BEGINNING_STRING), *tree, *end]))


def glob_runs(pattern: str) -> set[str]:
    """N-grams that each token matching a glob holds."""
    return _needs(re.split(r"\*|\?|\[[^\]]*\]", START + pattern + END))


def _candidates(grams: DataFrame, asked: Sequence[set[str]]) -> DataFrame:
    """Tokens (with tf) that hold all runs of one of the sets; only these runs are read."""
    every = sorted(set().union(*asked))
    rows = grams.where(F.col("gram").isin(every)).groupBy("token", "tf").agg(F.collect_set("gram").alias("g"))  # at most `every`
    cond = reduce(lambda a, b: a | b, [F.size(F.array_intersect("g", F.array(*map(F.lit, sorted(s))))) == len(s) for s in asked])
    return rows.where(cond).select("token", "tf")


def matching_words(grams: DataFrame, vocab: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """P11 by n-grams: (token, tf) of the vocabulary's words that match literals, `*` globs or `|regex|`es. A pattern
    that asks for no run of GRAM characters reads the vocabulary."""
    from .dtm import word_match_condition

    asked = []
    for w in candidates:
        if len(w) > 2 and w.startswith("|") and w.endswith("|"):
            body = w[1:-1]
            flags = re.match(r"\(\?[a-z]+\)", body)
            asked.append(required_runs(body[flags.end():] if flags else body, whole=False))
        elif "*" in w:
            asked.append(glob_runs(w))
        else:
            asked.append(_needs([START + w + END]))
    known = _candidates(grams, asked) if asked and all(asked) else vocab.select("token", "tf")
    return known.where(word_match_condition(F.col("token"), candidates))


# Trend cube ------------------------------------------------------------------------------------------

def trend_cube(dtm: DataFrame | None, index: DataFrame, keys: Sequence[str] = CUBE_KEYS) -> DataFrame:
    """(token, keys..., year, n, upto): counts, and their running sum along the years. The rows of the
    token null count raw tokens of documents. Without `dtm`, `index` has the `lemma` arrays of documents whose ids are distinct, and
    their counts are shuffled once, by ranges of (token, keys)."""
    along = Window.partitionBy("token", *keys).orderBy("year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    none = F.lit(None).cast("string").alias("token")
    if dtm is None:
        parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        cells = row_counts(index, "lemma", [*keys, "year"], together=True).unionByName(index.select(*keys, "year", none, F.col("n_raw_tokens").cast("long").alias("n")))
        cells = cells.repartitionByRange(parts, "token", *keys)
        return cells.groupBy("token", *keys, "year").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(along))
    docs = index.select("document_id", "year", *keys)
    cells = dtm.join(docs, "document_id").groupBy("token", *keys, "year").agg(F.sum("n").cast("long").alias("n"))
    raw = index.groupBy(none, *keys, "year").agg(F.sum("n_raw_tokens").cast("long").alias("n"))
    return cells.unionByName(raw).withColumn("upto", F.sum("n").over(along))


def distinct_ids(index: DataFrame) -> bool:
    """Whether each document has an id of its own."""
    ids = index.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    return ids.where("n > 1 OR document_id IS NULL").isEmpty()


def store_trend_cube(dtm: DataFrame | None, index: DataFrame, path: str, keys: Sequence[str] = CUBE_KEYS) -> None:
    cube = trend_cube(dtm, index, keys)
    if dtm is not None:
        cube = cube.repartitionByRange(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), "token", *keys, "year")
    cube.sortWithinPartitions("token", *keys, "year").write.mode("overwrite").option("compression", "zstd").parquet(path)


def served_by_cube(opts: Mapping[str, Any], keys: Sequence[str] = CUBE_KEYS) -> bool:
    """Whether a request's filters are all keys of the cube."""
    return set(opts) <= {"year", *keys}


def cube_counts(cube: DataFrame, terms: Sequence[str] | None, opts: Mapping[str, Any], keys: Sequence[str]) -> DataFrame:
    """E03's counts (keys..., token, n) of some tokens, or of raw tokens (terms None: keys..., n)."""
    rows = cube.where(F.col("token").isin(list(terms)) if terms is not None else F.col("token").isNull())
    rows = rows.where(predicate(rows.columns, opts))
    names = [*keys, "token"] if terms is not None else list(keys)
    return rows.groupBy(*names).agg(F.sum("n").alias("n"))


def period_counts(cube: DataFrame, terms: Sequence[str], period: str, pivots: Sequence[str] = (),
                  keys: Sequence[str] = CUBE_KEYS) -> DataFrame:
    """A03/A04 from running sums: (token, pivots..., period, n) for years taken together as lustrum, decade or
    mapping. Of each (token, keys) and period only the last running sum is kept; a period's count is its
    difference to the one before."""
    rows = cube.where(F.col("token").isin(list(terms))).withColumn("period", temporal_key(F.col("year"), period))
    last = rows.groupBy("token", *keys, "period").agg(F.max("upto").alias("upto"))
    before = Window.partitionBy("token", *keys).orderBy("period")
    part = last.withColumn("n", F.col("upto") - F.coalesce(F.lag("upto").over(before), F.lit(0)))
    return part.groupBy("token", *pivots, "period").agg(F.sum("n").alias("n"))


def span_counts(cube: DataFrame, terms: Sequence[str], spans: Sequence[tuple[int, int]], pivots: Sequence[str] = (),
                keys: Sequence[str] = CUBE_KEYS) -> DataFrame:
    """(token, pivots..., first, last, n) for spans of years: the running sum up to the span's end less that before
    its start."""
    def upto(year: Column) -> Column:
        return F.coalesce(F.max(F.when(F.col("year") <= year, F.col("upto"))), F.lit(0))
    rows = cube.where(F.col("token").isin(list(terms)))
    asked = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in spans])
    each = rows.withColumn("s", F.explode(asked)).groupBy("token", *keys, "s").agg((upto(F.col("s.last")) - upto(F.col("s.first") - 1)).alias("n"))
    return (each.groupBy("token", *pivots, F.col("s.first").alias("first"), F.col("s.last").alias("last")).agg(F.sum("n").alias("n"))
            .where("n > 0"))


# Keys of speeches ---------------------------------------------------------------------------------------

PAGE_ROWS = 256


def speech_keys(index: DataFrame) -> DataFrame:
    """(key, document_id, year): a row for each way to name a speech."""
    names = F.array(F.col("document_id").cast("string"), "document_name", "speech_id")
    return index.select(F.explode(F.array_distinct(names)).alias("key"), "document_id", "year").where(F.col("key").isNotNull())


def store_keys(index: DataFrame, path: str, page_rows: int = PAGE_ROWS) -> None:
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pages = {"parquet.page.row.count.limit": str(page_rows), "parquet.bloom.filter.enabled#key": "true"}
    (speech_keys(index).repartitionByRange(parts, "key").sortWithinPartitions("key", "document_id")
     .write.mode("overwrite").options(**DELTA, **pages).parquet(path))


def find_keys(stored: DataFrame, keys: Sequence[int | str]) -> DataFrame:
    """(key, document_id, year) of request keys; the condition reaches the pages."""
    return stored.where(F.col("key").isin([str(k) for k in keys]))


def speeches_by_keys(speeches: DataFrame, stored: DataFrame, keys: Sequence[int | str], limit: int = 10_000) -> DataFrame:
    """The speeches that keys name, with `key`. The keys' documents (at most a few a key) come to the driver and go back as
    a condition on year and document id, so that neither side is shuffled; more than `limit` keys raise an error."""
    keys = list(dict.fromkeys(str(k) for k in keys))
    if len(keys) > limit:
        raise ValueError(f"at most {limit} keys, got {len(keys)}")
    found = find_keys(stored, keys).collect() if keys else []
    by_id: dict[int, list[str]] = {}
    for r in found:
        by_id.setdefault(r["document_id"], []).append(r["key"])
    years = sorted({r["year"] for r in found})
    hit = speeches.where(F.col("year").isin(years) & F.col("document_id").isin(sorted(by_id)))
    names = F.create_map(*[x for i, k in by_id.items() for x in (F.lit(i).cast("long"), F.array(*map(F.lit, sorted(k))))]) if by_id \
        else F.lit(None).cast("map<bigint, array<string>>")
    return hit.withColumn("key", F.explode(F.element_at(names, F.col("document_id").cast("long"))))
