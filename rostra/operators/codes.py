"""Code tables: decoding and encoding ids, speakers, party lists (J01-J06, J14, J17,
S03, T04, T06, R06, X01, X02).

Code tables are small and joined under a size-checked broadcast; the person table
grows with the corpus and falls back to a shuffled join above the bound.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fx
from ..session import bounded_broadcast


@dataclass(frozen=True)
class Codec:
    table: str
    kind: str  # "decode" | "encode"
    from_column: str
    to_column: str
    default: Any = None
    # An optional Column -> Column function used instead of the table
    fx: Callable[[Column], Column] | None = None


# The decoders and encoders, in the order they are tried.
CODECS: tuple[Codec, ...] = (
    Codec("gender", "decode", "gender_id", "gender"),
    Codec("gender", "decode", "gender_id", "gender_abbrev"),
    Codec("office_type", "decode", "office_type_id", "office"),
    Codec("party", "decode", "party_id", "party"),
    Codec("party", "decode", "party_id", "party_abbrev"),
    Codec("chamber", "decode", "chamber_id", "chamber"),
    Codec("chamber", "decode", "chamber_id", "chamber_abbrev"),
    Codec("sub_office_type", "decode", "sub_office_type_id", "sub_office_type"),
    Codec("persons", "decode", "person_id", "name"),
    Codec("persons", "decode", "person_id", "wiki_id"),
    Codec("persons", "decode", "person_id", "pid"),
    Codec("persons", "decode", "pid", "name"),
    Codec("gender", "encode", "gender", "gender_id"),
    Codec("gender", "encode", "gender_abbrev", "gender_id"),
    Codec("sub_office_type", "encode", "sub_office_type", "sub_office_type_id"),
)

# Text name <-> id name of the pivot keys.
PROPERTY_VALUES_SPECS = (
    ("gender", "gender_id"), ("office", "office_type_id"), ("party_abbrev", "party_id"), ("party", "party_id"),
    ("chamber_abbrev", "chamber_id"), ("sub_office_type", "sub_office_type_id"), ("name", "pid"),
)


def _planned(df_columns: Sequence[str], codecs: Sequence[Codec], kind: str, ignores: Sequence[str]) -> list[Codec]:
    cols, plan = set(df_columns), []
    for c in codecs:
        if c.kind != kind or c.to_column in ignores:
            continue
        if c.from_column not in cols or c.to_column in cols:
            continue
        plan.append(c)
        cols.add(c.to_column)
    return plan


def apply_codecs(df: DataFrame, tables: Mapping[str, DataFrame], codecs: Sequence[Codec] = CODECS,
                 kind: str = "decode", drop: bool = True, keeps: Sequence[str] = (),
                 ignores: Sequence[str] = ()) -> DataFrame:
    """Apply every applicable codec in order; all codecs of one (table, from
    column) share one left join. Unmapped -> null or the codec's default. With `drop`
    the source columns are removed (except `keeps`)."""
    plan = _planned(df.columns, codecs, kind, ignores)
    groups: dict[tuple[str, str], list[Codec]] = {}
    for c in plan:
        groups.setdefault((c.table, c.from_column), []).append(c)
    for (table, src), cs in groups.items():
        with_fx = [c for c in cs if c.fx is not None]
        for c in with_fx:
            df = df.withColumn(c.to_column, c.fx(F.col(src)))
        cs = [c for c in cs if c.fx is None]
        if not cs:
            continue
        t = tables[table].select(F.col(src).alias("_key"), *[F.col(c.to_column).alias(f"_v_{c.to_column}") for c in cs])
        df = df.join(bounded_broadcast(t), df[src] == t["_key"], "left").drop("_key")
        for c in cs:
            v = F.col(f"_v_{c.to_column}")
            df = df.withColumn(c.to_column, F.coalesce(v, F.lit(c.default)) if c.default is not None else v) \
                .drop(f"_v_{c.to_column}")
    if drop:
        sources = {c.from_column for c in plan} - set(keeps)
        targets = {c.to_column for c in plan}
        df = df.drop(*[s for s in sources if s not in targets])
    return df


def decode(df: DataFrame, tables: Mapping[str, DataFrame], drop: bool = True, keeps: Sequence[str] = (),
           ignores: Sequence[str] = (), codecs: Sequence[Codec] = CODECS) -> DataFrame:
    return apply_codecs(df, tables, codecs, "decode", drop, keeps, ignores)


def encode(df: DataFrame, tables: Mapping[str, DataFrame], drop: bool = True, keeps: Sequence[str] = (),
           ignores: Sequence[str] = (), codecs: Sequence[Codec] = CODECS) -> DataFrame:
    """Label -> id; when two encoders target one id, the first applicable wins."""
    return apply_codecs(df, tables, codecs, "encode", drop, keeps, ignores)


def reverse(codec: Codec) -> Codec:
    """J02 `reverse`."""
    return Codec(codec.table, "encode" if codec.kind == "decode" else "decode", codec.to_column, codec.from_column)


def mapping(tables: Mapping[str, DataFrame], table: str, from_column: str, to_column: str) -> DataFrame:
    """J02 `get_mapping`: the (from, to) pairs of a code table as a frame."""
    return tables[table].select(from_column, to_column).where(F.col(from_column).isNotNull())


def decode_pivot_keys(df: DataFrame, tables: Mapping[str, DataFrame], drop: bool = True) -> DataFrame:
    """Decode every known id column to its text column."""
    return decode(df, tables, drop=drop)


# S03 ---------------------------------------------------------------------------------

def slim_table(df: DataFrame, defaults: Mapping[str, Any] | None = None,
               dtypes: Mapping[str, str] | None = None) -> DataFrame:
    """Fill nulls by column default and cast to the given types."""
    if defaults:
        df = df.fillna(dict(defaults))
    for col, dtype in (dtypes or {}).items():
        if col in df.columns:
            df = df.withColumn(col, F.col(col).cast(dtype))
    return df


def duplicate_keys(df: DataFrame, pk: str) -> DataFrame:
    """S03 data-quality check: primary key values that occur more than once."""
    return df.groupBy(pk).count().where(F.col("count") > 1)


# J05, J06, J17 ---------------------------------------------------------------------------

def multi_party_abbrevs(persons: DataFrame, person_party: DataFrame, party: DataFrame) -> DataFrame:
    """Each person's distinct parties as text (abbrevs ', '-joined, ids ','-joined,
    sorted); persons without any -> '?'. The list per person is bounded by the number
    of parties (a code table)."""
    pp = person_party.join(bounded_broadcast(party.select("party_id", "party_abbrev")), "party_id", "left")
    lists = pp.groupBy("person_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.coalesce("party_abbrev", F.lit("?")))), ", ").alias("multi_party_abbrev"),
        F.array_join(F.array_sort(F.collect_set(F.col("party_id").cast("string"))), ",").alias("multi_party_id"))
    return persons.join(lists, "person_id", "left").select(
        *[F.col(c) for c in persons.columns],
        F.coalesce(F.nullif(F.col("multi_party_abbrev"), F.lit("")), F.lit("?")).alias("multi_party_abbrev"),
        F.coalesce(F.nullif(F.col("multi_party_id"), F.lit("")), F.lit("?")).alias("multi_party_id"))


def filtered_speakers(persons: DataFrame, person_party: DataFrame, speech_index: DataFrame,
                      selection: Mapping[str, Sequence[Any]]) -> DataFrame:
    """Speakers by party (through person_party), by chamber (persons seen in the
    index with that chamber, lower-cased) or by their own column. Empty values are
    skipped; an unknown key raises ValueError."""
    out = persons
    for key, values in selection.items():
        if not values:
            continue
        values = list(values)
        if key == "party_id":
            ids = person_party.where(F.col("party_id").isin(values)).select("person_id")
            out = out.join(ids, "person_id", "left_semi")
        elif key == "chamber_abbrev":
            ids = speech_index.where(F.lower(F.col("chamber_abbrev")).isin([str(v).lower() for v in values])) \
                .select("person_id")
            out = out.join(ids, "person_id", "left_semi")
        elif key in persons.columns:
            out = out.where(F.col(key).isin(values))
        else:
            raise ValueError(f"unknown speaker filter key {key}")
    return out


def speakers(persons: DataFrame, person_party: DataFrame, party: DataFrame, speech_index: DataFrame,
             selection: Mapping[str, Sequence[Any]]) -> DataFrame:
    """Name, party_abbrev (all parties), year_of_birth, year_of_death, person_id."""
    p = filtered_speakers(persons, person_party, speech_index, selection)
    p = multi_party_abbrevs(p, person_party, party)
    return p.select("name", F.col("multi_party_abbrev").alias("party_abbrev"), "year_of_birth",
                    "year_of_death", "person_id")


def person_by_key(persons: DataFrame, key: Any) -> DataFrame:
    """One person by row number (pid), wiki id (q...) or person id."""
    if isinstance(key, int):
        return persons.where(F.col("pid") == key)
    if isinstance(key, str) and key.lower().startswith("q"):
        return persons.where(F.col("wiki_id") == key)
    return persons.where(F.col("person_id").cast("string") == str(key))


# T04, T06 ---------------------------------------------------------------------------------

def parties_sorted(party: DataFrame) -> DataFrame:
    """T04."""
    return party.orderBy("sort_order", "party")


def decode_speech_index(speech_index: DataFrame, tables: Mapping[str, DataFrame],
                        value_updates: Mapping[str, Mapping[str, str]] | None = None, sort: bool = False,
                        pdf_base_url: str = fx.DEFAULT_PDF_BASE_URL) -> DataFrame:
    """Decode ids, add wiki and PDF links, replace display values; optional sort
    with empty names last (sorting belongs at the sink)."""
    if "name" in speech_index.columns:
        return speech_index  # already decoded
    df = decode(speech_index, tables, drop=True, keeps=["person_id"], ignores=["pid"])
    df = df.withColumn("link", fx.wiki_link(F.col("wiki_id"))) \
        .withColumn("speech_link", fx.speech_link(F.col("document_name"), 1, pdf_base_url))
    for col, updates in (value_updates or {}).items():
        if col in df.columns:
            expr = F.col(col)
            for old, new in updates.items():
                expr = F.when(F.col(col) == old, F.lit(new)).otherwise(expr)
            df = df.withColumn(col, expr)
    if sort:
        df = df.orderBy(F.coalesce(F.col("name"), F.lit("")) == "", "document_id")
    return df


# J14 ------------------------------------------------------------------------------------

def key_column(key: str | int) -> tuple[str, Any]:
    """J14 key resolution: integer id, 'prot-' document name or 'i-' speech id."""
    if isinstance(key, int) or (isinstance(key, str) and key.isdigit()):
        return "document_id", int(key)
    if key.startswith("prot-"):
        return "document_name", key
    if key.startswith("i-"):
        return "speech_id", key
    raise ValueError(f"unknown speech key {key}")


def speech_info(speech_index: DataFrame, persons: DataFrame, speaker_notes: DataFrame,
                keys: DataFrame | None = None) -> DataFrame:
    """J14 for many speeches at once: speaker name (person id as text when unknown) and
    the introductory note (fixed text when missing). `keys` (document_id) restricts the
    speeches with a semi-join."""
    si = speech_index if keys is None else speech_index.join(keys.select("document_id"), "document_id", "left_semi")
    p = persons.select(F.col("person_id").alias("_pid"), F.col("name"))
    out = si.join(bounded_broadcast(p), si["person_id"] == p["_pid"], "left").drop("_pid")
    out = out.withColumn("name", F.coalesce(F.col("name"), F.col("person_id").cast("string")))
    notes = speaker_notes.select("speaker_note_id", "speaker_note")
    out = out.join(notes, "speaker_note_id", "left")
    return out.withColumn("speaker_note", F.coalesce("speaker_note", F.lit("(introductory note not found)")))


# X02 ------------------------------------------------------------------------------------

def run_hooks(tables: dict[str, DataFrame], hooks: Sequence[Callable[[dict], dict]]) -> dict[str, DataFrame]:
    """Plain functions over the dict of code tables, applied in order."""
    return reduce(lambda acc, h: h(acc), hooks, dict(tables))


def add_multi_party_hook(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    out = dict(tables)
    out["persons"] = multi_party_abbrevs(tables["persons"], tables["person_party"], tables["party"])
    return out


def add_pid_hook(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """`pid` = row number of the person (dense 0-based ids in person_id order)."""
    from .dtm import dense_ids

    out = dict(tables)
    persons = tables["persons"].drop("pid") if "pid" in tables["persons"].columns else tables["persons"]
    out["persons"] = dense_ids(persons, ["person_id"], id_col="pid")
    return out


def rename_sub_office_hook(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    out = dict(tables)
    t = tables["sub_office_type"]
    if "description" in t.columns:
        out["sub_office_type"] = t.withColumnRenamed("description", "sub_office_type")
    return out
