"""Protocols, utterances and speech text.

A protocol is a sequence of utterances; a speech is a run of `n_utterances` of them,
in the order of the protocol's speech index. Speech boundaries come from a running
sum over the speech index; each speech is expanded to the utterance positions it
covers and joined on (protocol, position) - an equi-join, so a large protocol is
spread over many keys instead of one range-join partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fx
from ..session import bounded_broadcast

# Nested protocol layout (S04): one JSON document per protocol.
UTTERANCE_SCHEMA = T.StructType([
    T.StructField("u_id", T.StringType()), T.StructField("who", T.StringType()),
    T.StructField("speaker_note_id", T.StringType()), T.StructField("page_number", T.LongType()),
    T.StructField("num_tokens", T.LongType()), T.StructField("num_words", T.LongType()),
    T.StructField("paragraphs", T.ArrayType(T.StringType())),
])
PROTOCOL_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("utterances", T.ArrayType(UTTERANCE_SCHEMA)),
])


# Speeches per bucket of the two-level running sum.
PREFIX_BUCKET = 1024


def running_sum_before(df: DataFrame, key: str, order: str, value: str, out: str,
                       bucket: int = PREFIX_BUCKET) -> DataFrame:
    """Exclusive running sum of `value` per `key` in `order` (an integer position),
    computed in two levels so that one very large key is spread over many tasks:
    sums within buckets of `bucket` positions, then a running sum over the bucket
    totals (one row per bucket), joined back on (key, bucket)."""
    b = F.floor(F.col(order) / bucket).alias("_bucket")
    keyed = df.withColumn("_bucket", b)
    inner = Window.partitionBy(key, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("_within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    totals = keyed.groupBy(key, "_bucket").agg(F.sum(value).alias("_total"))
    outer = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, "_bucket", F.coalesce(F.sum("_total").over(outer), F.lit(0)).alias("_before"))
    return keyed.join(offsets, [key, "_bucket"], "inner") \
        .withColumn(out, (F.col("_before") + F.col("_within")).cast("bigint")).drop("_bucket", "_within", "_before")


def speech_bounds(speech_index: DataFrame, protocol: str = "protocol_id", order: str = "speech_no") -> DataFrame:
    """Start offset = running sum of n_utterances of the earlier speeches."""
    b = running_sum_before(speech_index, protocol, order, "n_utterances", "u_start")
    return b.withColumn("u_end", F.col("u_start") + F.col("n_utterances"))


def assign_utterances(speech_index: DataFrame, utterances: DataFrame, protocol: str = "protocol_id",
                      order: str = "speech_no", position: str = "turn") -> DataFrame:
    """Each utterance with the speech it belongs to (position in [start, end))."""
    b = speech_bounds(speech_index, protocol, order)
    spans = b.where(F.col("n_utterances") > 0).select(protocol, order, "u_start", "u_end")
    cover = spans.select(protocol, order, F.explode(F.sequence("u_start", F.col("u_end") - 1)).alias(position))
    return utterances.join(cover, [protocol, position], "inner")


def speeches_from_utterances(assigned: DataFrame, protocol: str = "protocol_id", order: str = "speech_no",
                             position: str = "turn") -> DataFrame:
    """W04 `_create_speech` for every speech at once: paragraphs in order joined by
    newline (F02 applied), token and word sums, the first utterance's who / u_id /
    page, the last utterance's page; falsy pages -> '?'."""
    first = F.min_by(F.struct("who", "u_id", "page_number"), F.col(position))
    last_page = F.max_by(F.col("page_number"), F.col(position))
    paragraphs = F.transform(F.array_sort(F.collect_list(F.struct(position, "paragraph"))), lambda x: x["paragraph"])
    g = assigned.groupBy(protocol, order).agg(
        first.alias("_first"), last_page.alias("_last_page"), paragraphs.alias("paragraphs"),
        F.sum("num_tokens").alias("num_tokens"), F.sum("num_words").alias("num_words"))

    def page(c):
        return F.when(F.coalesce(c, F.lit(0)) == 0, F.lit("?")).otherwise(c.cast("string"))

    return g.select(protocol, order, F.col("_first.who").alias("who"), F.col("_first.u_id").alias("u_id"),
                    fx.join_paragraphs(F.col("paragraphs")).alias("speech_text"), "num_tokens", "num_words",
                    page(F.col("_first.page_number")).alias("page_number"),
                    page(F.col("_last_page")).alias("page_number2"))


def speech_records(speech_index: DataFrame, protocol: str = "protocol_id", order: str = "speech_no",
                   fields: Sequence[str] = ("speech_id", "n_utterances")) -> DataFrame:
    """A protocol's speeches as one ordered list of records, here rendered as
    'field:value|...' entries joined by ','. The list is bounded by the protocol."""
    rec = F.struct(order, *fields)
    entries = F.transform(F.array_sort(F.collect_list(rec)), lambda x: F.concat_ws(
        "|", *[F.concat(F.lit(f + ":"), x[f].cast("string")) for f in (order, *fields)]))
    return speech_index.groupBy(protocol).agg(F.array_join(entries, ",").alias("records"))


def speech_texts(speech_index: DataFrame, utterances: DataFrame, persons: DataFrame, speaker_notes: DataFrame,
                 gender: DataFrame, party: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """E07 for many speeches at once. `keys` (document_id) restricts to requested
    speeches; requested keys without a speech come back as rows with an `error`."""
    si = speech_index if keys is None else speech_index.join(keys.select("document_id"), "document_id", "left_semi")
    sp = speeches_from_utterances(assign_utterances(si, utterances))
    out = si.join(sp, ["protocol_id", "speech_no"], "left")
    p = persons.select(F.col("person_id").alias("_p"), F.col("name"))
    out = out.join(bounded_broadcast(p), out["person_id"] == p["_p"], "left").drop("_p")
    out = out.withColumn("name", F.coalesce(F.col("name"), F.col("person_id").cast("string")))
    out = out.join(speaker_notes, "speaker_note_id", "left")
    note = (F.when(F.col("speaker_note_id").isNull(), F.lit(""))
            .when(F.col("speaker_note_id") == "missing", F.lit(fx.MISSING_NOTE))
            .otherwise(F.coalesce(F.col("speaker_note"), F.lit("(introductory note not found)"))))
    out = out.withColumn("speaker_note", note)
    g = bounded_broadcast(gender.select("gender_id", "gender"))
    pa = bounded_broadcast(party.select("party_id", "party_abbrev"))
    out = out.join(g, "gender_id", "left").join(pa, "party_id", "left") \
        .withColumn("gender", F.coalesce("gender", F.lit(fx.UNKNOWN_CODE))) \
        .withColumn("party_abbrev", F.coalesce("party_abbrev", F.lit(fx.UNKNOWN_CODE)))
    res = out.select("document_id", "document_name", "protocol_name", "speech_id", "who", "u_id", "speech_text",
                     "num_tokens", "num_words", "page_number", "page_number2", "name", "speaker_note", "gender",
                     "party_abbrev", F.lit(None).cast("string").alias("error"))
    if keys is not None:
        missing = keys.select("document_id").join(speech_index.select("document_id"), "document_id", "left_anti")
        err = missing.select("document_id", *[F.lit(None).cast(f.dataType).alias(f.name)
                                              for f in res.schema.fields if f.name not in ("document_id", "error")],
                             F.concat(F.lit("speech "), F.col("document_id").cast("string"), F.lit(" not found"))
                             .alias("error"))
        res = res.unionByName(err.select(*res.columns))
    return res


def resolve_keys(spark, speech_index: DataFrame, keys: Sequence[int | str], strict: bool = True) -> DataFrame:
    """J14 key forms for many requested speeches: integer document id, `prot-...`
    document name or `i-...` speech id -> (key, document_id). Unknown keys keep a null
    id; an unsupported key form raises ValueError (checked on the driver, per key), or
    with `strict=False` also resolves to a null id."""
    from .codes import key_column

    rows = []
    for k in keys:
        try:
            col, value = key_column(k)
        except ValueError:
            if strict:
                raise
            col, value = "invalid", k
        rows.append((str(k), col, str(value)))
    req = spark.createDataFrame(rows, "key string, kind string, value string")
    si = speech_index.select("document_id", "document_name", "speech_id")
    by_id = req.where(F.col("kind") == "document_id").join(
        si.select(F.col("document_id").cast("string").alias("value"), "document_id"), "value", "left")
    by_name = req.where(F.col("kind") == "document_name").join(
        si.select(F.col("document_name").alias("value"), "document_id"), "value", "left")
    by_sid = req.where(F.col("kind") == "speech_id").join(
        si.select(F.col("speech_id").alias("value"), "document_id"), "value", "left")
    invalid = req.where(F.col("kind") == "invalid").select("key", F.lit(None).cast("bigint").alias("document_id"))
    return by_id.unionByName(by_name).unionByName(by_sid).select("key", "document_id").unionByName(invalid)


def speech_texts_by_keys(spark, speech_index: DataFrame, utterances: DataFrame, persons: DataFrame,
                         speaker_notes: DataFrame, gender: DataFrame, party: DataFrame,
                         keys: Sequence[int | str]) -> DataFrame:
    """E07 by request keys: one row per key; keys that match no speech (or have no known
    form) carry an `error` instead of failing the request."""
    resolved = resolve_keys(spark, speech_index, keys, strict=False)
    found = resolved.where(F.col("document_id").isNotNull())
    texts = speech_texts(speech_index, utterances, persons, speaker_notes, gender, party,
                         keys=found.select("document_id"))
    hit = found.join(texts, "document_id", "inner")
    miss = resolved.where(F.col("document_id").isNull()).select(
        "key", *[F.lit(None).cast(f.dataType).alias(f.name) for f in texts.schema.fields if f.name != "error"],
        F.concat(F.lit("speech "), F.col("key"), F.lit(" not found")).alias("error"))
    return hit.unionByName(miss.select(*hit.columns))


def export_rows(texts: DataFrame) -> DataFrame:
    """One row per speech: file name `{speaker}_{speech_id}.txt` and text."""
    return texts.select(F.concat(F.concat_ws("_", F.col("name"), F.col("speech_id")), F.lit(".txt")).alias("filename"),
                        F.col("speech_text").alias("text"))


def export_speeches(spark, speech_index: DataFrame, utterances: DataFrame, persons: DataFrame,
                    speaker_notes: DataFrame, gender: DataFrame, party: DataFrame,
                    ids: Sequence[int | str], max_ids: int = 100) -> DataFrame:
    """Export rows for 1..max_ids requested speeches (file name and text)."""
    if not 1 <= len(ids) <= max_ids:
        raise ValueError(f"between 1 and {max_ids} speech ids are required, got {len(ids)}")
    texts = speech_texts_by_keys(spark, speech_index, utterances, persons, speaker_notes, gender, party, ids)
    return export_rows(texts.where(F.col("error").isNull()))


def write_export(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """S11 sink: a bulk text export (one record per speech) instead of a driver-side zip."""
    rows.write.mode("overwrite").format(fmt).save(path)


def read_protocols(spark, path: str) -> DataFrame:
    """S04 re-aimed: protocols as JSON documents, read with a fixed schema."""
    return spark.read.schema(PROTOCOL_SCHEMA).json(path)


def read_protocol_zips(spark, path: str) -> DataFrame:
    """S04 from zip archives: each archive holds `{protocol}.json` (the utterances) and
    `metadata.json`; JSON is parsed by Spark with fixed schemas."""
    from ..sources import read_zip_members

    members = read_zip_members(spark, path, "*.json")
    utt = members.where(~F.col("member").endswith("metadata.json")).select(
        "archive", F.from_json("content", T.ArrayType(UTTERANCE_SCHEMA)).alias("utterances"))
    meta = members.where(F.col("member").endswith("metadata.json")).select(
        "archive", F.from_json("content", "name string, date string").alias("m"))
    return utt.join(meta, "archive", "left").select(F.col("m.name").alias("name"), F.col("m.date").alias("date"),
                                                    "utterances")


def protocol_utterances(protocols: DataFrame) -> DataFrame:
    """Flatten protocols to utterances; position = offset in the protocol, and
    each paragraph list joined (one utterance row)."""
    u = protocols.select(F.col("name").alias("protocol_name"), F.posexplode("utterances").alias("turn", "u"))
    return u.select("protocol_name", F.col("turn").cast("bigint").alias("turn"), "u.u_id", "u.who",
                    "u.speaker_note_id", "u.page_number", "u.num_tokens", "u.num_words",
                    F.array_join("u.paragraphs", "\n").alias("paragraph"))


def canonical_protocol_name(name: F.Column, width: int = 3) -> F.Column:
    """S04 name probing re-aimed: zero-pad the trailing number so join keys agree
    (`prot-1970--ak--29` -> `prot-1970--ak--029`)."""
    num = F.regexp_extract(name, r"(\d+)$", 1)
    return F.when(num == "", name).otherwise(
        F.concat(F.regexp_replace(name, r"\d+$", ""), F.lpad(num, F.greatest(F.lit(width), F.length(num)), "0")))
