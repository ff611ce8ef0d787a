"""Sources and sinks (S01-S16): explicit schemas, no inference; parquet is the stored
form of every model table, CSV/JSON for exchange."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fx

# Speech index columns and types as stored by the corpus tools.
SPEECH_INDEX_SCHEMA = T.StructType([
    T.StructField("document_id", T.LongType()), T.StructField("document_name", T.StringType()),
    T.StructField("u_id", T.StringType()), T.StructField("speech_index", T.IntegerType()),
    T.StructField("speech_name", T.StringType()), T.StructField("year", T.IntegerType()),
    T.StructField("chamber_abbrev", T.StringType()), T.StructField("who", T.StringType()),
    T.StructField("gender_id", T.IntegerType()), T.StructField("party_id", T.IntegerType()),
    T.StructField("speaker_note_id", T.StringType()), T.StructField("office_type_id", T.IntegerType()),
    T.StructField("sub_office_type_id", T.IntegerType()), T.StructField("n_utterances", T.IntegerType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("n_raw_tokens", T.LongType()),
    T.StructField("page_number", T.IntegerType()),
])
SPEECH_RENAMES = {"who": "person_id", "u_id": "speech_id"}


# S01 ------------------------------------------------------------------------------------

def read_speech_index(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """`;`-separated (optionally gzip) CSV with a header, or parquet; renames who/u_id and
    keeps the fixed columns with fixed types."""
    if fmt == "csv":
        df = spark.read.schema(SPEECH_INDEX_SCHEMA).option("sep", ";").option("header", True).csv(path)
    else:
        df = spark.read.parquet(path)
    for old, new in SPEECH_RENAMES.items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


# S02, S03 ----------------------------------------------------------------------------------

def read_tables(spark: SparkSession, folder: str, names: Sequence[str], fmt: str = "parquet") -> dict[str, DataFrame]:
    """Code tables by name (`select *` per table) as a dict of DataFrames."""
    return {n: spark.read.format(fmt).option("header", True).load(f"{folder.rstrip('/')}/{n}") for n in names}


def read_jdbc_tables(spark: SparkSession, url: str, names: Sequence[str],
                     properties: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """Code tables from a database reachable over JDBC (the driver jar must be on the classpath)."""
    return {n: spark.read.jdbc(url, n, properties=dict(properties or {})) for n in names}


# S05, S06, S10 ----------------------------------------------------------------------------

def store_corpus(dtm: DataFrame, vocab: DataFrame, index: DataFrame, folder: str, tag: str,
                 partition_by: Sequence[str] = ()) -> None:
    """Dtm (long), vocabulary and index as parquet below `folder/tag`."""
    base = f"{folder.rstrip('/')}/{tag}"
    w = dtm.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{base}/dtm")
    vocab.write.mode("overwrite").parquet(f"{base}/vocab")
    index.write.mode("overwrite").parquet(f"{base}/index")


def load_corpus(spark: SparkSession, folder: str, tag: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dtm, vocab, index)."""
    base = f"{folder.rstrip('/')}/{tag}"
    return (spark.read.parquet(f"{base}/dtm"), spark.read.parquet(f"{base}/vocab"),
            spark.read.parquet(f"{base}/index"))


def store_vocab(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(path)


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def ids_to_tokens(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """token_id -> token (token -> id is the same join on the other column)."""
    return ids.join(vocab.select("token_id", "token"), "token_id", "left")


# S08, S09, S12 ----------------------------------------------------------------------------

def read_document_index(spark: SparkSession, path: str, sep: str = "\t", schema: T.StructType | None = None
                        ) -> DataFrame:
    """Generic document index: needs `filename`; unnamed index columns are dropped;
    document_name = basename without extension; year as int when present."""
    reader = spark.read.option("sep", sep).option("header", True)
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    if "filename" not in df.columns:
        raise ValueError("document index has no filename column")
    df = df.drop(*[c for c in df.columns if c == "" or c.startswith("Unnamed") or c == "_c0"])
    df = df.withColumn("document_name", fx.document_name_of(F.col("filename")))
    if "year" in df.columns:
        df = df.withColumn("year", F.col("year").try_cast("int"))
    if "document_id" in df.columns:
        df = df.withColumn("document_id", F.col("document_id").try_cast("bigint"))
    else:  # W05: dense ids in file-name order
        from ..operators.dtm import dense_ids

        df = dense_ids(df, ["filename"], id_col="document_id")
    return df


def store_document_index(index: DataFrame, path: str, compression: str | None = None) -> None:
    """Tab-separated CSV with header (S12: optionally gzip)."""
    w = index.write.mode("overwrite").option("sep", "\t").option("header", True)
    if compression:
        w = w.option("compression", compression)
    w.csv(path)


def store_frames(frames: Mapping[str, DataFrame], folder: str, fmt: str = "csv", compression: str = "gzip") -> None:
    """Several frames as compressed files below one folder (one sub-folder each)."""
    for name, df in frames.items():
        w = df.write.mode("overwrite").option("compression", compression)
        if fmt == "csv":
            w.option("header", True).csv(f"{folder.rstrip('/')}/{name}")
        else:
            w.format(fmt).save(f"{folder.rstrip('/')}/{name}")


# S13 ----------------------------------------------------------------------------------------

def filename_field(filename: Column, spec: str) -> Column:
    """One field from a file name: `regex` (group 1 of a match anchored at the start) or
    `sep:pos` (after replacing '.' by sep), both on the base name. Empty -> null."""
    filename = F.regexp_extract(filename, "[^/]*$", 0)
    if ":" in spec and re.fullmatch(r".:\d+", spec):
        sep, pos = spec.split(":")
        parts = F.split(F.replace(filename, F.lit("."), F.lit(sep)), re.escape(sep))
        value = F.get(parts, int(pos))
    else:
        value = F.regexp_extract(filename, "^(?:" + spec + ")", 1)
    return F.nullif(value, F.lit(""))


def extract_filename_fields(df: DataFrame, filename_col: str, fields: Mapping[str, str],
                            int_fields: Sequence[str] = ()) -> DataFrame:
    """Add fields parsed from file names; existing columns are not overwritten; the
    int type is decided per column (declared), bad values -> null."""
    out = df
    for name, spec in fields.items():
        if name in df.columns:
            continue
        col = filename_field(F.col(filename_col), spec)
        out = out.withColumn(name, col.try_cast("bigint") if name in int_fields else col)
    return out


# S14 ----------------------------------------------------------------------------------------

def read_text_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """Files by glob as (filename, text) rows."""
    df = spark.read.option("pathGlobFilter", pattern).option("wholetext", True).text(folder)
    return df.select(F.input_file_name().alias("filename"), F.col("value").alias("text"))


def filter_by_names(df: DataFrame, filename_col: str, names: Sequence[str]) -> DataFrame:
    """Keep files whose basename or stem is in `names` (with or without extension).
    The name list is a request parameter, so it is a literal IN list."""
    base = fx.strip_path(F.col(filename_col))
    names = list(names)
    return df.where(base.isin(names) | fx.strip_extension(base).isin(names))


# Zip archives -------------------------------------------------------------------

ZIP_MEMBER_SCHEMA = "archive string, member string, content string"


def _unzip(pattern: str):
    import fnmatch
    import io
    import zipfile

    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(data)) as zf:
                    for name in zf.namelist():
                        if fnmatch.fnmatch(name, pattern):
                            rows.append((path, name, zf.read(name).decode("utf-8")))
            if rows:
                yield pd.DataFrame(rows, columns=["archive", "member", "content"])

    return run


def read_zip_members(spark: SparkSession, path: str, member_pattern: str = "*", archive_glob: str = "*.zip"
                     ) -> DataFrame:
    """Members of zip archives as (archive, member, content) text rows. Each archive is
    one binary row, so a task unpacks whole files; members are filtered by glob."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", archive_glob).load(path)
    return files.select("path", "content").mapInPandas(_unzip(member_pattern), ZIP_MEMBER_SCHEMA)


def read_zipped_csv(spark: SparkSession, path: str, schema: T.StructType, member_pattern: str = "*.csv",
                    sep: str = ",") -> DataFrame:
    """CSV members of zip archives parsed by Spark (`from_csv` per line)."""
    members = read_zip_members(spark, path, member_pattern)
    lines = members.select(F.explode(F.split("content", "\r?\n")).alias("line"))
    header = sep.join(f.name for f in schema.fields)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    lines = lines.where((F.col("line") != "") & (F.col("line") != header))
    return lines.select(F.from_csv("line", ddl, {"sep": sep}).alias("r")).select("r.*")
