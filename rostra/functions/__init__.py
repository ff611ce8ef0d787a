"""Scalar column functions (F01-F10). Every function maps Columns to a Column built
from Spark's own expressions, so it stays inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_broadcast, with_scalars

# Fixed values -----------------------------------------------------------------------
# Period lengths in years.
TIME_PERIODS = {"year": 1, "lustrum": 5, "decade": 10}
# Wikidata item URL prefix and the label shown for an unknown speaker.
WIKIDATA_URL = "https://www.wikidata.org/wiki/"
UNKNOWN_SPEAKER = "Okänd"
# Label for codes that cannot be decoded in speech details.
UNKNOWN_CODE = "Okänt"
# Speaker note text when the note is marked missing.
MISSING_NOTE = "Talet saknar notering"
# Punctuation that loses the space in front of it (followed by whitespace or the end).
PUNCTUATION_SPACE = r"(?U)\s([,?.!\"%';:`](?:\s|$))"
# Default replacement of masked terms.
MASKED_TERM = "_masked_"
# Where protocol PDFs are served; deployments pass their own.
DEFAULT_PDF_BASE_URL = "https://pdf.example.org/records/"
# -------------------------------------------------------------------------------------


# F01 ---------------------------------------------------------------------------------

def temporal_key(year: Column, spec: Any) -> Column:
    """year -> period: 'year' | 'lustrum' | 'decade' (y - y % k); a dict {period: [years]}
    (years not listed -> null); or a function Column -> Column."""
    if callable(spec):
        return spec(year)
    if isinstance(spec, str):
        if spec not in TIME_PERIODS:
            raise ValueError(f"{spec} is not a known period specifier")
        k = TIME_PERIODS[spec]
        return year if k == 1 else year - year % k
    if isinstance(spec, Mapping):
        pairs = [(y, period) for period, years in spec.items() for y in years]
        mapping = F.create_map(*[F.lit(v) for pair in pairs for v in pair])
        return F.element_at(mapping, year) if pairs else F.lit(None)
    raise ValueError(f"unknown temporal key specifier {spec!r}")


# F02 ---------------------------------------------------------------------------------

def fix_whitespace(text: Column) -> Column:
    """Drop the space before punctuation (Unicode-aware whitespace)."""
    return F.regexp_replace(text, PUNCTUATION_SPACE, "$1")


def join_paragraphs(paragraphs: Column) -> Column:
    """Speech text: paragraphs joined by newline, then F02."""
    return fix_whitespace(F.array_join(paragraphs, "\n"))


# F03 ---------------------------------------------------------------------------------

def format_protocol_id(name: Column) -> Column:
    """Protocol id -> readable label.

    prot-1951-vår-ak--7_012   -> 'Andra kammaren 1951:7 012'     (six '-' parts)
    prot-1933-b-fk--4-02_009  -> 'Första kammaren 1933:4 02 009' (seven parts)
    prot-1987--21_003         -> '1987:21 003'
    prot-199091--56_118       -> '1990/91:56 118'
    Names with too few parts come back unchanged.
    """
    parts = F.split(name, "-")
    n = F.size(parts)

    def part(i: int) -> Column:
        return F.get(parts, i)

    last = F.replace(F.element_at(parts, -1), F.lit("_"), F.lit(" "))
    is_two_chamber = F.contains(name, F.lit("ak")) | F.contains(name, F.lit("fk"))
    chamber = F.concat(F.when(F.contains(name, F.lit("ak")), F.lit("Andra")).otherwise(F.lit("Första")),
                       F.lit(" kammaren"))
    two = (F.when(n == 6, F.concat(chamber, F.lit(" "), part(1), F.lit(":"), last))
           .when(n > 5, F.concat(chamber, F.lit(" "), part(1), F.lit(":"), part(5), F.lit(" "), last)))
    year = part(1)
    number = F.replace(part(3), F.lit("_"), F.lit(" "))
    one = (F.when(n < 4, F.lit(None))
           .when(F.length(year) == 4, F.concat(year, F.lit(":"), number))
           .otherwise(F.concat(F.substring(year, 1, 4), F.lit("/"), year.substr(F.lit(5), F.length(year)),
                               F.lit(":"), number)))
    return F.coalesce(F.when(is_two_chamber, two).otherwise(one), name)


# F04, F05 ----------------------------------------------------------------------------

def wiki_link(wiki_id: Column, unknown_label: str = UNKNOWN_SPEAKER) -> Column:
    return F.when(wiki_id == "unknown", F.lit(unknown_label)).otherwise(F.concat(F.lit(WIKIDATA_URL), wiki_id))


def speech_link(document_name: Column, page: Column | int = 1, base_url: str = DEFAULT_PDF_BASE_URL) -> Column:
    """PDF link: base + year (2nd '-' part) + '/' + name before '_' + '.pdf#page=' + page."""
    page_col = page if isinstance(page, Column) else F.lit(page)
    return F.concat(F.lit(base_url), F.get(F.split(document_name, "-"), 1), F.lit("/"),
                    F.get(F.split(document_name, "_"), 0), F.lit(".pdf#page="), page_col.cast("string"))


# F06 ---------------------------------------------------------------------------------

def multiple_replace(text: Column, replace_map: Mapping[str, str], ignore_case: bool = False) -> Column:
    """Replace many literal strings in one pass from left to right, the longest key first:
    the text is split at all keys at once and joined again with what the keys map to."""
    import re

    keys = sorted((k for k in replace_map if k), key=len, reverse=True)
    if not keys:
        return text
    fold = F.lower if ignore_case else (lambda c: c)
    pattern = ("(?i)" if ignore_case else "") + "(?:" + "|".join(re.escape(k).replace("\\ ", " ") for k in keys) + ")"
    table = {k.lower() if ignore_case else k: replace_map[k] for k in reversed(keys)}
    values = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    between = F.split(text, pattern, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.element_at(values, fold(m)))
    return F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def load_term_substitutions(df: DataFrame, default_term: str = MASKED_TERM, vocab: DataFrame | None = None
                            ) -> DataFrame:
    """F06 table form: a read `term;replacement` file (one column `_c0` or two columns)
    -> (term, replacement); missing replacement -> default; only terms in `vocab`."""
    cols = df.columns
    if len(cols) == 1:
        parts = F.split(F.col(cols[0]), ";")
        t = df.select(F.trim(F.get(parts, 0)).alias("term"), F.trim(F.get(parts, 1)).alias("replacement"))
    else:
        t = df.select(F.trim(F.col(cols[0])).alias("term"), F.trim(F.col(cols[1])).alias("replacement"))
    t = t.where(F.col("term") != "").select(
        "term", F.coalesce(F.nullif(F.col("replacement"), F.lit("")), F.lit(default_term)).alias("replacement"))
    if vocab is not None:
        t = t.join(vocab.select(F.col("token").alias("term")), "term", "left_semi")
    return t


def substitute_tokens(tokens: DataFrame, substitutions: DataFrame, token_col: str = "token") -> DataFrame:
    """F06 token level: left join on a substitution table (broadcast when its size is
    within the bound)."""
    s = bounded_broadcast(substitutions.select(F.col("term").alias(token_col), "replacement"))
    return tokens.join(s, token_col, "left") \
        .withColumn(token_col, F.coalesce("replacement", token_col)).drop("replacement")


# F07 ---------------------------------------------------------------------------------

def page_number(value: Column) -> Column:
    """Page as integer, else 1."""
    return F.coalesce(value.try_cast("int"), F.lit(1))


def speaker_note(note_id: Column, note: Column) -> Column:
    """'' without a note id, the fixed text for a note marked missing, else the note."""
    return (F.when(note_id.isNull(), F.lit(""))
            .when(note == "missing", F.lit(MISSING_NOTE))
            .otherwise(F.coalesce(note, F.lit(""))))


# F08 ---------------------------------------------------------------------------------

def project_to_range(value: Column, max_value: Column, low: float, high: float) -> Column:
    """Scale by the maximum into [low, high]."""
    return F.lit(low) + (F.lit(high) - F.lit(low)) * F.try_divide(value, max_value)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def normalize_array(values: Column, p: int = 1) -> Column:
    """Lp-normalise an array column (zero vectors stay zero)."""
    if p == 1:
        norm = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.abs(x))
    else:
        norm = F.pow(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.pow(F.abs(x), p)), 1.0 / p)
    return F.transform(values, lambda x: F.when(norm == 0, x.cast("double")).otherwise(x / norm))


def normalize_column(df: DataFrame, col: str, by: Sequence[str] = (), p: int = 1) -> DataFrame:
    """L1/Lp-normalise a value column within groups `by` (one aggregate + join)."""
    if p == 1:
        agg = F.sum(F.abs(col))
    else:
        agg = F.pow(F.sum(F.pow(F.abs(col), p)), 1.0 / p)
    norms = df.groupBy(*by).agg(agg.alias("_norm"))
    joined = df.join(norms, list(by), "inner") if by else with_scalars(df, norms)
    return joined.withColumn(col, F.when(F.col("_norm") == 0, F.col(col).cast("double"))
                             .otherwise(F.col(col) / F.col("_norm"))).drop("_norm")


# F09 ---------------------------------------------------------------------------------

def as_slim_types(df: DataFrame, columns: Sequence[str], dtype: str) -> DataFrame:
    """Fill nulls with 0 and cast."""
    present = [c for c in columns if c in df.columns]
    return df.fillna(0, subset=present).select(
        *[F.col(c).cast(dtype).alias(c) if c in present else F.col(c) for c in df.columns])


# F10 ---------------------------------------------------------------------------------

def strip_path(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./]*$", "")


def strip_path_and_extension(path: Column) -> Column:
    return strip_extension(strip_path(path))


def replace_extension(name: Column, extension: str) -> Column:
    ext = extension if extension.startswith(".") else "." + extension
    return F.concat(strip_extension(name), F.lit(ext))


def document_name_of(filename: Column) -> Column:
    """Generic index: basename without extension."""
    return strip_path_and_extension(filename)


