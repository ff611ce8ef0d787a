"""Part-of-speech groups (A16, U03): tags are joined to a scheme table and counted per
group; the group list for pivots comes from the scheme table itself."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded_broadcast

# The SUC tag set (tag, group, description).
SUC_TAGS = [
    ("AB", "Adverb", "Adverb"), ("DT", "Pronoun", "Determinator"), ("HA", "Adverb", "Adverbs (inq.)"),
    ("HD", "Pronoun", "Det. (inq.)"), ("HP", "Pronoun", "Pronoun (inq.)"), ("HS", "Pronoun", "Pronoun (inq.)"),
    ("IE", "Adverb", "Inf. mark"), ("IN", "Adverb", "Interjection"), ("JJ", "Adjective", "Adjectiv"),
    ("KN", "Conjunction", "Conjunction"), ("NN", "Noun", "Noun"), ("PC", "Verb", "Participle"),
    ("PL", "Adverb", "Particle"), ("PM", "Noun", "Proper noun"), ("PN", "Pronoun", "Pronoun"),
    ("PP", "Preposition", "Preposition"), ("PS", "Pronoun", "Poss. pron."), ("RG", "Numeral", "Numeral"),
    ("RO", "Numeral", "Numeral"), ("SN", "Conjunction", "Subjuncion"), ("UO", "Other", "Foreign ord"),
    ("VB", "Verb", "Verb"), ("MAD", "Delimiter", "Delimiter"), ("MID", "Delimiter", "Delimiter"),
    ("PAD", "Delimiter", "Delimiter"),
]
# The Universal tag set (tag, group, description).
UNIVERSAL_TAGS = [
    ("ADJ", "Adjective", "Adjective"), ("ADP", "Preposition", "Preposition"), ("ADV", "Adverb", "Adverb"),
    ("AUX", "Other", "Other"), ("CONJ", "Conjunction", "Conjunction"),
    ("CCONJ", "Conjunction", "Conjunction, coordinating"), ("DET", "Pronoun", "Determinator"),
    ("INTJ", "Adverb", "Interjection"), ("NOUN", "Noun", "Noun"), ("NUM", "Numeral", "Numeral"),
    ("PART", "Adverb", ""), ("PRON", "Pronoun", "Pronoun"), ("PROPN", "Noun", "Proper Noun"),
    ("PUNCT", "Delimiter", "Punctuation"), ("SCONJ", "Conjunction", "Subjuncion"), ("SYM", "Other", "Symbol"),
    ("VERB", "Verb", "Verb"), ("X", "Other", "Other"), ("EOL", "Delimiter", "End of line"),
    ("SPACE", "Delimiter", "Space"),
]
# The Penn Treebank tag set (tag, group, universal tag, description).
PENN_TAGS = [
    ("$", "Other", "SYM", "symbol, currency"), ("``", "Delimiter", "PUNCT", "opening quotation mark"),
    ("''", "Delimiter", "PUNCT", "closing quotation mark"), (",", "Delimiter", "PUNCT", "punctuation mark, comma"),
    ("-LRB-", "Delimiter", "PUNCT", "left round bracket"), ("-RRB-", "Delimiter", "PUNCT", "right round bracket"),
    (".", "Delimiter", "PUNCT", "punctuation mark, sentence closer"),
    (":", "Delimiter", "PUNCT", "punctuation mark, colon or ellipsis"), ("ADD", "Other", "X", "email"),
    ("AFX", "Adjective", "ADJ", "affix"), ("CC", "Conjunction", "CCONJ", "conjunction, coordinating"),
    ("CD", "Numeral", "NUM", "cardinal number"), ("DT", "Pronoun", "DET", "determiner"),
    ("EX", "Pronoun", "PRON", "existential there"), ("FW", "Other", "X", "foreign word"),
    ("GW", "Other", "X", "additional word in multi-word expression"),
    ("HYPH", "Delimiter", "PUNCT", "punctuation mark, hyphen"),
    ("IN", "Preposition", "ADP", "conjunction, subordinating or preposition"), ("JJ", "Adjective", "ADJ", "adjective"),
    ("JJR", "Adjective", "ADJ", "adjective, comparative"), ("JJS", "Adjective", "ADJ", "adjective, superlative"),
    ("LS", "Other", "X", "list item marker"), ("MD", "Verb", "VERB", "verb, modal auxiliary"),
    ("NFP", "Delimiter", "PUNCT", "superfluous punctuation"), ("NIL", "Other", "X", "missing tag"),
    ("NN", "Noun", "NOUN", "noun, singular or mass"), ("NNP", "Noun", "PROPN", "noun, proper singular"),
    ("NNPS", "Noun", "PROPN", "noun, proper plural"), ("NNS", "Noun", "NOUN", "noun, plural"),
    ("PDT", "Pronoun", "DET", "predeterminer"), ("POS", "Adverb", "PART", "possessive ending"),
    ("PRP", "Pronoun", "PRON", "pronoun, personal"), ("PRP$", "Pronoun", "DET", "pronoun, possessive"),
    ("RB", "Adverb", "ADV", "adverb"), ("RBR", "Adverb", "ADV", "adverb, comparative"),
    ("RBS", "Adverb", "ADV", "adverb, superlative"), ("RP", "Adverb", "ADP", "adverb, particle"),
    ("SP", "Delimiter", "SPACE", "space"), ("SYM", "Other", "SYM", "symbol"),
    ("TO", "Adverb", "PART", "infinitival “to”"), ("UH", "Adverb", "INTJ", "interjection"),
    ("VB", "Verb", "VERB", "verb, base form"), ("VBD", "Verb", "VERB", "verb, past tense"),
    ("VBG", "Verb", "VERB", "verb, gerund or present participle"), ("VBN", "Verb", "VERB", "verb, past participle"),
    ("VBP", "Verb", "VERB", "verb, non-3rd person singular present"),
    ("VBZ", "Verb", "VERB", "verb, 3rd person singular present"), ("WDT", "Pronoun", "DET", "wh-determiner"),
    ("WP", "Pronoun", "PRON", "wh-pronoun, personal"), ("WP$", "Pronoun", "DET", "wh-pronoun, possessive"),
    ("WRB", "Adverb", "ADV", "wh-adverb"), ("XX", "Other", "X", "unknown"), ("_SP", "Delimiter", "SPACE", ""),
]
SCHEMES = {"SUC": SUC_TAGS, "Universal": UNIVERSAL_TAGS, "Penn": PENN_TAGS}
DELIMITER = "Delimiter"

# Tagged stream used with the stand-in tagger: words, numbers and single punctuation marks.
TAGGED_TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def scheme(spark: SparkSession, rows: Sequence[tuple[str, ...]] | str = SUC_TAGS) -> DataFrame:
    """A tag scheme as a table (pos_id, tag, tag_group_name, description); `rows` is a
    list of tag rows or one of the names in SCHEMES."""
    rows = SCHEMES[rows] if isinstance(rows, str) else rows
    return spark.createDataFrame([(i, r[0], r[1], r[-1]) for i, r in enumerate(rows)],
                                 "pos_id int, tag string, tag_group_name string, description string")


def universal_tags(spark: SparkSession) -> DataFrame:
    """Penn tag -> Universal tag mapping."""
    return spark.createDataFrame([(r[0], r[2]) for r in PENN_TAGS], "tag string, universal_tag string")


def groups_of(rows: Sequence[tuple[str, ...]] | str = SUC_TAGS) -> list[str]:
    rows = SCHEMES[rows] if isinstance(rows, str) else rows
    return sorted({r[1] for r in rows})


def stand_in_tag(token: Column) -> Column:
    """Shape rule standing in for a tagger: '.' MAD, ',' MID, other punctuation PAD,
    numbers RG, capitalised words PM, other words NN."""
    return (F.when(token == ".", F.lit("MAD")).when(token == ",", F.lit("MID"))
            .when(~token.rlike(r"^[\p{L}\p{N}]+$"), F.lit("PAD"))
            .when(token.rlike("^[0-9]+$"), F.lit("RG"))
            .when(F.substring(token, 1, 1) != F.lower(F.substring(token, 1, 1)), F.lit("PM"))
            .otherwise(F.lit("NN")))


def group_counts(tags: DataFrame, scheme_df: DataFrame, key: str = "document_id",
                 groups: Sequence[str] | None = None) -> DataFrame:
    """Per key, counts per PoS group (one column per group, zeros filled) and
    n_tokens = all tokens except delimiters; unknown tags are in no group but are
    counted in n_tokens. tags: (key, tag) one row per token."""
    groups = list(groups) if groups is not None else sorted(
        r["tag_group_name"] for r in scheme_df.select("tag_group_name").distinct().collect())
    t = tags.join(bounded_broadcast(scheme_df.select("tag", "tag_group_name")), "tag", "left")
    wide = t.groupBy(key).pivot("tag_group_name", groups).agg(F.count(F.lit(1)))
    n = t.groupBy(key).agg(F.count(F.when(F.coalesce(F.col("tag_group_name"), F.lit("")) != DELIMITER, 1))
                           .alias("n_tokens"))
    return wide.fillna(0, subset=groups).join(n, key, "inner")


def exclude_tags(scheme_df: DataFrame, excludes: Iterable[str] = ()) -> DataFrame:
    """All tags except the given tags or groups (a group name excludes its tags)."""
    ex = list(excludes)
    return scheme_df.where(~F.col("tag").isin(ex) & ~F.col("tag_group_name").isin(ex))


def all_types_except(scheme_df: DataFrame, tags: Iterable[str] = ()) -> DataFrame:
    """All tags except the given ones and the delimiters."""
    return exclude_tags(scheme_df, [*tags, DELIMITER])
