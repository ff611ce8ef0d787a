"""The corpus model derived from the driver tables.

Every rule here is written twice: as DataFrame code (used by the library) and as a
SQL common table expression (used by the DuckDB oracle in ``plans.catalog``). The two
must stay expression-for-expression equal.

  speech_index   <- documents      one row per speech
  speech_tokens  <- documents.text word / lemma / pos arrays, array offset = position
  dtm            <- speech_tokens  (document_id, token, n), token = lemma
  persons        <- customer       speakers
  person_party   <- orders         many-to-many person -> party
  party          <- nation         sub_office_type <- nation, office_type <- region
  speaker_notes  <- labels         partial coverage
  utterances     <- conversations  protocol = conv_id, one utterance per turn

No lemmatiser or tagger is built: lemma = lower(word), pos = a shape rule.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import spread

# Fixed values -------------------------------------------------------------------
# Word tokens: maximal runs of letters and digits.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
# Stand-in part-of-speech tags (a shape rule, not a tagger): numerals, capitalised
# words (proper nouns) and all other words.
POS_NUMERAL, POS_PROPER, POS_NOUN = "RG", "PM", "NN"
# gender(gender_id, gender, gender_abbrev)
GENDER_ROWS = [(0, "unknown", "?"), (1, "man", "M"), (2, "woman", "K")]
# chamber(chamber_id, chamber, chamber_abbrev); the last row has a blank abbreviation.
CHAMBER_ROWS = [(1, "English chamber", "en"), (2, "German chamber", "de"),
                (3, "French chamber", "fr"), (4, "Spanish chamber", "es"),
                (5, "Joint session", " ")]
# Speeches are cut from protocols two utterances at a time.
UTTERANCES_PER_SPEECH = 2
# --------------------------------------------------------------------------------

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Word tokens of a text column (group 0 of every match)."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), 0)


def pos_of(word: Column) -> Column:
    return (F.when(word.rlike("^[0-9]+$"), F.lit(POS_NUMERAL))
            .when(F.substring(word, 1, 1) != F.lower(F.substring(word, 1, 1)), F.lit(POS_PROPER))
            .otherwise(F.lit(POS_NOUN)))


def speech_columns(doc: DataFrame, words: Column) -> list[Column]:
    doc_id = F.col("doc_id")
    year = F.lit(1970) + doc_id % 50
    party_id = (F.expr("try_cast(regexp_extract(source, '([0-9]+)', 1) as int)") % 25).cast("bigint")
    name = F.format_string("prot-%d--%s--%06d_%03d", year, F.col("lang"),
                           F.floor(doc_id / 10), doc_id % 10 + 1)
    return [
        doc_id.alias("document_id"),
        name.alias("document_name"),
        F.concat(F.lit("i-"), doc_id.cast("string")).alias("speech_id"),
        (doc_id % 10 + 1).alias("speech_index"),
        name.alias("speech_name"),
        year.alias("year"),
        F.col("lang").alias("chamber_abbrev"),
        (doc_id % 150).alias("person_id"),
        (doc_id % 3).alias("gender_id"),
        party_id.alias("party_id"),
        F.concat(F.lit("n-"), doc_id.cast("string")).alias("speaker_note_id"),
        (party_id % 5).alias("office_type_id"),
        party_id.alias("sub_office_type_id"),
        F.size(F.split(F.col("text"), "\n")).cast("bigint").alias("n_utterances"),
        F.size(words).cast("bigint").alias("n_tokens"),
        F.size(words).cast("bigint").alias("n_raw_tokens"),
        (F.floor((doc_id % 10) / 2) + 1).alias("page_number"),
    ]


SPEECH_INDEX_COLUMNS = ["document_id", "document_name", "speech_id", "speech_index", "speech_name", "year",
                        "chamber_abbrev", "person_id", "gender_id", "party_id", "speaker_note_id",
                        "office_type_id", "sub_office_type_id", "n_utterances", "n_tokens", "n_raw_tokens",
                        "page_number"]


@dataclass
class Corpus:
    """Lazily derived model tables over one folder of driver tables."""

    spark: SparkSession
    sf_dir: str
    given: frozenset[str] = frozenset()  # tables that the caller supplied

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @classmethod
    def from_frames(cls, spark: SparkSession, sf_dir: str = "", **frames: DataFrame) -> "Corpus":
        """A corpus over the caller's own tables (speech_tokens, dtm, vocab, persons,
        party, gender, chamber, office_type, sub_office_type, person_party,
        speaker_notes, utterances, protocol_speech_index ...); tables not given are
        derived from `sf_dir` as usual."""
        c = cls(spark, sf_dir)
        c.given = frozenset(frames)
        for name, df in frames.items():
            if not isinstance(getattr(cls, name, None), cached_property):
                raise ValueError(f"unknown corpus table {name}")
            c.__dict__[name] = df
        return c

    # -- speeches and tokens -------------------------------------------------------
    @cached_property
    def documents(self) -> DataFrame:
        return spread(self.table("documents"), "doc_id")

    @cached_property
    def speech_tokens(self) -> DataFrame:
        """speech_index columns + `word` and `lemma` arrays (same length, offset = position)."""
        words = words_of(F.col("text"))
        doc = self.documents.select("doc_id", "lang", "source", "text", words.alias("_w"))
        return doc.select(*speech_columns(doc, F.col("_w")), F.col("_w").alias("word"),
                          F.transform("_w", F.lower).alias("lemma"))

    def speech_tokens_by_range(self, parts: int) -> DataFrame:
        """speech_tokens in ranges of (year, document_id). Texts are shuffled and cut into tokens afterwards, unless the tokens were given."""
        if "speech_tokens" in self.given:
            return self.speech_tokens.repartitionByRange(parts, "year", "document_id")
        docs = self.documents if "documents" in self.given else self.table("documents")
        dealt = docs.select("doc_id", "lang", "source", "text").repartitionByRange(parts, F.lit(1970) + F.col("doc_id") % 50, F.col("doc_id"))
        return Corpus.from_frames(self.spark, self.sf_dir, documents=dealt).speech_tokens

    @cached_property
    def speech_index(self) -> DataFrame:
        return self.speech_tokens.select(*SPEECH_INDEX_COLUMNS)

    def tokens_with_pos(self) -> DataFrame:
        return self.speech_tokens.withColumn("pos", F.transform("word", pos_of))

    @cached_property
    def dtm(self) -> DataFrame:
        """Document-term matrix in long form: (document_id, token, n)."""
        from .operators.dtm import dtm_from_token_arrays

        return dtm_from_token_arrays(self.speech_tokens)

    @cached_property
    def vocab(self) -> DataFrame:
        """Vocabulary with corpus term frequencies: (token, tf)."""
        return self.dtm.groupBy("token").agg(F.sum("n").alias("tf"))

    # -- code tables and persons -----------------------------------------------------
    @cached_property
    def persons(self) -> DataFrame:
        c = self.table("customer")
        key = F.col("c_custkey")
        return c.select(
            key.alias("person_id"),
            key.alias("pid"),
            F.when(F.col("c_acctbal") < 0, F.lit("unknown"))
             .otherwise(F.concat(F.lit("Q"), key.cast("string"))).alias("wiki_id"),
            F.col("c_name").alias("name"),
            (key % 3).alias("gender_id"),
            F.col("c_nationkey").cast("bigint").alias("party_id"),
            (F.lit(1900) + key % 60).alias("year_of_birth"),
            F.when(key % 4 == 0, F.lit(None).cast("bigint"))
             .otherwise(F.lit(1960) + key % 60).alias("year_of_death"),
        )

    @cached_property
    def person_party(self) -> DataFrame:
        o = self.table("orders")
        pp = o.select(F.col("o_custkey").alias("person_id"),
                      F.substring("o_orderpriority", 1, 1).try_cast("bigint").alias("party_id")).distinct()
        # person_party_id: a stable key derived from the pair, not a positional number.
        return pp.select((F.col("person_id") * 10 + F.col("party_id")).alias("person_party_id"),
                         "person_id", "party_id")

    @cached_property
    def party(self) -> DataFrame:
        n = self.table("nation")
        return n.select(F.col("n_nationkey").cast("bigint").alias("party_id"),
                        F.col("n_name").alias("party"),
                        F.regexp_replace("n_name", "NATION_", "N").alias("party_abbrev"),
                        F.col("n_regionkey").cast("bigint").alias("sort_order"))

    @cached_property
    def office_type(self) -> DataFrame:
        r = self.table("region")
        return r.select(F.col("r_regionkey").cast("bigint").alias("office_type_id"),
                        F.col("r_name").alias("office"))

    @cached_property
    def sub_office_type(self) -> DataFrame:
        n = self.table("nation")
        return n.select(F.col("n_nationkey").cast("bigint").alias("sub_office_type_id"),
                        F.col("n_regionkey").cast("bigint").alias("office_type_id"),
                        F.col("n_name").alias("identifier"),
                        F.concat(F.lit("Office of "), F.col("n_name")).alias("sub_office_type"))

    @cached_property
    def gender(self) -> DataFrame:
        return self.spark.createDataFrame(GENDER_ROWS, "gender_id bigint, gender string, gender_abbrev string")

    @cached_property
    def chamber(self) -> DataFrame:
        return self.spark.createDataFrame(CHAMBER_ROWS, "chamber_id bigint, chamber string, chamber_abbrev string")

    @cached_property
    def speaker_notes(self) -> DataFrame:
        lab = self.table("labels")
        return lab.select(
            F.concat(F.lit("n-"), F.col("doc_id").cast("string")).alias("speaker_note_id"),
            F.when(F.col("quality") == 0, F.lit("missing"))
             .otherwise(F.concat(F.lit("Speaker note "), F.col("doc_id").cast("string"))).alias("speaker_note"))

    def code_tables(self) -> dict[str, DataFrame]:
        return {"party": self.party, "gender": self.gender, "chamber": self.chamber,
                "office_type": self.office_type, "sub_office_type": self.sub_office_type,
                "persons": self.persons, "person_party": self.person_party,
                "speaker_notes": self.speaker_notes}

    # -- protocols -------------------------------------------------------------------
    @cached_property
    def utterances(self) -> DataFrame:
        c = self.table("conversations")
        w = words_of(F.col("text"))
        return c.select(
            F.col("conv_id").alias("protocol_id"),
            F.col("turn"),
            F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("u_id"),
            F.col("role").alias("who"),
            F.col("text").alias("paragraph"),
            F.size(w).cast("bigint").alias("num_tokens"),
            F.size(F.split(F.trim(F.col("text")), r"\s+")).cast("bigint").alias("num_words"),
            (F.floor(F.col("turn") / 3) + 1).cast("bigint").alias("page_number"),
        )

    @cached_property
    def protocol_speeches(self) -> DataFrame:
        """(protocol_id, speech_no, n_utterances): turns taken two by two; the last may be one."""
        k = UTTERANCES_PER_SPEECH
        n = self.table("conversations").groupBy(F.col("conv_id").alias("protocol_id")) \
            .agg((F.max("turn") + 1).alias("n_turns"))
        s = n.select("protocol_id", "n_turns",
                     F.explode(F.sequence(F.lit(0).cast("bigint"),
                                          F.floor((F.col("n_turns") - 1) / k).cast("bigint"))).alias("speech_no"))
        return s.select("protocol_id", "speech_no",
                        F.least(F.lit(k).cast("bigint"), F.col("n_turns") - F.col("speech_no") * k)
                        .alias("n_utterances"))


    @cached_property
    def protocol_speech_index(self) -> DataFrame:
        """Speech index of the protocols: keys, names and speaker attributes by rule."""
        s = self.protocol_speeches
        pid, k = F.col("protocol_id"), F.col("speech_no")
        pname = F.format_string("prot-%d--cv--%06d", F.lit(1970) + pid % 50, pid)
        return s.select(
            (pid * 1000 + k).alias("document_id"),
            F.concat(pname, F.format_string("_%03d", k + 1)).alias("document_name"),
            pname.alias("protocol_name"),
            F.format_string("i-c%d-%d", pid, k).alias("speech_id"),
            "protocol_id", "speech_no", "n_utterances",
            ((pid + k) % 150).alias("person_id"),
            ((pid + k) % 3).alias("gender_id"),
            ((pid * 7 + k) % 30).alias("party_id"),
            F.when((pid + k) % 7 == 0, F.lit("missing"))
             .otherwise(F.concat(F.lit("n-"), (pid * 3 + k).cast("string"))).alias("speaker_note_id"),
        )


# Parts of a prepared corpus, each after those that it is built from.
PARTS = ("speech_tokens", "dtm", "vocab", "postings", "grams", "cube", "keys")


def prepare_corpus(corpus: Corpus, folder: str, with_indexes: bool = True, only: Sequence[str] | None = None) -> None:
    """Tokenise once and store the speech rows (with token arrays, partitioned by year),
    the DTM and the vocabulary with term frequencies as parquet (S06). The DTM is built
    from the stored token arrays (no second tokenisation). `with_indexes` also stores
    postings, the vocabulary's n-grams, the trend cube and the speeches' keys (`operators.indexes`). `only` names the PARTS
    to store; what they are built from is read where it is stored, else computed.

    Each part shuffles its rows once: counts are taken within a document's row, sent to the range of their sort key and
    added there."""
    from .operators import indexes

    base, spark = folder.rstrip("/"), corpus.spark
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = [p for p in PARTS if (p in only if only is not None else with_indexes or p in PARTS[:3])]
    have = PreparedCorpus(spark, corpus.sf_dir, base, corpus)

    def write(df: DataFrame, name: str, *by: str) -> None:
        w = df.write.mode("overwrite").option("compression", "zstd")
        (w.partitionBy(*by) if by else w).parquet(f"{base}/{name}")

    if "speech_tokens" in wanted:
        # range partitioning on (year, document_id): each task writes one or two year folders,
        # a large year is split over many tasks, and files are sorted by document id
        write(corpus.speech_tokens_by_range(parts).sortWithinPartitions("document_id"), "speech_tokens", "year")
    speeches = have.speech_tokens  # tokenised once where stored
    if "dtm" in wanted:
        # sorted by (token, document_id): word lookups skip files and row groups by their
        # min/max statistics; the range key includes document_id so no token is one task
        cells = indexes.row_counts(speeches, "lemma", ["document_id"]).repartitionByRange(parts, "token", "document_id")
        write(cells.groupBy("document_id", "token").agg(F.sum("n").alias("n")).sortWithinPartitions("token", "document_id"), "dtm")
    if "vocab" in wanted:
        stored_dtm = have.part("dtm")
        words = stored_dtm.groupBy("token").agg(F.sum("n").alias("tf")) if stored_dtm is not None \
            else speeches.select(F.explode("lemma").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("tf"))
        write(words, "vocab")
    if "postings" in wanted:
        indexes.store_postings(speeches, f"{base}/postings")
    if "grams" in wanted:
        indexes.store_grams(have.vocab, f"{base}/grams")
    if "cube" in wanted:
        indexes.store_trend_cube(None if indexes.distinct_ids(speeches) else have.dtm, speeches, f"{base}/cube")
    if "keys" in wanted:
        indexes.store_keys(speeches, f"{base}/keys")


def read_prepared_tokens(corpus: Corpus, base: str) -> DataFrame:
    """Stored speech rows; the year folders are read back as int, so year is cast to the
    model's bigint (filters on it still prune folders)."""
    return corpus.spark.read.parquet(f"{base}/speech_tokens").withColumn("year", F.col("year").cast("bigint"))


class PreparedCorpus(Corpus):
    """A corpus whose token arrays and DTM are read from a prepared folder (S05); code
    tables and protocols still come from the driver tables. Token arrays, DTM and vocabulary that the folder
    doesn't hold are derived as in `source` (a corpus over the tables if none is given)."""

    def __init__(self, spark: SparkSession, sf_dir: str, folder: str, source: Corpus | None = None):
        super().__init__(spark, sf_dir)
        self.folder = folder.rstrip("/")
        self.source = source or Corpus(spark, sf_dir)

    @cached_property
    def speech_tokens(self) -> DataFrame:
        return self.source.speech_tokens if self.part("speech_tokens") is None else read_prepared_tokens(self, self.folder)

    @cached_property
    def dtm(self) -> DataFrame:
        found = self.part("dtm")
        return super().dtm if found is None else found

    @cached_property
    def vocab(self) -> DataFrame:
        found = self.part("vocab")
        return super().vocab if found is None else found

    def part(self, name: str) -> DataFrame | None:
        """A stored part; None in a folder prepared without."""
        try:
            return self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    @cached_property
    def postings(self) -> DataFrame | None:
        return self.part("postings")

    @cached_property
    def grams(self) -> DataFrame | None:
        return self.part("grams")

    @cached_property
    def cube(self) -> DataFrame | None:
        return self.part("cube")

    @cached_property
    def keys(self) -> DataFrame | None:
        return self.part("keys")


# ---------------------------------------------------------------------------------
# The same model as SQL (DuckDB dialect). Concatenate the CTEs a query needs.
# ---------------------------------------------------------------------------------

SQL_SPEECH_TOKENS = r"""
st_words AS (
  SELECT doc_id, lang, source, text, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM documents
),
speech_tokens AS MATERIALIZED (
  SELECT
    doc_id AS document_id,
    printf('prot-%d--%s--%06d_%03d', 1970 + doc_id % 50, lang, doc_id // 10, doc_id % 10 + 1) AS document_name,
    'i-' || CAST(doc_id AS VARCHAR) AS speech_id,
    doc_id % 10 + 1 AS speech_index,
    printf('prot-%d--%s--%06d_%03d', 1970 + doc_id % 50, lang, doc_id // 10, doc_id % 10 + 1) AS speech_name,
    1970 + doc_id % 50 AS year,
    lang AS chamber_abbrev,
    doc_id % 150 AS person_id,
    doc_id % 3 AS gender_id,
    CAST(TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) % 25 AS BIGINT) AS party_id,
    'n-' || CAST(doc_id AS VARCHAR) AS speaker_note_id,
    CAST(TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) % 25 AS BIGINT) % 5 AS office_type_id,
    CAST(TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) % 25 AS BIGINT) AS sub_office_type_id,
    CAST(len(string_split_regex(text, '\n')) AS BIGINT) AS n_utterances,
    CAST(len(w) AS BIGINT) AS n_tokens,
    CAST(len(w) AS BIGINT) AS n_raw_tokens,
    CAST((doc_id % 10) // 2 + 1 AS BIGINT) AS page_number,
    w AS word,
    list_transform(w, lambda x: lower(x)) AS lemma
  FROM st_words
),
speech_index AS (
  SELECT * EXCLUDE (word, lemma) FROM speech_tokens
)"""

# Flat token table: one row per token with 1-based position.
SQL_FLAT_TOKENS = r"""
flat_tokens AS (
  SELECT document_id, unnest(word) AS word, unnest(lemma) AS lemma,
         unnest(generate_series(1, len(word))) AS pos
  FROM speech_tokens
)"""

SQL_DTM = r"""
dtm AS MATERIALIZED (
  SELECT document_id, token, CAST(count(*) AS BIGINT) AS n
  FROM (SELECT document_id, unnest(lemma) AS token FROM speech_tokens)
  GROUP BY document_id, token
)"""

SQL_CODES = r"""
persons AS (
  SELECT c_custkey AS person_id, c_custkey AS pid,
         CASE WHEN c_acctbal < 0 THEN 'unknown' ELSE 'Q' || CAST(c_custkey AS VARCHAR) END AS wiki_id,
         c_name AS name, c_custkey % 3 AS gender_id, CAST(c_nationkey AS BIGINT) AS party_id,
         1900 + c_custkey % 60 AS year_of_birth,
         CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 1960 + c_custkey % 60 END AS year_of_death
  FROM customer
),
person_party AS (
  SELECT person_id * 10 + party_id AS person_party_id, person_id, party_id FROM (
    SELECT DISTINCT o_custkey AS person_id, TRY_CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS party_id FROM orders)
),
party AS (
  SELECT CAST(n_nationkey AS BIGINT) AS party_id, n_name AS party, replace(n_name, 'NATION_', 'N') AS party_abbrev,
         CAST(n_regionkey AS BIGINT) AS sort_order FROM nation
),
office_type AS (SELECT CAST(r_regionkey AS BIGINT) AS office_type_id, r_name AS office FROM region),
sub_office_type AS (
  SELECT CAST(n_nationkey AS BIGINT) AS sub_office_type_id, CAST(n_regionkey AS BIGINT) AS office_type_id,
         n_name AS identifier, 'Office of ' || n_name AS sub_office_type FROM nation
),
gender AS (
  SELECT * FROM (VALUES (0::BIGINT, 'unknown', '?'), (1::BIGINT, 'man', 'M'), (2::BIGINT, 'woman', 'K'))
    AS t(gender_id, gender, gender_abbrev)
),
chamber AS (
  SELECT * FROM (VALUES (1::BIGINT, 'English chamber', 'en'), (2::BIGINT, 'German chamber', 'de'),
                        (3::BIGINT, 'French chamber', 'fr'), (4::BIGINT, 'Spanish chamber', 'es'),
                        (5::BIGINT, 'Joint session', ' ')) AS t(chamber_id, chamber, chamber_abbrev)
),
speaker_notes AS (
  SELECT 'n-' || CAST(doc_id AS VARCHAR) AS speaker_note_id,
         CASE WHEN quality = 0 THEN 'missing' ELSE 'Speaker note ' || CAST(doc_id AS VARCHAR) END AS speaker_note
  FROM labels
)"""

SQL_UTTERANCES = r"""
utterances AS (
  SELECT conv_id AS protocol_id, turn, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS u_id,
         role AS who, text AS paragraph,
         CAST(len(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS BIGINT) AS num_tokens,
         CAST(len(string_split_regex(trim(text), '\s+')) AS BIGINT) AS num_words,
         CAST(turn // 3 + 1 AS BIGINT) AS page_number
  FROM conversations
),
protocol_speeches AS (
  SELECT protocol_id, speech_no, least(2, n_turns - speech_no * 2) AS n_utterances FROM (
    SELECT protocol_id, n_turns, unnest(generate_series(0, (n_turns - 1) // 2)) AS speech_no FROM (
      SELECT conv_id AS protocol_id, max(turn) + 1 AS n_turns FROM conversations GROUP BY conv_id))
),
protocol_speech_index AS (
  SELECT protocol_id * 1000 + speech_no AS document_id,
         printf('prot-%d--cv--%06d', 1970 + protocol_id % 50, protocol_id) || printf('_%03d', speech_no + 1)
           AS document_name,
         printf('prot-%d--cv--%06d', 1970 + protocol_id % 50, protocol_id) AS protocol_name,
         printf('i-c%d-%d', protocol_id, speech_no) AS speech_id,
         protocol_id, speech_no, n_utterances,
         (protocol_id + speech_no) % 150 AS person_id, (protocol_id + speech_no) % 3 AS gender_id,
         (protocol_id * 7 + speech_no) % 30 AS party_id,
         CASE WHEN (protocol_id + speech_no) % 7 = 0 THEN 'missing'
              ELSE 'n-' || CAST(protocol_id * 3 + speech_no AS VARCHAR) END AS speaker_note_id
  FROM protocol_speeches
)"""


def with_sql(*ctes: str) -> str:
    """Join CTE blocks into one WITH clause."""
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
