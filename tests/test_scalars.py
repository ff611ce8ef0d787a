"""Scalar functions and filter semantics."""

import pytest
from pyspark.sql import functions as F

from rostra import functions as fx
from rostra.operators import predicates as P


def _one(spark, col_fn, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(col_fn(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("name,label", [
    ("prot-1966-höst-fk--38_044", "Första kammaren 1966:38 044"),
    ("prot-200405--113_075", "2004/05:113 075"),
    ("prot-1958-a-ak--17-01_001", "Andra kammaren 1958:17 01 001"),
    ("prot-2004--113_075", "2004:113 075"),
    ("prot", "prot"),
])
def test_format_protocol_id(spark, name, label):
    assert _one(spark, fx.format_protocol_id, name) == label


def test_fix_whitespace(spark):
    assert _one(spark, fx.fix_whitespace, "Hej , du . Vad sägs ?") == "Hej, du. Vad sägs?"
    assert _one(spark, fx.fix_whitespace, "a , b") == "a, b"  # Unicode whitespace


def test_temporal_keys(spark):
    df = spark.createDataFrame([(1957,), (1975,)], "year int")
    out = df.select(fx.temporal_key(F.col("year"), "decade").alias("d"),
                    fx.temporal_key(F.col("year"), "lustrum").alias("l"),
                    fx.temporal_key(F.col("year"), {"x": [1957]}).alias("m")).collect()
    assert [(r["d"], r["l"], r["m"]) for r in out] == [(1950, 1955, "x"), (1970, 1975, None)]
    with pytest.raises(ValueError):
        fx.temporal_key(F.col("year"), "century")


def test_year_interval(spark):
    df = spark.range(1950, 1980).select(F.col("id").cast("int").alias("year"))
    assert df.where(P.year_interval(F.col("year"), 1957, 1975)).count() == 19
    with pytest.raises(ValueError):
        P.year_interval(F.col("year"), 1975, 1957)


def test_predicate_forms_and_negation_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "a", 2000), (2, None, 2001), (3, "b", 2010)], "id int, c string, year int")
    ids = lambda opts: sorted(r["id"] for r in df.where(P.predicate(df.columns, opts)).collect())
    assert ids({"c": ["a", "b"]}) == [1, 3]
    assert ids({"year": (2000, 2001)}) == [1, 2]
    assert ids({"c": (False, "a")}) == [2, 3]  # NOT keeps the null row
    assert ids({"year": ("gt", 2000)}) == [2, 3]
    assert ids({"year": (False, "ge", 2001)}) == [1]
    assert ids({"missing": 1, "c": None}) == [1, 2, 3]  # unknown columns and None skipped
    with pytest.raises(ValueError):
        P.predicate(df.columns, {"year": (1, 2, 3, 4)})


def test_value_pairs_and_request_opts():
    assert P.parse_value_pairs(["gender: man,woman", "party: S"]) == {"gender": ["man", "woman"], "party": ["S"]}
    opts = P.request_filter_opts(party_id=[5], who=["p1"], from_year=None, to_year=1990)
    assert opts == {"party_id": [5], "person_id": ["p1"], "year": (0, 1990)}


def test_links_and_pages(spark):
    assert _one(spark, fx.wiki_link, "Q1") == "https://www.wikidata.org/wiki/Q1"
    assert _one(spark, fx.wiki_link, "unknown") == "Okänd"
    assert _one(spark, fx.page_number, "x") == 1 and _one(spark, fx.page_number, "7") == 7


def test_multiple_replace_and_paths(spark):
    assert _one(spark, lambda c: fx.multiple_replace(c, {"a.b": "X", "c": "Y"}), "a.b acb c") == "X aYb Y"
    assert _one(spark, lambda c: fx.multiple_replace(c, {"a": "ab"}), "a a") == "ab ab"
    assert _one(spark, lambda c: fx.multiple_replace(c, {"a": "b", "b": "a"}), "abba") == "baab"
    assert _one(spark, lambda c: fx.multiple_replace(c, {"The": "X"}, ignore_case=True), "the THE") == "X X"
    assert _one(spark, fx.strip_path_and_extension, "/x/y/file.tar.txt") == "file.tar"
    assert _one(spark, lambda c: fx.replace_extension(c, "csv"), "a/b.txt") == "a/b.csv"


def test_rename_by_patterns():
    assert P.replace_by_patterns(["skola man", "skola woman"], [(" man", " Män"), ("woman", "Kvinnor")]) == \
        ["skola Män", "skola Kvinnor"]


def test_normalize_array(spark):
    out = spark.createDataFrame([([1.0, 3.0],), ([0.0, 0.0],)], "v array<double>") \
        .select(fx.normalize_array(F.col("v")).alias("n")).collect()
    assert out[0]["n"] == [0.25, 0.75] and out[1]["n"] == [0.0, 0.0]


def test_pos_schemes(spark):
    from rostra.operators import pos as POS

    tags = spark.createDataFrame([(0, "NOUN"), (0, "PUNCT"), (0, "VERB"), (0, "??"), (1, "PROPN")],
                                 "document_id long, tag string")
    got = {r["document_id"]: r for r in POS.group_counts(tags, POS.scheme(spark, "Universal")).collect()}
    assert (got[0]["Noun"], got[0]["Verb"], got[0]["Delimiter"], got[0]["n_tokens"]) == (1, 1, 1, 3)
    assert got[1]["Noun"] == 1
    penn = {r["tag"]: r["universal_tag"] for r in POS.universal_tags(spark).collect()}
    assert penn["NNP"] == "PROPN" and penn["-LRB-"] == "PUNCT"
    assert "Delimiter" in POS.groups_of("Penn")
    kept = {r["tag"] for r in POS.exclude_tags(POS.scheme(spark, "SUC"), ["Delimiter", "NN"]).collect()}
    assert "NN" not in kept and "MAD" not in kept and "PM" in kept
