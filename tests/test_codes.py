"""Code-table fixture: decode / encode, speaker filters, party lists, speech index decoding."""

import pytest

from rostra.operators import codes as C


@pytest.fixture()
def tables(spark):
    return {
        "gender": spark.createDataFrame([(1, "Male", "M"), (2, "Female", "F")],
                                        "gender_id int, gender string, gender_abbrev string"),
        "persons": spark.createDataFrame([("p1", 0, "John Doe", "q1"), ("p2", 1, "Jane Doe", "unknown")],
                                         "person_id string, pid int, name string, wiki_id string"),
        "chamber": spark.createDataFrame([(1, "Chamber A", "CA"), (2, "Chamber B", "CB")],
                                         "chamber_id int, chamber string, chamber_abbrev string"),
        "office_type": spark.createDataFrame([(1, "Office A"), (2, "Office B")], "office_type_id int, office string"),
        "party": spark.createDataFrame([(1, "Party A", "PA", 2), (2, "Party B", "PB", 1)],
                                       "party_id int, party string, party_abbrev string, sort_order int"),
        "sub_office_type": spark.createDataFrame([(1, 1, "A", "Description A"), (2, 2, "B", "Description B")],
                                                 "sub_office_type_id int, office_type_id int, identifier string, "
                                                 "description string"),
        "person_party": spark.createDataFrame([(1, "p1", 1), (2, "p2", 2), (3, "p1", 2)],
                                              "person_party_id int, person_id string, party_id int"),
    }


def test_hooks_rename_and_party_lists(tables):
    t = C.run_hooks(tables, [C.rename_sub_office_hook, C.add_multi_party_hook])
    assert "sub_office_type" in t["sub_office_type"].columns
    got = {r["person_id"]: (r["multi_party_abbrev"], r["multi_party_id"]) for r in t["persons"].collect()}
    assert got == {"p1": ("PA, PB", "1,2"), "p2": ("PB", "2")}


def test_decode_in_config_order_and_drop(spark, tables):
    t = C.run_hooks(tables, [C.rename_sub_office_hook])
    df = spark.createDataFrame([(1, 2, "p1", 1), (2, 9, "p2", 2)],
                               "gender_id int, party_id int, person_id string, sub_office_type_id int")
    out = C.decode(df, t)
    assert set(out.columns) == {"gender", "gender_abbrev", "party", "party_abbrev", "name", "wiki_id", "pid",
                                "sub_office_type"}
    rows = {r["name"]: r for r in out.collect()}
    assert rows["John Doe"]["gender"] == "Male" and rows["John Doe"]["party_abbrev"] == "PB"
    assert rows["Jane Doe"]["party"] is None  # unmapped -> null
    kept = C.decode(df, t, keeps=["person_id"], ignores=["pid"])
    assert "person_id" in kept.columns and "pid" not in kept.columns


def test_encode_first_applicable_wins(spark, tables):
    df = spark.createDataFrame([("Female", "M")], "gender string, gender_abbrev string")
    out = C.encode(df, tables).first()
    assert out["gender_id"] == 2  # 'gender' encoder comes first


def test_decode_encode_identity(spark, tables):
    df = spark.createDataFrame([(1,), (2,)], "gender_id int")
    back = C.encode(C.decode(df, tables), tables)
    assert sorted(r["gender_id"] for r in back.collect()) == [1, 2]


def test_filtered_speakers(spark, tables):
    persons = tables["persons"]
    si = spark.createDataFrame([("p1", "ak"), ("p2", "FK")], "person_id string, chamber_abbrev string")
    by_party = C.filtered_speakers(persons, tables["person_party"], si, {"party_id": [1]})
    assert [r["person_id"] for r in by_party.collect()] == ["p1"]
    by_chamber = C.filtered_speakers(persons, tables["person_party"], si, {"chamber_abbrev": ["fk"], "pid": []})
    assert [r["person_id"] for r in by_chamber.collect()] == ["p2"]
    with pytest.raises(ValueError):
        C.filtered_speakers(persons, tables["person_party"], si, {"nope": [1]})


def test_person_by_key(tables):
    p = tables["persons"]
    assert C.person_by_key(p, 1).first()["name"] == "Jane Doe"
    assert C.person_by_key(p, "q1").first()["name"] == "John Doe"
    assert C.person_by_key(p, "p2").first()["name"] == "Jane Doe"


def test_decode_speech_index(spark, tables):
    si = spark.createDataFrame(
        [(0, 1970, "prot-1970--ak--029_001", "i-1", "p1", "ak", 1, 2, 1, 1),
         (1, 1970, "prot-1970--ak--029_002", "i-2", "p2", "ak", 1, 1, 1, 2)],
        "document_id long, year int, document_name string, speech_id string, person_id string, "
        "chamber_abbrev string, gender_id int, party_id int, office_type_id int, sub_office_type_id int")
    t = C.run_hooks(tables, [C.rename_sub_office_hook])
    out = C.decode_speech_index(si, t, pdf_base_url="https://pdf.example.org/")
    r = {x["document_id"]: x for x in out.collect()}
    assert r[0]["link"] == "https://www.wikidata.org/wiki/q1"
    assert r[1]["link"] == "Okänd"
    assert r[0]["speech_link"] == "https://pdf.example.org/1970/prot-1970--ak--029.pdf#page=1"
    assert r[0]["party_abbrev"] == "PB" and r[1]["name"] == "Jane Doe"
    assert "person_id" in out.columns and "gender_id" not in out.columns


def test_duplicate_keys_check(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert [r["k"] for r in C.duplicate_keys(df, "k").collect()] == [1]


def test_parties_sorted(tables):
    assert [r["party"] for r in C.parties_sorted(tables["party"]).collect()] == ["Party B", "Party A"]


def test_speech_info_defaults(spark, tables):
    si = spark.createDataFrame([(0, "p1", "n1"), (1, "p9", "n2")], "document_id long, person_id string, "
                                                                  "speaker_note_id string")
    notes = spark.createDataFrame([("n1", "Intro")], "speaker_note_id string, speaker_note string")
    got = {r["document_id"]: (r["name"], r["speaker_note"]) for r in
           C.speech_info(si, tables["persons"], notes).collect()}
    assert got == {0: ("John Doe", "Intro"), 1: ("p9", "(introductory note not found)")}


def test_add_pid_hook(tables):
    t = C.run_hooks(tables, [C.add_pid_hook])
    assert sorted((r["person_id"], r["pid"]) for r in t["persons"].collect()) == [("p1", 0), ("p2", 1)]
