"""Round trips for sources and sinks (written to a scratch folder, read back)."""

import os

from pyspark.sql import functions as F

from rostra import sources as SRC
from rostra.model import Corpus, PreparedCorpus, prepare_corpus
from rostra.operators import speech_text as T

SMALL = "/root/testdata/sf0.001"


def test_speech_index_csv_roundtrip(spark, scratch):
    path = os.path.join(scratch, "speech_index.csv.gz")
    src = spark.createDataFrame([(0, "prot-1970--ak--029_001", "i-1", 1, "s", 1970, "ak", "p1", 1, 2, "n", 1, 1, 2,
                                  10, 12, 1)], SRC.SPEECH_INDEX_SCHEMA)
    src.write.option("sep", ";").option("header", True).option("compression", "gzip").csv(path)
    back = SRC.read_speech_index(spark, path)
    assert "person_id" in back.columns and "speech_id" in back.columns
    assert back.first()["person_id"] == "p1"


def test_document_index_tsv_roundtrip(spark, scratch):
    path = os.path.join(scratch, "document_index")
    idx = spark.createDataFrame([("a/x_1970.txt", "1970", 0), ("b/y_1980.txt", "1980", 1)],
                                "filename string, year string, document_id long")
    SRC.store_document_index(idx, path)
    back = SRC.read_document_index(spark, path)
    assert sorted(r["document_name"] for r in back.collect()) == ["x_1970", "y_1980"]
    assert dict(back.dtypes)["year"] == "int"
    fields = SRC.extract_filename_fields(back, "document_name", {"decade": r"[a-z]_(\d{3})", "stem": "_:0"},
                                         int_fields=["decade"])
    assert sorted((r["decade"], r["stem"]) for r in fields.collect()) == [(197, "x"), (198, "y")]


def test_store_and_load_corpus(spark, scratch):
    c = Corpus(spark, SMALL)
    vocab = c.dtm.groupBy("token").agg(F.sum("n").alias("tf"))
    SRC.store_corpus(c.dtm, vocab, c.speech_index, scratch, "tag1")
    dtm, v, idx = SRC.load_corpus(spark, scratch, "tag1")
    assert dtm.count() == c.dtm.count() and v.count() == vocab.count() and idx.count() == c.speech_index.count()


def test_prepared_corpus_equals_raw(spark, scratch):
    c = Corpus(spark, SMALL)
    prepare_corpus(c, os.path.join(scratch, "prep"))
    p = PreparedCorpus(spark, SMALL, os.path.join(scratch, "prep"))
    assert p.dtm.exceptAll(c.dtm).count() == 0 and c.dtm.exceptAll(p.dtm).count() == 0
    assert p.speech_index.exceptAll(c.speech_index).count() == 0


def test_protocol_json_roundtrip(spark, scratch):
    c = Corpus(spark, SMALL)
    u = c.utterances
    nested = u.groupBy("protocol_id").agg(F.sort_array(F.collect_list(F.struct(
        "turn", "u_id", "who", F.lit(None).cast("string").alias("speaker_note_id"), "page_number", "num_tokens",
        "num_words", F.array("paragraph").alias("paragraphs")))).alias("us"))
    protocols = nested.select(F.col("protocol_id").cast("string").alias("name"), F.lit("1970-01-01").alias("date"),
                              F.transform("us", lambda x: x.dropFields("turn")).alias("utterances"))
    path = os.path.join(scratch, "protocols")
    protocols.write.json(path)
    flat = T.protocol_utterances(T.read_protocols(spark, path))
    a = flat.select(F.col("protocol_name").cast("long").alias("protocol_id"), "turn", "paragraph")
    b = u.select("protocol_id", "turn", "paragraph")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_export_rows_written(spark, scratch):
    c = Corpus(spark, SMALL)
    texts = T.speech_texts(c.protocol_speech_index, c.utterances, c.persons, c.speaker_notes, c.gender, c.party)
    rows = T.export_rows(texts)
    T.write_export(rows, os.path.join(scratch, "export"))
    back = spark.read.json(os.path.join(scratch, "export"))
    assert back.count() == c.protocol_speech_index.count()


def test_speech_text_missing_keys_become_error_rows(spark):
    c = Corpus(spark, SMALL)
    keys = spark.createDataFrame([(0,), (999999999,)], "document_id long")
    out = {r["document_id"]: r for r in T.speech_texts(c.protocol_speech_index, c.utterances, c.persons,
                                                       c.speaker_notes, c.gender, c.party, keys=keys).collect()}
    assert out[0]["error"] is None and out[0]["speech_text"]
    assert out[999999999]["error"] == "speech 999999999 not found"


def test_text_files_by_glob_and_names(spark, scratch):
    folder = os.path.join(scratch, "texts")
    os.makedirs(folder)
    for name in ("a.txt", "b.txt", "c.md"):
        with open(os.path.join(folder, name), "w") as fh:
            fh.write(f"text of {name}")
    files = SRC.read_text_files(spark, folder, "*.txt")
    assert files.count() == 2
    picked = SRC.filter_by_names(files, "filename", ["a"])
    assert [r["text"] for r in picked.collect()] == ["text of a.txt"]


def test_canonical_protocol_names(spark):
    df = spark.createDataFrame([("prot-1970--ak--29",), ("prot-1970--ak--0029",), ("x",)], "n string")
    got = [r["c"] for r in df.select(T.canonical_protocol_name(F.col("n")).alias("c")).collect()]
    assert got == ["prot-1970--ak--029", "prot-1970--ak--0029", "x"]


def test_two_level_running_sum_matches_window(spark):
    from pyspark.sql import Window

    rows = [("hot", i, (i * 7) % 5) for i in range(100)] + [("cold", i, 1) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, pos long, v long")
    got = T.running_sum_before(df, "k", "pos", "v", "s", bucket=3)
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ref = df.withColumn("s", F.coalesce(F.sum("v").over(w), F.lit(0)).cast("bigint"))
    assert got.select("k", "pos", "v", "s").exceptAll(ref).count() == 0 and got.count() == ref.count()


def test_code_tables_vocab_and_gzip_frames(spark, scratch):
    gender = spark.createDataFrame([(1, "man"), (2, "woman")], "gender_id int, gender string")
    gender.write.parquet(os.path.join(scratch, "gender"))
    tables = SRC.read_tables(spark, scratch, ["gender"])
    assert tables["gender"].count() == 2
    vocab = spark.createDataFrame([("a", 0, 5), ("b", 1, 2)], "token string, token_id long, tf long")
    SRC.store_vocab(vocab, os.path.join(scratch, "vocab"))
    ids = spark.createDataFrame([(1,), (0,)], "token_id long")
    got = SRC.ids_to_tokens(ids, SRC.load_vocab(spark, os.path.join(scratch, "vocab")))
    assert sorted(r["token"] for r in got.collect()) == ["a", "b"]
    SRC.store_frames({"g": gender}, os.path.join(scratch, "zipped"))
    files = os.listdir(os.path.join(scratch, "zipped", "g"))
    assert any(f.endswith(".csv.gz") for f in files)
    back = spark.read.option("header", True).csv(os.path.join(scratch, "zipped", "g"))
    assert back.count() == 2


def test_term_substitutions(spark, scratch):
    from rostra import functions as fx

    lines = spark.createDataFrame([("foo;bar",), ("baz",), ("",)], "_c0 string")
    subst = fx.load_term_substitutions(lines)
    assert sorted((r["term"], r["replacement"]) for r in subst.collect()) == [("baz", "_masked_"), ("foo", "bar")]
    tokens = spark.createDataFrame([("foo",), ("x",), ("baz",)], "token string")
    assert sorted(r["token"] for r in fx.substitute_tokens(tokens, subst).collect()) == ["_masked_", "bar", "x"]


def test_documents_as_list(spark):
    from rostra.operators import tokens as TK

    df = spark.createDataFrame([("D1,D2,D3",)], "documents string")
    assert df.select(TK.documents_as_list(F.col("documents")).alias("d")).first()["d"] == ["D1", "D2", "D3"]


def test_speech_text_by_key_forms(spark):
    import pytest as _pytest

    c = Corpus(spark, SMALL)
    keys = [0, "prot-1970--cv--000000_002", "i-c1-0", "i-nope", "bad-key"]
    out = {r["key"]: r for r in T.speech_texts_by_keys(spark, c.protocol_speech_index, c.utterances, c.persons,
                                                       c.speaker_notes, c.gender, c.party, keys).collect()}
    assert out["0"]["document_id"] == 0 and out["0"]["error"] is None
    assert out["prot-1970--cv--000000_002"]["document_id"] == 1
    assert out["i-c1-0"]["document_id"] == 1000
    assert out["i-nope"]["error"] == "speech i-nope not found"
    assert out["bad-key"]["error"] == "speech bad-key not found"
    with _pytest.raises(ValueError):
        T.resolve_keys(spark, c.protocol_speech_index, ["bad-key"])
    rows = T.export_speeches(spark, c.protocol_speech_index, c.utterances, c.persons, c.speaker_notes, c.gender,
                             c.party, [0, "i-c1-0", "i-nope"]).collect()
    assert len(rows) == 2 and all(r["filename"].endswith(".txt") for r in rows)
    with _pytest.raises(ValueError):
        T.export_speeches(spark, c.protocol_speech_index, c.utterances, c.persons, c.speaker_notes, c.gender,
                          c.party, [])


def test_zip_sources(spark, scratch):
    import json
    import zipfile

    from pyspark.sql import types as PT

    folder = os.path.join(scratch, "zips")
    os.makedirs(folder)
    utterances = [{"u_id": "u1", "who": "p1", "speaker_note_id": "n1", "page_number": 3, "num_tokens": 2,
                   "num_words": 2, "paragraphs": ["Hej du", "Andra stycket"]},
                  {"u_id": "u2", "who": "p2", "speaker_note_id": None, "page_number": 4, "num_tokens": 1,
                   "num_words": 1, "paragraphs": ["Tack"]}]
    with zipfile.ZipFile(os.path.join(folder, "prot-1970--ak--029.zip"), "w") as zf:
        zf.writestr("prot-1970--ak--029.json", json.dumps(utterances))
        zf.writestr("metadata.json", json.dumps({"name": "prot-1970--ak--029", "date": "1970-01-02"}))
    with zipfile.ZipFile(os.path.join(folder, "frames.zip"), "w") as zf:
        zf.writestr("a.csv", "id,name\n1,x\n2,y\n")
        zf.writestr("b.txt", "not csv")
    protocols = T.read_protocol_zips(spark, folder)
    flat = T.protocol_utterances(protocols).orderBy("turn").collect()
    assert [(r["protocol_name"], r["turn"], r["u_id"], r["paragraph"]) for r in flat] == \
        [("prot-1970--ak--029", 0, "u1", "Hej du\nAndra stycket"), ("prot-1970--ak--029", 1, "u2", "Tack")]
    schema = PT.StructType([PT.StructField("id", PT.IntegerType()), PT.StructField("name", PT.StringType())])
    rows = SRC.read_zipped_csv(spark, folder, schema).orderBy("id").collect()
    assert [(r["id"], r["name"]) for r in rows] == [(1, "x"), (2, "y")]
    members = SRC.read_zip_members(spark, folder, "*.txt").collect()
    assert [(os.path.basename(r["archive"]), r["member"]) for r in members] == [("frames.zip", "b.txt")]


def test_document_index_without_ids_gets_dense_ids(spark, scratch):
    path = os.path.join(scratch, "idx")
    spark.createDataFrame([("b.txt", "1990"), ("a.txt", "1980")], "filename string, year string") \
        .write.option("sep", "\t").option("header", True).csv(path)
    got = sorted((r["filename"], r["document_id"]) for r in SRC.read_document_index(spark, path).collect())
    assert got == [("a.txt", 0), ("b.txt", 1)]
