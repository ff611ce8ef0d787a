"""Matrix stores and zip archives: round trips, row ranges, and runs that fail."""

import gzip
import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostra import sources as SRC
from rostra.operators import dtm as D
from rostra.sources import files


def cells(spark):
    rows = [(d, f"t{k}", 1 + (d * k) % 5) for d in range(0, 120, 2) for k in range(d % 7)]
    return spark.createDataFrame(rows, "document_id long, token string, n long")


def test_matrix_cells_are_not_shuffled_to_their_words(spark, scratch, monkeypatch):
    """A vocabulary beyond Spark's own limit of 10 MB sent each cell through a shuffle, to be written and to be read."""
    dtm = cells(spark)
    vocab = D.dense_ids(dtm.select("token").distinct(), ["token"], id_col="token_id")
    want = sorted((d, t, float(n)) for d, t, n in dtm.collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for limit, join in ((10**6, "BroadcastHashJoin"), (3, "MapInArrow")):
            monkeypatch.setattr(files, "_BROADCAST_WORDS", limit)
            files.store_matrix(dtm, vocab, scratch, "w", shards=2)
            got, _ = files.load_matrix(spark, scratch, "w", rows_per_partition=20)
            assert sorted(tuple(r) for r in got.collect()) == want and got.columns == ["document_id", "token", "n"]
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert join in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_matrix_round_trip(spark, scratch):
    dtm = cells(spark)
    vocab = D.dense_ids(dtm.select("token").distinct(), ["token"], id_col="token_id")
    files.store_matrix(dtm, vocab, scratch, "speeches", shards=3)
    shards = [f for f in os.listdir(scratch) if f.endswith(".npz")]
    assert len(shards) == 3 and not os.listdir(f"{scratch}/_temporary")
    for step in (1, 7, 1000):
        got, words = files.load_matrix(spark, scratch, "speeches", rows_per_partition=step)
        assert got.rdd.getNumPartitions() >= 1
        assert sorted(tuple(r) for r in got.collect()) == sorted((d, t, float(n)) for d, t, n in dtm.collect())
        assert sorted(tuple(r) for r in words.collect()) == sorted(tuple(r) for r in vocab.select("token", "token_id").collect())
    files.store_matrix(dtm.where("document_id < 50"), vocab, scratch, "speeches", shards=1)  # replaces the shards
    assert files.load_matrix(spark, scratch, "speeches")[0].agg(F.max("document_id")).first()[0] < 50


@pytest.mark.parametrize("compressed", [True, False])
def test_matrix_of_other_tools(spark, scratch, compressed):
    """One archive without row numbers, one JSON object, a document index with an unnamed first column."""
    x = (np.arange(40 * 6).reshape(40, 6) * 7 % 11) * (np.arange(240).reshape(40, 6) % 3 == 0)
    x[5:9] = 0
    rows, columns = np.nonzero(x)
    save = np.savez_compressed if compressed else np.savez
    save(f"{scratch}/tag_vector_data.npz", indices=columns.astype(np.int32), indptr=np.concatenate([[0], np.cumsum((x != 0).sum(1))]).astype(np.int32),
         format=np.array(b"csr"), shape=np.array(x.shape), data=x[rows, columns])
    files.write_token2id({f"w{i}": i for i in range(6)}, f"{scratch}/tag_token2id.json.gz")
    with gzip.open(f"{scratch}/tag_document_index.csv.gz", "wt") as f:
        f.write(";document_id;year\n" + "".join(f"{i};{i};{1970 + i}\n" for i in range(40)))
    dtm, vocab = files.load_matrix(spark, scratch, "tag", rows_per_partition=9)
    cells_ = spark.read.format("matrix_store").options(tag="tag", rows_per_partition="9").load(scratch)
    assert cells_.rdd.getNumPartitions() == 5
    assert {(r["document_id"], r["token"]): r["n"] for r in dtm.collect()} == {(r, f"w{c}"): float(x[r, c]) for r, c in zip(rows, columns)}
    index = files.read_matrix_index(spark, scratch, "tag")
    assert index.columns == ["document_id", "year"] and index.count() == 40
    assert json.loads(gzip.open(f"{scratch}/tag_token2id.json.gz").read())["w5"] == 5 and vocab.count() == 6


def test_dense_arrays(spark, scratch):
    x = np.arange(30).reshape(10, 3) % 4
    np.save(f"{scratch}/d_vector_data.npy", x)
    files.write_token2id({f"w{i}": i for i in range(3)}, f"{scratch}/d_token2id.json.gz")
    dtm, _ = files.load_matrix(spark, scratch, "d", rows_per_partition=4)
    assert {(r["document_id"], r["token"]): r["n"] for r in dtm.collect()} == {(i, f"w{j}"): float(x[i, j]) for i, j in zip(*np.nonzero(x))}


def test_matrices_that_are_refused(spark, scratch):
    with pytest.raises(Exception, match="no matrix|does not exist"):
        files.load_matrix(spark, scratch, "none")[0].count()
    np.save(f"{scratch}/o_vector_data.npy", np.array([{"a": 1}], dtype=object), allow_pickle=True)
    files.write_token2id({"a": 0}, f"{scratch}/o_token2id.json.gz")
    with pytest.raises(Exception, match="only dense arrays"):
        files.load_matrix(spark, scratch, "o")[0].count()


def test_speech_zips(spark, scratch):
    texts = spark.createDataFrame([("A B", "i-1", "text one"), ("C/D", "i-2", "é\ntwo"), (None, "i-3", None), ("A B", "i-4", "")],
                                  "name string, speech_id string, speech_text string")
    files.write_speech_zips(texts, scratch, archives=2)
    back = {r["member"]: r["content"] for r in SRC.read_zip_members(spark, scratch).collect()}
    assert back == {"A B_i-1.txt": "text one", "C_D_i-2.txt": "é\ntwo", "i-3.txt": "", "A B_i-4.txt": ""}


def test_zip_names_that_repeat_and_overwriting(spark, scratch):
    rows = spark.createDataFrame([("a.txt", "1"), ("a.txt", "2"), ("b", "3"), ("b", "4")], "member string, content string").coalesce(1)
    files.write_zips(rows, scratch)
    assert sorted(r["member"] for r in SRC.read_zip_members(spark, scratch).collect()) == ["a.txt", "a_2.txt", "b", "b_2"]
    files.write_zips(rows.limit(1), scratch)
    assert SRC.read_zip_members(spark, scratch).count() == 1
    first = open(f"{scratch}/{os.listdir(scratch)[0]}", "rb").read() if os.path.isfile(f"{scratch}/{os.listdir(scratch)[0]}") else None
    files.write_zips(rows.limit(0), scratch)
    assert not [f for f in os.listdir(scratch) if f.endswith(".zip")] and first != b""


def test_a_failed_run_leaves_nothing(spark, scratch):
    good = spark.createDataFrame([("keep.txt", "old")], "member string, content string")
    files.write_zips(good.coalesce(1), scratch, "run")
    bad = spark.range(40).repartition(4).select(F.when(F.col("id") != 17, F.concat(F.col("id").cast("string"), F.lit(".txt"))).alias("member"),
                                                F.lit("x").alias("content"))
    with pytest.raises(Exception, match="has no name"):
        files.write_zips(bad, scratch, "run")
    left = [os.path.join(d, f) for d, _, names in os.walk(scratch) for f in names]
    assert len(left) == 1 and zipfile.ZipFile(left[0]).namelist() == ["keep.txt"]


def test_csv_members(spark, scratch):
    df = spark.range(250).select("id", F.concat(F.lit('na"me, '), F.col("id").cast("string")).alias("name")).coalesce(2)
    files.write_zips(files.csv_member(df, "frame", rows_per_member=60), scratch)
    back = SRC.read_zipped_csv(spark, scratch, df.schema, "frame-*.csv")
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())
    members = SRC.read_zip_members(spark, scratch).collect()
    assert len(members) >= 4 and all(r["content"].startswith("id,name\n") for r in members)
