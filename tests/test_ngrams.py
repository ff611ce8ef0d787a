"""Hand-made concordance fixture: grouped windows, sliding and locked n-grams."""

from pyspark.sql import functions as F

from rostra.operators import tokens as TK

CONCORDANCE = [("f e b", "A"), ("f e b", "A"), ("n e b", "A"), ("n e b", "A"), ("n e b", "B"),
               ("f e n", "B"), ("f e n", "C"), ("f e n", "C"), ("f e n", "C"), ("e e e", "D"), ("e e e", "D")]


def _win(spark):
    df = spark.createDataFrame(CONCORDANCE, "window string, speech_id string")
    return df.withColumn("tokens", F.split("window", " "))


def _with_docs(grouped, docs, key):
    return {r[key]: (r["window_count"], r["documents"])
            for r in TK.with_document_lists(grouped, docs, key).collect()}


def test_grouped_windows(spark):
    win = _win(spark)
    got = _with_docs(TK.keyword_windows(win), TK.window_documents(win), "window")
    assert got == {"f e b": (2, "A"), "f e n": (4, "B,C"), "n e b": (3, "A,B"), "e e e": (2, "D")}


def test_sliding_bigrams(spark):
    win = _win(spark)
    got = _with_docs(TK.compile_n_grams(win, n=2), TK.ngram_documents(win, n=2), "ngram")
    assert got == {"e b": (5, "A,B"), "e e": (4, "D"), "e n": (4, "B,C"), "f e": (6, "A,B,C"), "n e": (3, "A,B")}


def test_locked_is_the_window(spark):
    win = _win(spark)
    got = {r["ngram"]: r["window_count"] for r in TK.compile_n_grams(win, n=3, mode="locked").collect()}
    assert got == {"f e b": 2, "f e n": 4, "n e b": 3, "e e e": 2}


def test_threshold(spark):
    win = _win(spark)
    got = {r["ngram"] for r in TK.compile_n_grams(win, n=2, threshold=5).collect()}
    assert got == {"e b", "f e"}


def test_phrase_ngrams(spark):
    df = spark.createDataFrame([("a b c d e",), ("a",)], "p string")
    out = df.select(F.size(TK.phrase_n_grams(F.col("p"), 2)).alias("b"),
                    F.size(TK.phrase_n_grams(F.col("p"), 3)).alias("t")).collect()
    assert (out[0]["b"], out[0]["t"]) == (4, 3)
    assert (out[1]["b"], out[1]["t"]) == (0, 0)
    first = df.limit(1).select(TK.phrase_n_grams(F.col("p"), 3).alias("g")).first()["g"]
    assert first == ["a b c", "b c d", "c d e"]


def test_n_gram_frame_modes():
    assert TK.n_gram_frame(3, 1, "sliding") == (3, "sliding")
    assert TK.n_gram_frame(3, 1, "left-aligned") == ((0, 2), "locked")
    assert TK.n_gram_frame(3, 2, "right-aligned") == ((1, 0), "locked")
    import pytest

    with pytest.raises(ValueError):
        TK.n_gram_frame(1, 2, "left-aligned")


def test_contains_phrase_keeps_only_covering_ngrams(spark):
    df = spark.createDataFrame([(0, "s0", ["x", "a", "b", "c", "y"])], "document_id long, speech_id string, word array<string>")
    pat = [{"target": "word", "value": v} for v in ("a", "b", "c")]
    win = TK.windows(df, pat, context=3)
    all_grams = {r["ngram"] for r in TK.compile_n_grams(win, n=3).collect()}
    covering = {r["ngram"] for r in TK.compile_n_grams(win, n=3, contains_phrase=True).collect()}
    assert all_grams == {"x a b", "a b c", "b c y"}
    assert covering == {"a b c"}
