"""Stable ids over a stream, many terms at once, and exact top-n from summaries."""

import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rostra.functions.automaton import Machine, replace_terms
from rostra.model import TOKEN_PATTERN
from rostra.operators import top_tokens as TT
from rostra.streaming import token_ids as ST

SMALL = "/root/testdata/sf0.001"


def test_ids_never_change(spark, scratch):
    """Three arrivals, a restart before the last, a batch that is run again, and a batch that was never published."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(60)
    source, sink, state = (os.path.join(scratch, x) for x in ("incoming", "ids", "state"))
    glob = os.path.join(source, "*", "*.parquet")
    parts = [docs.where(F.col("doc_id") % 3 == i).coalesce(1) for i in range(3)]
    seen: dict[str, int] = {}

    def run():
        ST.token_id_stream(spark, glob, sink, state, max_files_per_trigger=1, buckets=8).awaitTermination()
        rows = ST.read_token_ids(spark, sink).collect()
        ids = {r["token"]: r["token_id"] for r in rows}
        assert len(set(ids.values())) == len(ids)
        assert all(ids[t] == i for t, i in seen.items())
        seen.update(ids)
        return {r["token"]: r["tf"] for r in rows}
    for i in range(3):
        parts[i].write.parquet(os.path.join(source, f"b{i}"))
        if i != 1:  # the second arrival is read together with the third, by a query that was started anew
            got = run()
    words = F.regexp_extract_all(F.col("text"), F.lit(TOKEN_PATTERN), 0)
    want = docs.select(F.explode(F.transform(words, F.lower)).alias("token")).groupBy("token").count().collect()
    assert got == {r["token"]: r["count"] for r in want}
    epochs = ST.read_epochs(spark, sink)
    assert epochs.select("epoch").distinct().count() == 3
    assert epochs.groupBy("token").agg(F.count_distinct("token_id").alias("n")).where("n > 1").isEmpty()
    # rows of a batch that wasn't published aren't seen
    spark.createDataFrame([("ghost", 99, 1)], "token string, token_id long, tf long").write.parquet(f"{sink}/epoch=000000099")
    assert ST.read_token_ids(spark, sink).where("token = 'ghost'").isEmpty()
    assert ST.read_epochs(spark, os.path.join(scratch, "none")).isEmpty()


@pytest.mark.parametrize("fold", [False, True])
@pytest.mark.parametrize("whole", [False, True])
def test_machine_equals_one_expression(fold, whole):
    rng = random.Random(1)
    for _ in range(3000):
        table = {"".join(rng.choice("ab cé") for _ in range(rng.randrange(1, 5))): str(i) for i in range(rng.randrange(1, 6))}
        text = "".join(rng.choice("ab cABéÉ") for _ in range(rng.randrange(25)))
        edge = (r"(?<![^\W_])", r"(?![^\W_])") if whole else ("", "")
        keys = "|".join(edge[0] + re.escape(k) + edge[1] for k in sorted(table, key=len, reverse=True))
        want = re.sub(keys, lambda m: table[m[0].lower() if fold else m[0]], text, flags=re.I if fold else 0)  # noqa: B023
        assert Machine(table, fold, whole)(text) == want, (table, text)


def test_many_terms_on_a_table(spark):
    terms = [(f"term{i}", f"<{i}>") for i in range(60_000)] + [("term1", "<0>"), ("", "x"), ("İx", "dot"), ("gone", None)]
    subs = spark.createDataFrame(terms, "term string, replacement string")
    rows = [(1, "term59999 term5 term1x"), (2, None), (3, ""), (4, "TERM77 İX gone."), (5, "x" * 100_000 + "term3")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r["id"]: r["text"] for r in replace_terms(df, "text", subs).collect()}
    assert got[1] == "<59999> <5> <0>x" and got[2] is None and got[3] == "" and got[4] == "TERM77 İX ." and got[5].endswith("x<3>")
    got = {r["id"]: r["text"] for r in replace_terms(df, "text", subs, ignore_case=True, whole_words=True).collect()}
    assert got[1] == "<59999> <5> term1x" and got[4] == "<77> dot ." and got[5].endswith("xterm3")
    with pytest.raises(ValueError, match="more than"):
        replace_terms(df, "text", subs, limit=100)
    assert replace_terms(df, "text", subs.limit(0)).where("id = 1").first()["text"] == rows[0][1]


def test_summary_bounds():
    rng = random.Random(2)
    for size in (1, 5, 50):
        kept, true = TT.Summary(size), Counter()
        for _ in range(3000):
            t = f"t{int(rng.paretovariate(0.8)) % 300}"
            true[t] += 1
            kept.add(t, 1)
        assert len(kept.counts) <= size
        for t, n in true.items():
            if t in kept.counts:
                assert kept.counts[t] - kept.errors[t] <= n <= kept.counts[t]
            else:
                assert n <= kept.rest


@pytest.mark.parametrize("size", [1, 20, 100_000])
def test_top_n_is_exact(spark, size):
    rng = random.Random(3)
    tokens = [f"t{int(rng.paretovariate(0.6)) % 2000}" for _ in range(20_000)]
    frame = spark.createDataFrame([(t, 1) for t in tokens] + [(None, 5), ("zero", 0)], "token string, n long").repartition(5)
    want = sorted(Counter(tokens).items(), key=lambda x: (-x[1], x[0]))
    for n in (1, 7, 40):
        assert [tuple(r) for r in TT.top_n_exact(frame, n, size).collect()] == want[:n]
    assert TT.top_n_exact(frame.limit(0), 5, size).isEmpty() and TT.top_n_exact(frame, 0).isEmpty()


def test_top_n_of_ties_and_few_tokens(spark):
    frame = spark.createDataFrame([(t, 2) for t in "abcdefgh"], "token string, n long").repartition(3)
    assert [r["token"] for r in TT.top_n_exact(frame, 3, 2).collect()] == ["a", "b", "c"]
    assert TT.top_n_exact(frame, 100, 1).count() == 8


def test_documents_of_the_id_stream_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from rostra.plans import catalog_files as CF

    monkeypatch.setattr(CF, "_run_dir", lambda s, name: str(tmp_path / name))
    texts = spark.range(0, 40, 1, 4).selectExpr("id AS doc_id", "concat('Tom tom w', id % 5) AS text")
    texts.write.parquet(str(tmp_path / "in/documents.parquet"))
    got = {r["token"]: (r["tf"], r["n_ids"], r["n_tokens_of_id"]) for r in CF.q_a17_ids(spark, str(tmp_path / "in")).collect()}
    assert got == {"tom": (80, 1, 1)} | {f"w{k}": (8, 1, 1) for k in range(5)}
    for k in range(3):
        assert len(list((tmp_path / f"a17/in/b{k}").glob("*.parquet"))) > 1
