"""The threshold table against plain Python, on hard rows and random texts of few words."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rostra.llm import quality_rules as qr

SCHEMA = "doc_id long, text string, N_WORDS string, kept int, row string"
HARD = [None, "", " \t\n", "a", "a a a", "a a a a a a", "a b c a b c", "x  y\tx y\x0bx y", "# $$ %x <>|\n\n# $$ %x <>|\n \nend",
        "| a | b |\n| a | b |\nno", "One two...\nthree…\n- four\n• five", "ROT!! Rot!! ÄÖ!! 12!!", "é É ﬁ \U0001F600 it's «der» (The)",
        " ".join("the quick word is of use".split() * 20), "z" * 30_000, " ".join(f"w{i % 977}" for i in range(20_000))]


def random_texts():
    rng = random.Random(5)
    return [" ".join(rng.choice("ab") for _ in range(rng.randrange(30))) for _ in range(60)] + \
        ["\n".join(rng.choice(["a b", "", "c", " c"]) for _ in range(rng.randrange(20))) for _ in range(30)]


def plain(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    under = {i + d for at in seen.values() if len(at) > 1 for i in at for d in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(under),
            sum(x.strip(qr.PUNCTUATION).lower() in qr.STOP_WORDS for x in w), sum(not any(c.isalpha() for c in x) for x in w), len(lines),
            sum(bool(re.search(r"\|[^|]*\|", x)) for x in lines), sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*$", x)) for x in lines),
            sum(bool(re.match(r"[\x20\x09-\x0D]*[-*•‣·][\x20\x09]", x)) for x in lines),
            sum(x.endswith("!!") and x != x.lower() and x == x.upper() for x in w))


def fails(rule, m):
    value, base = m[rule.measure], 1 if rule.per is None else m[rule.per]
    value *= 1 if rule.per is None else 1000
    low, high = rule.low is not None and value < base * rule.low, rule.high is not None and value > base * rule.high
    return base >= rule.least and (low or high)


@pytest.fixture(scope="module")
def rows():
    return [(i if i % 7 else None, t, "kept as input", 9, "mine") for i, t in enumerate(HARD + random_texts() + HARD[:4])]


def test_measures_and_verdicts(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("place", F.monotonically_increasing_id()).repartition(3)
    got = qr.judge(docs).orderBy("place").collect()
    assert len(got) == len(rows)
    assert [r["row"] for r in got] == ["mine"] * len(rows)
    for (i, text, *_), r in zip(rows, got):
        m = dict(zip(qr.MEASURES, plain(text)))
        assert r["doc_id"] == i and {k: r[k] for k in qr.MEASURES} == m, text
        failed = [x.name for x in qr.THRESHOLDS if fails(x, m)]
        base = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        assert (r["failed_rules"], r["base_failed"], r["kept"]) == (failed, base, not base and not failed), text


def test_a_table_of_ones_own(spark):
    docs = spark.createDataFrame([("a b",), ("a b c",)], "body string")
    got = qr.judge(docs, "body", (qr.Rule("three", "n_words", None, low=3),)).collect()
    assert [r["failed_rules"] for r in got] == [["three"], []]
    assert got[0]["body"] == "a b"


def test_empty_table_and_plan(spark, rows):
    docs = spark.createDataFrame([], SCHEMA)
    assert qr.judge(docs).count() == 0
    plan = qr.judge(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_very_long_text(spark):
    n = 1_000_000
    text = " ".join(str(i % 3331 if i < 5000 else i) for i in range(n))
    r = qr.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["n_words"] == n and r["n_repeat_words"] == plain(text)[4]
