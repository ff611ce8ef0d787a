"""Ids as the tokenizer file gives them, and packing until the corpus' bound is met."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rostra.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def test_ids_of_hard_texts(tok):
    tokens = packing.UnitTokens(PATH)
    assert tokens.independent
    rng = random.Random(1)
    signs = list("aAbÉé ßΣσς İıſ K'S'lé̈ \n\t\x1c\x1f\x85\xa0 ​1½²-!«日本\U0001F600<|endoftext|>") + \
        ["<|endoftext|>", "<|startoftext|>", "  ", "가", "ᄀ", "ᅡ", "'LL", "'s ", "ﬁ", "Å"]
    some = ["".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(3000)] + ["", "x" * 50_000, "a <|endoftext|> b"]
    for lo in range(0, len(some), 500):
        part = some[lo:lo + 500]
        for t, got in zip(part, tokens(part)):
            assert got.tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)[:80]


def test_other_tokenizer_files_go_whole():
    other = packing.UnitTokens(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.independent
    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(" two  words", add_special_tokens=False).ids
    assert other([" two  words"])[0].tolist() == want


def test_special_strings_long_texts_and_repeated_rows(spark, tok):
    long = " ".join(f"w{i % 3000}" for i in range(30_000))
    rows = [(1, "a <|endoftext|> b"), (2, long), (2, long), (None, "x"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packing.pack(packing.pieces(docs, PATH)).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i, k, at, len(ids[at:at + 4096]), zlib.crc32(ids[at:at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    assert got == sorted(want, key=repr) and 49407 in tok.encode("a <|endoftext|> b").ids


@pytest.mark.parametrize(("sizes", "part"), [([60] * 30 + [40] * 30, 12), ([34] * 90, 12), ([1 + i * 7919 % 41 for i in range(400)], 60),
                                             ([1] * 1205, 150), ([100] * 7, 12), ([99] * 5 + [1] * 5, 12)])
def test_exchange_meets_the_bound(spark, sizes, part):
    rows = [(i, 0, 0, n, 0) for i, n in enumerate(sizes)]
    frame = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(frame, capacity=100, part_pieces=part)
    fill = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count(F.lit(1)).alias("k"), F.countDistinct("offset").alias("o")).collect()
    assert max(r["n"] for r in fill) <= 100 and all(r["k"] == r["o"] for r in fill)
    assert sum(r["k"] for r in fill) == len(sizes)
    assert len(fill) == packing.lower_bound(np.bincount(sizes, minlength=101), 100)
