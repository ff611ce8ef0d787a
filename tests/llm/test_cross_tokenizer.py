"""Alignment and pair counts against plain Python over the libraries; the hash by itself."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rostra.llm import cross_tokenizer as ct

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a string, part int, keys int"
TEXTS = [None, "", " ", "a", " a", "two words", "two  words ", "\n\nlines\n and\ttabs\r\n", "l'été déjà «vu» naïve ﬁ", "日本語 \U0001F600 test ​x",
         "<|endoftext|> </s> <s> <unk> <0x0A>", "a ▁ sign", "it's we'LL 12,345.67 #tag $$$ !!", "\x00 \x1c x\x1dy \x85 \xa0 z",
         "word " * 300, "x" * 5000, "same text twice", "same text twice", "tail space ", "é combining", "-" * 100 + " " * 50 + "end"]


def letters():
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    table, n = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            table[chr(n)] = b
            n += 1
    return table


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), letters()


def tokens(tools, text):
    a, b, table = tools
    if not text:
        return [], []
    at = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    bt = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        bt.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    return (at, bt) if b"".join(x for _, x in at) == raw == b"".join(x for _, x in bt) else ([], [])


def spans(ts):
    out, at = [], 0
    for i, raw in ts:
        out.append((at, at + len(raw), i))
        at += len(raw)
    return out


def plain(tools, texts):
    links, groups, sizes = [], [], []
    for t in texts:
        at, bt = map(spans, tokens(tools, t))
        links.append([(i, j) for s, e, i in at for u, v, j in bt if max(s, u) < min(e, v)])
        cuts = sorted({e for _, e, _ in at} & {e for _, e, _ in bt})
        lo, cells = 0, []
        for c in cuts:
            part = lambda ts: ",".join(str(i) for s, e, i in ts if lo <= s and e <= c)  # noqa: E731, B023
            cells.append(part(at) + "|" + part(bt))
            lo = c
        groups.append(";".join(cells))
        sizes.append((len(at), len(bt), len(cuts)))
    count = Counter(x for one in links for x in one)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return [(*s, len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x),
             hashlib.sha256(g.encode()).hexdigest() if g else "", g) for s, x, g in zip(sizes, links, groups)]


@pytest.mark.parametrize("kw", [{}, {"part_bytes": 300, "shard_keys": 16, "group_keys": 8}])
def test_equals_plain_python(spark, tools, kw):
    rows = [(i if i != 5 else None, t, "mine", 1, 2) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in ct.align(docs, A, B, with_groups=True, **kw).collect()}
    want = plain(tools, TEXTS)
    assert len(got) == len(TEXTS)
    for (i, t, *_), w in zip(rows, want):
        assert got[i] == w, repr(t)[:80]


def test_documents_of_the_tables(spark, tools):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    rows = [r for r in rows if len(r["text"] or "") < 3000]  # plain Python is quadratic
    small = spark.createDataFrame(rows, docs.select("doc_id", "text").schema)
    got = {r["doc_id"]: tuple(r)[1:] for r in ct.align(small, A, B, part_bytes=20_000).collect()}
    for r, w in zip(rows, plain(tools, [r["text"] for r in rows])):
        assert got[r["doc_id"]] == w[:-1]


def test_empty_table_and_tables_without_tokens(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ct.align(empty, A, B).count() == 0
    none = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "▁")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in ct.align(none, A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 4


def test_very_long_text_and_forgotten_words(spark, tools, monkeypatch):
    text = " ".join(f"w{i % 5000}x" for i in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, "w1x w2x"), (3, text)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in ct.align(docs.repartition(1), A, B, part_bytes=1 << 20).collect()}
    at, bt = tokens(tools, text)
    assert (got[1]["n_a"], got[1]["n_b"]) == (len(at), len(bt)) and got[1]["groups_sha256"] == got[3]["groups_sha256"]
    pair = ct.Pair(A, B)
    monkeypatch.setattr(ct, "_CACHE", 10)
    first = [pair.text[k] for k in pair.documents([text[:1000]])[0]]
    units = pair.documents(["w1x w1x w1x other words"])[0]
    pair.close(*np.unique(units, return_counts=True))
    assert pair.at == {"w1x": 0}
    assert [pair.text[k] for k in pair.documents([text[:1000]])[0]] == first


def test_words_are_cut_where_both_cut():
    pair = ct.Pair(A, B)
    rng = random.Random(3)
    for _ in range(5000):
        t = "".join(rng.choice(["a", "b", " ", " ", "\n", "\t", "é", "\x1c", "\xa0", "\u2003", "'s", "1"]) for _ in range(rng.randrange(1, 12)))
        assert pair.split(t) == ct._CUT.split(t)


def test_perfect_hash():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 100_000):
        keys = np.unique(rng.integers(0, 1 << 42, n))
        made = ct.PerfectHash.load(ct.PerfectHash.build(keys).dump())
        assert np.array_equal(np.sort(made(keys)), np.arange(len(keys)))
        assert len(made.dump()) * 8 < 4 * n + 3000
        other = made(rng.integers(1 << 43, 1 << 44, 100))
        assert ((other >= -1) & (other < max(len(keys), 1))).all()
