"""Operators against brute force on a small table with hard rows, nulls and empty tables."""

import hashlib
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from rostra.llm import (chat_format, embedding_dedup, exact_dedup, html_text, license_scan, packing, sentencepiece_fst,
                        simhash_dedup, substring_dedup, toxicity)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, n_words long, score double"
P = " ".join(f"passage{i}" for i in range(60))
TEXTS = ["", None, "One two", "one TWO", "É é", "é é", f"start {P} end", f"other {P} tail", f"other {P} tail", "x" * 40_000,
         "x" * 40_000 + "y", " ".join(f"w{i % 700}" for i in range(9000)), "a b\tc\x0bd", "lone ​\U0001F600 ﬁ it's I'LL 12.5 </s>"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, 1, 2, 0.5) for i, t in enumerate(TEXTS)] + [(None, "one two", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_exact_dedup(docs, empty):
    norm = lambda t: (t or "").encode().lower()
    got = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(docs, block_bytes=64).collect()}
    for i, t in enumerate(TEXTS):
        same = [j for j, u in enumerate(TEXTS) if norm(u) == norm(t)]
        size = len(same) + (norm(t) == b"one two")
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(same), size, i == max(same))
        assert got[i]["text_sha256"] == hashlib.sha256(norm(t)).hexdigest()
    assert got[None]["keep_id"] == 3 and not got[None]["kept"]
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_simhash(docs, empty):
    got = {r["doc_id"]: r for r in simhash_dedup.near_duplicates(docs).collect()}
    for i, t in enumerate(TEXTS):
        w = words((t or "").encode().lower().decode())
        sh = [" ".join(w[j:j + 3]) for j in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        assert got[i]["fingerprint"] == "%016x" % sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))
    assert got[0]["component_id"] == got[1]["component_id"] == 0 and got[None]["component_id"] == 2
    assert simhash_dedup.near_duplicates(empty).count() == 0


def test_simhash_links_are_whole(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fps = np.unique([int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), False)) for b in base for _ in range(150)]).astype(np.uint64)
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = simhash_dedup.link_fingerprints(frame, bucket_rows=8).collect()  # buckets are split again and again
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3

    def roots(pairs):
        label = list(range(len(fps)))
        for _ in range(len(fps)):
            old = list(label)
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
            if old == label:
                break
        return label
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    assert roots([(at[r["a"]], at[r["b"]]) for r in links]) == roots(list(zip(*np.nonzero(near))))


def test_thresholds_follow_the_pigeonhole_principle():
    rng = np.random.default_rng(0)
    bits = (rng.random((500, 64)) < 0.5).astype(float)
    for n in (500, 10 ** 6, 10 ** 9):
        parts = simhash_dedup.allocate(n, bits.T @ bits * (n / 500))
        used = sorted(b for p, _ in parts for b in p)
        assert len(set(used)) == len(used)
        assert sum(t + 1 for _, t in parts) == simhash_dedup.MAX_DISTANCE + 1


def brute_removed(texts, window):
    first, out = {}, {}
    for i, t in texts:
        w = words(t)
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j:j + window]), i)
    for i, t in texts:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j:j + window])] < i:
                gone[j:j + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def test_substring(docs, empty):
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs, unit_bytes=2000).collect()}
    want = brute_removed(list(enumerate(TEXTS)), 13)
    assert {i: (r["n_words"], r["n_removed"], r["kept_text"]) for i, r in got.items() if i is not None} == want
    assert want[8][1] == 62 and got[None]["n_removed"] == 0
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_packing(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    rows = packing.pack(packing.pieces(docs.where("doc_id is not null"), path), part_pieces=3).collect()
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows}
    for i, t in enumerate(TEXTS):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            assert got.pop((i, k)) == (at, len(part), zlib.crc32(part.tobytes()))
    assert not got
    place = {}
    for r in rows:
        place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in place.values():
        assert sum(n for _, n in spans) <= 4096
        assert [o for o, _ in sorted(spans)] == list(np.cumsum([0] + [n for _, n in sorted(spans)])[:-1])
    assert packing.pack(packing.pieces(empty, path)).count() == 0


def test_packing_deals_rows_without_or_with_one_id(spark):
    for same in (None, 7):
        rows = [(same, 0, 0, 1500 + i % 700, i) for i in range(400)]
        frame = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
        got = packing.pack(frame, part_pieces=40).collect()
        assert sorted((r["length"], r["ids_crc32"]) for r in got) == sorted(r[3:] for r in rows)
        parts: dict = {}
        for r in got:
            parts[r["sequence_id"] >> 24] = parts.get(r["sequence_id"] >> 24, 0) + 1
        assert len(parts) >= 8 and max(parts.values()) <= 100


def test_packing_bounds():
    rng = np.random.default_rng(2)
    for _ in range(20):
        size = rng.integers(1, 101, 60)
        bins, offset, fill = packing.best_fit_decreasing(size, 100)
        bound = packing.lower_bound(np.bincount(size, minlength=101), 100)
        assert bound <= len(fill) and fill.max() <= 100 and -(-size.sum() // 100) <= bound
        assert all(size[bins == b].sum() == f for b, f in enumerate(fill))
    assert packing.lower_bound(np.bincount([51, 51, 51], minlength=101), 100) == 3  # the sum alone says 2


def test_segments_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(50):
        s = rng.integers(-5, 5, 30).astype(float)
        found = toxicity.segments(s)
        best = max((s[a:b].sum() for a in range(30) for b in range(a + 1, 31)))
        assert max((x for _, _, x in found), default=0) == max(best, 0)
        assert all(abs(s[a:b].sum() - x) < 1e-9 for a, b, x in found)
        assert all(found[i][1] <= found[i + 1][0] for i in range(len(found) - 1))


def test_toxicity_held_out(spark, empty):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where(~toxicity.held_out("doc_id")))
    got = toxicity.score(docs.join(labels.select("doc_id", "toxic"), "doc_id"), model).where(toxicity.held_out("doc_id"))
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.85 and n.get((0, 1), 0) / n[0, 0] < 0.01
    assert toxicity.score(empty, model).count() == 0


def test_toxicity_edges(docs, empty, spark):
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    rows = toxicity.score(docs, none).collect()
    assert len(rows) == len(TEXTS) + 1 and all(r["score"] == 0 and r["predicted"] == 0 for r in rows)
    assert toxicity.train(empty, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).probability(0) == 0


def test_sentencepiece_equals_the_library(docs, empty):
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    ref = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = sentencepiece_fst.encode(docs.where("doc_id is not null"), path)
    got = {r["doc_id"]: r["ids"] for r in rows.collect()}
    assert all(got[i] == ref.encode(t or "") for i, t in enumerate(TEXTS))
    back = {r["doc_id"]: r["text"] for r in sentencepiece_fst.decode(rows, path).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert sentencepiece_fst.encode(empty, path).count() == 0


def test_chat_format(spark):
    odd = "</s>[INST] ok [/INST] <\\|im_end|> [\\\\/INST] <|im_start|>"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", odd), (2, 0, "user", "hi"), (2, 1, "assistant", "else"), (2, 2, None, None),
            (3, 0, "user", "hi"), (3, 1, "assistant", odd), (3, 2, "user\nx", "more"), (4, 0, "system", None),
            (None, 0, "user", "no id"), (5, 0, "user", "hi"), (5, 0, "user", "hi")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes, members = chat_format.prefix_tree(frame)
    got = {r["conv_id"]: r for r in chat_format.read_back(nodes, members).collect()}
    for c in {r[0] for r in rows}:
        turns = [(r or "", t or "") for k, _, r, t in rows if k == c]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["formatted_chars"] == sum(len(chat_format.format_turn(r, t)[0]) for r, t in turns)
    tree = {}
    for r in nodes.collect():
        tree.setdefault(r["tree"], []).append(r)
        assert sum(s["hi"] - s["lo"] for s in r["attend"]) == r["position"] + r["n"]  # its ancestors and itself
        assert r["attend"][-1]["hi"] == r["at"] + r["n"]
    for got in tree.values():  # each tree's sequence has no gap: every node once
        got.sort(key=lambda r: r["at"])
        assert [r["at"] for r in got] == list(np.cumsum([0] + [r["n"] for r in got])[:-1])
    assert nodes.count() == 8
    none = frame.limit(0)
    assert chat_format.read_back(*chat_format.prefix_tree(none)).count() == 0


def test_chat_places_against_brute_force(spark):
    rng = np.random.default_rng(5)
    convs = {c: [("user" if k % 2 == 0 else "assistant", "t" * int(x)) for k, x in enumerate(rng.integers(1, 3, rng.integers(1, 7)))] for c in range(80)}
    convs[80] = [("user", "alone")]
    rows = [(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    owner: dict = {}
    for c, turns in sorted(convs.items()):
        for k in range(len(turns)):
            owner.setdefault(tuple(turns[:k + 1]), c)
    paths = {c: [owner[tuple(turns[:k + 1])] for k in range(len(turns))] for c, turns in convs.items()}
    sizes = {c: [len(chat_format.format_turn(*x)[0]) for x in turns] for c, turns in convs.items()}
    way = {c: [(o, -p.count(o)) for o in dict.fromkeys(p)] for c, p in paths.items()}
    start: dict = {}
    for root in {t[0] for t in convs.values()}:
        at = 0
        for c in sorted((c for c in convs if convs[c][0] == root and c in paths[c]), key=way.get):
            start[c] = at
            at += sum(n for n, o in zip(sizes[c], paths[c]) if o == c)
    got = {r["conv_id"]: r for r in chat_format.places(*chat_format.prefix_tree(frame)).collect()}
    assert len(got) == len(convs)
    for c, p in paths.items():
        position = [sum(sizes[c][:k]) for k in range(len(p))]
        mine = [k for k, o in enumerate(p) if o == c]
        g = got[c]
        assert (g["n_runs"], g["own_nodes"]) == (len(way[c]), len(mine))
        if not mine:
            assert g["own_at"] is None and g["attended"] is None
            continue
        at = [start[c] + position[k] - position[mine[0]] for k in mine]
        whole = {o: (start[o], start[o] + sum(n for n, x in zip(sizes[c], p) if x == o)) for o in dict.fromkeys(p) if o != c}
        joined: list = []
        for k, a in zip(mine, at):  # each node's ancestors and its own branch up to it, touching ones as one
            spans: list = []
            for lo, hi in [*whole.values(), (start[c], a + sizes[c][k])]:
                if spans and spans[-1][1] == lo:
                    spans[-1] = (spans[-1][0], hi)
                else:
                    spans.append((lo, hi))
            joined += spans
        assert (g["own_at"], g["own_position"], g["sum_at"], g["sum_position"]) == (start[c], position[mine[0]], sum(at), sum(position[k] for k in mine))
        assert (g["n_intervals"], g["sum_lo"]) == (len(joined), sum(lo for lo, _ in joined))
        assert g["attended"] == sum(position[k] + sizes[c][k] for k in mine)


def test_chat_chain_has_one_interval_a_node(spark):
    """Conversations each a turn longer than the last: their branches touch."""
    rows = [(c, k, "user", f"turn {k}") for c in range(30) for k in range(c + 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes, _ = chat_format.prefix_tree(frame)
    got = nodes.collect()
    assert len(got) == 30 and all(len(r["attend"]) == 1 and r["attend"][0]["lo"] == 0 for r in got)


def test_escape_round_trip():
    for t in ["<s>", "<\\s>", "<\\\\s>", "[INST]x[\\INST]", "<|a|>", "<<SYS>> <</SYS>>", "<<s>", "\\<s>", "<|<s>|>"]:
        e = chat_format.escape(t)
        assert chat_format.unescape(e) == t and chat_format.parse_turn(chat_format.format_turn("a\nb\\n<s>", t)[0]) == ("a\nb\\n<s>", t)
        assert "<s>" not in e and "[INST]" not in e


def test_license_scan(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "a/LICENSE", mit, 1), (2, "a/b/c/x.py", "plain words", 1), (3, "a/b/LICENSE.txt", gpl, 1), (4, "z/x.py", None, 1),
            (5, None, "", 1), (6, "a/y.py", f"code\n{gpl}\nmore code of many other words, so that the licence line is the smaller part of this file " * 3, 1), (7, "a/w.py", "the copyright of nothing", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, path string, text string, cosine int")
    got = {r["doc_id"]: (r["license"], r["origin"], r["from_dir"]) for r in license_scan.scan(frame).collect()}
    assert got == {1: ("MIT", "own", None), 2: ("GPL-3.0", "inherited", "a/b"), 3: ("GPL-3.0", "own", None), 4: (None, None, None),
                   5: (None, None, None), 6: ("GPL-3.0", "own", None), 7: ("MIT", "inherited", "a")}
    assert license_scan.scan(frame.limit(0)).count() == 0


def test_a_text_about_a_licence_is_no_licence_file(spark):
    rows = [(1, "s/en/1.txt", "Some notes.\nlicensed under the GPL 3"), (2, "s/en/2.txt", "an unrelated text of some words"), (3, "s/de/LICENSE", "Released under the MIT License."),
            (4, "s/de/x/4.txt", None), (5, "s/fr/text", license_scan.full_texts()["ISC"][0]), (6, "s/fr/6.txt", "words")]
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got[2] == (None, None) and got[4] == ("MIT", "inherited") and got[6] == ("ISC", "inherited")


def test_license_scan_header_blocks_and_full_texts(spark):
    full = {k: v[0] for k, v in license_scan.full_texts().items()}
    mine = "Copyright (c) 2019, A. Person\nAll rights reserved.\n\n"
    gpl = ("This file is part of Tool.\n\nTool is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License "
           "as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.")
    code = "import os\nfor name in os.listdir('.'):\n    print(name, len(name))\n" * 20
    wrapped = "\n".join(f"# {x}".rstrip() for x in gpl.split("\n"))
    block = "/*\n" + mine + full["BSD-2-Clause"] + "*/\nint main() { return 0; }\n" + "int f(int x) { return x + 1; }\n" * 200
    rows = [(1, "b3/LICENSE", mine + full["BSD-3-Clause"]), (2, "b3/src/x.c", "int x;"), (3, "isc/COPYING", full["ISC"].replace("ISC License", mine)),
            (4, "isc/x.js", "var x"), (5, "g/x.py", "#!/usr/bin/python\n" + wrapped + "\n\n" + code), (6, "b2/x.c", block),
            (7, "b2/y.c", "int y;"), (8, "r/README", code + gpl.replace("3", "2") + "\n\n" + code), (9, "p/x.txt", code + "We permit no free software in this house.\n" + code),
            *[(10 + i, f"full/{k}.x", t) for i, (k, t) in enumerate(sorted(full.items()))]]
    frame = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in license_scan.scan(frame).collect()}
    assert {i: got[i] for i in range(1, 10)} == {
        1: ("BSD-3-Clause", "own"), 2: ("BSD-3-Clause", "inherited"), 3: ("ISC", "own"), 4: ("ISC", "inherited"), 5: ("GPL-3.0", "own"),
        6: ("BSD-2-Clause", "own"), 7: (None, None), 8: ("GPL-2.0", "own"), 9: (None, None)}
    assert [got[10 + i] for i in range(len(full))] == [(k, "own") for k in sorted(full)]
    assert all(any(w in t.lower() for w in license_scan._STEMS) for t in full.values())


def test_html(spark):
    page = ('<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar"><nav><ul><li>'
            '<a href=/>Home</a></li></ul></nav><!-- x --><div class="cookie-notice">We use cookies here</div><main><article><header><h1>A &amp; b'
            '</h1></header><p>First <b>bold</b>\n text<br>line &eacute;.</p><p>No.</p><aside>Side</aside><form>Mail <input></form>'
            '<div class="comments"><p>Nice article, thank you so much for it</p></div></article></main><footer>&copy; me</footer>')
    frame = spark.createDataFrame([(1, "u", page, "old"), (2, "u", None, ""), (3, "u", "", ""), (4, "u", "<p", "")],
                                  "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_text.main_text(frame).collect()}
    assert got[1]["text"] == "A & b\n\nFirst bold text line é.\n\nNo." and got[1]["n_chars"] == len(got[1]["text"])
    assert [got[i]["text"] for i in (2, 3, 4)] == ["", "", ""]
    assert html_text.main_text(frame.limit(0)).count() == 0


def test_html_raw_text(spark):
    article = "<p>Article of quite a few words, as any page has it.</p>"
    heads = ["<script>for(i=0;i<n;i++){x()}</script>", "<script><!-- stray\nx()</script>", "<style>a<b{}<!--</style>",
             "<textarea>1 <b 'or\" </textarea>", "<SCRIPT>if(a<b&&c=='\"')y('</p>')</Script >", "<script>var t='<!--<script>'</script>",
             "<script><!-- <script>z('<p>no</p>')</script> --></script>", "<title>a <b</title>", "<iframe><!-- x</iframe>",
             "<noscript><style>a<b{}</style></noscript>", "<svg><title>a <b</title></svg>", "<noscript><iframe src=x></noscript>",
             "<script src=x></script>", "<script>var s='</scripts>';i<n</script>"]
    frame = spark.createDataFrame([(i, h + article) for i, h in enumerate(heads)] + [(99, article + "<script>i<n;" + article)], "page_id long, html string")
    want = "Article of quite a few words, as any page has it."
    got = {r["page_id"]: r["text"] for r in html_text.main_text(frame).collect()}
    assert got == {i: want for i in [*range(len(heads)), 99]}


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 16))
    near = [base[i % 20] + rng.standard_normal(16) * 0.04 for i in range(150)]
    rows = [(i, [float(x) for x in v], int(i % 2)) for i, v in enumerate([*base, *near, *base[:5], *[base[0]] * 40])]
    n = len(rows)
    odd = [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [1.0, None], 1), (n + 4, rows[0][1], None), (None, rows[0][1], 0)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(frame, leaf=40, block=30).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    link = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    want = link.sum(1)
    have = np.array([got[i]["n_links"] for i in range(n)])
    assert (have <= want).all() and have.sum() >= 0.9 * want.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(n, n + 5))
    assert got[None]["n_links"] == 0
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_embeddings_split_within_tasks(spark, monkeypatch):
    """Each level was two joins of all rows and a written table; now only nodes beyond `gather` are split so."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((900, 12))
    x = np.concatenate([base, base[:200] + rng.standard_normal((200, 12)) * 0.02])
    frame = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.98
    np.fill_diagonal(link, False)
    written = []
    monkeypatch.setattr(embedding_dedup, "materialise", lambda df, own=embedding_dedup.materialise: written.append(df.columns) or own(df))
    monkeypatch.setattr(embedding_dedup, "MOST_AHEAD", 3)  # projections end before the leaves do
    tables = {}
    for gather in (10**6, 200):
        written.clear()
        got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(frame, leaf=60, gather=gather).collect()}
        have = np.array([got[i] for i in range(len(x))])
        assert (have <= link.sum(1)).all() and have.sum() >= 0.97 * link.sum()
        tables[gather] = len(written)
    assert tables[10**6] <= 10 and tables[10**6] < tables[200]


def test_embeddings_near_pairs():
    """Single precision only picks: pairs are those of double precision, for some at the threshold itself, too."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((300, 8))
    x = embedding_dedup._unit(np.concatenate([base, base + rng.standard_normal((300, 8)) * 0.07, base[:40]]))
    exact = x @ x.T
    want = {(a, b) for a, b in zip(*np.nonzero(exact >= 0.98)) if a < b and abs(exact[a, b] - 0.98) > 1e-12}
    for step in (7, 256, 10**4):
        a, b = embedding_dedup._near(x, 0.98, step)
        assert {(i, j) for i, j in zip(a, b) if abs(exact[i, j] - 0.98) > 1e-12} == want and len(a) == len(set(zip(a, b)))


def _pipeline_fixture():
    """Documents and labels: toxic, exact, near and passage cases among clean ones."""
    rng = np.random.default_rng(6)
    vocabulary = [f"{a}{b}" for a in ("mar", "ten", "sol", "vin", "per", "lo", "kas", "dru") for b in ("ka", "do", "rin", "el", "us", "ta", "mo", "be", "an", "ir")]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    texts, toxic = {}, set()
    for i in range(120):
        texts[i] = prose(int(rng.integers(30, 90)))
        if i % 4 == 0:
            texts[i] += " " + " ".join(rng.choice(["vileone", "viletwo", "vilethree"], 25))
            toxic.add(i)
    labels = [(i, 1, int(i in toxic)) for i in range(100)]  # the others have no label
    texts[200], texts[201], texts[202] = texts[1].upper(), texts[1], texts[2] + " "
    texts[203], texts[204], texts[205] = None, "", "Ünlike ünlike"
    long = prose(900).split()
    for i in range(6):
        texts[210 + i] = " ".join([*long[:100 * i], "altered", *long[100 * i + 1:]])
    shared = prose(40)
    texts[220], texts[221], texts[222] = f"{prose(60)} {shared} {prose(50)}", f"{prose(70)}\n{shared}\t{prose(30)}", shared
    texts[223] = prose(9000)
    return texts, toxic, labels


def _near_kept(texts):
    """Ids that are the least of their SimHash component."""
    fps = {}
    for i, t in texts.items():
        w = words((t or "").encode().lower().decode())
        h = [xxhash.xxh64_intdigest(" ".join(w[j:j + 3]).encode(), 42) for j in range(max(1, len(w) - 2))] if w else []
        fps[i] = sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))
    label = {i: i for i in texts}
    for _ in texts:
        old = dict(label)
        for a in texts:
            for b in texts:
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    label[a] = label[b] = min(label[a], label[b])
        if old == label:
            break
    return {i for i in texts if label[i] == i}


def test_pipeline_stages_against_plain_python(spark, scratch):
    import corpus_pipeline
    from tokenizers import Tokenizer
    texts, toxic, labels = _pipeline_fixture()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], schema).write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{scratch}/labels.parquet")
    want = [{i: t for i, t in texts.items() if i not in toxic}]
    norm = lambda t: (t or "").encode().lower()
    last = {norm(t): i for i, t in sorted(want[0].items())}
    want.append({i: t for i, t in want[0].items() if last[norm(t)] == i})
    near = _near_kept(want[1])
    want.append({i: t for i, t in want[1].items() if i in near})
    removed = brute_removed(sorted(want[2].items()), 13)
    want.append({i: removed[i][2] if removed[i][1] else t for i, t in want[2].items()})
    assert len(want[0]) > len(want[1]) > len(want[2]) and want[2] != want[3]  # each stage has its cases
    docs = spark.read.parquet(f"{scratch}/documents.parquet")
    for (name, stage), expected in zip(corpus_pipeline.STAGES, want):
        rows = stage(spark, docs, scratch).collect()
        assert sorted(r["doc_id"] for r in rows) == sorted(expected), name
        assert {r["doc_id"]: r["text"] for r in rows} == expected, name
        docs = spark.createDataFrame(rows, schema)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = []
    for i, t in want[3].items():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        pieces += [(i, k, at, len(ids[at:at + 4096]), zlib.crc32(ids[at:at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    packed = corpus_pipeline.run(spark, scratch).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == sorted(pieces)
    spans = sorted((r["sequence_id"], r["offset"], r["length"]) for r in packed)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(spans, spans[1:])) and all(o + n <= 4096 for _, o, n in spans)


def test_pipeline(spark):
    import corpus_pipeline
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == names, name
        rows = got.collect()
        docs = spark.createDataFrame(rows, got.schema)
    texts = [(r["text"] or "").encode().lower() for r in rows]
    assert len(set(texts)) == len([t for t in texts if t]) + (b"" in texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.select("doc_id").distinct().count() == len(rows)


def test_segments_take_linear_time():
    for step in ([1.0, -2.0], [2.0, -1.0, -0.5]):
        scores = np.tile(step, 1_000_000 // len(step))
        begin = time.time()
        assert toxicity.segments(scores)
        assert time.time() - begin < 20
