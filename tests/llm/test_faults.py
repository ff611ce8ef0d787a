"""Inputs that once gave wrong results or took quadratic time."""

import random
import time

from rostra.llm import exact_dedup, html_text, substring_dedup


def thue_morse(n):
    out = [0]
    while len(out) < n:
        out += [1 - x for x in out]
    return out[:n]


def test_substring_words_that_hash_alike(spark):
    """Two long words on which every polynomial hash modulo 2^64 agrees aren't one word."""
    x = "".join("ab"[k] for k in thue_morse(1024))
    y = "".join("ba"[k] for k in thue_morse(1024))
    head = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{head} {x}"), (2, f"{head} {y}"), (3, f"{head}  {y} more")]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_substring_rows_with_one_or_no_id(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text)] * 30 + [(5, text)] * 30 + [(4, text + " x")] + [(6, text)]
    for unit in (100, 1 << 20):
        got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), unit_bytes=unit).collect()
        lost = {i: {r["n_removed"] for r in got if r["doc_id"] == i} for i in (None, 4, 5, 6)}
        assert lost == {None: {0}, 4: {0}, 5: {40}, 6: {40}} and len(got) == 62


def test_nested_pages_take_linear_time():
    for unit in ("<div>x", "<span class=ad>x", "<a>x<article>", "</div>x", "<b class=nav>x</i>", "<p>x<li>"):
        begin = time.time()
        found = html_text.blocks(unit * (1_000_000 // len(unit)))
        assert found and time.time() - begin < 30, unit


def test_pages_mixed_at_random():
    """No text is lost or doubled, and open elements are known: the article and furniture marks agree with a search
    of the open tags (no end tag is left out here)."""
    rng = random.Random(2)
    for _ in range(300):
        page, stack, want = "", [], []
        for _ in range(rng.randrange(60)):
            tag = rng.choice(["div", "article", "nav", "section", "text", "close"])
            if tag == "text":
                page += "x y "
                if not want or want[-1] is None:
                    want.append(("article" in stack, "nav" in stack))
            elif tag == "close" and stack:
                tag = rng.choice(stack)  # closes what lies within, too
                page += f"</{tag}>"
                while stack.pop() != tag:
                    pass
                want.append(None)
            elif tag != "close":
                page += f"<{tag}>"
                stack.append(tag)
                want.append(None)
        got = [(b.main, b.side) for b in html_text.blocks(page)]
        assert got == [w for w in want if w is not None], page
        assert "".join(b.text for b in html_text.blocks(page)).replace(" ", "") == page_text(page)


def page_text(page):
    out, inside = "", False
    for c in page:
        inside = c == "<" or inside and c != ">"
        out += "" if inside or c == ">" else c
    return out.replace(" ", "")


def test_exact_dedup_keeps_one_row_of_each_group(spark):
    rows = [(7, "Same"), (7, "Same"), (3, "same"), (None, "SAME"), (None, "alone"), (None, "alone"), (9, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == 8
    assert sorted((r["doc_id"] is None, r["doc_id"], r["group_size"]) for r in got if r["kept"]) == [(False, 7, 4), (False, 9, 2), (True, None, 2)]


def test_stages_keep_one_of_repeated_rows(spark, tmp_path):
    """Rows repeated whole, one id for two texts, null ids, and an empty table."""
    import corpus_pipeline
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = [" ".join(f"{c}{i}" for i in range(30)) for c in "pqrs"]
    rows = [(7, words[0])] * 2 + [(7, words[1]), (None, words[2]), (None, words[2]), (None, words[3]), (2, words[1].upper())]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema).write.parquet(path)
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(path)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in stages["exact_dedup"](spark, docs, "").collect()) == \
        sorted([(7, words[0]), (7, words[1]), (0, words[2]), (0, words[3])])
    assert sorted((r["doc_id"] or 0, r["text"]) for r in stages["near_dedup"](spark, docs, "").collect()) == \
        sorted([(7, words[0]), (2, words[1].upper()), (0, words[2]), (0, words[3])])
    empty = spark.createDataFrame([], schema)
    for name in ("exact_dedup", "near_dedup", "substring_dedup", "packing"):
        assert stages[name](spark, empty, "").count() == 0
