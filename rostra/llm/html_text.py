"""Main text of web pages: flat text blocks classified by a decision tree.

A page becomes a flat list of text blocks (text between block-level tags). Each block has
its word count and link density (share of words in links), those of the blocks before and
after it, its kind, and whether it lies in an element that marks the article or one that
marks page furniture (by tag, role, or a word in class or id). A decision tree, grown on
the small labelled table below (one row a block), tells content from the rest.

Defined results: null and empty pages and pages without content give the empty text; text
outside tags is a block; scripts, styles and other elements of raw text end at their own
end tag, whatever they hold; an unclosed script, style or comment lasts to the page's end; a
page cut anywhere is read as far as it goes; rows are independent, so repeats and ties
don't matter; other columns stay, those with the outputs' names are replaced. Pages are
read whole."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import texts, without

# Tags that end a text block, hold no text of the page, mark the article or furniture
BLOCK_TAGS = set("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol optgroup option p
    pre search section select summary table tbody td tfoot th thead title tr ul""".split())
SILENT_TAGS = set("script style noscript template textarea svg math title iframe object canvas audio video select".split())
RAW_TAGS = set("script style textarea title iframe".split())  # silent ones whose content is no markup
VOID_TAGS = set("area base br col embed hr img input link meta source track wbr".split())
MAIN_TAGS = {"article", "main"}
SIDE_TAGS = set("nav header footer aside form menu dialog button search fieldset".split())
MAIN_WORDS = set("article articlebody content entry main post story text".split())
SIDE_WORDS = set("""ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs byline comment commentlist comments
    consent contentinfo cookie cookies copyright dialog disclaimer disqus feedback footer gdpr header login masthead menu
    menubar message modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion
    recommended related reply replies respond review reviews search share sharing sidebar signup skip social sponsor sponsored
    subscribe subscription toc toolbar widget complementary alert""".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

# The labelled table: page, kind (h heading, p paragraph, l list item or cell, o other), in an
# article element, in a furniture element, words, words in links, content.
LABELLED = """
a l 0 1 1 1 0|a l 0 1 2 2 0|a l 0 1 1 1 0|a o 0 1 9 0 0|a h 1 0 8 0 1|a p 1 0 64 0 1|a p 1 0 3 0 1|a p 1 0 41 2 1|a o 0 1 12 1 0
b l 0 1 1 1 0|b l 0 1 1 1 0|b o 0 1 25 0 0|b h 1 0 2 0 1|b p 1 0 1 0 1|b p 1 0 2 0 1|b p 1 0 150 0 1|b l 1 0 6 0 1|b o 0 1 30 0 0
c h 0 1 3 3 0|c l 0 1 2 2 0|c h 1 0 5 0 1|c p 1 0 80 1 1|c p 1 0 5 5 1|c p 1 0 22 0 1|c h 1 1 2 0 0|c p 1 1 18 1 0|c p 1 1 35 0 0|c o 0 1 6 0 0
d l 0 0 1 1 0|d l 0 0 2 2 0|d l 0 0 1 1 0|d h 0 0 7 0 1|d p 0 0 45 0 1|d p 0 0 90 3 1|d p 0 0 12 0 1|d p 0 0 60 0 1|d o 0 0 4 4 0|d o 0 0 7 1 0
e o 0 0 3 3 0|e o 0 0 5 4 0|e h 0 0 6 0 1|e o 0 0 120 4 1|e o 0 0 75 0 1|e o 0 0 28 1 1|e o 0 0 3 3 0|e o 0 0 6 0 0|e o 0 0 2 2 0
f l 0 1 3 3 0|f p 0 1 40 1 0|f h 1 0 9 0 1|f p 1 0 30 0 1|f l 1 0 4 0 1|f l 1 0 9 1 1|f o 1 0 14 0 1|f o 1 1 10 2 0|f l 0 1 4 4 0
g p 0 1 55 0 0|g p 0 1 120 0 0|g p 0 1 2 0 0|g h 0 1 3 0 0|g h 1 0 4 0 1|g p 1 0 17 0 1|g p 0 1 20 0 0|g o 0 1 70 3 0
h l 0 0 2 2 0|h h 0 0 5 0 1|h p 0 0 33 0 1|h l 0 0 9 0 1|h l 0 0 11 0 1|h l 0 0 8 1 1|h p 0 0 50 2 1|h l 0 0 3 3 0|h l 0 0 4 4 0|h o 0 0 5 0 0
i o 1 0 1 0 1|i o 1 0 40 0 1|i h 1 0 1 0 1|i p 1 0 1 1 1|i p 1 0 9 9 1|i l 1 0 2 2 1|i o 1 1 3 3 0|i h 1 1 6 0 0|i p 1 1 1 0 0
"""
_KINDS = {"h": 0, "p": 1, "l": 2, "o": 3}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)", re.S)
_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in SILENT_TAGS}
_SCRIPT = re.compile(r"<!--|-->|<(/?)script(?=[\s/>]|\Z)", re.I)
_NAMES = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    kind: int
    main: bool
    side: bool
    words: int
    linked: int


def _marks(tag: str, attrs: str, inside_main: bool) -> tuple[bool, bool]:
    """Whether an element marks the article, or furniture."""
    names: set[str] = set()
    hidden = False
    for m in _NAMES.finditer(attrs) if attrs else ():
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() in ("hidden", "aria-hidden"):
            hidden |= value.lower() in ("", "true", "hidden")
        else:
            names |= {w.lower() for w in _WORDS.findall(value)}
    main = tag in MAIN_TAGS or bool({"articlebody"} & names) or "main" in names and tag in ("div", "section")
    if tag in ("html", "body") or tag in MAIN_TAGS:
        return main, bool(names & {"comment", "comments"}) and tag == "article"
    found = names & SIDE_WORDS
    if inside_main:
        found = found - {"header", "byline", "text"}
    side = hidden or tag in SIDE_TAGS and not (tag == "header" and inside_main) or bool(found and not names & (MAIN_WORDS - {"text"}))
    return main, side or bool(names & {"comment", "comments", "sidebar", "ad", "ads", "advert", "cookie"})


def _escaped_end(page: str, at: int) -> int:
    """Where a script's end tag lies by HTML's rule that <!-- <script> </script> --> is within; -1: nowhere."""
    comment = inner = False
    for m in _SCRIPT.finditer(page, at):
        if m[0] == "<!--":
            comment = True
        elif m[0] == "-->":
            comment = inner = False
        elif m[1] and not inner:
            return m.start()
        else:
            inner = comment and not m[1]
    return -1


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: tag, article, furniture
    holders: list[str] = []  # those of them that end blocks
    open_tags: Counter = Counter()
    marked = [0, 0]  # open elements that mark the article, furniture
    text: list[tuple[str, bool]] = []
    links, silent, at = 0, "", 0
    silent_end, no_end, escapes = 0, set(), True  # of a silent element with markup: its end, tags that don't end before

    def flush() -> None:
        if not text:
            return
        whole = "".join(t for t, _ in text)
        if whole and not whole.isspace():
            words = html.unescape(whole).split()
            if words:
                linked = sum(len(html.unescape(t).split()) for t, link in text if link)
                tag = holders[-1] if holders else ""
                kind = 0 if tag in HEADINGS else 1 if tag == "p" else 2 if tag in ("li", "td", "th", "dd", "dt") else 3
                out.append(Block(" ".join(words), kind, marked[0] > 0, marked[1] > 0,
                                 len(words), min(linked, len(words))))
        text.clear()

    def push(tag: str, main: bool, side: bool) -> None:
        stack.append((tag, main, side))
        open_tags[tag] += 1
        marked[0] += main
        marked[1] += side
        if tag in BLOCK_TAGS:
            holders.append(tag)

    def pop() -> str:
        tag, main, side = stack.pop()
        open_tags[tag] -= 1
        marked[0] -= main
        marked[1] -= side
        if tag in BLOCK_TAGS:
            holders.pop()
        return tag

    def close(tag: str) -> None:
        if open_tags[tag] > 0:
            while pop() != tag:
                pass

    while m := _TOKEN.search(page, at):
        if m.start() > at and not silent:
            text.append((page[at:m.start()], links > 0))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = (m[1] or m[4]) == "/"
        opening = not closing and not (m[3] or m[6] or "").rstrip().endswith("/")
        if silent:
            if closing and tag == silent:
                silent = ""
            elif opening and tag in RAW_TAGS and tag not in no_end:
                if end := _END[tag].search(page, at, silent_end):
                    at = end.start()
                else:
                    no_end.add(tag)
            continue
        if tag in SILENT_TAGS:
            if tag in BLOCK_TAGS:
                flush()
            if opening:
                silent = tag
                end = _END[tag].search(page, at)
                if tag in RAW_TAGS:  # its content is no markup: go on at its end tag
                    if end is None:
                        break
                    if tag == "script" and escapes and page.find("<!--", at, end.start()) >= 0:
                        escaped = _escaped_end(page, at)
                        escapes = escaped >= 0
                        at = escaped if escapes else end.start()
                    else:
                        at = end.start()
                else:
                    silent_end, no_end = end.start() if end else len(page), set()
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag not in BLOCK_TAGS:
            text.append((" " if tag == "br" else "", links > 0))
            if closing or tag in VOID_TAGS:
                if closing:
                    close(tag)
                continue
            main, side = _marks(tag, m[3] or m[6] or "", marked[0] > 0)
            if main or side:  # inline elements count only if they mark something
                flush()
                push(tag, main, side)
            continue
        flush()
        if tag in VOID_TAGS:
            continue
        if closing:
            links = 0
            close(tag)
            continue
        if stack and stack[-1][0] in ("p", *HEADINGS) or stack and tag in ("li", "td", "th", "tr", "dd", "dt", "option") and stack[-1][0] == tag:
            pop()  # end tags that may be left out
        main, side = _marks(tag, m[3] or m[6] or "", marked[0] > 0)
        push(tag, main, side)
    if at < len(page) and not silent:
        text.append((page[at:], links > 0))
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """Rows: kind is heading, paragraph, list; article, furniture; words and link density of
    the block, the one before and the one after."""
    n = len(found)
    words = np.zeros(n + 2)
    density = np.zeros(n + 2)
    words[1:-1] = [b.words for b in found]
    density[1:-1] = [b.linked / b.words for b in found]
    kind = np.array([b.kind for b in found])
    return np.column_stack([kind == 0, kind == 1, kind == 2, [b.main for b in found], [b.side for b in found],
                            words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:]]).astype(float)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    pages: dict[str, list] = {}
    for row in LABELLED.replace("\n", "|").split("|"):
        if row:
            page, kind, *rest = row.split()
            main, side, words, linked, label = map(int, rest)
            pages.setdefault(page, []).append((Block("", _KINDS[kind], bool(main), bool(side), words, linked), label))
    return (np.concatenate([features([b for b, _ in p]) for p in pages.values()]),
            np.array([x for p in pages.values() for _, x in p]))


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2):
    """A tree of (feature, threshold, low side, high side), or the share of content at a leaf."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return float(y.mean())
    best = (1e18, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            a, b = y[low], y[~low]
            if min(len(a), len(b)) < least:
                continue
            impurity = sum(len(s) * s.mean() * (1 - s.mean()) for s in (a, b))
            if impurity < best[0] - 1e-12:
                best = (impurity, f, t)
    if best[1] is None:
        return float(y.mean())
    low = x[:, best[1]] <= best[2]
    return best[1], float(best[2]), grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def classify(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree >= 0.5)
    out = np.zeros(len(x), bool)
    low = x[:, tree[0]] <= tree[1]
    out[low], out[~low] = classify(tree[2], x[low]), classify(tree[3], x[~low])
    return out


def main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """`pages` with text (content blocks joined by two newlines), n_chars and n_blocks."""
    base = without(pages, *[c for c in ("text", "n_chars", "n_blocks") if c != html_col])
    at = base.columns.index(html_col)
    names = [c if c not in ("text", "n_chars", "n_blocks") else f"{c}_in" for c in base.columns]
    base = base.toDF(*names)
    schema = T.StructType([*base.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
                           T.StructField("n_blocks", T.LongType())])
    tree = grow(*labelled())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, size, number = [], [], []
            for page in texts(b.column(at)):
                found = blocks(page)
                keep = classify(tree, features(found)) if found else []
                got.append("\n\n".join(x.text for x, k in zip(found, keep) if k))
                size.append(len(got[-1]))
                number.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(got, pa.string()), pa.array(size, pa.int64()), pa.array(number, pa.int64())],
                names=[*names, "text", "n_chars", "n_blocks"])
    return base.mapInArrow(run, schema)
