"""Licence scan: sparse TF-IDF cosine to templates, inheritance along directories.

Candidates of a file are the whole file, its header blocks, and every line that names a
licensing word. Header blocks are paragraphs, runs of comment lines, neighbouring
paragraphs or neighbouring lines that all hold a licensing word, joined. Candidates are
compared with the templates by the cosine of TF-IDF vectors: lines with the notices, by
plain counts; blocks and the file with notices and full licence texts, by damped counts
(1 + log n), as long texts repeat their common words. Document frequencies of the templates'
words are counted over all files, other words weigh as unseen ones. A file that as a whole
matches a full text has that licence; else the best candidate at or above the threshold
names the file's. A licence file is one named so, or one that as a whole matches a full text (a
short text about some licence is none); the best match of the licence files of a directory is the directory's licence. A
file without a licence of its own takes that of its nearest ancestor directory that has
one, found by joining directories (not files) with their ancestors.

Scans are narrow; shuffled are directories, and, if very many of them have a licence, file rows without
text once to meet their directory (Spark splits a directory with many files).

Defined results: null and empty texts have no own licence but inherit; a null path lies in
the root directory; rows that repeat a path are judged one by one; equal cosines go to the licence
that sorts first, equal licence files to the path that sorts first; other columns are ignored;
empty tables give empty results. Texts are read whole."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_broadcast
from .common import materialise, texts

THRESHOLD = 0.6
# Short notices of common licences, by SPDX name
TEMPLATES = {
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.",
                 "This program is free software under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "BSD-2-Clause": ["Use of this source code is governed by a BSD 2-Clause license.", "Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.",
                "This program is free software; you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."],
    "ISC": ["Released under the ISC License.", "Licensed under the ISC License."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released into the public domain under the Unlicense."],
}
_GNU = ("This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} License as published "
        "by the Free Software Foundation, either version {3} of the License, or (at your option) any later version.")
_WARRANTY = (" This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
             "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2} License for more details. You should have "
             "received a copy of the GNU {2} License along with this {0}. If not, see https://www.gnu.org/licenses/.")
_GNU_NAMES = {"AGPL-3.0": ("program", ":", "Affero General Public", "3"), "GPL-2.0": ("program", ";", "General Public", "2"),
              "GPL-3.0": ("program", ":", "General Public", "3"), "LGPL-2.1": ("library", ";", "Lesser General Public", "2.1"),
              "LGPL-3.0": ("library", ";", "Lesser General Public", "3")}
# Notices that run over lines (blocks only), by SPDX name
NOTICES = {name: [_GNU.format(*x), (_GNU + _WARRANTY).format(*x)] for name, x in _GNU_NAMES.items()} | {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or "
                   "agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
                   "limitations under the License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
                "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
}
_SAYS = re.compile(r"(?i)licen[sc]e|copyright|public domain|spdx|permission is hereby granted")
_HINT = re.compile(r"(?i)licen[sc]e|copyright|public domain|spdx|permi(?:ssion|tted)|redistribut|warrant|free software|\bliab|\bas is\b")
_STEMS = ("licen", "copyright", "public domain", "spdx", "permi", "redistribut", "warrant", "free software", "liab", "as is")  # of both
_COMMENT = re.compile(r"\s*(?:#|//|/\*|\*|--|;|%|<!--|\"\"\"|'''|\(\*|dnl\b|rem\b)", re.I)
_OPENS = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''", "(*": "*)"}
_OPEN = re.compile("|".join(map(re.escape, _OPENS)))
_WORD = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")
_NAMED = r"(?i)^(licen[sc]e|copying|notice|unlicense)([.\-_].*)?$"


def _plain(word: str) -> str:
    """A version without the zeros that end it."""
    return re.sub(r"(\.0)+$", "", word) if "." in word else word


def words(line: str) -> list[str]:
    """Words and version numbers."""
    return [_plain(w) for w in _WORD.findall(line.lower())]


def _count(low: str) -> Counter:
    """Words of a lower-case text with their counts."""
    counts = Counter(_WORD.findall(low))
    for w in [w for w in counts if "." in w and _plain(w) != w]:
        counts[_plain(w)] += counts.pop(w)
    return counts


def full_texts() -> dict[str, list[str]]:
    """The full texts of the licences in this package, by SPDX name."""
    return {p.stem: [p.read_text(encoding="utf8")] for p in sorted((Path(__file__).parent / "licences").glob("*.txt"))}


def frequencies(files: DataFrame, text_col: str, *templates: Mapping[str, list[str]]) -> tuple[int, dict[str, int]]:
    """Number of files, and of those that hold each word of the templates (a bounded list)."""
    terms = frozenset(w for some in templates for lines in some.values() for x in lines for w in words(x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for t in texts(b.column(0)):
                n.update(terms.intersection(map(_plain, set(_WORD.findall(t.lower())))) | {""})
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])
    rows = files.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    got = {r["word"]: r["n"] for r in rows}
    return got.pop("", 0), got


class Matcher:
    """Sparse unit TF-IDF vectors of the templates, by word; `damped` takes 1 + log n for counts."""

    def __init__(self, total: int, found: Mapping[str, int], templates: Mapping[str, list[str]] = TEMPLATES, damped: bool = False):
        self.idf = {w: math.log((1 + total) / (1 + n)) + 1 for w, n in found.items()}
        self.unseen = math.log(1 + total) + 1
        self.damped = damped
        self.names = [name for name in sorted(templates) for _ in templates[name]]
        vectors = [self._vector(Counter(words(x))) for name in sorted(templates) for x in templates[name]]
        self.row = {w: i for i, w in enumerate(dict.fromkeys(w for v in vectors for w in v))}
        norms = [math.sqrt(sum(x * x for x in v.values())) or 1.0 for v in vectors]
        cells = sorted((self.row[w], k, x / norms[k]) for k, v in enumerate(vectors) for w, x in v.items())
        self.start = np.searchsorted([r for r, _, _ in cells], np.arange(len(self.row) + 1))
        self.template, self.value = np.array([k for _, k, _ in cells], np.int64), np.array([x for _, _, x in cells])

    def _vector(self, counts: Mapping[str, int]) -> dict[str, float]:
        if self.damped:
            return {w: (1 + math.log(n)) * self.idf.get(w, self.unseen) for w, n in counts.items()}
        return {w: n * self.idf.get(w, self.unseen) for w, n in counts.items()}

    def counted(self, counts: Mapping[str, int], least: float = 0.0) -> tuple[str | None, float]:
        """The best template and its cosine for words with their counts; (None, 0) also if the
        share of the templates' words proves that no cosine reaches `least`."""
        known = self._vector({w: counts[w] for w in counts.keys() & self.row.keys()})
        inside = sum(x * x for x in known.values())
        most = inside / max(least - 1e-6, 1e-9) ** 2  # a longer vector is too far from all templates
        if not known or inside + (len(counts) - len(known)) * self.unseen ** 2 > most:  # others weigh this at least
            return None, 0.0
        norm = inside + sum(x * x for x in self._vector({w: n for w, n in counts.items() if w not in known}).values())
        row = np.array([self.row[w] for w in known])
        size = self.start[row + 1] - self.start[row]
        at = np.arange(int(size.sum())) + np.repeat(self.start[row] - (np.cumsum(size) - size), size)
        sums = np.bincount(self.template[at], self.value[at] * np.repeat(list(known.values()), size), len(self.names))
        dots = np.round(sums / math.sqrt(norm), 12)
        best = int(dots.argmax())
        return (self.names[best], round(float(dots[best]), 9)) if dots[best] > 0 else (None, 0.0)

    def __call__(self, line: str) -> tuple[str | None, float]:
        return self.counted(_count(line.lower()))


def _runs(marks: Iterable[bool]) -> list[tuple[int, int]]:
    """Ranges of neighbouring true marks."""
    out, lo = [], None
    for i, x in enumerate([*marks, False]):
        if x and lo is None:
            lo = i
        elif not x and lo is not None:
            out.append((lo, i))
            lo = None
    return out


def header_blocks(lines: list[str], hinted: bool = True) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Ranges of lines: the paragraphs, and the other header blocks; not `hinted`: no line
    holds a licensing word."""
    paragraphs = _runs(any(map(str.isalnum, x)) for x in lines)
    comment, closer = [], ""
    for x in lines:
        comment.append(bool(closer) or _COMMENT.match(x) is not None)
        if not closer and comment[-1] and (m := _OPEN.match(x.lstrip())):
            closer = _OPENS[m[0]]
            x = x.lstrip()[len(m[0]):]
        if closer and closer in x:
            closer = ""
    says = [_HINT.search(x) is not None for x in lines] if hinted else [False] * len(lines)
    joined = _runs(hinted and (any(says[lo:hi]) or _HINT.search(" ".join(lines[lo:hi])) is not None) for lo, hi in paragraphs)
    other = {*_runs(comment), *((paragraphs[lo][0], paragraphs[hi - 1][1]) for lo, hi in joined), *_runs(says)}
    return paragraphs, sorted({(lo, hi) for lo, hi in other if hi - lo > 1} - {*paragraphs})


class Scanner:
    """Own licence of a text, its cosine, and whether it is as a whole a full licence text."""

    def __init__(self, line: Matcher, block: Matcher, full: Matcher, threshold: float):
        self.line, self.block, self.full, self.threshold = line, block, full, threshold

    def __call__(self, text: str) -> tuple[str | None, float, bool]:
        low = text.lower()
        flat = low.replace("\n", " ")
        hinted = any(x in flat for x in _STEMS)
        lines = low.split("\n")
        paragraphs, other = header_blocks(lines, hinted)
        found: list[tuple[str | None, float, int, int]] = []
        whole: Counter = Counter()
        for lo, hi in paragraphs:
            counts = _count("\n".join(lines[lo:hi]))
            found.append((*self.block.counted(counts, self.threshold), lo, hi))
            if len(paragraphs) > 1:
                whole.update(counts)
            else:
                whole = counts
        is_full = self.full.counted(whole, self.threshold)
        if is_full[1] >= self.threshold:
            return (*is_full, True)
        if len(paragraphs) > 1:
            found.append((*self.block.counted(whole, self.threshold), 0, len(lines)))
        found += [(*self.block.counted(_count("\n".join(lines[lo:hi])), self.threshold), lo, hi) for lo, hi in other]
        if hinted:
            found += [(*self.line(x), i, i + 1) for i, x in enumerate(lines) if _SAYS.search(x)]
        found = [x for x in found if x[0] and x[1] >= self.threshold]
        if not found:
            return None, 0.0, False
        name, cos, _, _ = min(found, key=lambda x: (-x[1], x[0]))
        return name, cos, False


def headers(files: DataFrame, scanner: Scanner, id_col: str, path_col: str, text_col: str) -> DataFrame:
    """Per row: id, path, own licence with its cosine, whether the file is a full licence text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [scanner(t) for t in texts(b.column(2))]
            cols = list(zip(*got)) if got else [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[0], pa.string()),
                                              pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())],
                                             names=["id", "path", "own", "cosine", "is_text"])
    return (files.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.col(text_col).alias("text"))
            .mapInArrow(run, "id long, path string, own string, cosine double, is_text boolean"))


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text",
         templates: Mapping[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD,
         notices: Mapping[str, list[str]] = NOTICES, full: Mapping[str, list[str]] | None = None) -> DataFrame:
    """Per row: id, path, license, cosine, origin (own, inherited or null), from_dir."""
    full = full_texts() if full is None else full
    seen = frequencies(files, text_col, templates, notices, full)
    blocks = {name: [x for some in (templates, notices, full) for x in some.get(name, [])] for name in {*templates, *notices, *full}}
    scanner = Scanner(Matcher(*seen, templates), Matcher(*seen, blocks, True), Matcher(*seen, full, True), threshold)
    found = headers(files, scanner, id_col, path_col, text_col)
    found = materialise(found.withColumn("dir", F.regexp_replace(F.regexp_replace("path", "[^/]*$", ""), "/+$", "")))
    name = F.regexp_extract("path", "[^/]*$", 0)
    licence_files = found.where(F.col("own").isNotNull() & (name.rlike(_NAMED) | F.col("is_text")))
    by_dir = licence_files.groupBy("dir").agg(F.max("cosine").alias("top"))
    by_dir = (licence_files.join(by_dir, "dir").where("cosine = top").groupBy("dir")
              .agg(F.min(F.struct("path", "own")).alias("least")).select("dir", F.col("least.own").alias("dir_license")))
    dirs = found.select("dir").distinct()
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(
        k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above")))).alias("a")).select(
        "dir", F.col("a.depth").alias("depth"), F.col("a.above").alias("above")).distinct()
    near = (up.join(by_dir.withColumnRenamed("dir", "above"), "above").groupBy("dir")
            .agg(F.max(F.struct("depth", "above", "dir_license")).alias("near"))
            .select("dir", F.col("near.above").alias("from_dir"), F.col("near.dir_license").alias("dir_license")))
    own = F.col("own").isNotNull()
    # directories with a licence reach the files by broadcast if few enough (checked), so that a large directory's files stay
    # where they are; else Spark splits a directory with many files
    return found.join(bounded_broadcast(materialise(near)), "dir", "left").select(
        F.col("id").alias(id_col), "path", F.coalesce("own", "dir_license").alias("license"),
        F.when(own, F.round("cosine", 6)).alias("cosine"),
        F.when(own, F.lit("own")).when(F.col("dir_license").isNotNull(), F.lit("inherited")).alias("origin"),
        F.when(~own, F.col("from_dir")).alias("from_dir"))
