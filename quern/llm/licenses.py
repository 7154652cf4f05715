"""License scan: sparse TF-IDF cosine of headers and licence files to templates, inheritance by path.

Two kinds of templates: notices, as headers have them, and whole licence texts (the
files of `templates/`, verbatim texts of public licences). Of every file, each line, each
run of two or three lines, each paragraph and each whole text is compared with the
notices, so that a notice that is wrapped over lines is seen whole; and the whole text with
the licence texts. Weights are (1 + log count) times the inverse document frequency over the
lines of the corpus, of all documents; words that no template has count in the norm of
a vector. The best notice at or above the threshold, or text at or above
text_threshold, is the file's own licence. Notices without a licence's name stand
for "other", so that an unknown name isn't taken for the nearest known one. A file without
a licence of its own inherits that of the nearest directory above it that
holds a licence file: a join of (directory, depth) with the licence files'
directories, of which the deepest match counts.

Words of templates are few, so vectors are made in one map without a
shuffle; the joins carry paths and scores only. What directories inherit is
broadcast up to BROADCAST_ROWS; beyond that, a directory that holds a third
of all files is one row on the other side of its join, whose partitions Spark may split.

Defined cases: a null text counts as the empty text, which has no licence of its own; long texts
are compared whole; a null path is a file at
the root named ""; equal scores go to the first template by name; of several
licence files in one directory the one with the highest score counts, then the
least licence name; repeated rows get the same result; an empty table gives an
empty result; columns other than id, path and text aren't looked at, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import bytes_np as b
from quern.llm.common import scratch, stored, text_of

OTHER = "other"
#: Notices and opening words of public licences, by SPDX id.
NOTICES = {
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "Licensed under the GNU Affero General Public License, version 3"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "you may not use this file except in compliance with the License"],
    "Artistic-2.0": ["The Artistic License 2.0", "Licensed under the Artistic License 2.0"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC0-1.0": ["CC0 1.0 Universal", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."],
    "EPL-2.0": ["Eclipse Public License - v 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "either version 3 of the License, or (at your option) any later version"],
    "ISC": ["Licensed under the ISC license"],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Zlib": ["Licensed under the zlib license", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
    OTHER: ["Licensed under the License", "Released under the License.", "This work is licensed under the License", "SPDX-License-Identifier:"],
}
THRESHOLD, TEXT_THRESHOLD = 0.6, 0.8
BROADCAST_ROWS = 200_000
LICENCE_FILE = "(?i)^(licen[cs]e|copying|unlicense|notice)(\\.(txt|md|rst))?$"
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_FOLDER = Path(__file__).parent / "templates"


def words(line: str) -> list[str]:
    return _WORD.findall(line.lower())


def notices() -> list[tuple[str, list[str]]]:
    """(licence, words) of each notice, the machine-readable line of each licence among them."""
    return [(name, words(t)) for name in sorted(NOTICES) for t in [*NOTICES[name], *([] if name == OTHER else [f"SPDX-License-Identifier: {name}"])]]


def texts() -> list[tuple[str, list[str]]]:
    """(licence, words) of each whole licence text."""
    return [(p.stem, words(p.read_text(encoding="utf-8"))) for p in sorted(_FOLDER.glob("*.txt"))]


class Matcher:
    """Cosine of a bag of words to templates; idf holds the weights of the templates' words, other is that of any other word."""

    def __init__(self, templates: list[tuple[str, list[str]]], idf: dict[str, float], other: float, threshold: float) -> None:
        self.idf, self.other, self.templates = idf, other, []
        for name, own in templates:
            v = {w: (1 + math.log(c)) * idf[w] for w, c in Counter(own).items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.templates.append((name, {w: x / norm for w, x in v.items()}))
        #: a bag without any of these words of a template can't reach the threshold (Cauchy-Schwarz) and is left out
        self.keys: dict[str, set[int]] = {}
        for k, (_, v) in enumerate(self.templates):
            left = 1.0
            for w in sorted(v, key=lambda w: (-v[w], w)):
                if left < threshold**2 - 1e-9:
                    break
                self.keys.setdefault(w, set()).add(k)
                left -= v[w] ** 2

    def best(self, bag: Counter) -> tuple[float, str | None]:
        """The highest cosine of the templates that may reach the threshold, and its licence."""
        near = sorted(set().union(*(self.keys[w] for w in bag if w in self.keys)))
        if not near:
            return 0.0, None
        vector = {w: (1 + math.log(c)) * self.idf.get(w, self.other) for w, c in bag.items()}
        norm = math.sqrt(sum(x * x for x in vector.values()))
        top, name = 0.0, None
        for k in near:
            who, v = self.templates[k]
            s = sum(x * vector[w] for w, x in (v.items() if len(v) <= len(vector) else ((w, v[w]) for w in vector if w in v)) if w in vector) / norm
            if s > top + 1e-12:
                top, name = s, who
        return top, name


def units(lines: list[list[str]], keys: Iterable[str]) -> Iterator[Counter]:
    """Bags of the runs of one, two and three lines and of the paragraphs that hold a key."""
    hot = [bool(x) and not keys.isdisjoint(x) for x in lines]
    if not any(hot):
        return
    for n in (1, 2, 3):
        for i in range(len(lines) - n + 1):
            if any(hot[i : i + n]):
                yield Counter(w for x in lines[i : i + n] for w in x)
    start = 0
    for i in range(len(lines) + 1):
        if i == len(lines) or not lines[i]:
            if i - start > 3 and any(hot[start:i]):
                yield Counter(w for x in lines[start:i] for w in x)
            start = i + 1


def own_licence(text: str, short: Matcher, long: Matcher, threshold: float = THRESHOLD, text_threshold: float = TEXT_THRESHOLD) -> tuple[float, str | None]:
    """(highest similarity, licence or None) of one file by its own text."""
    lines = [words(x) for x in text.split("\n")]
    whole = Counter(w for x in lines for w in x)
    found = [short.best(u) for u in units(lines, short.keys.keys())]
    found += [short.best(whole)] if len(lines) > 3 else []
    found = [(s, n) for s, n in found if n is not None]
    of_text = long.best(whole)
    # a whole text says more than a notice inside it
    if of_text[0] >= text_threshold:
        return of_text
    top = min(found, key=lambda x: (-round(x[0], 9), x[1]), default=(0.0, None))
    return (top[0], top[1] if top[0] >= threshold else None) if top[0] >= of_text[0] else (of_text[0], top[1] if top[0] >= threshold else None)


def _vocabulary() -> list[str]:
    return sorted({w for _, t in notices() + texts() for w in t})


def _frequencies(vocabulary: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, lines = Counter(), 0
        for batch in batches:
            for piece in b.pieces(batch, "text"):
                for text in piece.column("text").to_pylist():
                    for line in text.split("\n"):
                        lines += 1
                        df.update(vocabulary.intersection(words(line)))
        df[""] = lines
        yield pa.RecordBatch.from_arrays([pa.array(list(df)), pa.array(list(df.values()), pa.int64())], names=["word", "n"])

    return run


def parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def scan(files: DataFrame, path: str = "path", text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, text_threshold: float = TEXT_THRESHOLD) -> DataFrame:
    """One row per file row: doc_id, path, license (null if none), similarity (of its own text), inherited_from (directory, or null)."""
    kind = files.schema[id_col].dataType.simpleString()
    source = files.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(path), F.lit("")).alias("path"), text_of(text).alias("text"))
    vocabulary = _vocabulary()
    # a row per word of the templates
    found = {r["word"]: r["n"] for r in source.select("text").mapInArrow(_frequencies(set(vocabulary)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    lines = found.get("", 0)
    idf = {w: math.log((lines + 1) / (found.get(w, 0) + 1)) + 1 for w in vocabulary}
    other = math.log(lines + 1) + 1
    short, long = Matcher(notices(), idf, other, threshold), Matcher(texts(), idf, other, text_threshold)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in b.pieces(batch, "text"):
                out = [own_licence(t, short, long, threshold, text_threshold) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("path"), pa.array([s for s, _ in out], pa.float64()), pa.array([n for _, n in out], pa.string())], names=["doc_id", "path", "similarity", "name"])

    with scratch(files.sparkSession) as tables:
        scanned = tables.kept(source.mapInArrow(own, f"doc_id {kind}, path string, similarity double, name string"), "licences")
        # nearest directory above with a licence file
        whole = F.substring_index(F.col("path"), "/", -1).rlike(LICENCE_FILE)
        dirs = scanned.filter(whole & F.col("name").isNotNull()).groupBy(parent(F.col("path")).alias("dir")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "name")).alias("x")).select("dir", F.col("x.name").alias("from_name"))
        dirs = stored(dirs, "directories")
        mine = scanned.filter("name is null").select(parent(F.col("path")).alias("home")).distinct()
        parts = mine.withColumn("p", F.split("home", "/"))
        above = parts.select("home", F.explode_outer(F.transform(F.sequence(F.lit(0), F.size("p")), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice("p", F.lit(1), i), "/").alias("dir")))).alias("x")).select("home", "x.depth", "x.dir")
        nearest = above.join(dirs, "dir").groupBy("home").agg(F.max(F.struct("depth", "dir", "from_name")).alias("x")).select("home", F.col("x.dir").alias("dir"), F.col("x.from_name").alias("from_name"))
        nearest = tables.kept(nearest, "nearest")
    if nearest.count() <= BROADCAST_ROWS:
        nearest = F.broadcast(nearest)
    out = scanned.withColumn("home", F.when(F.col("name").isNull(), parent(F.col("path")))).join(nearest, "home", "left")
    return out.select("doc_id", "path", F.coalesce("name", "from_name").alias("license"), "similarity", F.when(F.col("name").isNull(), F.col("dir")).alias("inherited_from"))
