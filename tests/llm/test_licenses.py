import math
import random
from collections import Counter

from pyspark.sql import functions as F

from quern.llm import licenses

FILES = [
    (1, "src/LICENSE", "Released under the MIT License.\n\nmore words here and there"),
    (2, "src/a/b/x.c", "int x;"),
    (3, "src/a/y.c", "/* Licensed under the Apache License, Version 2.0. */\nint y;"),
    (4, "src/a/b/COPYING.md", "This work is licensed under the GNU General Public License, version 3."),
    (5, "src/a/b/c/z.c", None),
    (6, "other/q.c", "the license of this software is unclear to all of us and the public"),
    (7, None, ""),
    (8, "src/top.c", "x"),
    (8, "src/top.c", "x"),
    (9, "src/LICENSE/odd.c", "y"),
]


def test_scan(spark):
    df = spark.createDataFrame(FILES, "doc_id long, path string, text string")
    got = licenses.scan(df).collect()
    assert len(got) == len(FILES)
    found = {r["doc_id"]: (r["license"], r["inherited_from"]) for r in got}
    assert found == {1: ("MIT", None), 2: ("GPL-3.0", "src/a/b"), 3: ("Apache-2.0", None), 4: ("GPL-3.0", None), 5: ("GPL-3.0", "src/a/b"), 6: (None, None), 7: (None, None), 8: ("MIT", "src"), 9: ("MIT", "src")}
    assert licenses.scan(df.limit(0)).count() == 0


def corpus_weights(lines=100_000):
    """Weights as of a corpus in which the commonest words of the templates are on many lines."""
    count = Counter(w for _, t in licenses.texts() for w in t)
    return {w: math.log((lines + 1) / (min(lines, 20 * count[w]) + 1)) + 1 for w in licenses._vocabulary()}, math.log(lines + 1) + 1


def test_left_out_lines_could_not_match():
    idf, other = corpus_weights()
    for templates, threshold in ((licenses.notices(), licenses.THRESHOLD), (licenses.texts(), licenses.TEXT_THRESHOLD)):
        m = licenses.Matcher(templates, idf, other, threshold)
        plain = licenses.Matcher(templates, idf, other, threshold)
        plain.keys = {w: set(range(len(m.templates))) for w in m.idf}
        for _, words in templates:
            for k in range(1, len(words), max(1, len(words) // 20)):
                bag = Counter([*words[k:], "foo"])
                a, b = m.best(bag), plain.best(bag)
                assert a[0] == b[0] and a[1] == b[1] or max(a[0], b[0]) < threshold


def test_whole_texts_decide():
    """A licence's own text, with a name and year put in, some words cut, or lines rewrapped, is that licence; a third of it isn't a whole one."""
    idf, other = corpus_weights()
    short, long = licenses.Matcher(licenses.notices(), idf, other, licenses.THRESHOLD), licenses.Matcher(licenses.texts(), idf, other, licenses.TEXT_THRESHOLD)
    rng = random.Random(4)
    for path in sorted(licenses._FOLDER.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        assert licenses.own_licence(text, short, long)[1] == path.stem
        words = text.replace("<year>", "2019").replace("<owner>", "Some Body and others").split()
        kept = " ".join(w for w in words if rng.random() > 0.08)
        score, name = licenses.own_licence(kept, short, long)
        assert name == path.stem and score >= licenses.TEXT_THRESHOLD, (path.stem, score, name)
        assert long.best(Counter(licenses.words(" ".join(words[: len(words) // 3]))))[0] < 0.99
    score, name = licenses.own_licence("rain over the hills and " * 500, short, long)
    assert name is None and score < 0.2


def test_headers_wrapped_and_unknown():
    idf, other = corpus_weights()
    short, long = licenses.Matcher(licenses.notices(), idf, other, licenses.THRESHOLD), licenses.Matcher(licenses.texts(), idf, other, licenses.TEXT_THRESHOLD)
    own = lambda t: licenses.own_licence(t, short, long)[1]
    assert own("/*\n * This Source Code Form is subject to the terms of the\n * Mozilla Public License, v. 2.0.\n */\nint x;") == "MPL-2.0"
    assert own("# This program is free software: you can redistribute it and/or modify it\n# under the terms of the GNU Affero General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n\nimport x") == "AGPL-3.0"
    assert own("// SPDX-License-Identifier: ISC\nx") == "ISC" and own("// SPDX-License-Identifier: Foo-1.1\nx") == licenses.OTHER
    assert own("Licensed under the Quux License.") == licenses.OTHER and own("Licensed under the MIT License.") == "MIT"
    assert own("nothing of the kind\n\nat all") is None and own("") is None


def test_against_brute_force(spark, make_docs, prose):
    rng = random.Random(9)
    pool = [t for v in licenses.NOTICES.values() for t in v]
    bodies = []
    for i in range(60):
        lines = [prose(100 * i + k, rng.randrange(0, 8)) for k in range(rng.randrange(1, 9))]
        for _ in range(rng.randrange(0, 3)):
            words = rng.choice(pool).split()
            cut = rng.randrange(1, len(words) + 1)
            lines.insert(rng.randrange(len(lines) + 1), " ".join(words[:cut]) + "\n// " + " ".join(words[cut:]))
        bodies.append("\n".join(lines))
    bodies += [(licenses._FOLDER / "ISC.txt").read_text(), None, "", "x " * 50_000]
    docs = make_docs(bodies).withColumn("path", F.concat(F.lit("a/f"), "doc_id"))
    for c in ("home", "dir", "name", "similarity", "whole", "depth"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = {r["doc_id"]: (r["license"], r["similarity"]) for r in licenses.scan(docs).collect()}
    lines = [licenses.words(x) for t in bodies for x in (t or "").split("\n")]
    df = Counter(w for x in lines for w in set(x))
    known = set(licenses._vocabulary())
    weight = lambda w: math.log((len(lines) + 1) / ((df[w] if w in known else 0) + 1)) + 1

    def cosine(a, b):
        a, b = ({w: (1 + math.log(c)) * weight(w) for w, c in Counter(x).items()} for x in (a, b))
        return sum(a[w] * b[w] for w in a.keys() & b.keys()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    for i, t in enumerate(bodies):
        own = [licenses.words(x) for x in (t or "").split("\n")]
        runs = [sum(own[k : k + n], []) for n in (1, 2, 3) for k in range(len(own) - n + 1)] + [sum(own, [])]
        runs += [licenses.words(p) for p in "\n".join(" ".join(x) for x in own).split("\n\n")]
        best = min(((cosine(r, n), who) for r in runs if r for who, n in licenses.notices()), key=lambda x: (-round(x[0], 9), x[1]), default=(0, None))
        text = max(((cosine(sum(own, []), n), who) for who, n in licenses.texts()), default=(0, None)) if sum(own, []) else (0, None)
        want = text if text[0] >= licenses.TEXT_THRESHOLD else best if best[0] >= licenses.THRESHOLD else (None, None)
        assert got[i][0] == want[1], (i, got[i], want)
        assert want[1] is None or abs(got[i][1] - want[0]) < 1e-9


def test_a_folder_that_holds_most_files(spark):
    rows = [(i, f"hot/f{i}.c", "x") for i in range(3000)] + [(3000, "hot/LICENSE", "Released under the MIT License."), (3001, "hot/COPYING", "Released under the MIT License."), (3002, "cold/f.c", "x"), (3003, "hot/deep/er/f.c", "")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    for most in (licenses.BROADCAST_ROWS, 0):
        was, licenses.BROADCAST_ROWS = licenses.BROADCAST_ROWS, most
        try:
            got = licenses.scan(df).groupBy("license", "inherited_from").count().collect()
        finally:
            licenses.BROADCAST_ROWS = was
        assert {(r["license"], r["inherited_from"]): r["count"] for r in got} == {("MIT", "hot"): 3001, ("MIT", None): 2, (None, None): 1}
