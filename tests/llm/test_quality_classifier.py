import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quern.llm import quality_classifier as c


def test_features_do_not_depend_on_the_batch(prose):
    texts = ["", None, "a", "A b\nA b A b 12 #!", prose(1, 500), "é" * 9]
    whole = c.features(pa.array(texts))
    assert whole.shape == (6, len(c.FEATURES)) and np.isfinite(whole).all()
    assert np.allclose(whole, np.vstack([c.features(pa.array([t], pa.string())) for t in texts]))
    f = dict(zip(c.FEATURES, whole[3], strict=True))
    assert np.isclose(f["log_words"], np.log1p(8)) and f["repeated_triples"] > 0 and f["symbols"] > 0


def test_discriminant_against_the_formula():
    rng = np.random.default_rng(0)
    d = len(c.FEATURES)
    xs = [rng.normal(0, 1, (300, d)), rng.normal(0.5, 2, (200, d))]
    sums = np.array([np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()]) for x in xs])
    m = c.Discriminant(sums, shrink=0.0, ridge=0.0)
    x = rng.normal(0, 1, (5, d))
    logs = []
    n = 500
    pooled = sum((v - v.mean(0)).T @ (v - v.mean(0)) for v in xs) / n + 1e-4 * np.eye(d)
    for v in xs:
        w = d / (d + len(v))
        s = (1 - w) * np.cov(v.T, bias=True) + w * pooled
        r = x - v.mean(0)
        logs.append(-0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", r, np.linalg.inv(s), r) + np.log(len(v) / n))
    assert np.allclose(m.scores(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_held_out_accuracy_and_edge_cases(spark, make_docs, prose):
    good = [prose(i, 80).capitalize() + "." for i in range(100)]
    bad = [" ".join(w + "&&&" for w in prose(i, 80).split()) for i in range(60)]
    docs = make_docs([*good, *bad, None, "", "x " * 50_000], ids=[*range(160), 170, 171, 172]).withColumn("x", F.lit(1))
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i in range(160)] + [(3, None, 1)], "doc_id long, quality int, toxic int")
    got = c.score(docs, labels).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 160]
    assert len(got) == 163 and np.mean([r["predicted"] == int(r["doc_id"] < 100) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in c.score(docs, labels.limit(0)).collect()} == {0.5}
    assert c.score(docs.limit(0), labels).count() == 0


def plain(t):
    """The statistics of one text, one after the other, in plain Python."""
    import math
    import re

    raw = (t or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
    n, chars = max(1, len(w)), sum(map(len, w))
    letters = max(1, chars)
    of = lambda some: sum(chr(c) in some for c in raw)
    mean = chars / n
    spread = math.sqrt(max(0.0, sum(len(x) ** 2 for x in w) / n - mean**2))
    triples = list(zip(low, low[1:], low[2:], strict=False))
    share = lambda x, y: math.sqrt(max(0, x) / y)
    return [
        math.log1p(len(w)), math.log1p(mean), math.log1p(spread), share(sum(65 <= c <= 90 for c in raw), letters), share(sum(48 <= c <= 57 for c in raw), letters), share(of(",;:'\"()-"), n), share(of("#*$%&<>@~^=_{}[]\\/"), n),
        share(of("!?"), n), share(of("|"), n), share(of("\n"), n), share(len(w) - len(set(low)), n), share(sum(a == b for a, b in zip(low, low[1:], strict=False)), n), share(len(triples) - len(set(triples)), n), share(of("."), n),
        math.log1p(len(set(low))) - 0.5 * math.log1p(len(w)), share(sum(c >= 128 for c in raw), letters), math.log1p(max(map(len, w), default=0)),
    ]


def test_features_against_plain_python(prose):
    texts = ["", None, " \n\t", "A b\nA b A b 12 #!", prose(1, 300).title() + "!? | {x} é 😀", "é" * 9, "go go go go", prose(2, 40) + "\n" + prose(2, 40), "x" * 5000, "a\u00a0b (c), d; 'e' -- f."]
    assert np.allclose(c.features(pa.array(texts, pa.string())), [plain(t) for t in texts], atol=1e-9)


def test_repeated_and_long_rows(spark, make_docs, prose):
    docs = make_docs([prose(i % 7, 30 + i % 7) for i in range(40)] + [prose(1, 20_000)] * 2, ids=[*(i % 7 for i in range(40)), 50, 50])
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, quality int")
    by = {}
    for r in c.score(docs, labels).collect():
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(by) == 8 and all(len(v) == 1 for v in by.values())
