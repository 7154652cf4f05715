import math
import pickle
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import ctw


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def brute(train, texts, depth):
    """Context-tree weighting with dictionaries, one tree per (bits so far)."""
    low = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    steps = lambda t: [((bytes(depth) + low(t) + b"\0")[i : i + depth], x) for i, x in enumerate(low(t) + b"\0")]
    n = defaultdict(lambda: [0, 0])
    children = defaultdict(set)
    for t in train:
        for c, x in steps(t):
            for j in range(8):
                for d in range(depth + 1):
                    key = (j, x >> (8 - j), c[depth - d :])
                    n[key][(x >> (7 - j)) & 1] += 1
                    if d:
                        children[key[0], key[1], c[depth - d + 1 :]].add(key)
    memo = {}

    def weighted(key):
        if key not in memo:
            own = kt(*n[key]) if key in n else 0.0
            memo[key] = own if len(key[2]) == depth else np.logaddexp(own, sum(map(weighted, children[key]))) - math.log(2)
        return memo[key]

    def p(j, head, c, bit):
        out = None
        for d in range(depth, -1, -1):
            key = (j, head, c[depth - d :])
            a = n[key] if key in n else [0, 0]
            own = (a[bit] + 0.5) / (sum(a) + 1)
            if out is None:
                out = own
            else:
                w = 1 / (1 + math.exp(min(700, sum(map(weighted, children[key])) - kt(*a))))
                out = w * own + (1 - w) * out
        return out

    return [sum(math.log10(p(j, x >> (8 - j), c, (x >> (7 - j)) & 1)) for c, x in steps(t) for j in range(8)) for t in texts]


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_against_brute_force(spark, make_docs, broadcast_rows):
    texts = ["The cat sat", "the cat ran É", None, "", "dog THE cat", "zq", "the the the", "  a\tb ", "the cat sat"]
    docs = make_docs(texts, ids=[*range(8), 0]).withColumn("score", F.lit("x"))
    got = sorted(ctw.score(docs, depth=3, broadcast_rows=broadcast_rows).collect(), key=lambda r: r["doc_id"])
    held = {r["doc_id"] for r in got if r["held_out"]}
    assert held and len(got) == 9
    pairs = sorted(zip([*range(8), 0], texts, strict=True), key=lambda x: x[0])
    train = [t for i, t in pairs if i not in held]
    c = defaultdict(int)
    for t in train:
        for w in (t or "").lower().split():
            c[w.replace("é", "É")] += 1
        c[None] += 1
    total, v = sum(c.values()), len(c)
    assert np.allclose([r["score"] for r in got], brute(train, [t for _, t in pairs], 3))
    for r, (_, t) in zip(got, pairs, strict=True):
        words = [*(w.replace("é", "É") for w in (t or "").lower().split()), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(w in c for w in words), total)
        assert math.isclose(r["base_score"], sum(math.log10((c.get(w, 0) + 1) / (total + v + 1)) for w in words), rel_tol=1e-9)


def test_probabilities_add_up(spark, make_docs):
    """Over all bytes after one context the probabilities sum to one."""
    counts = spark.createDataFrame([((0x616263 << 8) | x, int(x == 100)) for x in range(256)], "key long, n long")
    logs = ctw.gram_table(counts, 3)
    assert math.isclose(sum(10 ** r["v"] for r in logs.collect()), 1.0, rel_tol=1e-9)


def test_no_documents_and_no_training(spark, make_docs):
    assert ctw.score(make_docs([])).count() == 0
    only = [i for i in range(200) if __import__("zlib").crc32(str(i).encode()) % 7 == 2][:2]
    got = ctw.score(make_docs(["ab", ""], ids=only)).orderBy("doc_id").collect()
    assert [r["base_score"] for r in got] == [0.0, 0.0] and math.isclose(got[0]["score"], 24 * math.log10(0.5))


def test_pieces_of_whole_groups_give_the_same_table(spark, monkeypatch):
    rng = np.random.default_rng(6)
    keys = np.unique(rng.integers(97, 101, (4000, 6)) @ (256 ** np.arange(5, -1, -1)))
    counts = spark.createDataFrame([(int(k), int(n)) for k, n in zip(keys, rng.integers(0, 9, len(keys)), strict=True)], "key long, n long")
    whole = {r["key"]: r["v"] for r in ctw.gram_table(counts, 5).collect()}
    monkeypatch.setattr(ctw, "CHUNK", 100)
    parts = {r["key"]: r["v"] for r in ctw.gram_table(counts.repartition(5), 5).collect()}
    assert whole.keys() == parts.keys() == set(keys.tolist()) and all(math.isclose(whole[k], parts[k], rel_tol=1e-9) for k in whole)


def test_words_that_a_polynomial_would_mix_up_and_long_texts(spark, make_docs, prose):
    """Words of a regular sequence, 2,048 bytes each and of equal letters; a long text in both ways."""
    one, two = "a", "b"
    for _ in range(11):
        one, two = one + two, two + one
    training = [i for i in range(100) if __import__("zlib").crc32(str(i).encode()) % 7 != 2][:3]
    docs = make_docs([one, two + " " + two, prose(1, 20_000)], ids=training).withColumn("key", F.lit(1)).withColumn("block", F.lit(2))
    a, b = (sorted(map(tuple, ctw.score(docs, broadcast_rows=n).collect())) for n in (10**6, 0))
    assert [x[0] for x in a] == training and [x[2] for x in a] == [2, 3, 20_001] == [x[3] for x in a]
    total, distinct = 20_006, 3 + len(set(prose(1, 20_000).split()))
    assert math.isclose(a[0][5], math.log10(2 / (total + distinct + 1)) + math.log10(4 / (total + distinct + 1)))
    assert math.isclose(a[1][5], 2 * math.log10(3 / (total + distinct + 1)) + math.log10(4 / (total + distinct + 1)))
    assert np.allclose([x[5:] for x in a], [x[5:] for x in b])


@pytest.mark.parametrize(("broadcast_rows", "run"), [(2_500, 10**6), (2_500, 40), (300, 10**6)])
def test_beyond_the_broadcast_rows_texts_are_neither_stored_nor_shuffled(spark, make_docs, prose, monkeypatch, broadcast_rows, run):
    """A part of the rows is broadcast; what is stored for the others follows the rare words, not the texts."""
    rng, words = np.random.default_rng(3), prose(5, 90).split()
    texts = [" ".join([*rng.permutation(words * 6), f"only{i}"]) for i in range(200)]
    texts += [None, "", "Only3 only3 zq", texts[0]]
    docs = make_docs(texts, ids=[*range(203), 0]).withColumn("doc_id", F.when(F.col("doc_id") != 7, F.concat(F.lit("d"), "doc_id"))).repartition(6)
    tables = {}
    stored = ctw.stored

    def measured(df, name):
        out = stored(df, name)
        tables[name] = sum(__import__("os").path.getsize(f.removeprefix("file://")) for f in out.inputFiles())
        return out

    monkeypatch.setattr(ctw, "stored", measured)
    monkeypatch.setattr(ctw, "RUN", run, raising=False)
    order = lambda r: (r["doc_id"] or "", r["n_bytes"])
    some, every = (sorted(ctw.score(docs, broadcast_rows=n).collect(), key=order) for n in (broadcast_rows, 10**6))
    assert len(some) == len(every) == 204 and [r[:5] + r[7:8] for r in some] == [r[:5] + r[7:8] for r in every]
    assert np.allclose([[r["base_score"], r["score"]] for r in some], [[r["base_score"], r["score"]] for r in every], rtol=1e-12)
    twice = [r for r in some if r["doc_id"] == "d0"]
    assert len(twice) == 2 and twice[0] == twice[1]
    after = sum(n for name, n in tables.items() if name not in ("counts", "tree", "second", "logs"))
    assert broadcast_rows == 300 or after < sum(len(t or "") for t in texts) / 4


def test_the_tables_pass_through_the_driver_in_pieces(spark, make_docs, monkeypatch):
    """What the driver's Python collects and broadcasts at once is bounded, however large the tables are."""
    rng = np.random.default_rng(8)
    texts = [bytes(rng.integers(97, 123, 20_000, np.uint8)).decode() for _ in range(10)]
    docs = make_docs([*texts, "Ab ab", None, " ".join(f"w{i}" for i in range(3000))])
    order = lambda r: r["doc_id"]
    one = sorted(ctw.score(docs).collect(), key=order)
    collected, sent = [0], []
    monkeypatch.setattr(ctw, "SENT", 20_000, raising=False)
    arrow, broadcast = type(docs).toArrow, type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(docs), "toArrow", lambda df: (out := arrow(df), collected.append(out.nbytes))[0])
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda sc, value: (sent.append(len(pickle.dumps(value))), broadcast(sc, value))[1])
    pieces = sorted(ctw.score(docs).collect(), key=order)
    assert sum(sent) > 16 * 190_000 + 2**21  # the grams are there, beside the upper nodes with their dense 2 MB
    assert max(sent) < 2.8e6 and max(collected) < 1e6
    assert one == pieces
