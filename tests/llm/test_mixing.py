import numpy as np
from pyspark.sql import functions as F

from quern.llm import mixing


def test_water_fill():
    assert mixing.water_fill([100, 100], [1, 1], 150) == [75, 75]
    # 3:1 of 300 would be 225 and 75: the first stops at 200, the rest goes on
    assert mixing.water_fill([100, 100], [3, 1], 300) == [200, 100]
    assert mixing.water_fill([], [], 0) == [] and mixing.water_fill([0, 10], [3, 1], 15) == [0, 15]


def test_pivot_keeps_words_and_expectation():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 50, 200)
    p = rng.random(200)
    out = mixing.pivot(p, sizes, np.random.default_rng(2))
    open_ = (out > 0) & (out < 1)
    assert open_.sum() <= 1 and abs((out * sizes).sum() - (p * sizes).sum()) < 1e-6
    mean = np.mean([mixing.pivot(np.array([0.3, 0.6, 0.8]), np.array([2, 3, 5]), np.random.default_rng(k)) for k in range(4000)], axis=0)
    assert np.allclose(mean, [0.3, 0.6, 0.8], atol=0.03)


def test_mix(spark, make_docs, prose):
    n = 400
    rng = np.random.default_rng(3)
    texts = [prose(i, int(rng.integers(0, 60))) for i in range(n)] + [None, "", "same words", "same words"]
    source = [["a", "b", "é", None][int(rng.integers(0, 4))] for _ in range(n)] + ["a", None, "b", "b"]
    docs = make_docs(texts, ids=[*range(n), 900, 901, 902, 902], source=source).withColumn("size", F.lit("clash"))
    mixing.BUCKET_ROWS, mixing.FAN_IN, was = 10, 3, (mixing.BUCKET_ROWS, mixing.FAN_IN)
    try:
        out = mixing.mix(docs)
        got = out.collect()
        again = mixing.mix(docs.repartition(7)).collect()
    finally:
        mixing.BUCKET_ROWS, mixing.FAN_IN = was
    assert out.columns == [*docs.columns, "_size", "source_size", "target", "copies", "taken"] and len(got) == n + 4
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    total = sum(r["_size"] for r in got)
    targets = {r["source"]: r["target"] for r in got}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6
    for s, t in targets.items():
        own = [r for r in got if r["source"] == s]
        assert own[0]["source_size"] == sum(r["_size"] for r in own) and t <= 2 * own[0]["source_size"] + 1e-9
        assert abs(sum(r["taken"] for r in own) - t) <= max(r["_size"] for r in own)
    assert all(r["taken"] == r["copies"] * r["_size"] <= 2 * r["_size"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_what_stays_open_is_small():
    """Skewed sizes: the words taken of a source end within a median document of its target, and a large document is taken as often as its fraction."""
    rng, off, taken = np.random.default_rng(7), [], []
    for k in range(200):
        sizes = np.sort(np.maximum(1, rng.lognormal(5.5, 1.2, 400)).astype(int))[::-1]
        p = mixing.pivot(np.full(400, 0.37), sizes, np.random.default_rng(k))
        left = (p > 0) & (p < 1)
        assert left.sum() <= 1 and abs((p * sizes).sum() - 0.37 * sizes.sum()) < 1e-5
        off.append(sizes[left].sum() / np.median(sizes))
        taken.append(p[0])
    assert np.mean(off) < 1 and np.median(off) < 0.2 and abs(np.mean(taken) - 0.37) < 0.1


def test_sources_come_near_their_targets(spark, make_docs, prose):
    rng = np.random.default_rng(8)
    sizes = np.maximum(1, rng.lognormal(4, 1.2, 900)).astype(int)
    words = prose(1, int(sizes.max())).split()
    docs = make_docs([" ".join(words[:n]) for n in sizes], source=[("hot", "b", "c")[min(2, int(rng.integers(0, 6)) // 2 if rng.random() < 0.6 else 0)] for _ in sizes])
    was, mixing.BUCKET_ROWS = mixing.BUCKET_ROWS, 60
    try:
        got = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    finally:
        mixing.BUCKET_ROWS = was
    assert all(abs(r["taken"] - r["target"]) <= 0.01 * r["target"] for r in got), got


def test_long_texts_and_targets(spark, make_docs, prose):
    docs = make_docs([prose(1, 30_000), prose(2, 10), "", None], source=["a", "a", "b", None])
    assert {r["doc_id"]: (r["size"], r["copies"] >= 1) for r in mixing.mix(docs).collect() if r["doc_id"] == 0} == {0: (30_000, True)}
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"]) for r in mixing.targets(docs).collect()}
    assert got == {0: (30_000, 30_010, 1.5 * 30_010), 1: (10, 30_010, 1.5 * 30_010), 2: (0, 0, 0.0), 3: (0, 0, 0.0)}
