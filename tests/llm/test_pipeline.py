import random

from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__ as entry


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(k.startswith(f"op{i}_") for k in names) for i in range(1, 11))
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "mixing"]


def test_stages(spark, make_docs, prose, tmp_path):
    rng = random.Random(2)
    item = prose(7777, 25)
    texts = []
    for i in range(90):
        w = prose(i, 100).split()
        if i % 3 == 0:
            for k in (10, 40, 70, 90):
                w[k] = "zugg" + w[k][:2]
        texts.append(" ".join(w))
    texts += [texts[1], texts[2] + " more", prose(200, 50) + " " + item + " end", prose(201, 60) + " write to jo.81@mail7.example.com"]
    docs = make_docs(texts, source=[rng.choice(["a", "b"]) for _ in texts])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.stored(stage(spark, now, str(tmp_path)), name)
        seen[name] = {r["doc_id"]: r["text"] for r in now.select("doc_id", "text").collect()}
        if name != "mixing":
            assert now.columns == docs.columns
    gone = set(range(94)) - set(seen["toxicity"])
    assert sum(i % 3 == 0 for i in gone if i < 90) >= 27 and sum(i % 3 != 0 or i >= 90 for i in gone) <= 2
    assert set(seen["toxicity"]) - set(seen["near_dedup"]) == {i for i in (90, 91) if i in seen["toxicity"]}
    assert set(seen["near_dedup"]) - set(seen["decontamination"]) == {92} & set(seen["near_dedup"])
    assert set(seen["pii"]) == set(seen["decontamination"]) and not any("jo.81@" in t for t in seen["pii"].values())
    rows = now.collect()
    assert 0 < len(rows) <= len(seen["pii"]) and all(r["copies"] >= 1 and r["taken"] == r["copies"] * r["size"] for r in rows)


def test_edge_cases(spark, make_docs, prose, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing columns and empty tables, through all five stages."""
    docs = make_docs([None, "", "  ", prose(1, 20_000), prose(2, 50), prose(2, 50), prose(3, 50), prose(4, 40), prose(4, 40)], ids=[0, 1, 2, 3, 4, 4, None, 7, 8], source=["a", "a", None, "b", "b", "b", "a", None, "c"])
    docs = docs.withColumn("lang", F.when(F.col("doc_id") > 3, F.col("lang")))
    for c in ("key", "label", "score", "size", "copies", "rank", "text_hash", "n_entities", "w", "hash", "set"):
        docs = docs.withColumn(c, F.lit("mine"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, counts = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.stored(stage(spark, now, str(tmp_path)), name)
        counts[name] = now.count()
        assert now.columns[: len(docs.columns)] == docs.columns and all(r["key"] == "mine" for r in now.collect())
        assert name == "mixing" or now.columns == docs.columns
    # one text without words of each kind stays: null and empty are one, blanks another
    assert counts | {"mixing": 0} == {"toxicity": 9, "near_dedup": 6, "decontamination": 6, "pii": 6, "mixing": 0} and 0 < counts["mixing"] <= 4
    rows = now.collect()
    assert all((r["text"] or "").split() for r in rows) and now.columns[-5:] == ["_size", "source_size", "target", "_copies", "taken"]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_run_leaves_one_table(spark, make_docs, prose, tmp_path):
    import os

    make_docs([prose(i, 60) for i in range(12)], source=["a", "b"] * 6).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(99, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    out = corpus_pipeline.run(spark, str(tmp_path))
    new = set(os.listdir(shared)) - before
    assert out.count() > 0 and len(new) == 1 and next(iter(new)).startswith("quern-mixing")


def test_arrow_batches_are_bounded_where_the_caller_writes(spark, make_docs, tmp_path, monkeypatch):
    """A stage's lazy result is written by others: no batch of texts may be as large as a partition."""
    most = 3 << 20

    class Probe:
        unlabelled = False

        def scores(self, texts):
            import numpy as np

            return np.full(len(texts), 1.0 if texts.buffers()[-1].size > most else 0.0)

    monkeypatch.setattr(corpus_pipeline.tox, "fit", lambda *a, **b: Probe())
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.range(0, 600, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 4000).alias("text"))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        corpus_pipeline.toxicity(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out")
        assert spark.read.parquet(f"{tmp_path}/out").count() == 600
        spark.conf.set(key, str(64 << 20))
        corpus_pipeline.toxicity(spark, docs, str(tmp_path))
        assert spark.conf.get(key) == str(64 << 20)
    finally:
        spark.conf.set(key, was) if was is not None else spark.conf.unset(key)
