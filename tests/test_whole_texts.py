import hashlib
import re

from quern.plans import catalog

#: a character of two or three bytes across byte 1000 and byte 500; texts whose prefixes say nothing; slashes
TEXTS = ["x" * 999 + "é tail", "x" * 998 + "€ tail", "é" * 700, "y" * 499 + "é" * 600, "- " * 50 + "Late Words " * 9, "é" * 30 + " plain end", "a/b c/Last Part", "short", "", "z" * 2000, "über " * 300]


def slug(t):
    s = re.sub("^-|-$", "", re.sub("[^a-z0-9]+", "-", t.lower()))
    return (s[:60].strip("-") if len(s) > 60 else s) or "search"


def test_whole_texts_against_brute_force(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", f"src{i}", len(t)) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, [1.0, 0.1 * i], i) for i in range(10)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    run = lambda name: [tuple(r) for r in catalog.QUERIES[name](spark, d).collect()]
    cut = lambda t, n: t.encode()[:n].decode("utf-8", "replace")
    assert dict(run("truncate_bytes")) == {i: hashlib.md5(cut(t, 1000).encode()).hexdigest() for i, t in enumerate(TEXTS)}
    assert dict(run("slugify")) == {i: slug(t) for i, t in enumerate(TEXTS)}
    assert dict(run("markdown_path")) == {i: f"/notes/{i}.MD" if i % 3 == 0 else f"/notes/{slug(t)}.md" for i, t in enumerate(TEXTS)}
    names = {}
    for i, t in enumerate(TEXTS):
        last = re.sub("[^a-zA-Z0-9._-]+", "-", f"/a b/{t}".rsplit("/", 1)[-1])
        names[i] = f"{'codebase' if last in ('', '-') else last}-{hashlib.sha256(f'/a b/{t}'.encode()).hexdigest()[:8]}"
    assert {i: n for i, n, _ in run("storage_name")} == names
    got = {int(re.search(r"/(\d+)[^/]*$", f)[1]): n for f, n, _ in run("knn_verbose")}
    assert got == {i: len(cut(t, 500).encode()) for i, t in enumerate(TEXTS[:10])}
