import io
import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import cli
from quern.config import Config
from quern.engine import Engine, checked_limit
from quern.operators import embed, knn, registry, tables
from quern.operators.embed import HashingEmbedder
from quern.sources import codebase


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "code"
    (root / "pkg").mkdir(parents=True)
    (root / "pkg/__init__.py").write_text("def banana_split():\n    return 'banana'\n")
    (root / "main.go").write_text("package main\n\n// Parses tokens.\nfunc ParseTokens() {\n}\n")
    (root / "notes.yaml").write_text("colour: green\n")
    (root / "empty.py").write_text("")
    (root / "pic.png").write_bytes(b"\x89PNG")
    (root / "big.txt").write_text("x" * 3000)
    (root / ".gitignore").write_text("skip/\n")
    (root / "skip").mkdir()
    (root / "skip/a.py").write_text("a = 1\n")
    return root


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, Config(warehouse=str(tmp_path / "wh"), max_file_kb=2), HashingEmbedder(dims=64))


def test_source(spark, tree):
    df = codebase.read(spark, str(tree), max_kb=2, partitions=3)
    assert {r["rel_path"] for r in df.select("rel_path").collect()} == {"pkg/__init__.py", "main.go", "notes.yaml", "empty.py"}
    some = df.filter(F.col("rel_path") == "main.go").collect()
    assert len(some) == 1 and some[0]["content"].startswith(b"package main") and some[0]["error"] is None
    with pytest.raises(NotADirectoryError):
        codebase.read(spark, str(tree / "main.go"))


def test_index_search_and_increments(engine, tree):
    first = engine.index(str(tree))
    assert (first.files_processed, first.files_skipped, first.errors) == (3, 0, [])
    top = engine.search("banana split").collect()
    assert top[0]["file"].endswith("pkg/__init__.py") and top[0]["symbol"] == "banana_split" and len(top) <= 6
    assert [r["file"] for r in engine.search("banana", area="pkg").collect()] == [str(tree / "pkg/__init__.py")]
    assert {r["type"] for r in engine.search("x", language="go", chunk_type="function").collect()} == {"function"}
    with pytest.raises(ValueError):
        engine.search("x", area="../other")
    again = engine.index(str(tree))
    assert (again.files_processed, again.files_skipped) == (0, 3)
    (tree / "main.go").write_text("package main\n\nfunc Other() {\n}\n")
    os.utime(tree / "main.go", (time.time() + 5, time.time() + 5))
    third = engine.index(str(tree))
    assert (third.files_processed, third.files_skipped) == (1, 2)
    symbols = {r["symbol_name"] for r in engine.chunks([str(tree)]).collect()}
    assert "Other" in symbols and "ParseTokens" not in symbols
    (tree / "notes.yaml").unlink()
    engine.index(str(tree))
    assert engine.files([str(tree)]).count() == 3
    engine.index(str(tree), sync=True)
    assert engine.files([str(tree)]).count() == 2
    assert {r["file_path"] for r in engine.chunks([str(tree)]).select("file_path").collect()} == {r["file_path"] for r in engine.files([str(tree)]).collect()}
    status = engine.status()
    assert status["files"] == 2 and status["last_run"]["errors"] == 0 and status["last_run"]["error_details"] == []


def test_report_and_lifecycle(engine, tree, tmp_path, spark):
    engine.index(str(tree))
    path = engine.save_search("Banana split!", str(tmp_path / "out"), notes="why")
    assert path.endswith("/banana-split.md") and "## Summary\n\nwhy\n" in open(path, encoding="utf-8").read()
    other = Engine(spark, engine.config, HashingEmbedder("other", 64))
    with pytest.raises(registry.ModelMismatchError):
        other.index(str(tree))
    with pytest.raises(LookupError):
        other.search("x")
    with pytest.raises(registry.ModelMismatchError):
        other.search("x", codebase=str(tree))
    assert engine.search("x", codebase=str(tmp_path / "never")).collect() == []
    assert engine.info(str(tree))["bytes"] > 0
    other.rebuild(str(tree), reembed=True)
    assert [(x["status"], x["matches"]) for x in other.list(all_=True)].count(("active", True)) == 1
    assert other.purge() == 1 and len(other.list(all_=True)) == 1
    os.rename(tree, f"{tree}-moved")
    assert [x["status"] for x in other.prune()] == ["deprecated"]
    assert other.list() == [] and "set aside: 1," in other.doctor()[-1]["detail"]
    with pytest.raises(LookupError):
        other.deprecate("/nowhere")
    folder = os.path.join(engine.config.warehouse, "registry")
    last = max(n for n in os.listdir(folder) if n.startswith("v"))
    with open(os.path.join(folder, last), "w") as f:
        f.write("{broken")
    with pytest.raises(ValueError):
        engine.list()


def test_generations(engine, tree, monkeypatch):
    """A run that finds nothing changed writes nothing; one that finds a file changed writes that file; many are compacted."""
    from quern import engine as module

    monkeypatch.setattr(module, "GENERATIONS", 3)
    root = str(tree)
    engine.index(root)
    entry = lambda: engine._entry(root)
    first = entry()["generation"]
    again = engine.index(root)
    assert entry()["generation"] == first and again.seconds.keys() == {"walk", "chunk", "embed", "db", "total"}
    for k in range(4):
        (tree / "main.go").write_text(f"package main\n\nfunc Step{k}() {{\n}}\n")
        os.utime(tree / "main.go", (time.time() + 10 * (k + 1),) * 2)
        assert engine.index(root).files_processed == 1
        new = entry()["generation"].split(",")
        assert len(new) <= 3 and (len(new) == 1 or engine.spark.read.parquet(engine._at("files", root, new[-1])).count() == 1)
        symbols = {r["symbol_name"] for r in engine.chunks([root]).collect()}
        assert f"Step{k}" in symbols and f"Step{k - 1}" not in symbols and "banana_split" in symbols and engine.files([root]).count() == 3
    assert len(os.listdir(os.path.join(engine.config.warehouse, "files", f"codebase={module.text_name(root)}"))) == len(entry()["generation"].split(","))
    (tree / "pkg/__init__.py").write_text("def cherry():\n    pass\n")
    os.utime(tree / "pkg/__init__.py", (1, 1))
    assert engine.index(root, by_hash=True).files_processed == 1 and engine.index(root, by_hash=True).files_skipped == 3
    assert "cherry" in {r["symbol_name"] for r in engine.chunks([root]).collect()}
    assert not os.listdir(os.path.join(engine.config.warehouse, "work"))


def test_two_runs_at_once_do_not_overwrite(engine, tree):
    engine.index(str(tree))
    n = engine._version()
    engine.store.write_new(engine.store.at("registry", f"v{n + 1:08d}.json"), "[]")
    with pytest.raises(FileExistsError):
        engine.store.write_new(engine.store.at("registry", f"v{n + 1:08d}.json"), "[]")
    assert engine.list() == []


def test_listing_is_dealt_out(spark, tree):
    """Folder by folder in tasks, with the rules of every folder on the way, or all on the driver: the same files."""
    for a in "abc":
        for b in "xyz":
            (tree / a / b / "deep").mkdir(parents=True)
            (tree / a / b / "deep/f.txt").write_text("1")
            (tree / a / b / "deep/g.log").write_text("1")
        (tree / a / ".gitignore").write_text("*.log\n" if a != "c" else "!deep/g.log\ny/\n")
    (tree / "loop").symlink_to(tree)
    names = lambda df: sorted(r["rel_path"] for r in df.collect())
    want = sorted(x["rel_path"] for x in codebase.listing(str(tree), 2))
    assert names(codebase.listed(spark, str(tree), 2, tasks=1)) == names(codebase.listed(spark, str(tree), 2, tasks=5)) == want
    assert "a/x/deep/f.txt" in want and "c/x/deep/g.log" in want and not {"a/x/deep/g.log", "c/y/deep/f.txt", "loop/main.go"} & set(want)


def test_serve(engine, tree, tmp_path):
    from quern.serve import serve

    ask = lambda i, method, **params: json.dumps({"jsonrpc": "2.0", "id": i, "method": method, "params": params})
    tool = lambda i, name, **a: ask(i, "tools/call", name=name, arguments=a)
    lines = [
        ask(1, "initialize"), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), ask(2, "tools/list"), tool(3, "index_codebase", directory=str(tree)), tool(4, "search_code", query="banana split", limit=2.0),
        tool(5, "save_search_markdown", query="banana", output_path=str(tmp_path / "r.md")), tool(6, "index_status"), tool(7, "search_code", limit=3), tool(8, "nothing"), ask(9, "odd"), "not json", "[]", ask(10, "ping"),
    ]
    out = io.StringIO()
    serve(engine, io.StringIO("\n".join(lines) + "\n\n"), out)
    said = [json.loads(x) for x in out.getvalue().splitlines()]
    by = {x["id"]: x for x in said if x.get("id") is not None}
    assert sorted(by) == list(range(1, 11)) and any(x.get("method") == "notifications/message" for x in said)
    assert {t["name"] for t in by[2]["result"]["tools"]} == {"index_codebase", "search_code", "save_search_markdown", "index_status"}
    text = {i: by[i]["result"]["content"][0]["text"] for i in range(3, 9)}
    assert text[3].startswith("3 files") and json.loads(text[4])[0]["symbol"] == "banana_split" and len(json.loads(text[4])) == 2
    assert (tmp_path / "r.md").read_text().startswith("# banana\n") and json.loads(text[6])["files"] == 3
    assert [by[i]["result"]["isError"] for i in range(3, 9)] == [False] * 4 + [True] * 2
    assert by[9]["error"]["code"] == -32601 and [x["error"]["code"] for x in said if x.get("id", 0) is None] == [-32700, -32600] and by[10]["result"] == {}


def test_a_failed_batch_is_tried_text_by_text(spark):
    class Flaky:
        model, dims = "flaky", 4

        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return [[1.0, 0.0, 0.0, 0.0] for _ in texts]

    rows = [(f"/{i}", "go", "", "block", 1, 1, "bad" if i == 3 else "ok", i) for i in range(8)]
    df = spark.createDataFrame(rows, "file_path string, language string, symbol_name string, chunk_type string, start_line int, end_line int, content string, chunk_index int").coalesce(1)
    got = embed.embedded(df, Flaky(), batch_size=4).orderBy("chunk_index").collect()
    assert [r["embedding"] is None for r in got] == [i == 3 for i in range(8)] and "RuntimeError" in got[3]["error"]
    assert tables.embedded(embed.embedded(df, Flaky(), batch_size=4)).count() == 7
    with pytest.raises(ValueError):
        embed.embedded(df, Flaky(), batch_size=0)


def onehot(k, n=8):
    return [float(i == k) for i in range(n)]


def test_knn(spark):
    rows = [("/r/a.go", 0, 1, onehot(0)), ("/r/a.go", 1, 9, onehot(1)), ("/r/b.go", 0, 1, onehot(2)), ("/r/z.go", 0, 1, [0.0] * 8), ("/r/s.go", 0, 1, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "file_path string, chunk_index int, start_line int, embedding array<float>")
    top = knn.nearest(df, onehot(1), 3).collect()
    assert (top[0]["chunk_index"], round(top[0]["similarity"], 6)) == (1, 1.0)
    assert [(r["file_path"], r["chunk_index"]) for r in top[1:]] == [("/r/a.go", 0), ("/r/b.go", 0)]
    assert knn.nearest(df, onehot(1), 9).filter("similarity is null").count() == 2
    assert knn.nearest(df, onehot(1), 1, where=F.col("file_path") == "/r/b.go", mode="post").count() == 0
    many = knn.nearest_many(df.withColumn("id", F.monotonically_increasing_id()), np.array([onehot(1), onehot(2)]), 1, "id").collect()
    assert len(many) == 2 and all(round(r["similarity"], 6) == 1 for r in many)
    for bad in ({"k": 0}, {"k": 1, "mode": "x"}):
        with pytest.raises(ValueError):
            knn.nearest(df, onehot(1), **bad)
    plan = knn.nearest(df, onehot(1), 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_many_queries_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[7], x[9] = 0, x[8]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(knn, "QUERY_ROWS", 4)
    got = {}
    for r in knn.nearest_of_each(df, df.filter("id % 10 in (0, 7)"), 5, "id").collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["id"]
    y = x.astype(float)
    norms = np.linalg.norm(y, axis=1)
    y = np.divide(y, norms[:, None], out=np.zeros_like(y), where=norms[:, None] > 0)
    want = {q: [i for i in np.lexsort((np.arange(300), -(y @ y[q]))) if norms[i] > 0][:5] for q in range(300) if q % 10 in (0, 7) and norms[q] > 0}
    assert {q: [v[k] for k in sorted(v)] for q, v in got.items()} == want


def test_stored_index(spark, tmp_path, monkeypatch):
    """Every row is indexed; recall of the ten nearest on ids divisible by 100 is 0.9 or more, and all cells together are exact."""
    from quern.operators import vector_index as vi

    rng = np.random.default_rng(5)
    middle = rng.normal(size=(30, 24))
    clustered = middle[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 24))
    for name, x in (("clusters", clustered), ("random", rng.normal(size=(3000, 24)))):
        rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))] + [(3000, None), (3001, [0.0] * 24)]
        df = spark.createDataFrame(rows, "id long, embedding array<float>")
        monkeypatch.setattr(vi, "PART_ROWS", 40)  # large cells in several parts
        index = vi.build(df, str(tmp_path / name), "id", sample=1500)
        assert spark.read.parquet(str(tmp_path / name / "rows")).count() == 3000
        asked = df.filter("id % 100 = 0")
        exact = {(r["query"], r["id"]) for r in knn.nearest_of_each(df, asked, 10, "id").collect()}
        again = vi.VectorIndex(spark, str(tmp_path / name))
        assert again.probes == index.probes < len(index.centroids)
        found = {(r["query"], r["id"]) for r in again.search(asked, 10, "id").collect()}
        assert len(found & exact) / len(exact) >= 0.9 and len(exact) == 300
        assert {(r["query"], r["id"]) for r in again.search(asked, 10, "id", probes=10**6).collect()} == exact
    assert vi.build(df.limit(0), str(tmp_path / "none"), "id").search(asked, 3, "id").count() == 0
    with pytest.raises(ValueError):
        again.search(asked, 0, "id")


def test_replaced_keeps_what_failed(spark):
    old = spark.createDataFrame([("a", 0, "old"), ("a", 1, "old2"), ("b", 0, "b")], "file_path string, i int, v string")
    new = spark.createDataFrame([("a", 0, "new")], old.schema)
    assert sorted(map(tuple, tables.replaced(old, new).collect())) == [("a", 0, "new"), ("b", 0, "b")]
    with pytest.raises(ValueError):
        tables.batches(old, 0, "i")


@pytest.mark.parametrize(("model", "dims", "want"), [("m", 768, True), ("x", 768, False), ("m", 1024, False), ("", 0, True)])
def test_model_match(spark, model, dims, want):
    df = spark.createDataFrame([(model, dims)], "model string, dims int")
    ok, why = df.select(registry.matches("m", 768), registry.mismatch_reason("m", 768)).head()
    assert ok is want and (why == "") is want


def test_limits():
    assert [checked_limit(x, 6) for x in (None, 0, -1, 0.5, 2.9, "3", True)] == [6, 6, 6, 6, 2, 6, 6]
    with pytest.raises(ValueError):
        Config(batch_size=0)


class Fake:
    def __getattr__(self, name):
        return lambda *a, **k: []


@pytest.mark.parametrize(
    ("argv", "code"),
    [([], 0), (["help"], 0), (["nope"], 2), (["list"], 0), (["list", "--json"], 0), (["list", "--nope"], 2), (["info"], 1), (["remove"], 1), (["search"], 1), (["list", "-h"], 0), (["doctor"], 0), (["remove", "x", "--yes"], 0), (["remove", "--yes", "x"], 0)],
)
def test_exit_codes(argv, code, capsys):
    assert cli.main(argv, Fake()) == code


def test_no_answer_is_no(monkeypatch):
    monkeypatch.setattr("sys.stdin", io.StringIO(""))
    assert not cli.confirmed("sure?")
    monkeypatch.setattr("sys.stdin", io.StringIO("YES\n"))
    assert cli.confirmed("sure?")


def test_stream(spark, tmp_path):
    from quern.streaming import reindex

    schema = "file_path string, last_modified double, content string"
    src = str(tmp_path / "in")
    snaps = reindex.Snapshots(spark, str(tmp_path / "snap"))
    rows = [[("/a.yaml", 1.0, "one"), ("/b.yaml", 1.0, "two")], [("/a.yaml", 2.0, "three")]]
    for part in rows:
        spark.createDataFrame(part, schema).write.mode("append").json(src)
        q = reindex.start(spark.readStream.schema(schema).json(src), snaps, HashingEmbedder(dims=16), str(tmp_path / "cp"))
        q.awaitTermination()
    assert sorted((r["file_path"], r["content"]) for r in snaps.read().collect()) == [("/a.yaml", "three"), ("/b.yaml", "two")]


def test_http_embedder_checks_what_comes_back(monkeypatch):
    e = embed.HttpEmbedder("http://localhost:1", "nomic-embed-text", 3)
    monkeypatch.setattr(e, "_call", lambda path, body=None: {"embeddings": [[1, 2, 3]], "models": [{"name": "nomic-embed-text:latest"}]})
    assert e.embed(["a"]) == [[1, 2, 3]] and e.has_model() and e.probe() == 3
    with pytest.raises(ValueError):
        e.embed(["a", "b"])
    e.model = "mistral"
    assert not e.has_model()


def test_queries_and_sql_have_the_same_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    json.dumps(sorted(entry.queries()))
