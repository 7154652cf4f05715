import pytest
from pyspark.sql import functions as F

from quern.functions import text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column).head()[0]


@pytest.mark.parametrize(("path", "want"), [("cmd/run.go", "go"), ("tools/gen.PY", "python"), ("web/view.tsx", "typescript"), ("site.scss", "scss"), ("data.parquet", ""), ("a.b/none", ""), ("x.cxx", ""), ("Main.kt", "kotlin")])
def test_language(spark, path, want):
    assert one(spark, text.detect_language("p"), p=path) == want


def test_fence_and_binary(spark):
    assert one(spark, text.fence_language("p"), p="/a/x.CXX") == "cpp"
    assert one(spark, text.is_binary("p"), p="/a/x.PNG")
    assert not one(spark, text.is_binary("p"), p="/a/png")


@pytest.mark.parametrize(
    ("n", "want"),
    [(1, [(1, 1)]), (50, [(1, 50)]), (51, [(1, 51), (51, 51)]), (60, [(1, 60), (51, 60)]), (61, [(1, 60), (51, 61)]), (101, [(1, 60), (51, 101), (101, 101)])],
)
def test_windows(spark, n, want):
    got = one(spark, text.line_windows("c"), c="\n".join(f"l{i}" for i in range(n)))
    assert [(r["start_line"], r["end_line"]) for r in got] == want


def test_blank_files_have_no_windows(spark):
    for blank in ("", "   \n  \n  ", "  \n"):
        assert one(spark, text.line_windows("c"), c=blank) == []


@pytest.mark.parametrize(
    ("s", "lines", "chars", "want"),
    [
        ("let total = 0", 3, 160, "let total = 0"),
        ("sun\nmoon\nstar\ncomet", 3, 160, "sun\nmoon\nstar…"),
        ("sun\nmoon\nstar\ncomet", 9, 160, "sun\nmoon\nstar\ncomet"),
        ("  while ok:\n      step()\n  stop()", 3, 160, "while ok:\n    step()\nstop()"),
        ("\t\u00e4pfel\n\n\t\tbirnen", 3, 160, "\u00e4pfel\n\n\tbirnen"),
        ("0123456789", 3, 7, "0123456…"),
        ("\u00fcber den Bergen", 3, 4, "\u00fcber…"),
    ],
)
def test_preview(spark, s, lines, chars, want):
    assert one(spark, text.snippet_preview("s", lines, chars), s=s) == want


@pytest.mark.parametrize(
    ("out", "query", "want"),
    [("/notes/week.md", "x", "/notes/week.md"), ("/notes/WEEK.Md", "x", "/notes/WEEK.Md"), ("/notes//", "Rate  Limits?", "/notes/rate-limits.md"), ("/a.b/c", "42", "/a.b/c/42.md"), ("/notes", "\u00bf?", "/notes/search.md")],
)
def test_markdown_path(spark, out, query, want):
    assert one(spark, text.markdown_path("o", "q"), o=out, q=query) == want
    assert len(one(spark, text.slugify("q"), q="z9" * 80)) <= 60


def test_cut_bytes(spark):
    assert one(spark, text.cut_bytes("s", 5), s="é" * 5) == "éé�"
    assert one(spark, text.cut_bytes("s", 5), s="abc") == "abc"


def test_sizes_and_names(spark):
    assert [one(spark, text.human_size("n"), n=n) for n in (0, 1023, 1024, 1280, 5 * 1024**3)] == ["0B", "1023B", "1.0KB", "1.2KB", "5.0GB"]
    name = one(spark, text.storage_name("r"), r="/x/my repo")
    assert name.startswith("my-repo-") and len(name) == len("my-repo-") + 8
    assert one(spark, text.storage_name("r"), r="/x/ ").startswith("codebase-")


def test_embedding_text(spark):
    args = dict(p="/lib/sum.rs", l="rust", s="total", k="function", a=4, b=7, c="fn total() {}")
    got = one(spark, text.embedding_text("p", "l", "s", "k", "a", "b", "c"), **args)
    assert got == "# File: /lib/sum.rs\n# Language: rust\n# Symbol: total (function)\n# Lines: 4-7\n\nfn total() {}"
    assert "# Symbol" not in one(spark, text.embedding_text("p", "l", "s", "k", "a", "b", "c"), **args | {"s": ""})
    assert "unknown" in one(spark, text.embedding_text("p", "l", "s", "k", "a", "b", "c"), **args | {"l": ""})


def test_join_lines_is_cut_to_the_file(spark):
    lines = text.lines_of("c")
    assert one(spark, text.join_lines(lines, -2, 2), c="a\nb\nc") == "a\nb"
    assert one(spark, text.join_lines(lines, 3, 9), c="a\nb\nc") == "c"
    assert one(spark, F.size(lines), c="a\nb\n") == 3


def test_report(spark):
    from quern.functions.report import render

    row = dict(p="lib/queue.ts", a=3, b=9, s=0.51239, y="", k="class", c="class Queue {\n}\n\n")
    hit = one(spark, text.markdown_hit("p", "a", "b", "s", "y", "k", "c"), **row)
    assert hit == "\n### [lib/queue.ts:3-9](lib/queue.ts#L3-L9)\n\nScore: 0.5124 · Symbol: — · Type: class\n\n```typescript\nclass Queue {\n}\n```\n"
    meta = {"query": "waiting line", "roots": "/lib", "model": "m", "time": "t"}
    full = render(meta, "Queues", "What waits where.\n", [hit, hit])
    assert full.startswith("# Queues\n\n- **Query:** waiting line\n- **Codebase root(s):** /lib\n- **Results:** 2\n") and full.endswith(hit + hit)
    assert "\n\n## Summary\n\nWhat waits where.\n\n## Results\n" in full
    assert render(meta, "", " ", []) == "# waiting line\n\n- **Query:** waiting line\n- **Codebase root(s):** /lib\n- **Results:** 0\n- **Model:** m\n- **Generated:** t\n\n## Results\n\nNo matches found.\n"


def test_size_limit(spark):
    assert [one(spark, text.within_size("s", 1), s=x) for x in ("a" * 1024, "a" * 1025, "é" * 512, "é" * 513)] == [True, False, True, False]
