import pytest

from quern.operators.chunk import chunks_of
from quern.sources.ignore import IgnoreSpec, Rule, build, parse

GO = """package tide

import "time"

// Gauge reads a water level.
type Gauge struct {
	marks []int // with } inside
}

// NewGauge starts at zero.
func NewGauge() *Gauge {
	return &Gauge{}
}

// Read adds a mark.
func (g *Gauge) Read(m int) (int, error) {
	s := "}"
	return len(s) + m, nil
}

func (g Gauge) Label() string { return "tide" }
"""
PY = '''"""Module."""
import math

# Keeps the sum.
@frozen
class Ledger:
    def __init__(self):
        self.sum = 0

    def post(self, amount):
        return self.sum + amount


def halves(n):
    return [] if n < 2 else [n // 2, *halves(n // 2)]
'''
TS = """// What can be played.
export interface Track {
  length(): number;
}

export class Song implements Track {
  constructor(private beats: number) {}
  length() { return 2 * this.beats; }
}

type Pair = {
  left: number;
};

// Sum of two.
export function gap(a: Pair, b: Pair): number {
  return a.left - b.left;
}

export const START: Pair = { left: 0 };
"""


def names(path, source):
    return [(c.symbol_name, c.chunk_type) for c in chunks_of(path, source)]


def test_go():
    assert names("a.go", GO) == [("Gauge", "class"), ("NewGauge", "function"), ("Gauge.Read", "method"), ("Gauge.Label", "method")]
    found, lines = chunks_of("a.go", GO), GO.split("\n")
    assert "// Gauge reads" in found[0].content and "// NewGauge starts" in found[1].content
    for c in found:
        assert 1 <= c.start_line <= c.end_line and c.content.split("\n")[0] == lines[c.start_line - 1]


def test_python():
    assert names("a.py", PY) == [("Ledger", "class"), ("halves", "function")]
    first = chunks_of("a.py", PY)[0]
    assert first.content.startswith("# Keeps the sum.\n@frozen") and "def post" in first.content


def test_typescript():
    assert names("a.ts", TS) == [("Track", "class"), ("Song", "class"), ("Pair", "class"), ("gap", "function"), ("START", "function")]
    assert "// What can be played." in chunks_of("a.ts", TS)[0].content


@pytest.mark.parametrize(
    ("path", "source", "want"),
    [
        ("a.rs", "use x;\n/// Doc\npub struct P { a: u8 }\nimpl P {\n    pub fn new() -> P { P { a: 1 } }\n}\nfn main() {\n    let s = '}';\n}\n", ["P", "P", "main"]),
        ("A.java", "package a;\npublic class A {\n  int f() { return 1; }\n}\ninterface B { }\n", ["A", "B"]),
        ("a.c", "#include <x.h>\nstruct s {\n int a;\n};\nstatic int add(int a, int b)\n{\n  return a + b;\n}\n", ["s", "add"]),
        ("a.rb", "require 'x'\nclass Dog\n  def bark\n    if a\n      1\n    end\n  end\nend\n\ndef free\n  2\nend\n", ["Dog", "free"]),
        ("a.sh", "x=1\nfoo() {\n  echo '}'\n}\nfunction bar {\n  echo\n}\n", ["foo", "bar"]),
        ("a.js", "import x from 'x'\n// Greets.\nexport async function greet(n) {\n  return `}${n}`\n}\nclass Cat extends Pet {\n  meow() { return '}' }\n}\nexport const later = (n) => {\n  return n\n}\nlet one = 1;\n", ["greet", "Cat", "later", "one"]),
        ("a.php", "<?php\nnamespace A;\n# }\nfunction total(array $x): int\n{\n    return count($x);\n}\nfinal class Cart extends Base\n{\n    public function add() { return \"}\"; }\n}\ninterface Priced {\n    public function price();\n}\ntrait Named { }\n", ["total", "Cart", "Priced", "Named"]),
        ("a.swift", "import UIKit\npublic struct Size {\n    var w: Int\n}\nprotocol Drawn {\n    func draw()\n}\nextension Size: Drawn {\n    func draw() { }\n}\nfunc area(_ s: Size) -> Int {\n    return s.w\n}\nenum Way { case up, down }\n", ["Size", "Drawn", "Size", "area", "Way"]),
        ("a.kt", "package a\ndata class User(val name: String)\n/** Text. */\nfun String.shout(): String {\n    return this + \"}\"\n}\nobject Store {\n    fun open() = 1\n}\ninterface Repo {\n    fun all(): List<User>\n}\nfun <T> first(x: List<T>): T = x[0]\n", ["User", "shout", "Store", "Repo", "first"]),
        ("a.scala", "package a\ncase class Node(id: Int)\nobject Main {\n  def run(): Unit = { }\n}\ntrait Graph {\n  def size: Int\n}\nsealed abstract class Edge {\n  val w = 1\n}\ndef top(x: Int): Int = {\n  x + 1\n}\n", ["Node", "Main", "Graph", "Edge", "top"]),
        ("A.cs", "using System;\npublic static class Tools\n{\n    public static int Twice(int x) { return 2 * x; }\n}\ninternal interface IShelf { }\npublic struct Pos { public int X; }\npublic enum Kind { A, B }\npublic record Pair(int A, int B);\n", ["Tools", "IShelf", "Pos", "Kind", "Pair"]),
        ("a.cpp", "#include <vector>\nclass Heap {\npublic:\n  int top() const { return 1; }\n};\nstruct Item {\n  int w;\n};\nint Heap::size() const\n{\n  return 0;\n}\nstatic std::vector<int> sorted(const std::vector<int>& x) {\n  return x;\n}\n", ["Heap", "Item", "size", "sorted"]),
    ],
)
def test_other_languages(path, source, want):
    assert [c.symbol_name for c in chunks_of(path, source)] == want


def test_fallback_and_blank():
    assert names("config.yaml", "key: value\nfoo: bar\n") == [("", "block")]
    assert names("broken.py", "def f(:\n") == [("", "block")]
    assert chunks_of("a.py", "") == [] and chunks_of("a.py", "   \n  \n  ") == []


def test_large_nodes():
    big = "class Big:\n    size = 1\n\n" + "\n".join(f"    def m{k}(self):\n" + "\n".join(f"        x{i} = {i}" for i in range(40)) + "\n" for k in range(3))
    found = chunks_of("a.py", big)
    assert [(c.symbol_name, c.chunk_type) for c in found] == [("Big", "class"), ("Big.m0", "method"), ("Big.m1", "method"), ("Big.m2", "method")]
    assert "size = 1" in found[0].content and "x5" not in found[0].content and found[0].end_line == big.rstrip("\n").count("\n") + 1
    long = "def f():\n" + "\n".join(f"    x{i} = {i}" for i in range(150))
    assert [(c.start_line, c.end_line, c.symbol_name) for c in chunks_of("a.py", long)] == [(1, 60, "f"), (51, 110, "f"), (101, 151, "f"), (151, 151, "f")]


@pytest.mark.parametrize(
    ("path", "head", "method", "end", "extra"),
    [
        ("a.js", "class Big {", "  m{k}(a, b) {{", "  }", "  size = 1;"),
        ("a.ts", "export class Big {", "  private async m{k}(a: number): Promise<void> {{", "  }", "  size = 1;"),
        ("A.java", "public class Big {", "    public static <T> List<T> m{k}(int a) {{", "    }", "    int size = 1;"),
        ("A.cs", "public sealed class Big {", "    protected override int m{k}(int a) {{", "    }", "    int size = 1;"),
        ("a.php", "final class Big {", "    public static function m{k}($a) {{", "    }", "    private $size = 1;"),
        ("a.swift", "class Big {", "    func m{k}(a: Int) -> Int {{", "    }", "    var size = 1"),
        ("a.kt", "class Big {", "    override fun m{k}(a: Int): Int {{", "    }", "    val size = 1"),
        ("a.scala", "class Big {", "  def m{k}(a: Int): Int = {{", "  }", "  val size = 1"),
        ("a.cpp", "class Big {", "  int m{k}(int a) const {{", "  }", "  int size = 1;"),
        ("a.rs", "impl Big {", "    pub async fn m{k}(&self) -> u8 {{", "    }", "    const SIZE: u8 = 1;"),
        ("a.rb", "class Big", "  def m{k}(a)", "  end", "  size = 1"),
    ],
)
def test_large_containers_are_split(path, head, method, end, extra):
    body = [line for k in range(3) for line in (method.format(k=k), *(f"    x{i} = call({i})" + (";" if not path.endswith((".rb", ".kt", ".scala", ".swift")) else "") for i in range(40)), end, "")]
    source = "\n".join([head, extra, "", *body, "end" if path.endswith(".rb") else "}", ""])
    found = chunks_of(path, source)
    assert [(c.symbol_name, c.chunk_type) for c in found] == [("Big", "class"), ("Big.m0", "method"), ("Big.m1", "method"), ("Big.m2", "method")]
    assert extra in found[0].content and "x5" not in found[0].content and (found[0].start_line, found[0].end_line) == (1, len(source.rstrip("\n").split("\n")))
    for k, c in enumerate(found[1:]):
        assert c.content.startswith(method.format(k=k)) and c.content.endswith(end) and c.content.count("\n") == 41


@pytest.mark.parametrize(
    ("patterns", "path", "want"),
    [
        ("*.md", "main.go", False), ("*.md", "README.md", True), ("*.md", "docs/guide.md", True),
        ("*.md\n!KEEP.md\nvendor/", "KEEP.md", False), ("*.md\n!KEEP.md\nvendor/", "notes.md", True), ("*.md\n!KEEP.md\nvendor/", "vendor/lib.go", True),
        ("/build", "build/x", True), ("/build", "a/build", False), ("a/**/z", "a/z", True), ("a/**/z", "a/b/c/z", True), ("x/**", "x/y", True), ("?.txt", "a.txt", True), ("[!a].txt", "a.txt", False),
        ("", "node_modules/a.js", True), ("", "src/app.pyc", True), ("", "src/app.py", False), ("# no\n\n", "no", False),
    ],
)
def test_rules(patterns, path, want):
    assert IgnoreSpec(Rule(p) for p in parse(patterns)).ignores(path) is want


def test_nested_files(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".gitignore").write_text("*.log\n")
    (tmp_path / "sub/.gitignore").write_text("!keep.log\n*.tmp\n")
    spec = build(str(tmp_path))
    assert spec.ignores("a.log") and not spec.ignores("sub/keep.log") and spec.ignores("sub/d/x.tmp") and not spec.ignores("x.tmp")
