"""Files cut into chunks: by syntax where a language is known, by lines else.

Python goes through its own parser; languages with braces, Ruby and shell
through a scanner that knows strings and comments. What can't be parsed, or has
no chunk at the top level, falls back to overlapping windows of lines.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text
from quern.functions.text import OVERLAP_LINES, WINDOW_LINES

MAX_NODE_LINES = 100
CHUNK_SCHEMA = "array<struct<start_line:int,end_line:int,chunk_type:string,symbol_name:string,content:string>>"


@dataclass
class Chunk:
    start_line: int
    end_line: int
    chunk_type: str
    symbol_name: str
    content: str


@dataclass
class Node:
    """A definition: its lines (from 1), type and name; members are the methods of a container."""

    start: int
    end: int
    kind: str
    name: str
    members: list[Node] | None = None


def windows(lines: list[str], offset: int = 0, kind: str = "block", name: str = "") -> list[Chunk]:
    step = WINDOW_LINES - OVERLAP_LINES
    return [Chunk(offset + s + 1, offset + min(s + WINDOW_LINES, len(lines)), kind, name, "\n".join(lines[s : s + WINDOW_LINES])) for s in range(0, len(lines), step)]


def _python(source: str) -> list[Node]:
    def node(x: ast.stmt) -> Node | None:
        if not isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            return None
        start = min([x.lineno, *(d.lineno for d in x.decorator_list)])
        is_class = isinstance(x, ast.ClassDef)
        members = [m for m in map(node, x.body) if m and m.kind == "function"] if is_class else None
        return Node(start, x.end_lineno or x.lineno, "class" if is_class else "function", x.name, members)

    return [n for n in map(node, ast.parse(source).body) if n]


_W = r"[A-Za-z_$][\w$]*"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|virtual|override|async|export|default|declare|pub(?:\([^)]*\))?|unsafe|extern|open|data|inline|const|readonly|synchronized|fileprivate|mutating)\s+)*"
#: Per language: (pattern of a definition's first line, type). The name is the group.
_RULES: dict[str, list[tuple[str, str]]] = {
    "go": [(rf"func\s*\(\s*(?:\w+\s+)?\*?\s*(?P<recv>\w+)(?:\[[^\]]*\])?\s*\)\s*(?P<name>\w+)", "method"), (r"func\s+(?P<name>\w+)", "function"), (r"type\s*\(?\s*(?P<name>\w+)?", "class")],
    "javascript": [(rf"{_MODS}function\s*\*?\s*(?P<name>{_W})", "function"), (rf"{_MODS}class\s+(?P<name>{_W})", "class"), (rf"(?:export\s+)?(?:const|let)\s+(?P<name>{_W})", "function")],
    "rust": [(rf"{_MODS}(?:fn)\s+(?P<name>\w+)", "function"), (rf"{_MODS}(?:struct|enum|trait)\s+(?P<name>\w+)", "class"), (r"(?:unsafe\s+)?impl\b(?:<[^>]*>)?\s+(?:[\w:<>,&' ]+\s+for\s+)?(?P<name>\w+)", "class")],
    "java": [(rf"{_MODS}(?:class|interface|enum|record)\s+(?P<name>{_W})", "class")],
    "csharp": [(rf"{_MODS}(?:class|interface|struct|enum|record)\s+(?P<name>{_W})", "class")],
    "c": [(r"(?:typedef\s+)?(?:struct|enum|union)\s+(?P<name>\w+)\s*(?=\{|$)", "class"), (r"(?!(?:if|for|while|switch|return|else|do)\b)[A-Za-z_][\w\s\*]*?[\s\*](?P<name>\w+)\s*\([^;]*$", "function")],
    "php": [(rf"{_MODS}function\s+&?(?P<name>\w+)", "function"), (rf"{_MODS}(?:class|interface|trait)\s+(?P<name>\w+)", "class")],
    "swift": [(rf"{_MODS}func\s+(?P<name>\w+)", "function"), (rf"{_MODS}(?:class|struct|protocol|enum|extension)\s+(?P<name>\w+)", "class")],
    "kotlin": [(rf"{_MODS}fun\s+(?:<[^>]*>\s*)?(?:[\w<>]+\.)?(?P<name>\w+)", "function"), (rf"{_MODS}(?:class|interface|object)\s+(?P<name>\w+)", "class")],
    "scala": [(rf"{_MODS}def\s+(?P<name>\w+)", "function"), (rf"{_MODS}(?:case\s+)?(?:class|object|trait)\s+(?P<name>\w+)", "class")],
    "shell": [(r"(?:function\s+)(?P<name>[\w-]+)", "function"), (r"(?P<name>[\w-]+)\s*\(\)", "function")],
    "ruby": [(r"def\s+(?:self\.)?(?P<name>[\w?!=]+)", "function"), (r"(?:class|module)\s+(?P<name>[\w:]+)", "class")],
}
_RULES["typescript"] = [*_RULES["javascript"], (rf"{_MODS}interface\s+(?P<name>{_W})", "class"), (rf"{_MODS}type\s+(?P<name>{_W})", "class"), (rf"{_MODS}enum\s+(?P<name>{_W})", "class")]
_RULES["cpp"] = [
    (r"(?:template\s*<[^{;]*>\s*)?class\s+(?P<name>\w+)", "class"), *_RULES["c"],
    (r"(?!(?:if|for|while|switch|return|else|do|using|namespace)\b)[A-Za-z_][\w\s*&:<>,~]*?[\s*&:](?P<name>~?\w+)\s*\([^;]*$", "function"),
]
_METHOD = {
    "javascript": rf"{_MODS}(?:get\s+|set\s+|\*\s*)?(?P<name>{_W})\s*\([^)]*\)[^;=]*\{{", "java": rf"{_MODS}(?:<[^>]*>\s*)?(?:[\w<>\[\],.? ]+\s+)?(?P<name>{_W})\s*\([^)]*\)[^;=]*\{{",
    "rust": r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(?P<name>\w+)", "php": rf"{_MODS}function\s+&?(?P<name>\w+)", "swift": rf"{_MODS}(?:func\s+(?P<name>\w+)|(?P<init>init)\b)",
    "cpp": r"(?!(?:if|for|while|switch|return|else|do)\b)[\w:<>&\*\s~]*?(?P<name>~?\w+)\s*\([^;]*\)[^;]*\{", "kotlin": rf"{_MODS}fun\s+(?P<name>\w+)", "scala": rf"{_MODS}def\s+(?P<name>\w+)", "ruby": r"def\s+(?:self\.)?(?P<name>[\w?!=]+)",
}
_METHOD["typescript"] = _METHOD["javascript"]
_METHOD["csharp"] = _METHOD["java"]
_CONTAINERS = {"javascript", "typescript", "rust", "java", "csharp", "cpp", "ruby", "php", "swift", "kotlin", "scala"}
_LINE_COMMENT = {"python": "#", "shell": "#", "ruby": "#", "php": "//"}


def _bare(source: str, language: str) -> list[str]:
    """Lines with the contents of strings and comments blanked."""
    hashes = language in ("shell", "ruby")
    out, i, n = [], 0, len(source)
    while i < n:
        c = source[i]
        if (hashes and c == "#") or (not hashes and source.startswith("//", i)) or (language == "php" and c == "#"):
            end = source.find("\n", i)
            end = n if end < 0 else end
            out.append(" " * (end - i))
            i = end
        elif not hashes and source.startswith("/*", i):
            end = source.find("*/", i + 2)
            end = n if end < 0 else end + 2
            out.append(re.sub(r"[^\n]", " ", source[i:end]))
            i = end
        elif c in "\"'`" and not (c == "'" and language == "rust" and not re.match(r"'(\\.|[^\\'])'", source[i:])) and not (c == "`" and language in ("shell", "ruby", "java", "c", "cpp")):
            j = i + 1
            while j < n and source[j] != c and (source[j] != "\n" or c == "`"):
                j += 2 if source[j] == "\\" and not (c == "`" and language == "go") else 1
            j = min(j + 1, n)
            out.append(re.sub(r"[^\n]", " ", source[i:j]))
            i = j
        else:
            out.append(c)
            i += 1
    return "".join(out).split("\n")


_OPENS = re.compile(r"^\s*(?:def|class|module|if|unless|case|while|until|for|begin)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$")


def _depths(bare: list[str], language: str) -> list[int]:
    """Depth of nesting at the start of each line, and after the last."""
    depth, out = 0, [0]
    for line in bare:
        if language == "ruby":
            depth += bool(_OPENS.search(line)) and not re.search(r"\bend\s*$", line)
            depth -= bool(re.match(r"\s*end\b", line))
        else:
            depth += line.count("{") + line.count("(") - line.count("}") - line.count(")")
        out.append(max(depth, 0))
        depth = max(depth, 0)
    return out


def _end(bare: list[str], depths: list[int], start: int, language: str) -> int:
    """Last line (index) of the definition that starts there."""
    base, opened = depths[start], False
    for k in range(start, len(bare)):
        opened = opened or "{" in bare[k] or language == "ruby" and depths[k + 1] > base
        if depths[k + 1] <= base and (opened or bare[k].rstrip().endswith((";", ")")) or k > start and not bare[k].strip()):
            return k
        if depths[k + 1] <= base and not opened and (k + 1 >= len(bare) or "{" not in bare[k + 1] and not re.match(r"\s*[.|&=?:]", bare[k + 1])):
            return k
    return len(bare) - 1


def _scanned(source: str, language: str) -> list[Node]:
    bare = _bare(source, language)
    depths = _depths(bare, language)
    rules = [(re.compile(r"^\s*" + p), kind) for p, kind in _RULES[language]]
    method = re.compile(r"^\s*" + _METHOD[language]) if language in _METHOD else None
    out, k = [], 0
    while k < len(bare):
        found = next(((m, kind) for p, kind in rules if depths[k] == 0 and (m := p.match(bare[k]))), None)
        if not found:
            k += 1
            continue
        m, kind = found
        end, g = _end(bare, depths, k, language), m.groupdict()
        name = g.get("name") or ""
        if g.get("recv"):
            name = f"{g['recv']}.{name}"
        if not name and language == "go":
            inner = re.search(r"(\w+)", " ".join(bare[k + 1 : end + 1]))
            name = inner.group(1) if inner else ""
        members = None
        if kind == "class" and language in _CONTAINERS and method:
            members, j = [], k + 1
            while j < end:
                mm = method.match(bare[j]) if depths[j] == depths[k] + 1 else None
                if mm and (title := next((v for v in mm.groupdict().values() if v), "")) not in ("if", "for", "while", "switch", "catch", "return"):
                    last = min(_end(bare, depths, j, language), end)
                    members.append(Node(j + 1, last + 1, "function", title))
                    j = last + 1
                else:
                    j += 1
        out.append(Node(k + 1, end + 1, kind, name, members))
        k = end + 1
    return out


def _with_comment(lines: list[str], bare_start: int, floor: int, language: str) -> int:
    """First line of the comment above a definition, with at most one blank line between."""
    start, k, blanks = bare_start, bare_start - 1, 0
    while k > floor:
        s = lines[k - 1].strip()
        if not s:
            blanks += 1
            if blanks > 1:
                break
        elif s.startswith(("//", "#", "/*", "*", "--")) or s.endswith("*/"):
            start, blanks = k, 0
        else:
            break
        k -= 1
    return start


def parse(source: str, language: str) -> list[Chunk]:
    """Chunks of the definitions at the top level; imports, globals and the module's docstring belong to none."""
    nodes = _python(source) if language == "python" else _scanned(source, language)
    lines, out, floor = source.split("\n"), [], 0
    for node in nodes:
        start = _with_comment(lines, node.start, floor, language)
        floor = node.end
        if node.end - start + 1 <= MAX_NODE_LINES:
            out.append(Chunk(start, node.end, node.kind, node.name, "\n".join(lines[start - 1 : node.end])))
        elif node.members:
            covered = set()
            for m in node.members:
                covered.update(range(m.start, m.end + 1))
            signature = "\n".join(lines[k - 1] for k in range(start, node.end + 1) if k not in covered)
            out.append(Chunk(start, node.end, node.kind, node.name, signature))
            for m in node.members:
                part, name = lines[m.start - 1 : m.end], f"{node.name}.{m.name}"
                out += [Chunk(m.start, m.end, "method", name, "\n".join(part))] if len(part) <= MAX_NODE_LINES else windows(part, m.start - 1, "method", name)
        else:
            out += windows(lines[start - 1 : node.end], start - 1, node.kind, node.name)
    return out


def chunks_of(path: str, source: str) -> list[Chunk]:
    ext = re.search(r"(\.[^./]*)$", path.lower())
    language = text.LANGUAGES.get(ext.group(1), "") if ext else ""
    if not source.strip():
        return []
    if language == "python" or language in _RULES:
        try:
            found = parse(source, language)
        except (SyntaxError, ValueError, RecursionError):
            found = []
        if found:
            return found
    return windows(source.split("\n"))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start_line", pa.int32()), ("end_line", pa.int32()), ("chunk_type", pa.string()), ("symbol_name", pa.string()), ("content", pa.string())]))
    for batch in batches:
        out = [[vars(c) for c in chunks_of(p, t or "")] for p, t in zip(batch.column("file_path").to_pylist(), batch.column("content").to_pylist(), strict=True)]
        names = [n for n in batch.schema.names if n != "content"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, kind)], names=[*names, "chunks"])


def chunked(files: DataFrame) -> DataFrame:
    """A row per chunk of files (file_path, content, ...): the other columns, language, chunk_index, and the chunk. Other languages than those parsed never leave the JVM."""
    keep = [c for c in files.columns if c != "content"]
    files = files.withColumn("language", text.detect_language("file_path"))
    parsed = F.col("language").isin("python", *_RULES)
    schema = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in [*keep, "language"])
    by_syntax = files.filter(parsed).select(*keep, "language", "content").mapInArrow(_run, f"{schema}, chunks {CHUNK_SCHEMA}")
    by_lines = files.filter(~parsed).select(
        *keep, "language", F.transform(text.line_windows("content"), lambda c: F.struct(c["start_line"].alias("start_line"), c["end_line"].alias("end_line"), F.lit("block").alias("chunk_type"), F.lit("").alias("symbol_name"), c["content"].alias("content"))).alias("chunks")
    )
    both = by_syntax.unionByName(by_lines)
    out = both.select(*keep, "language", F.posexplode_outer("chunks").alias("chunk_index", "c")).filter("c is not null")
    return out.select(*keep, "language", F.col("chunk_index").cast("int").alias("chunk_index"), "c.*")
