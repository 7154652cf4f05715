"""Scalar text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extension to language.
LANGUAGES = {
    ".py": "python",
    ".js": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".tsx": "typescript",
    ".java": "java",
    ".go": "go",
    ".rs": "rust",
    ".c": "c", ".h": "c",
    ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp",
    ".rb": "ruby",
    ".php": "php",
    ".swift": "swift",
    ".kt": "kotlin",
    ".scala": "scala",
    ".cs": "csharp",
    ".sh": "shell", ".bash": "shell", ".zsh": "shell",
    ".sql": "sql",
    ".md": "markdown",
    ".yaml": "yaml", ".yml": "yaml",
    ".json": "json",
    ".toml": "toml",
    ".xml": "xml",
    ".html": "html", ".htm": "html",
    ".css": "css", ".scss": "scss", ".less": "less",
}
# File extension to the hint of a fenced code block.
FENCES = {
    "go": "go", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust", "java": "java",
    "rb": "ruby", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "sh": "bash", "bash": "bash",
}
# Extensions of files that aren't text.
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp",
    ".pdf", ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar",
    ".exe", ".dll", ".so", ".dylib", ".bin",
    ".woff", ".woff2", ".ttf", ".eot", ".otf",
    ".mp3", ".mp4", ".wav", ".avi", ".mov", ".flv",
    ".o", ".a", ".lib", ".class", ".jar",
    ".sqlite", ".db",
]
WINDOW_LINES, OVERLAP_LINES = 60, 10
EMBED_BYTES, VERBOSE_BYTES = 30_000, 500


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _fixed(x: Column, places: int) -> Column:
    """So many decimals, ties to the even digit, no grouping."""
    return F.call_function("format_number", x, F.lit("0." + "0" * places))


def extension(path: Column | str) -> Column:
    """The lower-cased extension with its dot, or ""."""
    return F.regexp_extract(F.lower(_col(path)), "(\\.[^./]*)$", 1)


def _mapped(key: Column, table: dict[str, str]) -> Column:
    by_value: dict[str, list[str]] = {}
    for k, v in table.items():
        by_value.setdefault(v, []).append(k)
    out = F.when(F.lit(False), "")
    for v, keys in by_value.items():
        out = out.when(key.isin(keys), v)
    return out.otherwise("")


def detect_language(path: Column | str) -> Column:
    return _mapped(extension(path), LANGUAGES)


def fence_language(path: Column | str) -> Column:
    return _mapped(F.regexp_replace(extension(path), "^\\.", ""), FENCES)


def is_binary(path: Column | str) -> Column:
    return extension(path).isin(BINARY_EXTENSIONS)


def within_size(content: Column | str, most_kb: int) -> Column:
    """Not larger, in bytes; the limit itself is within."""
    return F.octet_length(_col(content)) <= most_kb * 1024


def content_hash(content: Column | str) -> Column:
    return F.sha2(_col(content), 256)


def is_blank(text: Column | str) -> Column:
    """No character but white space, in the Unicode sense."""
    return _col(text).rlike("(?U)^\\s*$")


def lines_of(text: Column | str) -> Column:
    """Lines; a trailing line end adds an empty one."""
    return F.split(_col(text), "\n", -1)


def join_lines(lines: Column | str, start: Column | int, end: Column | int) -> Column:
    """Lines start to end, from 1 and inclusive, both cut to what there is."""
    lines = _col(lines)
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    first, last = F.greatest(start, F.lit(1)), F.least(end, F.size(lines))
    return F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")


def line_windows(text: Column | str, window: int = WINDOW_LINES, overlap: int = OVERLAP_LINES, offset: Column | int = 0) -> Column:
    """Array of (chunk_index, start_line, end_line, content), overlapping windows of lines; none of a blank text."""
    lines = lines_of(text)
    n = F.size(lines)
    offset = F.lit(offset) if isinstance(offset, int) else offset
    step = window - overlap
    starts = F.sequence(F.lit(0), n - 1, F.lit(step))
    one = lambda s, i: F.struct(
        i.alias("chunk_index"),
        (s + 1 + offset).cast("int").alias("start_line"),
        (F.least(s + window, n) + offset).cast("int").alias("end_line"),
        F.array_join(F.slice(lines, s + 1, F.lit(window)), "\n").alias("content"),
    )
    return F.when(is_blank(text), F.array().cast("array<struct<chunk_index:int,start_line:int,end_line:int,content:string>>")).otherwise(F.transform(starts, one))


def embedding_text(path: Column | str, language: Column | str, symbol: Column | str, kind: Column | str, start: Column | str, end: Column | str, content: Column | str) -> Column:
    """What is embedded for a chunk: a header and its content."""
    path, language, symbol, kind, start, end, content = (_col(c) for c in (path, language, symbol, kind, start, end, content))
    named = F.when(F.coalesce(symbol, F.lit("")) != "", F.concat(F.lit("# Symbol: "), symbol, F.lit(" ("), kind, F.lit(")\n"))).otherwise("")
    known = F.when(F.coalesce(language, F.lit("")) == "", "unknown").otherwise(language)
    return F.concat(F.lit("# File: "), path, F.lit("\n# Language: "), known, F.lit("\n"), named, F.lit("# Lines: "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("\n\n"), content)


def cut_bytes(text: Column | str, most: int) -> Column:
    """At most so many UTF-8 bytes; a character cut in two becomes U+FFFD."""
    text = _col(text)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string")))


def snippet_preview(text: Column | str, max_lines: int = 3, max_chars: int = 160) -> Column:
    """The first lines without the indent they share, at most so many characters, and an ellipsis if anything was cut."""
    lines = lines_of(text)
    kept = F.slice(lines, 1, max_lines)
    indent = lambda x: F.length(F.regexp_extract(x, "^([ \\t]*)", 1))
    shared = F.coalesce(F.array_min(F.transform(F.filter(kept, lambda x: ~is_blank(x)), indent)), F.lit(0))
    bare = F.transform(kept, lambda x: F.when(F.length(x) >= shared, F.substring(x, shared + 1, F.length(x))).otherwise(F.regexp_replace(x, "^[ \\t]+", "")))
    out = F.array_join(F.when(shared > 0, bare).otherwise(kept), "\n")
    long = F.length(out) > max_chars if max_chars > 0 else F.lit(False)
    return F.concat(F.substring(out, 1, max_chars) if max_chars > 0 else out, F.when((F.size(lines) > max_lines) | long, "…").otherwise(""))


def slugify(text: Column | str) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", "-"), "^-|-$", "")
    slug = F.when(F.length(slug) > 60, F.regexp_replace(F.substring(slug, 1, 60), "^-+|-+$", "")).otherwise(slug)
    return F.when(slug == "", "search").otherwise(slug)


def markdown_path(output: Column | str, query: Column | str) -> Column:
    output = _col(output)
    folder = F.regexp_replace(output, "/+$", "")
    return F.when(F.lower(output).endswith(".md"), output).otherwise(F.concat(folder, F.lit("/"), slugify(query), F.lit(".md")))


def human_size(n: Column | str) -> Column:
    n = _col(n).cast("long")
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit("B")))
    for k, unit in enumerate("KMGTP", 1):
        out = out.when(n < 1024 ** (k + 1), F.concat(_fixed(n / F.lit(float(1024**k)), 1), F.lit(f"{unit}B")))
    return out.otherwise(F.concat(_fixed(n / F.lit(float(1024**6)), 1), F.lit("EB")))


def base_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def storage_name(root: Column | str) -> Column:
    """The deterministic name of a codebase's storage: a slug of its last part and eight digits of a digest of its path."""
    root = _col(root)
    slug = F.regexp_replace(base_name(root), "[^a-zA-Z0-9._-]+", "-")
    return F.concat(F.when(slug.isin("", "-"), "codebase").otherwise(slug), F.lit("-"), F.substring(F.sha2(root, 256), 1, 8))


def archive_name(name: Column | str, model: Column | str, unix: Column | str) -> Column:
    slug = F.regexp_replace(_col(model), "[^a-zA-Z0-9._-]+", "-")
    return F.concat(_col(name), F.lit("-deprecated-"), F.when(slug == "", "unknown").otherwise(slug), F.lit("-"), _col(unix).cast("string"))


def markdown_hit(path: Column | str, start: Column | str, end: Column | str, score: Column | str, symbol: Column | str, kind: Column | str, snippet: Column | str) -> Column:
    """One hit of a saved search: a linked heading, its facts and the fenced snippet."""
    path, start, end, score, symbol, kind, snippet = (_col(c) for c in (path, start, end, score, symbol, kind, snippet))
    a, z = start.cast("string"), end.cast("string")
    shown = F.when(F.coalesce(symbol, F.lit("")) == "", "—").otherwise(symbol)
    head = F.concat(F.lit("\n### ["), path, F.lit(":"), a, F.lit("-"), z, F.lit("]("), path, F.lit("#L"), a, F.lit("-L"), z, F.lit(")\n\n"))
    facts = F.concat(F.lit("Score: "), _fixed(score, 4), F.lit(" · Symbol: "), shown, F.lit(" · Type: "), kind, F.lit("\n\n"))
    return F.concat(head, facts, F.lit("```"), fence_language(path), F.lit("\n"), F.regexp_replace(snippet, "\n+$", ""), F.lit("\n```\n"))
