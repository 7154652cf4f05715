"""Which paths of a tree are left out, with the rules of gitignore files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

# Always left out.
BUILT_IN = [
    ".git/", "node_modules/", "__pycache__/", ".venv/", "venv/", ".env",
    "*.pyc", "*.pyo", "*.so", "*.dylib", "*.dll", "*.exe", "*.lock",
    "package-lock.json", "yarn.lock", ".gitignore", ".codesearchignore",
]
#: Of one folder, the later file wins.
IGNORE_FILES = (".gitignore", ".codesearchignore")


def parse(content: str) -> list[str]:
    """Patterns of an ignore file: no blank lines, no comments."""
    lines = (x.strip() for x in content.split("\n"))
    return [x for x in lines if x and not x.startswith("#")]


def _regex(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob[i:] == "**" and i and glob[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif c == "*":
            while glob.startswith("*", i):
                i += 1
            out += "[^/]*"
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


class Rule:
    """One pattern of the ignore file of a folder (relative to the root, "" for the root)."""

    def __init__(self, pattern: str, folder: str = "") -> None:
        self.keeps = pattern.startswith("!")
        pattern = pattern[1:] if self.keeps else pattern
        self.dirs_only = pattern.endswith("/")
        pattern = pattern.rstrip("/")
        anchored = "/" in pattern
        pattern = pattern.lstrip("/")
        prefix = re.escape(folder + "/") if folder else ""
        self.regex = re.compile("^" + prefix + ("" if anchored else "(?:.*/)?") + _regex(pattern) + "$", re.DOTALL)

    def matches(self, path: str, is_dir: bool) -> bool:
        return (is_dir or not self.dirs_only) and self.regex.match(path) is not None


class IgnoreSpec:
    """The last rule that matches decides; nothing below a folder that is left out comes back."""

    def __init__(self, rules: Iterable[Rule] = ()) -> None:
        self.rules = [*(Rule(p) for p in BUILT_IN), *rules]

    def _decided(self, path: str, is_dir: bool) -> bool:
        for rule in reversed(self.rules):
            if rule.matches(path, is_dir):
                return not rule.keeps
        return False

    def ignores(self, path: str, is_dir: bool = False) -> bool:
        """path: relative to the root, with slashes."""
        parts = path.strip("/").split("/")
        if parts[0] in ("..", ""):
            return False
        return any(self._decided("/".join(parts[:k]), True) for k in range(1, len(parts))) or self._decided("/".join(parts), is_dir)


    def within(self, path: str, folder: str, names: Iterable[str]) -> IgnoreSpec:
        """The rules that hold in a folder (relative to the root) at a path with those names: its own ignore files' come last."""
        new = []
        for name in IGNORE_FILES:
            if name in names:
                try:
                    with open(os.path.join(path, name), encoding="utf-8", errors="replace") as f:
                        new += [Rule(p, folder) for p in parse(f.read())]
                except OSError:
                    continue
        if not new:
            return self
        out = IgnoreSpec()
        out.rules = [*self.rules, *new]
        return out


def build(root: str) -> IgnoreSpec:
    """The rules of all ignore files of a tree in one; those of a folder hold below it and come after its parents'."""
    spec = IgnoreSpec()
    for path, names, files in os.walk(root):
        rel = "" if path == root else os.path.relpath(path, root).replace(os.sep, "/")
        spec = spec.within(path, rel, files)
        names[:] = sorted(n for n in names if not spec.ignores(f"{rel}/{n}" if rel else n, True))
    return spec
