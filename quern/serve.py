"""Serve mode: the engine's tools over standard input and output, one JSON-RPC 2.0 message a line (the Model Context Protocol's stdio form)."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import TextIO

PROTOCOL = "2024-11-05"
_TEXT, _NUMBER, _FLAG = "string", "number", "boolean"
#: Tool: (what it does, arguments with their types, those that must be there).
TOOLS: dict[str, tuple[str, dict[str, str], tuple[str, ...]]] = {
    "index_codebase": ("Index what has changed below a folder.", {"directory": _TEXT}, ("directory",)),
    "search_code": (
        "Find the chunks nearest to a description in words.",
        {"query": _TEXT, "limit": _NUMBER, "codebase": _TEXT, "all": _FLAG, "verbose": _FLAG, "area": _TEXT},
        ("query",),
    ),
    "save_search_markdown": (
        "Search, and write the hits as a Markdown file.",
        {"query": _TEXT, "output_path": _TEXT, "limit": _NUMBER, "codebase": _TEXT, "all": _FLAG, "title": _TEXT, "notes": _TEXT},
        ("query", "output_path"),
    ),
    "index_status": ("Totals, the codebases and the last run.", {}, ()),
}


def _taken(name: str, given: dict) -> dict:
    """Arguments of the right type; the others count as not given. One that must be there and isn't is an error."""
    kinds = {_TEXT: str, _NUMBER: (int, float), _FLAG: bool}
    out = {k: given[k] for k, kind in TOOLS[name][1].items() if isinstance(given.get(k), kinds[kind]) and (kind != _NUMBER or not isinstance(given[k], bool))}
    for k in TOOLS[name][2]:
        if not out.get(k):
            raise ValueError(f"{name} needs {k}")
    return out


def call(engine, name: str, given: dict) -> str:  # noqa: ANN001
    """The text that a tool answers with."""
    if name not in TOOLS:
        raise LookupError(f"there is no tool {name}")
    a = _taken(name, given)
    where = {"codebase": a.get("codebase") or None, "all_": a.get("all", False)}
    if name == "index_codebase":
        r = engine.index(a["directory"])
        steps = " ".join(f"{k}={v:.1f}s" for k, v in r.seconds.items())
        return f"{r.files_processed} files and {r.chunks_created} chunks indexed, {r.files_skipped} files unchanged, {len(r.errors)} errors; {steps}"
    if name == "search_code":
        found = engine.search(a["query"], a.get("limit"), area=a.get("area") or None, verbose=a.get("verbose", False), **where)
        return json.dumps([r.asDict() for r in found.collect()], ensure_ascii=False)
    if name == "save_search_markdown":
        return "saved as " + engine.save_search(a["query"], a["output_path"], a.get("limit"), title=a.get("title", ""), notes=a.get("notes", ""), **where)
    return json.dumps(engine.status(), default=str, ensure_ascii=False)


def _listed() -> list[dict]:
    return [{"name": n, "description": what, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in args.items()}, "required": list(needed)}} for n, (what, args, needed) in TOOLS.items()]


def answer(engine, message: object, say: Callable[[dict], None]) -> None:  # noqa: ANN001
    """Handles one message; say() is given what goes back. A notification gets no answer."""
    if not isinstance(message, dict) or not isinstance(message.get("method"), str):
        say({"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not a request"}})
        return
    method, given = message["method"], message.get("params") if isinstance(message.get("params"), dict) else {}
    if "id" not in message:
        return
    if method == "initialize":
        result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}, "logging": {}}, "serverInfo": {"name": "quern", "version": "1"}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": _listed()}
    elif method == "tools/call":
        was = getattr(engine, "progress", None)
        engine.progress = lambda m: say({"jsonrpc": "2.0", "method": "notifications/message", "params": {"level": "info", "logger": "index", "data": m}})
        try:
            result = {"content": [{"type": "text", "text": call(engine, str(given.get("name")), given.get("arguments") or {})}], "isError": False}
        except Exception as e:  # noqa: BLE001
            result = {"content": [{"type": "text", "text": f"{type(e).__name__}: {e}"}], "isError": True}
        finally:
            engine.progress = was
    else:
        say({"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32601, "message": f"no method {method}"}})
        return
    say({"jsonrpc": "2.0", "id": message["id"], "result": result})


def serve(engine, lines: TextIO | None = None, out: TextIO | None = None) -> None:  # noqa: ANN001
    """Until the input ends."""
    out = out or sys.stdout

    def say(x: dict) -> None:
        out.write(json.dumps(x, ensure_ascii=False) + "\n")
        out.flush()

    for line in lines or sys.stdin:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            say({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}})
            continue
        answer(engine, message, say)
