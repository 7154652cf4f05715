"""Command line: serve, index, search, save, status, list, info, remove, rebuild, prune, doctor."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence

from quern.serve import serve

COMMANDS = ("serve", "index", "search", "save", "status", "list", "info", "remove", "forget", "rebuild", "prune", "doctor", "check", "help")


class _Parser(argparse.ArgumentParser):
    pass


def _parser(command: str) -> argparse.ArgumentParser:
    p = _Parser(prog=f"quern {command}")
    flag = lambda *names: p.add_argument(*names, action="store_true")
    if command in ("index", "info", "remove", "forget", "rebuild"):
        p.add_argument("root", nargs="?")
    if command == "index":
        flag("--reembed")
    if command == "rebuild":
        flag("--reembed")
        flag("--yes")
    if command in ("remove", "forget"):
        flag("--yes")
    if command == "prune":
        flag("--purge")
        flag("--yes")
    if command in ("search", "save"):
        p.add_argument("query", nargs="?")
        p.add_argument("--limit", type=int)
        p.add_argument("--codebase")
        flag("--all")
    if command == "search":
        p.add_argument("--area")
        p.add_argument("--language")
        p.add_argument("--type")
        flag("--verbose")
    if command == "save":
        p.add_argument("--output", default=".")
        p.add_argument("--title", default="")
        p.add_argument("--notes", default="")
    if command == "list":
        flag("--all")
    if command in ("list", "info", "search", "status", "doctor", "check"):
        flag("--json")
    return p


def confirmed(question: str) -> bool:
    """Only y or yes; no answer is no."""
    try:
        return input(f"{question} [y/N] ").strip().lower() in ("y", "yes")
    except EOFError:
        return False


def _engine():  # noqa: ANN202
    from pyspark.sql import SparkSession

    from quern.config import Config
    from quern.engine import Engine
    from quern.operators.embed import HashingEmbedder

    builder = SparkSession.builder.appName("quern").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    spark = (builder if "SPARK_MASTER" not in os.environ else builder.master(os.environ["SPARK_MASTER"])).getOrCreate()
    config = Config()
    own = HashingEmbedder(dims=config.dims) if config.model == "hashing" else None
    return Engine(spark, config, own, progress=lambda m: print(m, file=sys.stderr))


def _print(rows: list[dict] | dict, as_json: bool) -> None:
    if as_json:
        print(json.dumps(rows, indent=2, default=str))
        return
    for r in rows if isinstance(rows, list) else [rows]:
        print("  ".join(f"{k}={v}" for k, v in r.items()))


def run(engine, command: str, a: argparse.Namespace) -> int:  # noqa: ANN001
    if command == "serve":
        serve(engine)
    elif command == "index":
        result = engine.rebuild(a.root or ".", reembed=True) if a.reembed else engine.index(a.root or ".")
        for e in result.errors:
            print(f"{e['file']}: {e['error']}", file=sys.stderr)
        return int(bool(result.errors) and not result.files_processed)
    elif command == "search":
        found = engine.search(a.query, a.limit, codebase=a.codebase, all_=a.all, area=a.area, language=a.language, chunk_type=a.type, verbose=a.verbose)
        _print([r.asDict() for r in found.collect()], a.json)
    elif command == "save":
        print(engine.save_search(a.query, a.output, a.limit, codebase=a.codebase, all_=a.all, title=a.title, notes=a.notes))
    elif command == "status":
        _print(engine.status(), a.json)
    elif command == "list":
        _print(engine.list(a.all), a.json)
    elif command == "info":
        _print(engine.info(a.root), a.json)
    elif command in ("remove", "forget"):
        if a.yes or confirmed(f"Remove {a.root}?"):
            engine.deprecate(a.root)
    elif command == "rebuild":
        if a.yes or confirmed(f"Rebuild {a.root}?"):
            engine.rebuild(a.root, a.reembed)
    elif command == "prune":
        _print(engine.prune(), False)
        if a.purge and (a.yes or confirmed("Delete all deprecated data?")):
            print(f"purged {engine.purge()}")
    else:
        found = engine.doctor()
        _print(found, a.json)
        return int(any(x["status"] == "fail" for x in found))
    return 0


def main(argv: Sequence[str] | None = None, engine=None) -> int:  # noqa: ANN001
    """Exit code: 0 done, 1 failed, 2 not understood."""
    argv = list(sys.argv[1:] if argv is None else argv)
    if not argv or argv[0] in ("help", "-h", "--help"):
        print("usage: quern COMMAND ...\ncommands: " + ", ".join(COMMANDS))
        return 0
    command, rest = argv[0], argv[1:]
    if command not in COMMANDS:
        print(f"unknown command: {command}", file=sys.stderr)
        return 2
    try:
        a = _parser(command).parse_intermixed_args(rest)
    except SystemExit as e:
        return int(e.code or 0)
    lacking = "root" if command in ("info", "remove", "forget", "rebuild") and not a.root else "query" if command in ("search", "save") and not a.query else ""
    if lacking:
        print(f"{command}: {lacking} is missing", file=sys.stderr)
        return 1
    try:
        return run(engine or _engine(), command, a)
    except (LookupError, OSError, ValueError) as e:
        print(str(e), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
