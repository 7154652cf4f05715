"""The engine: index directory trees, search them, and keep the registry.

Tables live in a warehouse folder as Parquet, files and chunks partitioned by
codebase and generation, so that a search opens only its codebases. A run appends
a generation with what has changed (files written anew, and marks for those that are
gone) and then moves one pointer, the registry; a run that dies leaves the old
generations in place, and one that finds nothing changed writes none. Of a file, its
latest generation counts: a join of the chunks with the latest (file, generation), left out
where there is only one. Many generations are compacted into one. Nothing that is
being read is overwritten, and all of it goes through Spark's file system.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quern import schema
from quern.config import Config
from quern.functions import text
from quern.functions.report import render
from quern.operators import chunk, embed, knn, registry, tables
from quern.sources import codebase as source
from quern.sources.store import Store

#: Generations of a codebase beyond which a run writes them as one; versions of the registry that are kept.
GENERATIONS, VERSIONS = 8, 5
SEARCH_LIMIT, SAVE_LIMIT = 6, 10


@dataclass
class IndexResult:
    files_processed: int = 0
    files_skipped: int = 0
    chunks_created: int = 0
    errors: list[dict] = field(default_factory=list)
    seconds: dict[str, float] = field(default_factory=dict)


def checked_limit(limit: object, default: int) -> int:
    """A whole number of at least 1, else the default."""
    return int(limit) if isinstance(limit, (int, float)) and not isinstance(limit, bool) and limit >= 1 else default


class Engine:
    def __init__(self, spark: SparkSession, config: Config | None = None, embedder: embed.Embedder | None = None, progress: Callable[[str], None] | None = None) -> None:
        self.spark, self.config = spark, config or Config()
        self.embedder = embedder or embed.HttpEmbedder(self.config.model_url, self.config.model, self.config.dims)
        self.progress = progress or (lambda _: None)
        self.store = Store(spark, self.config.warehouse)

    # --- tables ---------------------------------------------------------------
    def _generations(self, entry: Row) -> list[str]:
        return [g for g in (entry["generation"] or "").split(",") if g]

    def _at(self, table: str, root: str, generation: str) -> str:
        return self.store.at(table, f"codebase={text_name(root)}", f"generation={generation}")

    def _version(self) -> int:
        found = [int(n[1:-5]) for n in self.store.names(self.store.at("registry")) if n.startswith("v") and n.endswith(".json")]
        return max(found, default=0)

    def codebases(self) -> DataFrame:
        """The registry: its last version. One that can't be read is an error, not an empty registry."""
        n = self._version()
        rows = json.loads(self.store.read(self.store.at("registry", f"v{n:08d}.json"))) if n else []
        frame = self.spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], _AS_TEXT)
        return frame.select(*(F.to_timestamp(c).alias(c) if c in TIMES else F.col(c) for c in COLUMNS))

    def _save(self, codebases: DataFrame) -> None:
        """One row per codebase, as a new version; where another run has written that version meanwhile, this one fails."""
        n = self._version() + 1
        rows = [{c: (r[c].astimezone(timezone.utc).isoformat() if c in TIMES and r[c] else r[c]) for c in COLUMNS} for r in codebases.orderBy("root", "generation").collect()]
        self.store.write_new(self.store.at("registry", f"v{n:08d}.json"), json.dumps(rows, indent=2))
        for k in range(max(1, n - 2 * VERSIONS), n - VERSIONS + 1):
            self.store.delete(self.store.at("registry", f"v{k:08d}.json"))

    def _entry(self, root: str) -> Row | None:
        return registry.active(self.codebases()).filter(F.col("root") == root).head()

    def _table(self, name: str, entries: list[Row], ddl: str) -> DataFrame:
        paths = [p for e in entries for g in self._generations(e) if self.store.exists(p := self._at(name, e["root"], g))]
        return self.spark.read.schema(ddl).parquet(*paths) if paths else self.spark.createDataFrame([], ddl)

    def _files(self, entries: list[Row]) -> DataFrame:
        found = self._table("files", entries, schema.FILES)
        return tables.latest(found, entries if any(len(self._generations(e)) > 1 for e in entries) else None)

    def _chunks(self, entries: list[Row]) -> DataFrame:
        found = self._table("chunks", entries, schema.CHUNKS)
        if not any(len(self._generations(e)) > 1 for e in entries):
            return found
        return found.join(self._files(entries).select("codebase", "file_path", "generation"), ["codebase", "file_path", "generation"], "left_semi").select(*found.columns)

    def files(self, roots: list[str]) -> DataFrame:
        return self._files(self._active(roots))

    def chunks(self, roots: list[str]) -> DataFrame:
        return self._chunks(self._active(roots))

    def _active(self, roots: list[str]) -> list[Row]:
        return registry.active(self.codebases()).filter(F.col("root").isin(roots)).collect() if roots else []

    def runs(self) -> DataFrame:
        path = self.store.at("runs")
        return self.spark.read.schema(schema.RUNS).json(path) if self.store.exists(path) else self.spark.createDataFrame([], schema.RUNS)

    def _cut_off(self, df: DataFrame, path: str) -> DataFrame:
        """df as a table of this run: read again, not computed again."""
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    # --- indexing -------------------------------------------------------------
    def index(self, directory: str, *, by_hash: bool = False, sync: bool = False) -> IndexResult:
        """Indexes what changed. sync also drops files that are gone; by default they stay."""
        root, began, started = os.path.abspath(directory), time.time(), datetime.now(timezone.utc)
        if not os.path.isdir(root):
            raise NotADirectoryError(f"not a directory: {root}")
        registry.guard(self.codebases(), root, self.embedder.model, self.embedder.dims)
        entry = self._entry(root)
        old = self._files([entry] if entry else [])
        result, generation = IndexResult(), f"{int(began * 1000):x}-{uuid.uuid4().hex[:8]}"
        work = self.store.at("work", generation)
        step = began

        def done(name: str) -> None:
            nonlocal step
            result.seconds[name], step = time.time() - step, time.time()

        listed = self._cut_off(source.listed(self.spark, root, self.config.max_file_kb), f"{work}/listed")
        # paths and times decide before anything is read; by_hash reads all, and the contents decide
        wanted = listed if by_hash else tables.changed(listed, old)
        content = source.read_paths(self.spark, wanted).withColumn("file_hash", text.content_hash("content"))
        content = self._cut_off(tables.changed(content, old, by_hash=True) if by_hash else content, f"{work}/content")
        done("walk")
        readable = content.filter("error is null").select("file_path", "rel_path", "last_modified", "file_hash", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
        cut = self._cut_off(chunk.chunked(readable), f"{work}/cut")
        done("chunk")
        made = self._cut_off(embed.embedded(cut, self.embedder, self.config.batch_size, self.config.concurrency), f"{work}/embedded")
        done("embed")
        ready = tables.embedded(made).select(
            F.lit(root).alias("codebase"), F.lit(generation).alias("generation"), "file_path", "rel_path", "last_modified", "file_hash", "chunk_index", "start_line", "end_line", "chunk_type", "symbol_name", "content", "language",
            F.lit(self.embedder.model).alias("model"), "embedding", "norm",
        )
        file_columns, chunk_columns = ([c.split()[0] for c in ddl.split(", ")] for ddl in (schema.FILES, schema.CHUNKS))
        new_files = ready.groupBy("codebase", "generation", "file_path", "rel_path", "last_modified", "file_hash", "language").count().drop("count").withColumns({"indexed_at": F.current_timestamp(), "deleted": F.lit(False)})
        if sync:
            gone = old.join(listed.select("file_path"), "file_path", "left_anti").withColumns({"generation": F.lit(generation), "indexed_at": F.current_timestamp(), "deleted": F.lit(True)})
            new_files = new_files.select(*file_columns).unionByName(gone.select(*file_columns))
        new_files = self._cut_off(new_files.select(*file_columns), f"{work}/files")
        result.files_processed, n_gone = new_files.filter("not deleted").count(), new_files.filter("deleted").count()
        result.chunks_created = tables.embedded(made).count()
        result.files_skipped = tables.unchanged(listed, old, content if by_hash else None).count()
        errors = made.filter("error is not null").select(F.col("file_path").alias("file"), "error").unionByName(content.filter("error is not null").select(F.col("file_path").alias("file"), "error"))
        result.errors = [r.asDict() for r in errors.collect()]
        kept = [g for g in (self._generations(entry) if entry else []) if self.store.exists(self._at("files", root, g))]
        stale: list[str] = []
        if result.files_processed or n_gone or not kept:
            new_files.write.parquet(self._at("files", root, generation))
            ready.select(*chunk_columns).write.parquet(self._at("chunks", root, generation))
            kept.append(generation)
            if len(kept) > GENERATIONS:
                kept, stale = [self._compacted(root, kept)], kept
        done("db")
        result.seconds["total"] = time.time() - began
        self._record(root, kept, result, started)
        for g in stale:
            self._delete(root, g)
        self.store.delete(work)
        self.progress(f"indexed {result.files_processed} files, {result.chunks_created} chunks, skipped {result.files_skipped}")
        return result

    def _compacted(self, root: str, generations: list[str]) -> str:
        """The generations written as one."""
        entry, new = Row(root=root, generation=",".join(generations)), f"{int(time.time() * 1000):x}-{uuid.uuid4().hex[:8]}"
        for name, df in (("files", self._files([entry])), ("chunks", self._chunks([entry]))):
            df.withColumn("generation", F.lit(new)).write.parquet(self._at(name, root, new))
        return new

    def _delete(self, root: str, generation: str) -> None:
        for t in ("files", "chunks"):
            self.store.delete(self._at(t, root, generation))

    def _record(self, root: str, generations: list[str], result: IndexResult, started: datetime) -> None:
        entry = Row(root=root, generation=",".join(generations))
        files, chunks = self._files([entry]).count(), self._chunks([entry]).count()
        now = datetime.now(timezone.utc)
        new = self.spark.createDataFrame([(root, entry["generation"], self.embedder.model, self.embedder.dims, files, chunks, now, "active", None, None)], schema.CODEBASES)
        keep = self.codebases().filter((F.col("root") != root) | (F.col("status") == "deprecated"))
        self._save(keep.unionByName(new))
        run = self.spark.createDataFrame([(time.time_ns(), root, started, now, result.files_processed, result.files_skipped, len(result.errors), [(e["file"], e["error"]) for e in result.errors])], schema.RUNS)
        run.coalesce(1).write.mode("append").json(self.store.at("runs"))
        line = json.dumps({"directory": root, "time": now.isoformat(), **asdict(result)})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(self.store.at("benchmark.jsonl"))

    # --- search ---------------------------------------------------------------
    def search(self, query: str, limit: object = None, *, codebase: str | None = None, all_: bool = False, area: str | None = None, language: str | None = None, chunk_type: str | None = None, verbose: bool = False) -> DataFrame:
        return knn.shaped(self._found(query, checked_limit(limit, SEARCH_LIMIT), codebase, all_, area, language, chunk_type), verbose)

    def _roots(self, codebase: str | None, all_: bool) -> list[str]:
        named = os.path.abspath(codebase) if codebase else None
        return registry.resolved(self.codebases(), self.embedder.model, self.embedder.dims, named, all_)

    def _found(self, query: str, k: int, codebase: str | None, all_: bool, area: str | None = None, language: str | None = None, chunk_type: str | None = None) -> DataFrame:
        roots, where = self._roots(codebase, all_), F.lit(True)
        if area:
            if ".." in area.split("/"):
                raise ValueError("the area must lie within the codebase")
            area = area.strip("/")
            where = where & F.col("file_path").startswith(F.concat(F.col("codebase"), F.lit(f"/{area}/")))
        if language:
            where = where & (F.col("language") == language)
        if chunk_type:
            where = where & (F.col("chunk_type") == chunk_type)
        (wanted,) = self.embedder.embed([query])
        return knn.nearest(self.chunks(roots), wanted, k, where=where, norm="norm")

    def save_search(self, query: str, output_path: str, limit: object = None, *, codebase: str | None = None, all_: bool = False, title: str = "", notes: str = "") -> str:
        """Writes a report and returns its path."""
        hit = text.markdown_hit("file_path", "start_line", "end_line", F.col("similarity"), "symbol_name", "chunk_type", "content")
        hits = self._found(query, checked_limit(limit, SAVE_LIMIT), codebase, all_).select(hit.alias("hit")).collect()  # limit rows
        path = self.spark.range(1).select(text.markdown_path(F.lit(output_path), F.lit(query))).head()[0]
        meta = {"query": query, "roots": ", ".join(self._roots(codebase, all_)), "model": self.embedder.model, "time": datetime.now(timezone.utc).isoformat(timespec="seconds")}
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(render(meta, title, notes, [h["hit"] for h in hits]))
        return path

    # --- lifecycle ------------------------------------------------------------
    def status(self) -> dict:
        """Totals, the active codebases (last indexed first) and the latest run with its errors."""
        all_ = self.codebases()
        run = tables.latest_run(self.runs()).head()
        listed = [r.asDict() for r in registry.listed(all_).collect()]
        return registry.rollup(all_).head().asDict() | {"list": listed, "last_run": run.asDict(recursive=True) if run else None}

    def list(self, all_: bool = False) -> list[dict]:
        found = registry.listed(self.codebases(), all_).withColumns({"matches": registry.matches(self.embedder.model, self.embedder.dims), "reason": registry.mismatch_reason(self.embedder.model, self.embedder.dims)})
        out = []
        for r in found.collect():  # one row per codebase
            stored = [self._at(t, r["root"], g) for t in ("files", "chunks") for g in self._generations(r)]
            sizes = [self.store.size(p) for p in stored]
            out.append(r.asDict() | {"on_disk": os.path.isdir(r["root"]), "stored": any(sizes), "bytes": sum(sizes)})
        return out

    def info(self, root: str) -> dict:
        """The active entry of a root, else a deprecated one."""
        found = [x for x in self.list(all_=True) if x["root"] == os.path.abspath(root)]
        if not found:
            raise LookupError(f"not indexed: {root}")
        return min(found, key=lambda x: x["status"] == "deprecated")

    def deprecate(self, root: str, reason: str = "removed") -> None:
        root = os.path.abspath(root)
        if self._entry(root) is None:
            raise LookupError(f"not indexed: {root}")
        self._save(registry.deprecated(self.codebases(), F.col("root") == root, reason))

    def drop(self, root: str) -> None:
        """Removes the data of a codebase; its registry row stays until the next run or purge."""
        entry = self._entry(os.path.abspath(root))
        if entry is None:
            raise LookupError(f"not indexed: {root}")
        for g in self._generations(entry):
            self._delete(entry["root"], g)

    def rebuild(self, root: str, reembed: bool = False) -> IndexResult:
        """From scratch; reembed first sets aside what another model made."""
        if reembed:
            if self._entry(os.path.abspath(root)) is not None:
                self.deprecate(root, "model-switch")
        else:
            registry.guard(self.codebases(), os.path.abspath(root), self.embedder.model, self.embedder.dims)
            self.drop(root)
        return self.index(root)

    def prune(self) -> list[dict]:
        """Active codebases whose folder or data are missing become deprecated."""
        gone = [x for x in self.list() if not x["on_disk"] or not x["stored"]]
        if gone:
            self._save(registry.deprecated(self.codebases(), F.col("root").isin([x["root"] for x in gone]), "stale"))
        return [x | {"status": "deprecated"} for x in gone]

    def purge(self) -> int:
        """Removes all deprecated data and rows."""
        gone = self.codebases().filter("status = 'deprecated'").collect()
        for r in gone:
            for g in self._generations(r):
                self._delete(r["root"], g)
        self._save(registry.purged(self.codebases()))
        return len(gone)

    def doctor(self) -> list[dict]:
        out = []
        if hasattr(self.embedder, "ping"):
            try:
                self.embedder.ping()
                known = self.embedder.has_model()
                out.append({"name": "model server", "status": "ok", "detail": self.embedder.url})
                out.append({"name": "model", "status": "ok" if known else "fail", "detail": self.embedder.model if known else f"the server doesn't have {self.embedder.model}"})
                if known:
                    n = self.embedder.probe()
                    out.append({"name": "dimension", "status": "ok" if n == self.embedder.dims else "fail", "detail": f"the model gives {n}, the settings say {self.embedder.dims}"})
            except Exception as e:  # noqa: BLE001
                out.append({"name": "model server", "status": "fail", "detail": str(e)})
        n = {"deprecated": 0, "mismatch": 0, "missing": 0}
        listed = self.list(all_=True)
        for x in listed:
            state = "deprecated" if x["status"] == "deprecated" else "mismatch" if not x["matches"] else "missing" if not (x["on_disk"] and x["stored"]) else ""
            if state:
                n[state] += 1
        detail = f"in use: {len(listed) - n['deprecated']}, set aside: {n['deprecated']}, with vectors of another model: {n['mismatch']}, without folder or data: {n['missing']}"
        out.append({"name": "registry", "status": "warn" if n["mismatch"] or n["missing"] else "ok", "detail": detail})
        return out


COLUMNS = [c.split()[0] for c in schema.CODEBASES.split(", ")]
TIMES = ("last_indexed", "deprecated_at")
_AS_TEXT = ", ".join(f"{c.split()[0]} string" if c.split()[0] in TIMES else c for c in schema.CODEBASES.split(", "))


def text_name(root: str) -> str:
    """storage_name of functions.text, for one path on the driver."""
    import hashlib
    import re

    slug = re.sub("[^a-zA-Z0-9._-]+", "-", os.path.basename(root))
    return f"{'codebase' if slug in ('', '-') else slug}-{hashlib.sha256(root.encode()).hexdigest()[:8]}"
