"""A directory tree as a Spark data source.

Names, sizes and times are listed folder by folder: the driver goes down until there
are some folders to deal out, tasks walk what lies below them. Partitions of the data source
carry paths; executors read the contents, and only of the files that are asked for: filters on
last_modified or path are applied to the listing, before anything is read. The tree must be on
a file system that the executors see. `binaryFile` isn't used, as it leaves out
names that start with an underscore or a dot.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, In, InputPartition, LessThanOrEqual, StringStartsWith

from quern.functions.text import BINARY_EXTENSIONS
from quern.sources import ignore

SCHEMA = "codebase string, file_path string, rel_path string, last_modified double, size long, content binary, error string"
_FILTERS = {EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, GreaterThan: lambda v, x: v > x, LessThanOrEqual: lambda v, x: v <= x, StringStartsWith: lambda v, x: v.startswith(x)}


Folder = tuple[str, ignore.IgnoreSpec]


def folder(root: str, rel: str, spec: ignore.IgnoreSpec, max_kb: int) -> tuple[list[dict], list[Folder]]:
    """(files, folders below with their rules) of one folder: not ignored, not binary, not too large. A folder that can't be read has none."""
    path = os.path.join(root, rel) if rel else root
    try:
        entries = sorted(os.scandir(path), key=lambda e: e.name)
    except OSError:
        return [], []
    spec = spec.within(path, rel, {e.name for e in entries})
    files, below = [], []
    for e in entries:
        name = f"{rel}/{e.name}" if rel else e.name
        try:
            if e.is_dir():
                if not e.is_symlink() and not spec.ignores(name, True):
                    below.append((name, spec))
            elif e.is_file() and not spec.ignores(name) and os.path.splitext(e.name)[1].lower() not in BINARY_EXTENSIONS and (stat := e.stat()).st_size <= max_kb * 1024:
                files.append({"codebase": root, "file_path": e.path, "rel_path": name, "last_modified": float(int(stat.st_mtime)), "size": stat.st_size})
        except OSError:
            continue
    return files, below


def _walk(root: str, todo: list[Folder], max_kb: int) -> Iterator[dict]:
    while todo:
        files, below = folder(root, *todo.pop(), max_kb)
        yield from files
        todo += reversed(below)


def _checked(root: str) -> str:
    root = os.path.abspath(root)
    if not os.path.isdir(root):
        raise NotADirectoryError(f"not a directory: {root}")
    return root


def listing(root: str, max_kb: int) -> Iterator[dict]:
    """Files of a tree."""
    root = _checked(root)
    yield from _walk(root, [("", ignore.IgnoreSpec())], max_kb)


class _Part(InputPartition):
    def __init__(self, files: list[dict]) -> None:
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, root: str, max_kb: int, partitions: int, names: list[str]) -> None:
        self.root, self.max_kb, self.n, self.names, self.filters = root, max_kb, partitions, names, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _FILTERS and len(f.attribute) == 1 and f.attribute[0] in ("codebase", "file_path", "rel_path", "last_modified", "size"):
                self.filters.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[_Part]:
        kept = [x for x in listing(self.root, self.max_kb) if all(_FILTERS[kind](x[name], value) for name, kind, value in self.filters)]
        kept.sort(key=lambda x: -x["size"])
        parts = [kept[k :: self.n] for k in range(self.n)]
        return [_Part(p) for p in parts if p] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for x in partition.files:
            content = error = None
            try:
                with open(x["file_path"], "rb") as f:
                    content = f.read()
            except OSError as e:
                error = str(e)
            row = x | {"content": content, "error": error}
            yield tuple(row[n] for n in self.names)


class CodebaseSource(DataSource):
    """Options: path, max_kb (512), partitions (8)."""

    @classmethod
    def name(cls) -> str:
        return "codebase"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        path = self.options.get("path")
        if not path:
            raise ValueError("option path is missing")
        return _Reader(path, int(self.options.get("max_kb", "512")), int(self.options.get("partitions", "8")), [f.name for f in schema])


def read(spark: SparkSession, root: str, max_kb: int = 512, partitions: int = 8) -> DataFrame:
    if not os.path.isdir(root):
        raise NotADirectoryError(f"not a directory: {root}")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CodebaseSource)
    return spark.read.format("codebase").option("path", root).option("max_kb", max_kb).option("partitions", partitions).load()


LISTED = "codebase string, file_path string, rel_path string, last_modified double, size long"


def listed(spark: SparkSession, root: str, max_kb: int = 512, tasks: int = 32) -> DataFrame:
    """The listing alone: nothing is read. Each task walks some of the first folders, as many as tasks if there are so many."""
    root, names = _checked(root), [c.split()[0] for c in LISTED.split(", ")]
    here, todo = [], [("", ignore.IgnoreSpec())]
    while todo and len(todo) < tasks:
        files, below = folder(root, *todo.pop(0), max_kb)
        here += files
        todo += below
    out = spark.createDataFrame([tuple(x[n] for n in names) for x in here], LISTED)
    if not todo:
        return out

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for k in batch.column("folder").to_pylist():
                files = list(_walk(root, [todo[k]], max_kb))
                yield pa.RecordBatch.from_pylist([{n: x[n] for n in names} for x in files], pa.schema([pa.field(n, t) for n, t in zip(names, (pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64()), strict=True)]))

    dealt = spark.range(0, len(todo), 1, len(todo)).select(F.col("id").alias("folder"))
    return out.unionByName(dealt.mapInArrow(run, LISTED))


def _contents(batches):  # noqa: ANN001, ANN202
    for batch in batches:
        found, errors = [], []
        for path in batch.column("file_path").to_pylist():
            try:
                with open(path, "rb") as f:
                    found.append(f.read())
                errors.append(None)
            except OSError as e:
                found.append(None)
                errors.append(str(e))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary()), pa.array(errors, pa.string())], names=[*batch.schema.names, "content", "error"])


def read_paths(spark: SparkSession, listed: DataFrame, partitions: int = 8) -> DataFrame:
    """A listing with contents: only its files are read, spread over the tasks."""
    return listed.repartition(partitions, "file_path").mapInArrow(_contents, SCHEMA)
