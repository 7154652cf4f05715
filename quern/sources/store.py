"""Small files and folders of the warehouse through Spark's file system, so that a path may be on any store that Spark reaches."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Store:
    """A folder. Paths are strings; whatever else the engine writes there goes through DataFrames."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._make(self.root)

    def at(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def _path(self, path: str):  # noqa: ANN202
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        # a side file with sums would call a file that other tools have edited broken
        fs.setVerifyChecksum(False)
        return fs, where

    def _make(self, path: str) -> None:
        fs, where = self._path(path)
        fs.mkdirs(where)

    def exists(self, path: str) -> bool:
        fs, where = self._path(path)
        return fs.exists(where)

    def names(self, path: str) -> list[str]:
        """What lies in a folder, in order; nothing if there is none."""
        fs, where = self._path(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []

    def size(self, path: str) -> int:
        fs, where = self._path(path)
        return fs.getContentSummary(where).getLength() if fs.exists(where) else 0

    def delete(self, path: str) -> None:
        fs, where = self._path(path)
        fs.delete(where, True)

    def read(self, path: str) -> str:
        fs, where = self._path(path)
        stream = fs.open(where)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> None:
        """A file that appears whole; one that is there already is an error."""
        fs, where = self._path(path)
        _, draft = self._path(f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if fs.exists(where) or not fs.rename(draft, where):
            fs.delete(draft, False)
            raise FileExistsError(path)


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: the checkpoint folder, or below the warehouse where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
