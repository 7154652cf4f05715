"""Extension: chunks and vectors of files as they arrive, by Structured Streaming.

The stream carries (file_path, last_modified, content). Each micro-batch keeps the
latest state of every path and replaces its chunks in a new snapshot; Spark's mark of
success comes last, and a batch that is run again finds its own snapshot and skips.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators import chunk, embed, tables
from quern.sources.store import Store


class Snapshots:
    """A table as numbered snapshots in a folder; the last one that Spark has marked as written counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.store = spark, Store(spark, path)

    def current(self) -> int:
        found = sorted((int(n.removeprefix("snapshot-")) for n in self.store.names(self.store.root) if n.startswith("snapshot-")), reverse=True)
        return next((n for n in found if self.store.exists(self.store.at(f"snapshot-{n}", "_SUCCESS"))), -1)

    def read(self) -> DataFrame | None:
        n = self.current()
        return None if n < 0 else self.spark.read.parquet(self.store.at(f"snapshot-{n}"))

    def write(self, df: DataFrame, n: int) -> None:
        """The snapshot before the last goes, so that readers of the last can end."""
        last = self.current()
        df.write.mode("overwrite").parquet(self.store.at(f"snapshot-{n}"))
        for name in self.store.names(self.store.root):
            if name.startswith("snapshot-") and int(name.removeprefix("snapshot-")) < last:
                self.store.delete(self.store.at(name))


def latest(files: DataFrame) -> DataFrame:
    """Of each path the row that changed last: a partial aggregate."""
    rest = [c for c in files.columns if c != "file_path"]
    top = files.groupBy("file_path").agg(F.max(F.struct("last_modified", *(c for c in rest if c != "last_modified"))).alias("x"))
    return top.select("file_path", *(F.col(f"x.{c}").alias(c) for c in rest))


def start(stream: DataFrame, snapshots: Snapshots, embedder: embed.Embedder, checkpoint: str, **trigger: object) -> StreamingQuery:
    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= snapshots.current():
            return
        made = tables.embedded(embed.embedded(chunk.chunked(latest(batch)), embedder).drop("error", "text"))
        old = snapshots.read()
        snapshots.write(made if old is None else tables.replaced(old, made.select(*old.columns)), batch_id)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
