"""Changes of the engine's tables, as joins: nothing is updated in place."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.store import shared_dir


def changed(candidates: DataFrame, files: DataFrame, by_hash: bool = False) -> DataFrame:
    """Candidate files that aren't indexed with the same time of change (or content)."""
    key = ["file_path", "file_hash" if by_hash else "last_modified"]
    return candidates.join(files.select(*key), key, "left_anti").select(*candidates.columns)


def unchanged(candidates: DataFrame, files: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Candidate files that are indexed with the same time of change, or (where changed is given) that aren't among the changed."""
    if changed is not None:
        return candidates.join(changed.select("file_path"), "file_path", "left_anti")
    key = ["file_path", "last_modified"]
    return candidates.join(files.select(*key), key, "left_semi")


def latest(files: DataFrame, several: object = True) -> DataFrame:
    """Of each file of a codebase the row of its last generation, unless that says it is gone. several: false where each file has one row."""
    if several:
        key, rest = ["codebase", "file_path"], [c for c in files.columns if c not in ("codebase", "file_path", "generation")]
        top = files.groupBy(*key).agg(F.max(F.struct("generation", *rest)).alias("x"))
        files = top.select(*(F.col(c) if c in key else F.col(f"x.{c}").alias(c) for c in files.columns))
    return files.filter(~F.coalesce("deleted", F.lit(False)))


def embedded(chunks: DataFrame) -> DataFrame:
    """Chunks whose embedding succeeded; gaps of chunk_index stay."""
    return chunks.filter(F.col("embedding").isNotNull())


def replaced(old: DataFrame, new: DataFrame, key: str = "file_path") -> DataFrame:
    """old with all rows of the keys in new replaced. A key without new rows keeps its old ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def below(path: Column, root: str) -> Column:
    return (path == root) | path.startswith(root.rstrip("/") + "/")


def prefix_counts(files: DataFrame, chunks: DataFrame, root: str) -> DataFrame:
    """(files, chunks) at or below a folder."""
    f = files.filter(below(F.col("file_path"), root)).agg(F.count("*").alias("files"))
    c = chunks.filter(below(F.col("file_path"), root)).agg(F.count("*").alias("chunks"))
    return f.crossJoin(c)


def without_prefix(table: DataFrame, root: str) -> DataFrame:
    return table.filter(~below(F.col("file_path"), root))


def batches(texts: DataFrame, size: int, order: str) -> DataFrame:
    """batch: which request of `size` texts a row would go into, in order. A report; embedding itself batches per task."""
    if size < 1:
        raise ValueError("batch size must be at least 1")
    # position = rows of earlier ranges + position in the own range: no single partition sees all rows
    # (written once: a range partitioning samples its input, and a second evaluation may cut elsewhere)
    ranged = texts.repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id())
    path = f"{shared_dir(texts.sparkSession)}/quern-batches-{uuid.uuid4().hex}"
    ranged.write.parquet(path)
    ranged = texts.sparkSession.read.schema(ranged.schema).parquet(path)

    own = ranged.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy(order)))
    counts = own.groupBy("__part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    out = own.join(F.broadcast(before.select("__part", F.coalesce("before", F.lit(0)).alias("before"))), "__part")
    return out.withColumn("batch", F.floor((F.col("before") + F.col("__row") - 1) / size).cast("long")).drop("__part", "__row", "before")


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("run_id").desc()).limit(1)


def status(files: DataFrame, chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts, and the latest run with its errors (an empty list where there are none)."""
    counts = files.agg(F.count("*").alias("files")).crossJoin(chunks.agg(F.count("*").alias("chunks")))
    last = latest_run(runs).select("run_id", "directory", "finished_at", F.coalesce("error_details", F.array().cast("array<struct<file:string,error:string>>")).alias("error_details"))
    return counts.join(last, F.lit(True), "left")
