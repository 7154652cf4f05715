"""The registry of codebases as DataFrame changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ModelMismatchError(ValueError):
    """A codebase holds vectors of another model."""


def upserted(codebases: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries replace rows of their root, become active and lose their deprecation."""
    new = entries.withColumns({"status": F.lit("active"), "deprecated_at": F.lit(None).cast("timestamp"), "deprecated_reason": F.lit(None).cast("string")})
    return codebases.join(new.select("root"), "root", "left_anti").unionByName(new.select(*codebases.columns))


def deprecated(codebases: DataFrame, roots: Column, reason: str, at: Column | None = None) -> DataFrame:
    """Rows that the condition selects become deprecated."""
    hit = roots & (F.coalesce("status", F.lit("active")) != "deprecated")
    return codebases.withColumns({
        "deprecated_at": F.when(hit, F.current_timestamp() if at is None else at).otherwise(F.col("deprecated_at")),
        "deprecated_reason": F.when(hit, reason).otherwise(F.col("deprecated_reason")),
        "status": F.when(hit, "deprecated").otherwise(F.col("status")),
    })


def active(codebases: DataFrame) -> DataFrame:
    return codebases.filter(F.coalesce("status", F.lit("")).isin("", "active"))


def purged(codebases: DataFrame) -> DataFrame:
    return codebases.filter(F.coalesce("status", F.lit("")) != "deprecated")


def matches(model: str, dims: int) -> Column:
    """Searchable with the configured model; an entry without model or dimension is."""
    return F.coalesce("model", F.lit("")).isin("", model) & F.coalesce("dims", F.lit(0)).isin(0, dims)


def mismatch_reason(model: str, dims: int) -> Column:
    """Why it isn't; "" if it is."""
    other = F.concat(F.lit("its vectors are of the model "), F.col("model"), F.lit(f", searches use {model}"))
    size = F.concat(F.lit("its vectors have "), F.col("dims").cast("string"), F.lit(f" dimensions, searches use {dims}"))
    return F.when(~F.coalesce("model", F.lit("")).isin("", model), other).when(~F.coalesce("dims", F.lit(0)).isin(0, dims), size).otherwise("")


def listed(codebases: DataFrame, all_: bool = False) -> DataFrame:
    return (codebases if all_ else active(codebases)).orderBy(F.col("last_indexed").desc_nulls_last(), "root")


def most_recent(codebases: DataFrame, model: str, dims: int) -> DataFrame:
    return listed(active(codebases).filter(matches(model, dims))).limit(1)


def longest_prefix(paths: DataFrame, codebases: DataFrame, path: str = "path") -> DataFrame:
    """For each path the deepest registered root at or above it: an equi-join on the path's ancestors, not a prefix scan."""
    parts = paths.withColumn("__p", F.split(path, "/"))
    above = F.transform(F.sequence(F.lit(1), F.size("__p")), lambda i: F.array_join(F.slice("__p", F.lit(1), i), "/"))
    roots = codebases.select(F.col("root").alias("__root")).distinct()
    met = parts.select(*paths.columns, F.explode_outer(above).alias("__root")).join(roots, "__root")
    best = met.groupBy(*paths.columns).agg(F.max_by("__root", F.length("__root")).alias("root"))
    return paths.join(best, paths.columns, "left")


def rollup(codebases: DataFrame) -> DataFrame:
    """Totals of the active codebases."""
    return active(codebases).agg(F.count("*").alias("codebases"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


def health(codebases: DataFrame, model: str, dims: int, present: Column) -> DataFrame:
    """How many are active, deprecated, of another model, or missing; the first that holds counts."""
    state = F.when(F.coalesce("status", F.lit("")) == "deprecated", "deprecated").when(~matches(model, dims), "mismatch").when(~present, "missing").otherwise("ok")
    count = lambda c: F.count(F.when(c, 1))
    return codebases.withColumn("__s", state).agg(
        count(F.col("__s") != "deprecated").alias("active"), count(F.col("__s") == "deprecated").alias("deprecated"), count(F.col("__s") == "mismatch").alias("mismatch"), count(F.col("__s") == "missing").alias("missing")
    )


def resolved(codebases: DataFrame, model: str, dims: int, codebase: str | None = None, all_: bool = False) -> list[str]:
    """Roots a search covers: all that match, the one named, or the one indexed last. One row per codebase reaches the driver."""
    if all_:
        roots = [r["root"] for r in active(codebases).filter(matches(model, dims)).select("root").orderBy("root").collect()]
        if not roots:
            raise LookupError("no codebase is indexed with the configured model")
        return roots
    if codebase is not None:
        row = active(codebases).filter(F.col("root") == codebase).withColumn("why", mismatch_reason(model, dims)).head()
        if row is not None and row["why"]:
            raise ModelMismatchError(row["why"])
        return [codebase]
    row = most_recent(codebases, model, dims).head()
    if row is None:
        raise LookupError("no codebase is indexed with the configured model")
    return [row["root"]]


def guard(codebases: DataFrame, root: str, model: str, dims: int) -> None:
    """Raises where the root is active with another model."""
    row = active(codebases).filter(F.col("root") == root).withColumn("why", mismatch_reason(model, dims)).head()
    if row is not None and row["why"]:
        raise ModelMismatchError(f"{root}: {row['why']}")
