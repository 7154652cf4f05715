"""What the operators of this subpackage share: shared storage, words, splits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blanks of the word rule `[^\x20\x09-\x0D]+`.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where none is set (local tests)."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    _own_dir = _own_dir or tempfile.mkdtemp(prefix="quern-")
    return _own_dir


#: Bytes of one Arrow batch between the JVM and Python while a table is stored; rows may be long (texts, sets of shingles).
ARROW_BYTES = 8 << 20
_ARROW_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Paths of the tables that stored() wrote in each open scratch().
_scratches: list[list[str]] = []


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ARROW_BYTES, where the session has no setting of its own."""
    if spark.conf.get(_ARROW_KEY, None) is not None:
        yield
        return
    spark.conf.set(_ARROW_KEY, str(ARROW_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_ARROW_KEY)


def bounded_batches(spark: SparkSession, most: int) -> None:
    """Arrow batches of `most` bytes from now on, where the session has no setting of its own; so it holds for lazy results that others write."""
    if spark.conf.get(_ARROW_KEY, None) is None:
        spark.conf.set(_ARROW_KEY, str(most))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder. Cuts the lineage: a lost executor costs a re-read, not a re-run."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.write.parquet(path)
    if _scratches:
        _scratches[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables through Spark's file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


class Scratch:
    """The tables of one scratch()."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """df stored as a table that outlives this scratch; an enclosing one, if any, removes it."""
        out = stored(df, name)
        path = self.paths.pop()
        if len(_scratches) > 1:
            _scratches[-2].append(path)
        return out

    def drop(self) -> None:
        """Removes the tables so far. Nothing that is still to be read may depend on them."""
        removed(self.spark, self.paths)
        self.paths.clear()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Tables that stored() writes inside are removed at the end, but for what kept() wrote."""
    own = Scratch(spark)
    _scratches.append(own.paths)
    try:
        yield own
    finally:
        _scratches.remove(own.paths)
        own.drop()


def text_of(column: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+` of a text that isn't null."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32(doc_id as text) mod divisor; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
