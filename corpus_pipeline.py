"""A corpus pipeline of five stages over `documents`, each written as Parquet and read by the next.

toxicity drops documents that score as toxic; near_dups keeps one document of
each group of near copies; decontamination drops documents that hold ten
consecutive words of a benchmark item; surrogates replaces personal data; mixing
gives each source its share. All but the last return the columns of documents.

Defined cases, in every stage: a null text counts as the empty text, and stays null; documents
without words are kept up to the mix, as one of each equal text, and the mix never takes
them; a null id, source or lang is a value like any other; texts of any length are handled
whole; repeated rows are one document in near_dedup, and any but the first go; with an empty
table, empty labels or an empty benchmark the stages still run (no labels: nothing is
toxic); columns that clash with added ones keep their names and values.

The session's Arrow batches stay bounded after a stage, as its result is still to be computed; a setting of the session's own stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, mixing, near_dups, surrogates
from quern.llm import toxicity as tox
from quern.llm.common import bounded_batches, scratch, stored

#: Bytes of an Arrow batch in the stages, several copies of which are in an executor's memory outside its heap.
ARROW_BYTES = 1 << 20


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5."""
    bounded_batches(spark, ARROW_BYTES)
    return tox.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id."""
    bounded_batches(spark, ARROW_BYTES)
    return near_dups.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the text."""
    out = surrogates.pseudonymised(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with copies (how often) and taken (words, repeats counted)."""
    bounded_batches(spark, ARROW_BYTES)
    out = mixing.mix(docs)
    return out.filter(F.col(out.columns[-2]) > 0)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("mixing", mixture),
]

#: SQL can't express the network, the similarity classes and the random rounding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What the stages wrote in between is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as own:
        for name, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), name)
        name, stage = STAGES[-1]
        return own.kept(stage(spark, docs, sf_dir), name)
