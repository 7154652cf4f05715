"""Mixing sources to target weights by pivotal dependent rounding.

Every document should be copied target/size-of-source times on average; the
whole part is certain, the fraction is rounded. Rounding pairs the largest open
document with smaller ones and moves mass between them until it is whole: up or
down at random, so that each keeps its expectation, by amounts that leave the
expected words of the pair as they are. (One partner alone can't make a large
document whole; it would wander, and often stay open to the end. So the partners
are as many of the next smaller ones as can.) What stays fractional of one bucket
of a source is one document, as a rule one of its smallest, and those residuals
meet in the next level of a reduction tree, 64 buckets to one, until one document
per source is left and rounded alone. So the words taken of a source differ from
its target by less than that document's size.

Buckets follow from a hash of the row, not from the partitions, and the random
numbers from the bucket: reruns agree on any cluster. A source that holds most
rows has most buckets. No task sees more than a bucket. One row per source
reaches the driver, where the targets are solved.

Rows are told apart by 128 bits of their id and text.

Defined cases: a null or empty text has size 0 and is taken never; a null source
is a source, last in order; rows that agree in id, source and text are rounded as
one document of their joint size; an empty table gives an empty result; columns
that clash with the added ones keep their names, the added ones get a leading
underscore; texts of any length count whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fresh, scratch, stored, text_of, words_of

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
BUCKET_ROWS, FAN_IN = 5_000, 64
#: Sources, and documents with one copy more, up to which they are broadcast.
SOURCES, BROADCAST_ROWS = 10_000, 1_000_000


def water_fill(sizes: Sequence[float], weights: Sequence[float], total: float, most: float = MOST) -> list[float]:
    """Targets in proportion to the weights, none above most times its size: what is in excess is shared again by weight."""
    targets = [0.0] * len(sizes)
    free = [i for i in range(len(sizes)) if sizes[i] > 0 and weights[i] > 0]
    left = float(total)
    for n, i in enumerate(order := sorted(free, key=lambda i: most * sizes[i] / weights[i])):
        rest = math.fsum(weights[j] for j in order[n:])
        if weights[i] * left / rest > most * sizes[i]:
            targets[i] = most * sizes[i]
            left -= targets[i]
        else:
            for j in order[n:]:
                targets[j] = weights[j] * left / rest
            break
    return targets


def pivot(fractions: np.ndarray, sizes: np.ndarray, rng: np.random.Generator, pool: int = 16) -> np.ndarray:
    """The fractions with all but one, at most, rounded to 0 or 1; sum(fraction * size) stays, and every fraction is its own expectation.

    In the order given, each is paired with the next open ones together: as many as can take or give what makes it whole
    (pool at first, doubled until enough or all that follow), each of them in proportion to its room. Given largest first,
    what stays open is among the smallest.
    """
    p, s, tiny = fractions.astype(float).copy(), np.asarray(sizes, float), 1e-12

    def snap(where: np.ndarray | int) -> None:
        p[where] = np.where(p[where] <= tiny, 0.0, np.where(p[where] >= 1 - tiny, 1.0, p[where]))

    snap(np.arange(len(p)))
    for i in range(len(p)):
        many = pool
        while 0 < p[i] < 1:
            near = i + 1 + np.flatnonzero((p[i + 1 : i + 1 + many] > 0) & (p[i + 1 : i + 1 + many] < 1))
            share = np.minimum(p[near], 1 - p[near])
            room = float((share * s[near]).sum())
            need_up, need_down = (1 - p[i]) * s[i], p[i] * s[i]
            if room < max(need_up, need_down) and i + 1 + many < len(p):
                many *= 2
                continue
            if not len(near):
                break
            up, down = min(need_up, room), min(need_down, room)  # words that may go to i, or from it
            move = up if rng.random() * (up + down) < down else -down
            p[i] += move / s[i]
            p[near] -= move / room * share
            if move == (need_up if move > 0 else -need_down):
                p[i] = float(move > 0)
            snap(i)
            snap(near)
    return p


def _seed(*parts: object) -> np.random.Generator:
    import hashlib

    return np.random.Generator(np.random.Philox(int.from_bytes(hashlib.sha256(repr(parts).encode()).digest()[:8], "big")))


def _rounder(seed: int, level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # large first, so that what stays open is small
        pdf = pdf.sort_values(["size", "hash", "hash2"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        rng = _seed(seed, level, int(pdf["rank"].iloc[0]), int(pdf["bucket"].iloc[0]))
        p = pivot(pdf["p"].to_numpy(), pdf["size"].to_numpy(float), rng)
        if last:
            open_ = (p > 0) & (p < 1)
            p[open_] = rng.random(int(open_.sum())) < p[open_]
        return pdf.assign(p=p, bucket=pdf["bucket"] // FAN_IN)

    return run


def _plan(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> list[tuple]:
    """(source, rank, source_size, target, rate, buckets) of every source: one row each reaches the driver, where the targets are solved."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
    sizes = [r["s"] for r in totals]
    solved = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), most)
    return [(r["source"], i, int(s), float(t), t / s if s else 0.0, max(1, -(-int(r["n"]) // BUCKET_ROWS))) for i, (r, s, t) in enumerate(zip(totals, sizes, solved, strict=True))]


def mix(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7) -> DataFrame:
    """The document rows with size, source_size, target, copies and taken (size times copies)."""
    size, src_size, target, copies, taken, rank, h, h2, src = fresh(docs, "size", "source_size", "target", "copies", "taken", "rank", "hash", "hash2", "src")
    hashes = (F.xxhash64(F.col(id_col), text_of(text)), F.xxhash64(F.lit(seed), text_of(text), F.col(id_col)))
    spark = docs.sparkSession
    with scratch(spark) as own:
        sized = docs.select(F.col(id_col).alias("doc"), F.col(source).alias("source"), hashes[0].alias("hash"), hashes[1].alias("hash2"), F.size(words_of(text_of(text))).cast("long").alias("size"))
        sized = stored(sized, "sizes")
        plan = _plan(sized, weights, share, most)
        kind = docs.schema[source].dataType.simpleString()
        plan_df = spark.createDataFrame(plan, f"source {kind}, rank int, source_size long, target double, rate double, buckets long")
        few = len(plan) <= SOURCES

        # rows that agree in id, source and text are one document of their joint size: all of them get the same copies
        rows = sized.groupBy("source", "hash", "hash2").agg(F.sum("size").alias("size"))
        a, b = rows.alias("a"), plan_df.alias("b")
        rows = a.join(F.broadcast(b) if few else b, F.col("a.source").eqNullSafe(F.col("b.source"))).filter((F.col("size") > 0) & (F.col("rate") > 0))
        open_rows = rows.select("rank", F.pmod(F.xxhash64("hash", F.lit(seed)), F.col("buckets")).alias("bucket"), "hash", "hash2", "size", (F.col("rate") % 1).alias("p"))
        most_buckets = max([p[5] for p in plan], default=1)
        decided, level = [], 0
        while True:
            last = most_buckets == 1
            done = open_rows.groupBy("rank", "bucket").applyInPandas(_rounder(seed, level, last), "rank int, bucket long, hash long, hash2 long, size long, p double")
            done = stored(done, f"level{level}")
            decided.append(done.filter("p = 1"))
            if last:
                break
            open_rows, level, most_buckets = done.filter("p > 0 and p < 1"), level + 1, -(-most_buckets // FAN_IN)
        extra = reduce(DataFrame.unionByName, decided).select(F.col("hash").alias(h), F.col("hash2").alias(h2), F.col("rank").alias(rank)).distinct()
        extra = own.kept(extra, "extra").withColumn(taken, F.lit(1))
    b = plan_df.select(F.col("source").alias(src), F.col("rank").alias(rank), F.col("source_size").alias(src_size), F.col("target").alias(target), F.floor("rate").cast("long").alias(copies))
    out = docs.select("*", hashes[0].alias(h), hashes[1].alias(h2), F.size(words_of(text_of(text))).cast("long").alias(size))
    out = out.join(F.broadcast(b) if few else b, F.col(source).eqNullSafe(F.col(src)))
    if extra.count() <= BROADCAST_ROWS:
        extra = F.broadcast(extra)
    out = out.join(extra, [h, h2, rank], "left").withColumn(copies, F.when(F.col(size) > 0, F.col(copies) + F.coalesce(F.col(taken), F.lit(0))).otherwise(0).cast("long"))
    return out.select(*docs.columns, size, src_size, target, copies, (F.col(size) * F.col(copies)).alias(taken))


def targets(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per document row: its id, size, source_size and target, without the rounding."""
    sized = docs.select(F.col(id_col), F.col(source).alias("source"), F.size(words_of(text_of(text))).cast("long").alias("size"))
    with scratch(docs.sparkSession) as own:
        sized = own.kept(sized, "sizes")
    plan = [(p[0], p[2], p[3]) for p in _plan(sized, weights, share, most)]
    plan_df = docs.sparkSession.createDataFrame(plan, f"source {docs.schema[source].dataType.simpleString()}, source_size long, target double")
    a, b = sized.alias("a"), plan_df.alias("b")
    return a.join(F.broadcast(b) if len(plan) <= SOURCES else b, F.col("a.source").eqNullSafe(F.col("b.source"))).select(f"a.{id_col}", "size", "source_size", "target")
