"""Nearest chunks by cosine similarity.

One query is a projection under TakeOrderedAndProject: each task keeps k rows,
the driver merges them, nothing is shuffled. Many queries are a NumPy matrix
product per Arrow batch with a running top k per query, then a top k over what
the tasks kept: tasks * queries * k rows, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import vector

#: Ties go to the least path, line and index.
TIES = ("file_path", "start_line", "chunk_index")
#: Queries in one pass over the rows; rows that a task compares with them at once.
QUERY_ROWS, TILE_ROWS = 2_048, 1_024


def scored(chunks: DataFrame, query: Sequence[float], embedding: str = "embedding", norm: str | None = None) -> DataFrame:
    similarity = vector.cosine(F.col(embedding), vector.literal(query), F.col(norm) if norm else None)
    return chunks.withColumn("similarity", similarity)


def _order(df: DataFrame, ties: Sequence[str]) -> list[Column]:
    return [F.col("similarity").desc_nulls_last(), *(F.col(c) for c in ties if c in df.columns)]


def nearest(chunks: DataFrame, query: Sequence[float], k: int, *, where: Column | None = None, mode: str = "pre", ties: Sequence[str] = TIES, embedding: str = "embedding", norm: str | None = None) -> DataFrame:
    """The k most similar rows. mode "pre" filters first; "post" takes k first and may return fewer."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if mode not in ("pre", "post"):
        raise ValueError(f"unknown mode {mode}")
    if where is not None and mode == "pre":
        chunks = chunks.filter(where)
    out = scored(chunks, query, embedding, norm)
    out = out.orderBy(*_order(out, ties)).limit(k)
    return out.filter(where) if where is not None and mode == "post" else out


def nearest_per_codebase(chunks: DataFrame, query: Sequence[float], k: int, *, where: Column | None = None, codebase: str = "codebase", ties: Sequence[str] = TIES) -> DataFrame:
    """The k best of each codebase, filtered after the cut, merged and cut to k (what separate stores would return).

    The rank keeps k rows per codebase and task before the shuffle (WindowGroupLimit)."""
    out = scored(chunks, query)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy(codebase).orderBy(*_order(out, ties)))).filter(F.col("rank") <= k)
    if where is not None:
        ranked = ranked.filter(where)
    return ranked.orderBy(*_order(out, ties)).limit(k).drop("rank")


def under(prefix: str, path: str = "file_path") -> Column:
    """Rows at or below a folder. Never LIKE: the folder's name isn't a pattern."""
    return F.col(path).startswith(prefix.rstrip("/") + "/")


def without_deprecated(chunks: DataFrame, codebases: DataFrame, codebase: str = "codebase") -> DataFrame:
    gone = codebases.filter("status = 'deprecated'").select(F.col("root").alias(codebase))
    return chunks.join(gone, codebase, "left_anti")


def nearest_many(chunks: DataFrame, queries: np.ndarray, k: int, id_col: str, embedding: str = "embedding") -> DataFrame:
    """(query, rank, id, similarity) of the k nearest rows to each of a bounded number of query vectors; query: its place in the array."""
    q = np.asarray(queries, np.float64)
    norms = np.linalg.norm(q, axis=1, keepdims=True)
    unit = np.divide(q, norms, out=np.zeros_like(q), where=norms > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sims = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
        for batch in batches:
            column = batch.column(embedding)
            ok = np.array([x is not None and x == q.shape[1] for x in column.value_lengths().to_pylist()], bool)
            part = column.filter(pa.array(ok))
            x = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
            own = np.asarray(batch.column(id_col).filter(pa.array(ok)))
            for a in range(0, len(x), TILE_ROWS):
                tile, names = x[a : a + TILE_ROWS], own[a : a + TILE_ROWS]
                n = np.linalg.norm(tile, axis=1)
                s = unit @ np.divide(tile.T, n, out=np.zeros_like(tile.T), where=n > 0)
                s[:, n == 0] = -np.inf
                sims = np.concatenate([sims, s], axis=1)
                ids = np.concatenate([ids, np.broadcast_to(names, s.shape)], axis=1)
                best = np.lexsort((ids, -sims), axis=1)[:, :k]
                sims, ids = np.take_along_axis(sims, best, 1), np.take_along_axis(ids, best, 1)
        known = np.isfinite(sims) & (norms > 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(known)[0]), pa.array(ids[known]), pa.array(sims[known])], names=["query", "id", "similarity"])

    kept = chunks.select(id_col, embedding).mapInArrow(run, "query long, id long, similarity double")
    order = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "id")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "rank", "id", "similarity")


def nearest_of_each(chunks: DataFrame, queries: DataFrame, k: int, id_col: str, embedding: str = "embedding", query_col: str | None = None) -> DataFrame:
    """(query, rank, id, similarity) of the k nearest rows to each row of queries, exact; query: its id (query_col, or id_col).

    Queries are taken in blocks of about QUERY_ROWS: one pass over the rows per block, whose queries go along with its tasks.
    """
    named = queries.select(F.col(query_col or id_col).cast("long").alias("query"), F.col(embedding).alias("v")).filter("v is not null")
    blocks = max(1, -(-named.count() // QUERY_ROWS))
    out = []
    for b in range(blocks):
        part = named.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).orderBy("query").toArrow()  # about QUERY_ROWS rows
        width = max((len(v) for v in part.column("v").to_pylist()), default=1)
        vectors = [v if len(v) == width else [0.0] * width for v in part.column("v").to_pylist()]
        names = chunks.sparkSession.createDataFrame(list(enumerate(part.column("query").to_pylist())), "at long, query long")
        found = nearest_many(chunks, np.array(vectors, np.float64).reshape(len(vectors), -1), k, id_col, embedding).withColumnRenamed("query", "at")
        out.append(found.join(F.broadcast(names), "at").select("query", "rank", "id", "similarity"))
    return reduce(DataFrame.unionByName, out)


def shaped(hits: DataFrame, verbose: bool = False) -> DataFrame:
    """As tools return it: file, lines, score, symbol, type, snippet."""
    from quern.functions import text

    snippet = text.cut_bytes("content", text.VERBOSE_BYTES) if verbose else text.snippet_preview("content")
    return hits.select(
        F.col("file_path").alias("file"), F.concat_ws("-", "start_line", "end_line").alias("lines"), vector.score(F.col("similarity")).alias("score"),
        F.coalesce("symbol_name", F.lit("")).alias("symbol"), F.col("chunk_type").alias("type"), snippet.alias("snippet"),
    )
