"""A stored index of vectors for approximate nearest neighbours: cells around centroids (inverted lists).

The centroids are fitted on a bounded sample (SAMPLE rows, least hash of the id
first); every row is indexed, in the cell of its nearest centroid, as its unit
vector. The index is a folder with two Parquet tables: `centroids`, and `rows`,
which Spark partitions by cell, so that a search reads the cells it probes and
no others. A cell of many rows is split into parts of about PART_ROWS.

How many cells a search probes is measured when the index is built: the fewest with
which queries of the sample find RECALL of their true neighbours in the sample. Vectors
without clusters need many (half of all, for random ones of 64 dimensions), others few.

A search takes a table of queries of any size: each query goes to its nearest
`probes` cells, queries and rows of one part of a cell meet in one task, in
blocks, as a matrix product with a running top k, and what the parts found is
cut to k. Without loss of rows, a search of all cells is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE, MOST_CELLS, ROUNDS = 20_000, 1_024, 12
#: Share of the true neighbours that a search should find, and the queries and neighbours that it is measured by.
RECALL, TRIALS, TRIAL_K = 0.95, 256, 10
#: Rows of a cell in one task.
PART_ROWS = 50_000
_ROWS = 2_048


def _matrix(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, which rows have one) of a column of vectors; a null, zero or odd-sized vector has none."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    width = int(np.bincount(sizes).argmax()) if len(sizes) and sizes.max() else 0
    ok = (sizes == width) & (width > 0)
    x = column.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, max(width, 1))
    norms = np.linalg.norm(x, axis=1)
    good = np.isfinite(norms) & (norms > 0)
    ok[np.flatnonzero(ok)[~good]] = False
    return x[good] / norms[good][:, None], ok


def _nearest_cells(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n centroids with the largest products, per row."""
    out = np.empty((len(x), n), np.int64)
    for k in range(0, len(x), _ROWS):
        s = x[k : k + _ROWS] @ centroids.T
        out[k : k + _ROWS] = np.argsort(-s, axis=1, kind="stable")[:, :n]
    return out


def fitted(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Centroids on the unit sphere by Lloyd's rounds; an empty cell takes the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), cells, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest_cells(sample, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        if len(empty):
            far = np.argsort((sample * centroids[own]).sum(axis=1), kind="stable")[: len(empty)]
            sums[empty] = sample[far]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids


def probes_for(sample: np.ndarray, centroids: np.ndarray, recall: float = RECALL) -> int:
    """The fewest cells that hold that share of the nearest rows of the sample's first rows."""
    asked = sample[:TRIALS]
    k = min(TRIAL_K, len(sample))
    true = np.concatenate([np.argsort(-(asked[a : a + 64] @ sample.T), axis=1, kind="stable")[:, :k] for a in range(0, len(asked), 64)])
    own = _nearest_cells(sample, centroids, 1)[:, 0]
    order = _nearest_cells(asked, centroids, len(centroids))
    place = np.argsort(order, axis=1)  # of each cell, how near it is
    needed = np.sort(np.take_along_axis(place, own[true], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def build(vectors: DataFrame, path: str, id_col: str, embedding: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Writes an index of all rows that have a vector; cells: as many as the root of their number, MOST_CELLS at most, unless given."""
    spark = vectors.sparkSession
    known = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(embedding).alias("v")).filter("v is not null")
    total = known.count()
    x, _ = _matrix(known.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column("v"))  # at most `sample` rows
    n = max(1, min(len(x), cells or min(MOST_CELLS, int(total**0.5))))
    centroids = fitted(x, n) if len(x) else np.zeros((0, 1))
    shared = spark.sparkContext.broadcast(centroids)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, ok = _matrix(batch.column("v"))
            if len(unit):
                cell = _nearest_cells(unit, shared.value, 1)[:, 0]
                lists = pa.ListArray.from_arrays((np.arange(len(unit) + 1) * unit.shape[1]).astype(np.int32), pa.array(unit.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(ok)), lists, pa.array(cell)], names=["id", "v", "cell"])

    probes = probes_for(x, centroids) if len(x) else 1
    spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centroids)], "cell long, v array<double>, probes int").write.mode("overwrite").parquet(f"{path}/centroids")
    rows = known.mapInArrow(placed, "id long, v array<float>, cell long") if len(centroids) else spark.createDataFrame([], "id long, v array<float>, cell long")
    # rows of a cell in several files where it is large, and few files elsewhere
    parts = max(1, -(-total // PART_ROWS))
    rows.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(parts))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    return VectorIndex(spark, path)


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        found = spark.read.parquet(f"{path}/centroids").orderBy("cell").toArrow()  # MOST_CELLS rows at most, unless more were asked for
        self.centroids = np.array(found.column("v").to_pylist(), np.float64) if found.num_rows else np.zeros((0, 1))
        self.probes = found.column("probes")[0].as_py() if found.num_rows else 1

    def search(self, queries: DataFrame, k: int, id_col: str, embedding: str = "embedding", probes: int | None = None) -> DataFrame:
        """(query, rank, id, similarity): the k best rows of the probed cells for each query that has a vector; ties go to the least id."""
        probes = self.probes if probes is None else probes
        if k < 1 or probes < 1:
            raise ValueError("k and probes must be at least 1")
        n = min(probes, len(self.centroids))
        if not n:
            return self.spark.createDataFrame([], "query long, rank int, id long, similarity double")
        centroids = self.spark.sparkContext.broadcast(self.centroids)

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit, ok = _matrix(batch.column("v"))
                if len(unit):
                    cells = _nearest_cells(unit, centroids.value, n)
                    at = np.repeat(np.flatnonzero(ok), n)
                    lists = pa.ListArray.from_arrays((np.arange(len(unit) * n + 1) * unit.shape[1]).astype(np.int32), pa.array(np.repeat(unit, n, axis=0).ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column("query").take(pa.array(at)), lists, pa.array(cells.ravel())], names=["query", "v", "cell"])

        wanted = queries.select(F.col(id_col).cast("long").alias("query"), F.col(embedding).alias("v")).filter("v is not null")
        wanted = wanted.mapInArrow(probed, "query long, v array<double>, cell long")
        rows = self.spark.read.schema("id long, v array<float>, cell long").parquet(f"{self.path}/rows")
        # a number per cell
        sizes = [(r["cell"], -(-r["count"] // PART_ROWS)) for r in rows.groupBy("cell").count().collect()]
        parts = lambda: F.broadcast(self.spark.createDataFrame(sizes, "cell long, parts long"))
        rows = rows.join(parts(), "cell").withColumn("part", F.expr("pmod(xxhash64(id), parts)"))
        wanted = wanted.join(parts(), "cell").withColumn("part", F.expr("explode(sequence(0L, parts - 1))"))

        def met(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
            q, x = (np.asarray(t.column("v").combine_chunks().flatten()).astype(np.float64).reshape(t.num_rows, -1) for t in (left, right))
            ids, names = np.asarray(right.column("id")), np.asarray(left.column("query"))
            out = []
            for a in range(0, len(q), _ROWS):
                sims, own = np.full((min(_ROWS, len(q) - a), 0), 0.0), np.zeros((min(_ROWS, len(q) - a), 0), np.int64)
                for b in range(0, len(x), _ROWS):
                    s = q[a : a + _ROWS] @ x[b : b + _ROWS].T
                    sims = np.concatenate([sims, s], axis=1)
                    own = np.concatenate([own, np.broadcast_to(ids[b : b + _ROWS], s.shape)], axis=1)
                    best = np.lexsort((own, -sims), axis=1)[:, :k]
                    sims, own = np.take_along_axis(sims, best, 1), np.take_along_axis(own, best, 1)
                out.append((np.repeat(names[a : a + _ROWS], sims.shape[1]), own.ravel(), sims.ravel()))
            return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], names=["query", "id", "similarity"])

        found = wanted.groupBy("cell", "part").cogroup(rows.groupBy("cell", "part")).applyInArrow(met, "query long, id long, similarity double")
        order = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "rank", "id", "similarity")
