"""Regularised quadratic discriminant on document statistics.

Each text becomes a dozen and a half statistics of its bytes and words, on
logarithmic or root scales. Per class, one pass adds up n, sum(x) and sum(x x')
in each partition; the sums (a bounded row per partition and class) give means
and covariances on the driver. A covariance is shrunk towards the pooled one and
that towards its diagonal. A score is the logistic of the difference of the two
Mahalanobis log densities, with the Cholesky factors computed once.

Every labelled row that isn't held out counts. The statistics are computed once
over all documents and kept as a table in the shared folder; labels join on the
id, so no text is shuffled.

Defined cases: a null text counts as the empty one and gets a score as well;
a label that is neither 0 nor 1 isn't used; with a class that has no labels all
scores are the share of ones (0.5 without labels); repeated rows are scored
alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import bytes_np as b
from quern.llm.common import remainder, stored, text_of

FEATURES = [
    "log_words", "log_word_size", "word_size_spread", "upper", "digits", "marks", "symbols", "exclamations", "pipes",
    "lines", "repeated_words", "adjacent_repeats", "repeated_triples", "stops", "distinct", "non_ascii", "longest_word",
]


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[[ord(c) for c in chars]] = 1
    return out


_UPPER, _DIGIT = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")
_MARK, _SYMBOL, _SHOUT, _PIPE, _LINE, _STOP = (_table(x) for x in (",;:'\"()-", "#*$%&<>@~^=_{}[]\\/", "!?", "|", "\n", "."))
_HIGH = np.zeros(256)
_HIGH[128:] = 1


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each owner has."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n).astype(float)


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text, from all of the text."""
    data, offsets = b.raw(texts)
    n = len(offsets) - 1
    starts, ends, counts = b.words(data, offsets)
    owner = np.repeat(np.arange(n), counts)
    size = (ends - starts).astype(float)
    words = np.maximum(counts, 1).astype(float)
    chars = np.bincount(owner, size, minlength=n)
    letters = np.maximum(chars, 1)

    def per(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1)
        np.cumsum(table[data], out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    hashes = b.span_hashes(data, starts, ends)
    distinct = _distinct(hashes, owner, n)
    same = np.zeros(n)
    triples = np.zeros(n)
    if len(hashes) > 1:
        same = np.bincount(owner[1:], (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]), minlength=n)
    if len(hashes) > 2:
        inside = owner[2:] == owner[:-2]
        runs = b.mix(hashes[:-2] * np.uint64(3) + b.mix(hashes[1:-1] * np.uint64(5) + hashes[2:]))[inside]
        triples = np.maximum(counts - 2, 0) - _distinct(runs, owner[2:][inside], n)
    mean = chars / words
    spread = np.sqrt(np.maximum(np.bincount(owner, size**2, minlength=n) / words - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, owner, size)
    share = lambda x, of: np.sqrt(np.maximum(x, 0) / of)
    return np.column_stack([
        np.log1p(counts), np.log1p(mean), np.log1p(spread), share(per(_UPPER), letters), share(per(_DIGIT), letters), share(per(_MARK), words), share(per(_SYMBOL), words), share(per(_SHOUT), words), share(per(_PIPE), words),
        share(per(_LINE), words), share(counts - distinct, words), share(same, words), share(triples, words), share(per(_STOP), words), np.log1p(distinct) - 0.5 * np.log1p(counts), share(per(_HIGH), letters), np.log1p(longest),
    ])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in b.pieces(batch, "text"):
            x = features(piece.column("text"))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), flat], names=["doc_id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(FEATURES)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        if batch.num_rows:
            x, y = _matrix(batch.column("x")), batch.column("y").to_numpy()
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(list(total))], names=["y", "sums"])


class Discriminant:
    """Two Gaussian classes; shrink mixes a covariance with the pooled one, ridge the pooled one with its diagonal."""

    def __init__(self, sums: np.ndarray, shrink: float = 0.2, ridge: float = 0.1) -> None:
        d = len(FEATURES)
        n = sums[:, 0]
        self.share = float(n[1] / n.sum()) if n.sum() else 0.5
        self.known = bool((n > 0).all())
        if not self.known:
            return
        means = [s[1 : 1 + d] / s[0] for s in sums]
        scatter = [s[1 + d :].reshape(d, d) - s[0] * np.outer(m, m) for s, m in zip(sums, means, strict=True)]
        pooled = sum(scatter) / n.sum()
        pooled = (1 - ridge) * pooled + ridge * np.diag(np.diag(pooled)) + 1e-4 * np.eye(d)
        self.parts = []
        for k in (0, 1):
            weight = shrink + (1 - shrink) * d / (d + n[k])  # few rows lean on the pooled covariance
            factor = np.linalg.cholesky((1 - weight) * scatter[k] / n[k] + weight * pooled)
            self.parts.append((means[k], np.linalg.inv(factor), np.log(np.diag(factor)).sum(), np.log(n[k] / n.sum())))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if not self.known:
            return np.full(len(x), self.share)
        logs = [prior - half - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, half, prior in self.parts]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id_col: str = "doc_id", divisor: int = 3, held_out: int = 1) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted."""
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    table = stored(source.mapInArrow(_features, f"doc_id {kind}, x array<double>"), "statistics")
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & (remainder(F.col("doc_id"), divisor) != held_out))
    rows = table.join(known, "doc_id").select("x", "y").mapInArrow(_sums, "y long, sums array<double>")
    # two rows of len(FEATURES)^2 numbers per partition, added up before they reach the driver
    added = rows.select("y", F.posexplode("sums").alias("k", "v")).groupBy("y", "k").agg(F.sum("v").alias("v")).collect()
    d = len(FEATURES)
    sums = np.zeros((2, 1 + d + d * d))
    for r in added:
        sums[r["y"], r["k"]] = r["v"]
    model = Discriminant(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.scores(_matrix(batch.column("x"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    out = table.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (remainder(F.col("doc_id"), divisor) == held_out).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
