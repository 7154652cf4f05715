"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Two levels. Each distinct word (pieces of 12 bytes, so that none is cut off) is
read byte by byte by a GRU in both directions and pooled by attention; beside it
stands a learned vector for words that are frequent in the training texts. Each
window of 32 words, 16 apart, so that every word falls into two, is read by a
second GRU in both directions and pooled by attention to a logit. The score of a
document is a logistic model of its largest window logit, the mean of its window
probabilities and its number of windows.

Training is multiple-instance: first any window takes its document's label, then
of a toxic document the window that scores highest. It runs on the driver on a
bounded sample: at most PER_CLASS labelled documents of each class, least hash
of the id first, each with its whole text. All else runs over all texts, as one
map without a shuffle; the model (under 1 MB: VOCABULARY is bounded) goes along
with the tasks.

Defined cases: a null text counts as the empty one and gets the score of a
window without words; a label other than 0 or 1 isn't used; without labels of
both classes every score is the share of ones (0.5 without labels, and then nothing is rejected); a document whose id
occurs in several rows is learned by its least text; long texts are scored whole, by all
their windows; columns other than id and text pass through, whatever their names; repeated
rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import bytes_np as b
from quern.llm.common import remainder, text_of

WINDOW, STRIDE, PIECE = 32, 16, 12
PER_CLASS, VOCABULARY, EPOCHS = 600, 5_000, 16
#: Windows that training sees at least; small samples get more epochs.
LEAST_WINDOWS = 50_000
#: Bytes of text that are in hand at once.
_PIECE = 1 << 19
#: Distinct words and windows that are in hand at once, few enough for a step's gates to stay in a core's cache.
_WORDS, _WINDOWS = 2048, 512
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Texts:
    """Words of a batch of texts: their distinct pieces as bytes, and windows of indexes into them (-1: none)."""

    def __init__(self, texts: pa.Array) -> None:
        data, offsets = b.raw(texts)
        starts, ends, counts = b.words(data, offsets)
        n = -(-(ends - starts) // PIECE)
        if len(n) and n.max() > 1:
            owner = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            total = np.concatenate([[0], np.cumsum(n)])
            at = np.concatenate([[0], np.cumsum(counts)])
            counts = np.diff(total[at])
            starts, ends = starts[owner] + k * PIECE, np.minimum(ends[owner], starts[owner] + (k + 1) * PIECE)
        hashes = b.span_hashes(data, starts, ends)
        self.hashes, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        size = (ends - starts)[first]
        index = starts[first][:, None] + np.arange(PIECE)[None, :]
        self.inside = np.arange(PIECE)[None, :] < size[:, None]
        self.chars = np.where(self.inside, _LOWER[data[np.minimum(index, max(len(data) - 1, 0))]], 0) if len(data) else np.zeros((0, PIECE), np.uint8)
        windows = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
        self.owner = np.repeat(np.arange(len(counts)), windows)
        k = np.arange(len(self.owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = (np.cumsum(counts) - counts)[self.owner] + k * STRIDE
        left = counts[self.owner] - k * STRIDE
        pos = at[:, None] + np.arange(WINDOW)[None, :]
        ok = np.arange(WINDOW)[None, :] < left[:, None]
        self.windows = np.where(ok, which[np.minimum(pos, max(len(which) - 1, 0))] if len(which) else 0, -1).astype(np.int32)
        self.counts = windows


def _gru(x: np.ndarray, inside: np.ndarray | None, u: np.ndarray, reverse: bool, keep: list | None = None) -> np.ndarray:
    """States of a GRU over x (steps, rows, 3 * hidden); where inside is 0 the state stays. keep gets what the gradient needs."""
    steps, rows, three = x.shape
    h = three // 3
    out = np.empty((steps, rows, h), np.float32)
    state = np.zeros((rows, h), np.float32)
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        rec = state @ u
        gates = np.tanh(0.5 * (x[t, :, : 2 * h] + rec[:, : 2 * h]))
        gates += 1
        gates *= 0.5
        z, r = gates[:, :h], gates[:, h:]
        new = np.tanh(x[t, :, 2 * h :] + r * rec[:, 2 * h :])
        if keep is not None:
            keep.append((t, state, z, r, new, rec[:, 2 * h :]))
        following = new + z * (state - new)
        if inside is not None:
            m = inside[t]
            following = np.where(m, following, state)
        state = following
        out[t] = state
    return out


def _gru_back(d_out: np.ndarray, inside: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients by x and u."""
    h = u.shape[0]
    dx = np.zeros((*d_out.shape[:2], 3 * h), np.float32)
    du = np.zeros_like(u)
    carry = np.zeros(d_out.shape[1:], np.float32)
    for t, state, z, r, new, rec in reversed(kept):
        d = (d_out[t] + carry) * inside[t]
        passed = (d_out[t] + carry) * ~inside[t]
        dn = d * (1 - z) * (1 - new**2)
        dz = d * (state - new) * z * (1 - z)
        dr = dn * rec * r * (1 - r)
        back = np.concatenate([dz, dr, dn * r], axis=1)
        dx[t] = np.concatenate([dz, dr, dn], axis=1)
        du += state.T @ back
        carry = d * z + back @ u.T + passed
    return dx, du


class Network:
    def __init__(self, vocabulary: np.ndarray, chars: int = 8, char_hidden: int = 8, words: int = 8, hidden: int = 8, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.vocabulary = vocabulary  # hashes, ascending
        wide, c2, h2 = words + 2 * char_hidden, 2 * char_hidden, 2 * hidden
        self.p = {"emb": init(256, chars) * 4, "word": init(len(vocabulary) + 1, words) * 0.3, "out": init(h2, 1), "bias": np.full(1, -1.0, np.float32)}
        for level, size, h in (("c", chars, char_hidden), ("w", wide, hidden)):
            for side in "fb":
                self.p |= {f"{level}x{side}": init(size, 3 * h), f"{level}b{side}": np.zeros(3 * h, np.float32), f"{level}u{side}": init(h, 3 * h)}
        for level, size in (("c", c2), ("w", h2)):
            self.p |= {f"{level}a": init(size, 8), f"{level}v": init(8, 1)}
        self.head = np.array([1.0, 0.0, 0.0, 0.0])
        self.share: float | None = None
        self.unlabelled = False

    def _pool(self, level: str, hs: np.ndarray, inside: np.ndarray, keep: dict | None = None) -> np.ndarray:
        e = np.tanh(hs @ self.p[f"{level}a"])
        s = np.where(inside, e @ self.p[f"{level}v"], np.float32(-30))
        s = np.exp(s - s.max(axis=0))
        s /= s.sum(axis=0)
        if keep is not None:
            keep |= {f"{level}e": e, f"{level}s": s, f"{level}h": hs}
        return (hs * s).sum(axis=0)

    def _pool_back(self, level: str, d: np.ndarray, inside: np.ndarray, keep: dict, g: dict) -> np.ndarray:
        e, s, hs = (keep[f"{level}{x}"] for x in "esh")
        dh = d[None] * s
        ds = (d[None] * hs).sum(axis=2, keepdims=True)
        dl = s * (ds - (s * ds).sum(axis=0)) * inside
        g[f"{level}v"] = (e * dl).sum(axis=(0, 1))[:, None]
        de = dl * self.p[f"{level}v"].T * (1 - e**2)
        g[f"{level}a"] = np.tensordot(hs, de, axes=((0, 1), (0, 1)))
        return dh + de @ self.p[f"{level}a"].T

    def _both(self, level: str, x: np.ndarray, inside: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
        out = []
        for side in "fb":
            kept: list | None = None if keep is None else []
            out.append(_gru(x @ self.p[f"{level}x{side}"] + self.p[f"{level}b{side}"], inside, self.p[f"{level}u{side}"], side == "b", kept))
            if keep is not None:
                keep[f"{level}k{side}"] = kept
        return np.concatenate(out, axis=2)

    def _both_back(self, level: str, d: np.ndarray, x: np.ndarray, inside: np.ndarray, keep: dict, g: dict) -> np.ndarray:
        h, dx = d.shape[2] // 2, 0
        for side, part in (("f", d[:, :, :h]), ("b", d[:, :, h:])):
            dp, g[f"{level}u{side}"] = _gru_back(part, inside, self.p[f"{level}u{side}"], keep[f"{level}k{side}"])
            g[f"{level}b{side}"] = dp.sum(axis=(0, 1))
            g[f"{level}x{side}"] = np.tensordot(x, dp, axes=((0, 1), (0, 1)))
            dx = dx + dp @ self.p[f"{level}x{side}"].T
        return dx

    def _ids(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of the word vectors; the last stands for all other words."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, len(self.vocabulary))

    def _words(self, chars: np.ndarray, inside: np.ndarray, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Vectors of distinct words. Steps beyond the longest word are left out."""
        steps = int(inside.sum(axis=1).max()) if len(inside) else 1
        m = np.ascontiguousarray(inside[:, :steps].T)[:, :, None]
        x = self.p["emb"][chars[:, :steps].T]
        pooled = self._pool("c", self._both("c", x, m, keep), m, keep)
        if keep is not None:
            keep |= {"cx": x, "cm": m}
        return np.concatenate([self.p["word"][ids], pooled], axis=1)

    def logits(self, t: Texts, rows: np.ndarray | None = None, batch: int = _WINDOWS) -> np.ndarray:
        """One per window. The input side of the upper GRU is computed once per distinct word."""
        order = np.argsort(t.inside.sum(axis=1), kind="stable")
        vectors = np.zeros((len(order) + 1, self.p["wxf"].shape[0]), np.float32)
        ids = self._ids(t.hashes)
        for k in range(0, len(order), _WORDS):
            part = order[k : k + _WORDS]
            vectors[part] = self._words(t.chars[part], t.inside[part], ids[part])
        tables = [vectors @ self.p[f"wx{side}"] + self.p[f"wb{side}"] for side in "fb"]
        windows = t.windows if rows is None else t.windows[rows]
        out = np.empty(len(windows), np.float32)
        full = (windows >= 0).all(axis=1)
        for some in (np.flatnonzero(full), np.flatnonzero(~full)):
            for k in range(0, len(some), batch):
                part = some[k : k + batch]
                w = np.ascontiguousarray(windows[part].T)
                m = (w >= 0)[:, :, None]
                hs = np.concatenate([_gru(tables[i][w], None if full[part[0]] else m, self.p[f"wu{side}"], side == "b") for i, side in enumerate("fb")], axis=2)
                out[part] = (self._pool("w", hs, m) @ self.p["out"])[:, 0] + self.p["bias"]
        return out

    def gradient(self, t: Texts, rows: np.ndarray, y: np.ndarray, rng: np.random.Generator, dropped: float = 0.3) -> tuple[float, dict]:
        """Loss and gradients of the logistic loss of some windows."""
        w = t.windows[rows]
        used, index = np.unique(w, return_inverse=True)
        index = index.reshape(w.shape)
        lacking = len(used) and used[0] < 0
        real = used[1:] if lacking else used
        ids = self._ids(t.hashes[real])
        ids = np.where(rng.random(len(ids)) < dropped, len(self.vocabulary), ids)
        keep: dict = {}
        vectors = self._words(t.chars[real], t.inside[real], ids, keep)
        if lacking:
            vectors = np.concatenate([np.zeros((1, vectors.shape[1]), np.float32), vectors])
        m = np.ascontiguousarray((w >= 0).T)[:, :, None]
        x = vectors[index.T]
        pooled = self._pool("w", self._both("w", x, m, keep), m, keep)
        logit = (pooled @ self.p["out"])[:, 0] + self.p["bias"]
        p = 1 / (1 + np.exp(-logit))
        loss = float(-np.mean(np.where(y, np.log(p + 1e-7), np.log(1 - p + 1e-7))))
        d = ((p - y) / len(y)).astype(np.float32)[:, None]
        g = {"out": pooled.T @ d, "bias": d.sum(axis=0)}
        dh = self._pool_back("w", d @ self.p["out"].T, m, keep, g)
        dx = self._both_back("w", dh, x, m, keep, g)
        dv = np.zeros_like(vectors)
        np.add.at(dv, index.T.ravel(), dx.reshape(-1, dx.shape[2]))
        dv = dv[1:] if lacking else dv
        size = self.p["word"].shape[1]
        g["word"] = np.zeros_like(self.p["word"])
        np.add.at(g["word"], ids, dv[:, :size])
        dc = self._pool_back("c", dv[:, size:], keep["cm"], keep, g)
        de = self._both_back("c", dc, keep["cx"], keep["cm"], keep, g)
        g["emb"] = np.zeros_like(self.p["emb"])
        steps = keep["cm"].shape[0]
        np.add.at(g["emb"], t.chars[real][:, :steps].T.ravel(), (de * keep["cm"]).reshape(-1, de.shape[2]))
        return loss, g

    def summary(self, t: Texts, logits: np.ndarray) -> np.ndarray:
        """Per text what the head reads."""
        at = np.cumsum(t.counts) - t.counts
        top = np.maximum.reduceat(logits, at) if len(logits) else np.zeros(0)
        mean = np.add.reduceat(1 / (1 + np.exp(-logits.astype(float))), at) / t.counts if len(logits) else np.zeros(0)
        return np.column_stack([top, mean, np.log(t.counts), np.ones(len(top))])

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.share is not None:
            return np.full(len(texts), self.share)
        t = Texts(texts)
        return 1 / (1 + np.exp(-np.clip(self.summary(t, self.logits(t)) @ self.head, -60, 60)))


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 5, least: int = LEAST_WINDOWS) -> Network:
    """A network for texts with labels 0 or 1."""
    y = np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        net = Network(np.zeros(0, np.uint64))
        net.share = float(y.mean()) if len(y) else 0.5
        net.unlabelled = not len(y)
        return net
    rng = np.random.default_rng(seed)
    t = Texts(pa.array(texts, pa.string()))
    # words of at least four texts, the most frequent first
    pairs = np.unique(np.stack([np.repeat(t.owner, WINDOW), t.windows.ravel()]), axis=1)
    spread = np.bincount(pairs[1][pairs[1] >= 0], minlength=len(t.hashes))
    often = np.lexsort((t.hashes, -spread))[:VOCABULARY]
    net = Network(np.sort(t.hashes[often[spread[often] >= 4]]), seed=seed)
    first = np.cumsum(t.counts) - t.counts
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    ones, zeros = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    epochs = max(epochs, -(-least // (3 * len(y))))
    some = lambda docs: first[docs] + (rng.random(len(docs)) * t.counts[docs]).astype(np.int64)
    for epoch in range(epochs):
        if epoch < epochs // 4:
            rows = np.concatenate([some(ones), some(ones), some(ones), some(zeros), some(zeros), some(zeros)])
        else:
            logits = net.logits(t)
            best = np.lexsort((-logits, t.owner))[first]
            second = np.lexsort((-logits, t.owner))[first + (t.counts > 1)]
            rows = np.concatenate([best[ones], best[ones], best[zeros], second[zeros], some(zeros)])
        rows = rng.permutation(rows)
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        for k in range(0, len(rows), 128):
            part = rows[k : k + 128]
            _, g = net.gradient(t, part, y[t.owner[part]], rng)
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            step += 1
            for name, v in g.items():
                v = v * min(1.0, 1.0 / (norm + 1e-9)) + (1e-4 * net.p[name] if name in ("word", "emb") else 0)
                m, s = moments[name]
                m += 0.1 * (v - m)
                s += 0.01 * (v**2 - s)
                net.p[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    # the head, by Newton's method with a ridge, weighing the classes as they are in the sample
    x = net.summary(t, net.logits(t))
    head = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ head, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 0.05 * len(y) / 100 * np.eye(len(head))
        head += np.linalg.solve(h, x.T @ (y - p) - 0.05 * len(y) / 100 * head)
    net.head = head
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", id_col: str = "doc_id", divisor: int = 5, held_out: int = 0, per_class: int = PER_CLASS) -> Network:
    """Trains on at most per_class labelled documents of each class that aren't held out."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & (remainder(F.col("doc_id"), divisor) != held_out)).distinct()
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = known.filter("y = 1").orderBy(*order).limit(per_class).unionByName(known.filter("y = 0").orderBy(*order).limit(per_class))
    # at most 2 * per_class rows
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text).alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"], r["y"]))
    return train([r["text"] for r in rows], [r["y"] for r in rows])


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", id_col: str = "doc_id", divisor: int = 5, held_out: int = 0, per_class: int = PER_CLASS) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted."""
    net = fit(docs, labels, label, text, id_col, divisor, held_out, per_class)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in b.pieces(batch, "text", _PIECE):
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(net.scores(piece.column("text")), pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col(id_col).alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (remainder(F.col("doc_id"), divisor) == held_out).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = 0.5, **options: object) -> DataFrame:
    """The document rows, all columns, that score below the threshold. The score is added row by row in one map, nothing is joined."""
    net = fit(docs, labels, text=text, id_col=id_col, **options)
    if net.unlabelled:
        return docs
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in b.pieces(batch, text, _PIECE):
                yield piece.filter(pa.array(net.scores(piece.column(text)) < threshold))

    return docs.mapInArrow(run, fields)
