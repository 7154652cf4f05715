"""Language-model scores by context-tree weighting over bytes.

Texts are lower-cased (A-Z), preceded by zero bytes and closed by one, the end.
A byte is eight binary decisions, each with its own context tree over the last
DEPTH bytes. In every node a Krichevsky-Trofimov estimate competes with the
product of the node's children, one half each; so all depths are mixed with the
weights that the training texts give them. KT block probabilities depend on
counts alone, therefore the tree is built from distributed n-gram counts and is
the same in any order of documents.

1. One map counts byte grams (DEPTH + 1 bytes) and words of each partition; a
   sum per key follows. Grams of held-out texts come along with count 0, so that
   every gram has a row.
2. Grams are dealt out by their three latest context bytes and sorted, so that a task
   takes whole groups in pieces of about CHUNK rows; a group has at most 2^24 grams, however
   large the corpus. There all nodes from DEPTH to 3 lie together, and the tree is built once:
   each gram gets its mixed predictions so far, each node of depth 2 what the group adds to
   its counts and its children's product. Those sums, by key, make the nodes of depth 2
   (2^24 at most; some hundred thousand for text), and those the nodes of depths 1 and 0
   (257 * 255), which a second map without a shuffle mixes in. Each gram gets the
   log10 probability of its last byte.
3. A last map adds up the logs over every text. The tables of grams and words are
   broadcast up to BROADCAST_ROWS rows in all, in sorted pieces of about SENT rows, so that
   the driver's Python has one of them in hand at a time. Beyond that the rows that most partitions
   hold are, and each run of documents asks once for every other key that it has; the
   answers are added to the sums so far. Texts aren't stored or shuffled, and both ways
   give the same sums.

Words are told apart by 64-bit hashes. Defined cases: a null text is the empty
text: one end; without training texts every bit has probability 1/2, and
base_score is 0 as all counts are; repeated rows count as often as they occur; long texts
are scored whole, in one piece; rows with equal ids and texts get equal scores; an empty table
gives an empty result; columns other than id and text aren't looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quern.llm import bytes_np as b
from quern.llm.common import remainder, scratch, stored, text_of

DEPTH = 5
BROADCAST_ROWS = 6_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MERGE = 1_000_000
#: Grams of whole groups that are in hand at once.
CHUNK = 500_000
#: Rows of a table that pass through the driver and are broadcast at once, of 16 bytes; about a block of Spark's broadcasts.
SENT = 250_000
#: Documents and keys beyond the broadcast tables that a run of documents has in hand.
RUN = 1_000_000
#: Bytes of text that are in hand at once.
_PIECE = 1 << 19


def grams(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams of all texts in order, how many each text has): depth context bytes and a byte, the end included."""
    data, offsets = b.raw(texts)
    n = len(offsets) - 1
    size = np.diff(offsets)
    padded = np.zeros(len(data) + n * (depth + 1), np.uint64)
    shift = np.repeat(np.arange(n) * (depth + 1) + depth, size)
    padded[np.arange(len(data)) + shift] = _LOWER[data]
    at = np.concatenate([[0], np.cumsum(size + 1)])
    where = np.arange(at[-1]) + np.repeat(np.arange(n) * depth + depth, size + 1)
    out = np.zeros(len(where), np.uint64)
    for k in range(depth, -1, -1):
        out = (out << np.uint64(8)) | padded[where - k]
    return out, size + 1


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, how many each text has)."""
    data, offsets = b.raw(texts)
    starts, ends, counts = b.words(data, offsets)
    return b.span_hashes(data, starts, ends), counts


class _Counter:
    """Sums by key; keeps memory to the distinct keys and one buffer."""

    def __init__(self) -> None:
        self.keys, self.sums, self.new, self.held = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray, weight: int) -> None:
        if len(keys):
            u, c = np.unique(keys, return_counts=True)
            self.new.append((u, c * weight))
            self.held += len(u)
            if self.held > _MERGE:
                self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.new)])
        sums = np.concatenate([self.sums, *(c for _, c in self.new)])
        if len(keys):
            order = np.argsort(keys, kind="stable")
            keys, sums = keys[order], sums[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.keys, self.sums = keys[first], np.add.reduceat(sums, first)
        self.new, self.held = [], 0


def _counting(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = (_Counter(), _Counter())
        for batch in batches:
            for piece in b.pieces(batch, "text", _PIECE):
                training = piece.column("training")
                for weight, part in ((1, piece.filter(training)), (0, piece.filter(pa.compute.invert(training)))):
                    if part.num_rows:
                        counters[0].add(grams(part.column("text"), depth)[0], weight)
                        counters[1].add(tokens(part.column("text"))[0], weight)
        for kind, c in enumerate(counters):
            c.merge()
            for k in range(0, len(c.keys), 50_000):
                keys = c.keys[k : k + 50_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(c.sums[k : k + 50_000])], names=["kind", "key", "n"])

    return run


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0, by Stirling's series after a shift of eight."""
    y = x + 8
    shift = np.log(x)
    for k in range(1, 8):
        shift = shift + np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability of the counts."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _levels(keys: np.ndarray, n: np.ndarray, depth: int, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """From depth down to least: (d, distinct keys of d context bytes, latest first, and the byte; their counts)."""
    # latest context byte first, so that a node's descendants are a range
    rev = np.zeros(len(keys), np.uint64)
    for k in range(1, depth + 1):
        rev = (rev << np.uint64(8)) | ((keys >> np.uint64(8 * k)) & np.uint64(255))
    rev = (rev << np.uint64(8)) | (keys & np.uint64(255))
    for d in range(depth, least - 1, -1):
        cut = ((rev >> np.uint64(8 * (depth - d + 1))) << np.uint64(8)) | (rev & np.uint64(255))
        order = np.argsort(cut, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], cut[order][1:] != cut[order][:-1]]))
        yield d, cut, order, first, np.add.reduceat(n[order], first)


def _tree(keys: np.ndarray, n: np.ndarray, depth: int, least: int) -> tuple[np.ndarray, dict[int, tuple]]:
    """Mixed predictions, from depth to least, of the eight bits of each gram (rows x 8), and per bit the nodes of depth least: (key, prefix, zeros, ones, log weighted probability)."""
    levels = list(_levels(keys, n, depth, least))
    mixed = np.zeros((len(keys), 8))
    nodes = {}
    for j in range(8):
        below: tuple[np.ndarray, np.ndarray] | None = None  # node keys and log weighted probabilities one level deeper
        p = None
        for d, cut, order, first, sums in levels:
            leaf = cut[order][first]  # distinct (context, byte), ascending
            node = leaf >> np.uint64(8 - j)
            bit = ((leaf >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
            start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            ones = np.add.reduceat(np.where(bit, sums, 0), start).astype(float)
            zeros = np.add.reduceat(np.where(bit, 0, sums), start).astype(float)
            names = node[start]
            kt = log_kt(zeros, ones)
            at = np.searchsorted(names, cut >> np.uint64(8 - j))
            took = ((cut >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
            own = (np.where(took, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)
            if below is None:
                weighted, p = kt, own
            else:
                # a child's key holds one more context byte between this node's context and the bits
                child = ((below[0] >> np.uint64(8 + j)) << np.uint64(j)) | (below[0] & np.uint64((1 << j) - 1))
                children = np.zeros(len(names))
                np.add.at(children, np.searchsorted(names, child), below[1])
                weighted = np.logaddexp(kt, children) + math.log(0.5)
                w = 1 / (1 + np.exp(np.clip(children - kt, -700, 700)))
                p = w[at] * own + (1 - w[at]) * p
            below = (names, weighted)
        mixed[:, j] = p
        nodes[j] = (below[0], zeros, ones, below[1])
    return mixed, nodes


class Root:
    """Depths 1 and 0: for each the KT weight and counts of every (context, bits) node, dense."""

    def __init__(self, sums: np.ndarray) -> None:
        """sums: (256 latest bytes, 256 nodes: bits behind a leading one) x (zeros, ones, log weighted probability of the children)."""
        self.one = sums[:, :, :2]
        kt = log_kt(sums[:, :, 0], sums[:, :, 1])
        self.w1 = 1 / (1 + np.exp(np.clip(sums[:, :, 2] - kt, -700, 700)))
        weighted = np.logaddexp(kt, sums[:, :, 2]) + math.log(0.5)
        empty = sums[:, :, :2].sum(axis=2) == 0
        children = np.where(empty, 0.0, weighted).sum(axis=0)
        self.zero = sums[:, :, :2].sum(axis=0)
        kt0 = log_kt(self.zero[:, 0], self.zero[:, 1])
        self.w0 = 1 / (1 + np.exp(np.clip(children - kt0, -700, 700)))

    def log10(self, keys: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        byte, last = (keys & np.uint64(255)).astype(np.int64), ((keys >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
        out = np.zeros(len(keys))
        for j in range(8):
            node, bit = (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1
            p = mixed[:, j]
            c = self.one[last, node]
            p = self.w1[last, node] * (np.take_along_axis(c, bit[:, None], 1)[:, 0] + 0.5) / (c.sum(axis=1) + 1) + (1 - self.w1[last, node]) * p
            c = self.zero[node]
            p = self.w0[node] * (np.take_along_axis(c, bit[:, None], 1)[:, 0] + 0.5) / (c.sum(axis=1) + 1) + (1 - self.w0[node]) * p
            out += np.log10(p)
        return out


class Second:
    """Depth 2: for each (two latest bytes, bits) node that occurs the KT weight and the estimate for a one."""

    def __init__(self, keys: np.ndarray, weight: np.ndarray, one: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.weight, self.one = keys[order], weight[order], one[order]

    def mixed(self, keys: np.ndarray, below: np.ndarray) -> np.ndarray:
        byte = (keys & np.uint64(255)).astype(np.int64)
        two = (((keys >> np.uint64(8)) & np.uint64(255)) << np.uint64(8) | (keys >> np.uint64(16)) & np.uint64(255)).astype(np.int64)
        out = np.empty_like(below)
        for j in range(8):
            at = np.searchsorted(self.keys, (two << 8) | (1 << j) | (byte >> (8 - j)))
            own = np.where((byte >> (7 - j)) & 1, self.one[at], 1 - self.one[at])
            out[:, j] = self.weight[at] * own + (1 - self.weight[at]) * below[:, j]
        return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) of whole groups of grams with equal latest three bytes, about CHUNK rows at a time, from rows sorted by group."""
    keys, n, held = [], [], 0
    for batch in batches:
        keys.append(batch.column("key").to_numpy().view(np.uint64))
        n.append(batch.column("n").to_numpy())
        held += batch.num_rows
        if held >= CHUNK:
            k, c = np.concatenate(keys), np.concatenate(n)
            near = (k >> np.uint64(8)) & np.uint64(0xFFFFFF)
            end = int(np.searchsorted(near, near[-1]))
            if end:
                yield k[:end], c[:end]
            keys, n, held = [k[end:]], [c[end:]], len(k) - end
    if held:
        yield np.concatenate(keys), np.concatenate(n)


def _built(depth: int):
    """From sorted grams: kind 0, a row per gram with its eight mixed predictions, and kind 1, what nodes of depth 2 get of their children."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "key", "p", "zeros", "ones", "weighted"]
        for keys, n in _groups(batches):
            mixed, nodes = _tree(keys, n, depth, 3)
            for k in range(0, len(keys), 50_000):
                part = np.ascontiguousarray(mixed[k : k + 50_000])
                m = len(part)
                binary = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer((np.arange(m + 1) * 64).astype(np.int32)), pa.py_buffer(part)])
                none = pa.nulls(m, pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.array(keys[k : k + 50_000].view(np.int64)), binary, none, none, none], names=names)
            above, sums = [], []
            for j, (own, zeros, ones, weighted) in nodes.items():
                above.append((((own >> np.uint64(8 + j)) << np.uint64(8)) | np.uint64(1 << j) | (own & np.uint64((1 << j) - 1))).view(np.int64))
                sums.append(np.stack([zeros, ones, weighted]))
            found, where = np.unique(np.concatenate(above), return_inverse=True)
            out = [np.bincount(where, v, len(found)) for v in np.concatenate(sums, axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(found), np.int32)), pa.array(found), pa.nulls(len(found), pa.binary()), *(pa.array(v) for v in out)], names=names)

    return run


def _second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of depth 2: their weight against their children, their estimate for a one, and their own weighted probability."""
    for batch in batches:
        zeros, ones, children = (batch.column(c).to_numpy() for c in ("zeros", "ones", "weighted"))
        kt = log_kt(zeros, ones)
        weight = 1 / (1 + np.exp(np.clip(children - kt, -700, 700)))
        weighted = np.logaddexp(kt, children) + math.log(0.5)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(weight), pa.array((ones + 0.5) / (zeros + ones + 1)), batch.column("zeros"), batch.column("ones"), pa.array(weighted)], names=["key", "weight", "one", "zeros", "ones", "weighted"])


def gram_table(counts: DataFrame, depth: int) -> DataFrame:
    """(key, log10 of the probability of the gram's byte after its context) from (key, n); depth is 3 at least."""
    dealt = counts.withColumn("near", F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(0xFFFFFF)))
    dealt = dealt.repartition(F.col("near")).sortWithinPartitions("near").select("key", "n")
    built = stored(dealt.mapInArrow(_built(depth), "kind int, key long, p binary, zeros double, ones double, weighted double"), "tree")
    second = built.filter("kind = 1").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")))
    second = stored(second.mapInArrow(_second, "key long, weight double, one double, zeros double, ones double, weighted double"), "second")
    sums = np.zeros((256, 256, 3))
    first = second.groupBy(F.shiftright("key", 16).alias("x"), F.col("key").bitwiseAND(F.lit(255)).alias("y"))
    for r in first.agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("weighted")).collect():  # 65,280 rows at most
        sums[r["x"], r["y"]] = r["zeros"], r["ones"], r["weighted"]
    nodes = second.select("key", "weight", "one").toArrow()  # 24 bytes a row, 2^24 rows at most
    upper = counts.sparkSession.sparkContext.broadcast((Second(*(nodes.column(c).to_numpy() for c in ("key", "weight", "one"))), Root(sums)))

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second, root = upper.value
        for batch in batches:
            if batch.num_rows:
                keys = batch.column("key").to_numpy().view(np.uint64)
                p = batch.column("p")
                at = np.frombuffer(p.buffers()[1], np.int32)[p.offset]
                below = np.frombuffer(p.buffers()[2], np.float64, 8 * len(p), int(at)).reshape(-1, 8)
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(root.log10(keys, second.mixed(keys, below)))], names=["key", "v"])

    table = stored(built.filter("kind = 0").select("key", "p").mapInArrow(logs, "key long, v double"), "logs")
    upper.destroy()
    return table


def _packed(most: int):
    """From sorted rows of (key, v): a row of bytes for each `most` of them or somewhat more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def row() -> pa.RecordBatch:
            columns = [np.concatenate([x.column(c).to_numpy() for x in held]).tobytes() for c in ("key", "v")]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in columns], names=["keys", "values"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= most:
                yield row()
                held.clear()
        if held:
            yield row()

    return run


def _sent(table: DataFrame) -> list[Broadcast]:
    """(keys, values) of a table of (key, v) in broadcasts of about SENT rows, by ascending keys; one partition at a time is in the driver."""
    sc = table.sparkSession.sparkContext
    dealt = table.repartitionByRange(max(1, math.ceil(table.count() / SENT)), "key").sortWithinPartitions("key")
    # a partition is one piece, as a rule: ranges are cut by a sample
    pieces = dealt.mapInArrow(_packed(2 * SENT), "keys binary, values binary").toLocalIterator()
    return [sc.broadcast((np.frombuffer(r["keys"], np.int64), np.frombuffer(r["values"], np.float64))) for r in pieces]


class _Lookup:
    """Values by key, and whether the key is there; 0 for a key that isn't. pieces: what _sent() gives."""

    def __init__(self, pieces: list[Broadcast]) -> None:
        self.pieces = pieces

    def __call__(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, distinct = pd.factorize(wanted.view(np.int64))
        order = np.argsort(distinct)  # a search in order stays in the caches
        asked = distinct[order]
        values, there = np.zeros(len(asked)), np.zeros(len(asked), bool)
        for piece in self.pieces:
            keys, v = piece.value
            start, end = np.searchsorted(asked, keys[0]), np.searchsorted(asked, keys[-1], "right")
            at = np.searchsorted(keys, asked[start:end])
            found = keys[at] == asked[start:end]
            there[order[start:end]] = found
            values[order[start:end]] = np.where(found, v[at], 0.0)
        return values[codes], there[codes]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs, each added by itself, so that a text's sum doesn't depend on its neighbours."""
    at = np.cumsum(counts) - counts
    out = np.zeros(len(counts))
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, at[some])
    return out


class _Rare:
    """Of a run of documents, the keys that the broadcast tables don't have: each distinct one once, and per document its places among them."""

    def __init__(self, run: int) -> None:
        self.run, self.held, self.docs = run, 0, []
        self.keys: tuple[list, list] = ([], [])
        self.sizes: tuple[list, list] = ([], [])

    def add(self, docs: list[pa.Array], missing: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """docs: the columns but the places; missing: for grams and for words the keys in order, and how many each document has."""
        self.docs.append(docs)
        for which, (keys, sizes) in enumerate(missing):
            self.keys[which].append(keys)
            self.sizes[which].append(sizes)
            self.held += len(keys)
        self.held += len(docs[0])

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Kinds 0 and 1, a row per distinct gram and word with its place, and kind 2, a row per document."""
        places = []
        for which in (0, 1):
            found, at = np.unique(np.concatenate(self.keys[which]), return_inverse=True)
            for k in range(0, len(found), 50_000):
                keys = found[k : k + 50_000].view(np.int64)
                own = {"kind": np.full(len(keys), which, np.int32), "run": np.full(len(keys), self.run), "key": keys, "place": np.arange(k, k + len(keys), dtype=np.int32)}
                yield _batch(schema, len(keys), {c: pa.array(v) for c, v in own.items()})
            places.append((at.astype(np.int32), np.concatenate([[0], np.cumsum(np.concatenate(self.sizes[which]))])))
        start = 0
        for docs in self.docs:
            n = len(docs[0])
            own = {"kind": pa.array(np.full(n, 2, np.int32)), "run": pa.array(np.full(n, self.run)), **dict(zip(schema.names[4:-2], docs, strict=True))}
            for name, (at, ends) in zip(schema.names[-2:], places, strict=True):
                own[name] = pa.array([at[x:y].tobytes() for x, y in zip(ends[start : start + n], ends[start + 1 : start + n + 1], strict=True)], pa.binary())
            yield _batch(schema, n, own)
            start += n


def _batch(schema: pa.Schema, n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The columns in the schema's order, nulls for those that are lacking."""
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _common(known: DataFrame, most: int) -> Column:
    """Which rows of known (key, parts) are among the about `most` that the most partitions hold; ties by hash."""
    parts = F.least(F.col("parts"), F.lit(4096))
    hist = dict(known.groupBy(parts.alias("parts")).count().collect())  # 4,096 rows at most
    for n in sorted(hist, reverse=True):
        if hist[n] > most:
            return (parts > n) | (parts == n) & (F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(most / hist[n] * (1 << 20)))
        most -= hist[n]
    return F.lit(True)


def score(docs: DataFrame, text: str = "text", id_col: str = "doc_id", divisor: int = 7, held_out: int = 2, depth: int = DEPTH, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    out_of = remainder(F.col(id_col), divisor) == held_out
    source = docs.select(F.col(id_col).alias("doc_id"), (~out_of).alias("training"), text_of(text).alias("text"))
    with scratch(spark) as own:
        counted = source.select("training", "text").mapInArrow(_counting(depth), "kind int, key long, n long").groupBy("kind", "key")
        counted = stored(counted.agg(F.sum("n").alias("n"), F.count("*").alias("parts")), "counts")
        seen = counted.filter("kind = 0")
        table = gram_table(seen.select("key", "n"), depth)
        words = counted.filter("kind = 1 and n > 0").select(F.lit(1).alias("kind"), "key", F.col("n").cast("double").alias("v"), "parts")
        n_words, sum_words = words.agg(F.count("*"), F.coalesce(F.sum("v"), F.lit(0)).cast("long")).first()
        whole = n_words + seen.count() <= broadcast_rows
        with_parts = table.withColumn("parts", F.lit(0).cast("long")) if whole else table.join(seen.select("key", "parts"), "key")
        known = with_parts.select(F.lit(0).alias("kind"), "key", "v", "parts").unionByName(words)
        if not whole:
            known = own.kept(known, "known")
        # about broadcast_rows rows of 16 bytes
        common = F.lit(True) if whole else _common(known, broadcast_rows)
        by_gram, by_word = (_Lookup(_sent(known.filter(common & (F.col("kind") == k)).select("key", "v"))) for k in (0, 1))
    ends = source.filter("training").count()
    total, distinct = sum_words + ends, n_words + (ends > 0)
    least = -math.log10(total + distinct + 1)
    log_end = math.log10(ends + 1) + least if total else 0.0

    def base(c: np.ndarray) -> np.ndarray:
        return np.log10(c + 1.0) + least if total else np.zeros(len(c))

    def scored(texts: pa.RecordBatch) -> tuple[list[pa.Array], list[tuple[np.ndarray, np.ndarray]]]:
        """The result's columns as far as the broadcast tables have the keys; of grams and words the keys that they don't have, and how many each text has of them."""
        g, n_g = grams(texts.column("text"), depth)
        w, n_w = tokens(texts.column("text"))
        logs, has_g = by_gram(g)
        c, has_w = by_word(w)
        has = np.full(len(w), True) if whole else has_w
        missing = [] if whole else [(keys[~x], np.bincount(np.repeat(np.arange(len(n)), n)[~x], minlength=len(n))) for keys, x, n in ((g, has_g, n_g), (w, has_w, n_w))]
        known = _sums((c > 0).astype(float), n_w).astype(np.int64) + (ends > 0)
        return [texts.column("doc_id"), pa.array(n_w + 1), pa.array(known), pa.array(_sums(np.where(has, base(c), 0), n_w) + log_end), pa.array(_sums(logs, n_g)), pa.array(n_g - 1)], missing

    names = ["doc_id", "n_tokens", "n_known", "base_score", "score", "n_bytes"]
    result = f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, n_bytes long"
    if whole:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in b.pieces(batch, "text", _PIECE):
                    yield pa.RecordBatch.from_arrays(scored(piece)[0], names=names)

        out = source.select("doc_id", "text").mapInArrow(run, result)
    else:
        # Texts stay where they are: each run of documents asks once for every key that isn't broadcast, and gets its values.
        names_of_places = ["grams", "words"]
        asked = f"kind int, run long, key long, place int, {result}, grams binary, words binary"
        schema = to_arrow_schema(StructType.fromDDL(asked))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = TaskContext.get().partitionId() << 32
            rare = _Rare(first)
            for batch in batches:
                for piece in b.pieces(batch, "text", _PIECE):
                    rare.add(*scored(piece))
                    if rare.held >= RUN:
                        yield from rare.rows(schema)
                        rare = _Rare(rare.run + 1)
            if rare.docs:
                yield from rare.rows(schema)

        parts = stored(source.select("doc_id", "text").mapInArrow(partial, asked), "partial")
        wanted = parts.filter("kind < 2").select("kind", "key", F.col("run").alias("asker"), F.col("place").alias("at"))
        met = wanted.join(known.filter(~common).select("kind", "key", "v"), ["kind", "key"]).select("asker", F.col("kind").alias("which"), "at", "v")

        def complete(texts: pa.Table, values: pa.Table) -> pa.Table:
            kinds, place, v = (values.column(c).to_numpy() for c in ("which", "at", "v"))
            sums = []
            for which, name in enumerate(names_of_places):
                of = kinds == which
                lists = [np.frombuffer(x, np.int32) for x in texts.column(name).to_pylist()]
                at = np.concatenate(lists)
                by_place = np.zeros(max(at.max(initial=-1), place[of].max(initial=-1)) + 1)
                by_place[place[of]] = v[of]
                sums.append((by_place[at], np.array([len(x) for x in lists], np.int64)))
            (logs, n_g), (c, n_w) = sums
            more = {"n_known": _sums((c > 0).astype(float), n_w).astype(np.int64), "base_score": _sums(base(c), n_w), "score": _sums(logs, n_g)}
            return pa.Table.from_arrays([pa.array(texts.column(x).to_numpy() + more[x]) if x in more else texts.column(x) for x in names], names=names)

        out = parts.filter("kind = 2").select("run", *names, *names_of_places).groupBy("run").cogroup(met.groupBy("asker")).applyInArrow(complete, result)
    return out.select(
        "doc_id", (remainder(F.col("doc_id"), divisor) == held_out).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes",
        (-F.col("score") * math.log2(10) / F.greatest(F.col("n_bytes") + 1, F.lit(1))).alias("bits_per_byte"),
    )
