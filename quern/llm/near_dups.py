"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A document is the set of its 5-word shingles (lower-cased A-Z, words between
blanks), and again the same set weighted 1 + log(occurrences), so that a repeated
line counts more, but not as often as it is repeated. ProbMinHash of both: every shingle
sends arrivals of a Poisson process of its weight to random registers; a
register keeps the shingle that arrives first, and a shingle stops as soon as
its next arrival is later than every register's. Two registers agree with the
probability Jaccard similarity of the documents.

Equal texts become one node. Nodes that agree in a band of registers fall into a
bucket. A bucket isn't expanded into its pairs:

1. Every member is compared with the bucket's hub h, the member that meets most
   others over all bands; of edited copies that is as a rule the original. Only the
   shingles in which it differs from h, D(x), are kept.
2. Two members x, y of one hub may be similar to each other and not both to h.
   With r = (1 - t) / (1 + t), J(x, y) >= t holds exactly if D(x) and D(y) share
   at least (e(x) + e(y)) / 2 shingles, where e(x) = |D(x)| - r |x|. That number
   is above 0 for such pairs: copies that are too far from h can only be near
   each other where they differ from h in the same way. So the shingles of each
   D, rarest within the hub's group first, are offered as a prefix filter, and
   two members meet only where, at the places of the shared shingle, as many are
   left on either side. Edits made at random meet nowhere. Members that meet are
   compared with one of those that share the shingle, and then, where components
   still differ, with each other.

So no pair of the LSH candidates with Jaccard similarity t or more is lost to the
classes, and the work follows the differences, not the square of a group. Every
link is verified exactly, by the sizes of the sets and of what D(x) and D(y) share.
Classes are the connected components, found by label propagation with pointer
jumping over tables in the shared folder. Texts leave their rows once, as sets of
shingles; hubs of many members are dealt out by a salt.

The registers of the plain set agree with the very similarity that decides a link,
so 24 bands of 5 of them miss a pair at 0.8 with probability 8e-5, above it less,
however often passages repeat. The 24 bands of the weighted set are offered besides,
where any shingle repeats (else both are the same); they can only add candidates.
A pair that is similar by the weighted measure alone is compared and not linked.

Defined cases: a text of fewer than 5 words is one shingle of all its words; a
text without words (null and empty alike) equals only equal texts; repeated rows
fall into one class; a null id is no class's id unless all its ids are null; texts of any
length are compared whole; of rows of different texts with the least id, the least digest
stands for the class; columns other than id and text aren't looked at, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import bytes_np as b
from quern.llm.common import scratch, stored, text_of

SHINGLE, BANDS, ROWS, THRESHOLD = 5, 24, 5, 0.8
#: Rows up to which keys are broadcast.
BROADCAST_ROWS = 1_000_000
#: Members of a hub in one task of their comparison with it.
HUB_ROWS = 500
#: For sums of doubles.
_SLACK = 1e-6
_STEP = np.random.Generator(np.random.Philox(77)).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: pa.Array, k: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct shingles (64-bit hashes, ascending) and how often each occurs."""
    data, offsets = b.raw(texts)
    starts, ends, counts = b.words(data, offsets)
    hashes = b.span_hashes(data, starts, ends)
    total = np.concatenate([[0], np.cumsum(counts)])
    n = max(0, len(hashes) - k + 1)
    runs = np.zeros(n, np.uint64)
    for j in range(k):
        runs += hashes[j : j + n] * _STEP[j]
    runs = b.mix(runs)
    out = []
    for i, c in enumerate(counts):
        s = total[i]
        if c >= k:
            out.append(np.unique(runs[s : s + c - k + 1], return_counts=True))
        elif c:
            short = b.mix((hashes[s : s + c] * _STEP[:c]).sum(dtype=np.uint64, keepdims=True) + np.uint64(c))
            out.append((short, np.ones(1, np.int64)))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return out


def sketch(keys: np.ndarray, weights: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash signature of a weighted set that isn't empty."""
    at = np.full(m, np.inf)
    who = np.zeros(m, np.uint64)
    active, base, round_ = np.arange(len(keys)), np.zeros(len(keys)), 0
    while len(active):
        # some arrivals at once, so that small sets fill the registers in few rounds
        many = int(min(256, max(1, -(-2 * m // len(active)))))
        seeds = (np.arange(round_, round_ + many, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
        mine = keys[active]
        bits = b.mix(mine[:, None] + seeds[None, :])
        gaps = -np.log1p(-(bits >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        times = base[active][:, None] + np.cumsum(gaps, axis=1) / weights[active][:, None]
        register = (b.mix(bits ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(m)).astype(np.int64)
        flat, slots = times.ravel(), register.ravel()
        np.minimum.at(at, slots, flat)
        won = flat == at[slots]
        who[slots[won]] = np.repeat(mine, many)[won]
        base[active] = times[:, -1]
        active = active[times[:, -1] < at.max()]
        round_ += many
    return who


def bands(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS)
    return b.mix((rows * _STEP[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def buckets(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bands of the plain set, and those of the weighted set that differ from them; the band's number is part of each hash."""
    plain = bands(sketch(keys, np.ones(len(keys))))
    if (counts == 1).all():
        return plain
    weighted = bands(sketch(keys, 1 + np.log(counts)))
    return np.concatenate([plain, weighted[weighted != plain]])


def _key(text: str) -> Column:
    """128 bits of a strong digest of the text."""
    return F.unhex(F.substring(F.sha2(text_of(text), 256), 1, 32))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in b.pieces(batch, "text"):
            out = [buckets(k, w).view(np.int64) if len(k) else np.zeros(0, np.int64) for k, w in shingles(piece.column("text"))]
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32), np.concatenate(out))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("key"), lists], names=["doc_id", "key", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in b.pieces(batch, "text"):
            sets = [k for k, _ in shingles(piece.column("text"))]
            yield pa.RecordBatch.from_arrays([piece.column("key"), pa.array([x.tobytes() for x in sets], pa.binary())], names=["key", "set"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of members, which follow their hub (whose b is null): the sizes of both sets and the shingles that one of them alone has."""
    hub = np.zeros(0, np.uint64)
    for batch in batches:
        for piece in b.pieces(batch, "set"):
            at, sizes, diffs = [], [], []
            for i, (key, value) in enumerate(zip(piece.column("b"), piece.column("set"), strict=True)):
                own = np.frombuffer(value.as_buffer(), np.uint64)
                if not key.is_valid:
                    hub = own.copy()
                    continue
                at.append(i)
                sizes.append((len(hub), len(own)))
                diffs.append(np.setxor1d(hub, own, assume_unique=True).view(np.int64))
            if at:
                members, sizes = piece.take(pa.array(at)), np.array(sizes, np.int64)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in diffs])]).astype(np.int32), np.concatenate(diffs))
                yield pa.RecordBatch.from_arrays([members.column("a"), members.column("b"), pa.array(sizes[:, 0]), pa.array(sizes[:, 1]), lists], names=["a", "b", "size_a", "size", "diff"])


def _is_link(sizes: Column, apart: Column, threshold: float) -> Column:
    """Whether two sets are similar, from the sum of their sizes and the number of shingles that one of them alone has."""
    return (sizes - apart) / (sizes + apart) >= threshold


def components(links: DataFrame) -> DataFrame:
    """(key, label) of all keys in links (a, b): label is the least key of the component."""
    with scratch(links.sparkSession) as own:
        ends = links.select(F.col("a").alias("key"), F.col("b").alias("other"))
        ends = stored(ends.union(ends.select("other", "key")).distinct(), "ends")
        labels = ends.groupBy("key").agg(F.least(F.min("other"), F.col("key")).alias("label"))
        labels = stored(labels, "labels")
        while True:
            near = ends.join(labels.select(F.col("key").alias("other"), F.col("label").alias("l")), "other").groupBy("key").agg(F.min("l").alias("l"))
            step = labels.join(near, "key").select("key", F.col("label").alias("was"), F.least("label", "l").alias("label"))
            jump = labels.select(F.col("key").alias("label"), F.col("label").alias("l2"))
            step = stored(step.join(jump, "label", "left").select("key", "was", F.least("label", F.coalesce("l2", "label")).alias("label")), "labels")
            if step.filter(F.col("was") != F.col("label")).isEmpty():
                return own.kept(step.select("key", "label"), "components")
            labels = step.select("key", "label")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after links (a, b) joined some components; a key without a label is its own."""
    ends = links
    for x in "ab":
        ends = ends.join(labels.select(F.col("key").alias(x), F.col("label").alias(f"l{x}")), x, "left").withColumn(f"l{x}", F.coalesce(f"l{x}", x))
    joined = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")).filter("a != b").distinct())
    known = labels.select("key", "label").unionByName(joined.select("key", F.col("key").alias("label"))).dropDuplicates(["key"])
    joined = joined.select(F.col("key").alias("label"), F.col("label").alias("new"))
    return stored(known.join(joined, "label", "left").select("key", F.coalesce("new", "label").alias("label")), "labels")


def _offers(first: DataFrame, ratio: float) -> DataFrame:
    """(hub, shingle, key, e, reach, near, size_d): the prefixes of the differences with a hub, for hubs with a member that isn't linked to them.

    A pair can be a link only if, at a shingle that both offer, the e of each is at most the reach of the other.
    """
    held = first.select(F.col("a").alias("hub"), F.col("b").alias("key"), "near", "diff", F.size("diff").alias("size_d"), (F.size("diff") - ratio * F.col("size")).alias("e"))
    far = F.when(~F.col("near"), F.col("e"))
    groups = held.groupBy("hub").agg(F.count("*").alias("n"), F.min("e").alias("least"), F.min(far).alias("least_far"))
    held = held.join(groups.filter("n > 1 and least_far is not null").drop("n"), "hub")
    tokens = held.select("hub", "key", "near", "size_d", "e", F.when(F.col("near"), F.col("least_far")).otherwise(F.col("least")).alias("partner"), F.explode_outer("diff").alias("shingle"))
    tokens = stored(tokens.filter(F.col("shingle").isNotNull()), "tokens")
    # only what several members hold, one of them apart from the hub, can bring two together; the others come first in the order
    often = tokens.groupBy("hub", "shingle").agg(F.count("*").alias("held"), F.min("near").alias("all_near"))
    often = tokens.join(often.filter("held > 1"), ["hub", "shingle"])
    order = Window.partitionBy("hub", "key").orderBy("held", "shingle")
    whole = Window.partitionBy("hub", "key")
    place = F.col("size_d") - F.count("*").over(whole) + F.row_number().over(order) - 1
    placed = often.withColumn("reach", 2.0 * (F.col("size_d") - place) - F.col("e"))
    return placed.filter((F.col("reach") >= F.col("partner") - _SLACK) & ~F.col("all_near")).select("hub", "shingle", "key", "near", "e", "reach", "size_d")


def classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row: doc_id, key (digest of the text), class_id (the least id of its class), class_key (the text that has it)."""
    with scratch(docs.sparkSession) as own:
        return own.kept(_classes(docs, text, id_col, threshold), "classes")


def _classes(docs: DataFrame, text: str, id_col: str, threshold: float) -> DataFrame:
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), _key(text).alias("key"), text_of(text).alias("text"))
    mine = stored(source.mapInArrow(_signatures, "doc_id long, key binary, bands array<long>"), "signatures")
    rows = mine.groupBy("key").agg(F.first("bands").alias("bands")).select("key", F.explode("bands").alias("hash"))
    shared = rows.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(rows.join(shared, "hash"), "members")
    weights = stored(members.groupBy("key").agg(F.sum("n").alias("weight")), "weights")
    hubs = members.join(weights, "key").groupBy("hash").agg(F.max(F.struct("weight", "key")).alias("top")).select("hash", F.col("top.key").alias("a"))
    pairs = stored(members.join(hubs, "hash").filter("key != a").select("a", F.col("key").alias("b")).distinct(), "pairs")

    needed = weights.select("key")
    if needed.count() <= BROADCAST_ROWS:
        needed = F.broadcast(needed)
    texts = source.join(needed, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    sets = stored(texts.mapInArrow(_sets, "key binary, set binary"), "sets")
    # a hub of many members has as many rows as it takes, so that no task gets all of them
    salts = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_ROWS).alias("salts")).filter("salts > 1"), "salts")
    if salts.count() <= BROADCAST_ROWS:
        salts = F.broadcast(salts)
    hubs = pairs.select("a").distinct().join(salts, "a", "left").join(sets.select(F.col("key").alias("a"), "set"), "a")
    hubs = hubs.select("a", F.explode_outer(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"), F.lit(None).cast("binary").alias("b"), "set")
    met = pairs.join(salts, "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).alias("salt"), "b")
    met = met.join(sets.select(F.col("key").alias("b"), "set"), "b").select("a", "salt", "b", "set")
    # each hub's set goes ahead of its members' and along with them once
    met = hubs.unionByName(met).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    first = met.select("a", "b", "set").mapInArrow(_compared, "a binary, b binary, size_a long, size long, diff array<long>")
    first = stored(first.withColumn("near", _is_link(F.col("size_a") + F.col("size"), F.size("diff"), threshold)), "first")
    labels = components(first.filter("near").select("a", "b"))

    offers = stored(_offers(first, (1 - threshold) / (1 + threshold)), "offers")
    for step in ("one", "all"):
        if offers.isEmpty():
            break
        labelled = offers.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
        far = F.when(~F.col("near"), F.struct("size_d", "key", "label", "e", "reach"))
        mixed = labelled.groupBy("hub", "shingle").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.min(far).alias("top")).filter("l1 != l2 and top is not null")
        x = labelled.alias("x")
        if step == "one":
            y = mixed.select("hub", "shingle", "top.*", F.lit(False).alias("near")).alias("y")
        else:
            x, y = (stored(labelled.join(mixed.select("hub", "shingle"), ["hub", "shingle"]), "mixed").alias(v) for v in "xy")
        met = (F.col("x.hub") == F.col("y.hub")) & (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.label") != F.col("y.label"))
        met = met & (F.col("x.e") <= F.col("y.reach") + _SLACK) & (F.col("y.e") <= F.col("x.reach") + _SLACK) & ~(F.col("x.near") & F.col("y.near"))
        if step == "all":
            met = met & (F.col("x.key") < F.col("y.key"))
        ends = (F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"))
        found = stored(x.join(y, met).groupBy(*ends).agg(F.min("x.hub").alias("hub")), "met")
        # what two differences with one hub share tells how similar the members are
        for side in "ab":
            member = first.select(F.col("a").alias("hub"), F.col("b").alias(side), F.col("diff").alias(f"diff_{side}"), F.col("size").alias(f"size_{side}"))
            found = found.join(member, ["hub", side])
        apart = F.size("diff_a") + F.size("diff_b") - 2 * F.size(F.array_intersect("diff_a", "diff_b"))
        links = stored(found.filter(_is_link(F.col("size_a") + F.col("size_b"), apart, threshold)).select("a", "b"), "links")
        if not links.isEmpty():
            labels = _merged(labels, links)
    nodes = mine.groupBy("key").agg(F.min("doc_id").alias("first")).join(labels, "key", "left")
    nodes = stored(nodes.select("key", "first", F.coalesce("label", "key").alias("label")), "nodes")
    # the least id stands for the class, with the least text where rows of several texts have it
    top = nodes.groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "key")).alias("top"))
    named = nodes.join(top, "label").select("key", F.col("top.first").alias("class_id"), F.col("top.key").alias("class_key"))
    return mine.select("doc_id", "key").join(named, "key")


def deduplicated(docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The document rows, all columns, one of each class: that with its class's id and text."""
    found = classes(docs, text, id_col, threshold)
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key"))
    gone = found.filter(~stays).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    kept = docs.alias("a").join(gone.alias("g"), F.col(f"a.{id_col}").cast("long").eqNullSafe(F.col("g._id")) & (_key(f"a.{text}") == F.col("g._key")), "left_anti")
    repeated = found.filter(stays).groupBy("doc_id", "key").count().filter("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates([id_col, text])
