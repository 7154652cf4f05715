"""Benchmark decontamination by winnowing (native: DataFrame expressions only).

A text's k-gram hashes are thinned to the minimum of every sliding window of
w = 10 - k + 1 hashes. Any 10 words that a document shares with an item give the
same choice on both sides, so a join of the thin fingerprints finds every such
span; each hit is then extended word by word along its diagonal, which also
removes hash collisions. The result is exact.

Items of fewer than 10 words are one window each: all their hashes of that
length are joined, no hash is thinned.

Plan: one scan thins all documents and joins the fingerprints of the items
(broadcast behind a check of their number, else shuffled); only documents with a
hit are read again for the extension. No text is shuffled on the first pass.

Defined cases: a null or empty text has no words and no hits; an item without
words never occurs; repeated document rows get one result each, repeated items
count once; a null item id counts as the empty string; with no items at all
nothing is contaminated.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import scratch, stored, text_of

K = 5
SPAN = 10
#: Rows up to which fingerprints, or keys of documents with hits, are broadcast.
BROADCAST_ROWS = 2_000_000
_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def item_words(text: Column) -> Column:
    """Array of the words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. text must be a column that stands by itself."""
    lower = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.split(lower, _GAP)


def _trimmed(parts: str) -> Column:
    """Without the empty string that a gap leaves at either end."""
    first = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
    last = F.when((F.size(parts) > 1) & (F.get(parts, F.size(parts) - 1) == ""), 1).otherwise(0)
    return F.slice(F.col(parts), first + 1, F.greatest(F.size(parts) - first - last, F.lit(0)))


def with_words(df: DataFrame, text: str, *keep: Column | str) -> DataFrame:
    """The columns to keep and w, the array of words."""
    df = df.select(*keep, text_of(text).alias("t"))
    names = df.columns[:-1]
    df = df.select(*names, item_words(F.col("t")).alias("parts"))
    return df.select(*names, _trimmed("parts").alias("w"))


def _grams(n: int, hashes: str = "h") -> Column:
    """Hashes of all runs of n words."""
    return F.when(F.size(hashes) < n, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(n))))
    )


def _located(n: int) -> Column:
    return F.transform(f"g{n}", lambda x, i: F.struct(F.lit(n).alias("len"), x.alias("hash"), i.alias("pos")))


def fingerprints(df: DataFrame, short: list[int]) -> DataFrame:
    """df with w replaced by n_words and f: (length, hash, position) of the winnowed k-grams, and of all runs of the short lengths."""
    names = [c for c in df.columns if c != "w"]
    window = SPAN - K + 1
    df = df.select(*names, F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    df = df.select(*names, "h", _grams(K).alias("g"))
    df = df.select(
        *names,
        "h",
        "g",
        F.when(F.size("g") < window, F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.sequence(F.lit(0), F.size("g") - window), lambda i: F.least(*(F.get("g", i + j) for j in range(window)))))
        .alias("m"),
    )
    # chosen where it is the least of some window: the greatest of the windows' minima around it
    chosen = F.when(F.size("m") == 0, F.array().cast("array<int>")).otherwise(
        F.filter(F.sequence(F.lit(0), F.size("g") - 1), lambda j: F.get("g", j) == F.greatest(*(F.get("m", j - i) for i in range(window))))
    )
    df = df.select(*names, "h", "g", chosen.alias("c"))
    prints = [F.transform("c", lambda j: F.struct(F.lit(K + SPAN).alias("len"), F.get("g", j).alias("hash"), j.alias("pos")))]
    for n in short:
        df = df.withColumn(f"g{n}", _grams(n))
        prints.append(_located(n))
    return df.select(*names, F.size("h").alias("n_words"), (F.concat(*prints) if short else prints[0]).alias("f"))


def spans(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """One row per distinct (document id, text): doc_id, text_hash, n_words, starts (first words of hit windows and their lengths), item_ids."""
    its = with_words(items, item_text, F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.xxhash64(F.col(item_id), text_of(item_text)).alias("item_key"))
    its = stored(its.filter(F.size("w") > 0).dropDuplicates(["item", "w"]), "items")
    short = sorted(r[0] for r in its.filter(F.size("w") < SPAN).select(F.size("w")).distinct().collect())  # 9 lengths at most
    prints = fingerprints(its.select("item_key", F.size("w").alias("n_item"), "w"), short)
    prints = prints.select("item_key", "n_item", F.explode_outer("f").alias("f"))
    whole = F.col("f.len") == F.col("n_item")
    prints = prints.filter(F.when(F.col("n_item") < SPAN, whole).otherwise(F.col("f.len") == K + SPAN))
    prints = stored(prints.select("item_key", "n_item", F.col("f.len").alias("len"), F.col("f.hash").alias("hash"), F.col("f.pos").alias("q")), "prints")

    key = (F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text)).alias("text_hash"))
    mine = fingerprints(with_words(docs, text, *key), short)
    # One more entry per document, so that documents without hits stay. explode_outer, here and below: from explode
    # the optimiser infers a filter on the array, and copies all that computes it into that filter, level by level.
    rows = mine.select("doc_id", "text_hash", "n_words", F.explode_outer(F.concat(F.array(F.struct(F.lit(0).alias("len"), F.lit(None).cast("bigint").alias("hash"), F.lit(0).alias("pos"))), "f")).alias("f"))
    rows = rows.select("doc_id", "text_hash", "n_words", F.col("f.len").alias("len"), F.col("f.hash").alias("hash"), F.col("f.pos").alias("p"))
    if prints.count() <= BROADCAST_ROWS:
        prints = F.broadcast(prints)
    rows = rows.join(prints, ["len", "hash"], "left").filter((F.col("len") == 0) | F.col("item_key").isNotNull())
    found = rows.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("item_key").isNotNull(), F.struct("item_key", "n_item", (F.col("p") - F.col("q")).alias("diag")))).alias("cands"),
    )
    found = stored(found, "candidates")

    hit = found.filter(F.size("cands") > 0)
    source = docs.select(*key, text_of(text).alias("t"))
    keys = hit.select("doc_id", "text_hash")
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    a, b = source.alias("a"), keys.alias("b")
    source = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash")), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    worded = with_words(source, "t", "doc_id", "text_hash")
    a, b = worded.alias("a"), hit.alias("b")
    both = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash")))
    both = both.select("a.doc_id", "a.text_hash", "a.w", "b.cands")
    # of the document, only the words that lie along each item
    both = both.select(
        "doc_id",
        "text_hash",
        F.explode_outer(
            F.transform(
                "cands",
                lambda c: F.struct(
                    c["item_key"].alias("item_key"),
                    F.greatest(c["diag"], F.lit(0)).alias("start"),
                    F.greatest(-c["diag"], F.lit(0)).alias("from"),
                    F.slice("w", F.greatest(c["diag"], F.lit(0)) + 1, F.greatest(c["n_item"] - F.greatest(-c["diag"], F.lit(0)), F.lit(0))).alias("dw"),
                ),
            )
        ).alias("c"),
    ).select("doc_id", "text_hash", "c.*")
    both = both.join(its.select("item_key", "item", F.col("w").alias("iw")), "item_key")
    span = F.least(F.lit(SPAN), F.size("iw"))
    room = F.size("dw") - span
    starts = F.when(room < 0, F.array().cast("array<int>")).otherwise(
        F.filter(F.sequence(F.lit(0), room), lambda i: F.slice("dw", i + 1, span) == F.slice("iw", F.col("from") + i + 1, span))
    )
    both = both.select("doc_id", "text_hash", "item", "start", span.alias("span"), starts.alias("s")).filter(F.size("s") > 0)
    both = both.select("doc_id", "text_hash", "item", F.transform("s", lambda i: F.struct((i + F.col("start")).alias("at"), F.col("span").alias("span"))).alias("s"))
    both = both.groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("starts"), F.array_sort(F.collect_set("item")).alias("item_ids"))
    a, b = found.drop("cands").alias("a"), both.alias("b")
    return a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash")), "left").select("a.*", "b.starts", "b.item_ids")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of spans()."""
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s["at"], s["at"] + s["span"] - 1)))))
    n_hit = F.when(F.col("starts").isNull(), 0).otherwise(hit).cast("long")
    return found.select(
        "doc_id",
        "text_hash",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        ids.alias("item_ids"),
    )


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids."""
    with scratch(docs.sparkSession) as own:
        found = own.kept(digest(spans(docs, items, text, id_col, item_text, item_id)), "contamination")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text)).alias("text_hash"))
    a, b = rows.alias("a"), found.alias("b")
    return a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash"))).select("a.doc_id", *(f"b.{c}" for c in found.columns if c not in ("doc_id", "text_hash")))


def clean(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The document rows, all columns, without those that hold a window of an item."""
    with scratch(docs.sparkSession) as own:
        found = digest(spans(docs, items, text, id_col, item_text, item_id)).filter("contaminated")
        found = own.kept(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "contaminated")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    a, b = docs.alias("a"), found.alias("b")
    return a.join(b, F.col(f"a.{id_col}").eqNullSafe(F.col("b._id")) & (F.xxhash64(text_of(F.col(f"a.{text}"))) == F.col("b._hash")), "left_anti")
