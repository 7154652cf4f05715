import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quern.llm import near_dups as n


def probability_jaccard(a, b):
    keys = set(a) & set(b)
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in set(a) | set(b)) for i in keys)


def test_registers_agree_as_often_as_they_should():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 2**63, 60, dtype=np.uint64)
    a = {int(k): float(w) for k, w in zip(keys[:40], rng.integers(1, 6, 40), strict=True)}
    b = {int(k): float(w) for k, w in zip(keys[15:], rng.integers(1, 6, 45), strict=True)}
    signature = lambda s: n.sketch(np.array(list(s), np.uint64), np.array(list(s.values())), m=6000)
    assert abs((signature(a) == signature(b)).mean() - probability_jaccard(a, b)) < 0.03
    twice = {k: 2 * w for k, w in a.items()}
    assert (signature(a) == signature(twice)).all()  # only shares matter
    assert len(set(n.sketch(np.array([7], np.uint64), np.array([1.0])))) == 1


def test_shingles():
    got = n.shingles(pa.array(["a b c d e f", "A  b\nc d E", "a b", "", None, "a b c d e a b c d e"]))
    assert [len(k) for k, _ in got] == [2, 1, 1, 0, 0, 5] and got[0][0].tolist().count(got[1][0][0]) == 1
    assert got[5][1].tolist().count(2) == 1


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**9)}"
    return " ".join(w)


def brute(rows, threshold=0.8):
    words = {i: tuple(re.findall(r"[^\x20\x09-\x0d]+", (t or "").lower())) for i, t in rows}
    sets = {i: (set(zip(*(w[k:] for k in range(5)), strict=False)) or {w}) if w else {("none", t or "")} for (i, t), w in zip(rows, words.values(), strict=True)}
    label = {i: i for i, _ in rows}
    for i, _ in rows:
        for j, _ in rows:
            if i < j and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    return label


def test_classes_against_brute_force(spark, make_docs, prose):
    rng = random.Random(6)
    base = prose(1, 200)
    # copies that are near the original and copies that are only near each other
    texts = [base] + [edited(rng, base, rng.choice((1, 2, 3, 4, 6, 9))) for _ in range(60)]
    far = edited(rng, base, 12)
    texts += [far] + [edited(rng, far, 1) for _ in range(5)]
    texts += [prose(k, 30) for k in range(10, 20)] * 2 + [None, "", "  ", "two words", "Two words", "x " * 500, "x " * 400, prose(3, 4000)]
    got = {r["doc_id"]: r["class_id"] for r in n.classes(make_docs(texts)).collect()}
    assert got == brute(list(enumerate(texts)))


def test_near_copies_whose_passages_repeat_unequally(spark, make_docs, prose):
    """Plain similarity 0.8 or more, a much lower weighted one; a hundred pairs of each kind, of which none may be missed."""
    rng, texts = random.Random(8), []
    for k in range(200):
        passage, rest = prose(1000 + k, 100), prose(5000 + k, 400)
        texts += [f"{passage} {rest}", f"{' '.join([passage] * (20, 100)[k % 2])} {edited(rng, rest, 8)}"]
    sets = [dict(zip(s.tolist(), (1 + np.log(c)).tolist(), strict=True)) for s, c in n.shingles(pa.array(texts))]
    plain = [len(a.keys() & b.keys()) / len(a.keys() | b.keys()) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert min(plain) >= 0.8 and probability_jaccard(sets[0], sets[1]) < 0.75 and probability_jaccard(sets[2], sets[3]) < 0.65
    got = {r["doc_id"]: r["class_id"] for r in n.classes(make_docs(texts)).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_one_of_each_class_stays(spark, make_docs, prose):
    docs = make_docs([prose(1, 50), prose(1, 50), prose(2, 50), None, "", prose(2, 50)], ids=[4, 3, 9, 10, 11, 9]).withColumn("key", F.lit("k")).withColumn("class_id", F.lit(0))
    out = n.deduplicated(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [3, 9, 10]
    clash = make_docs([prose(1, 50), prose(2, 50), prose(2, 50) + " end"], ids=[3, 3, 3])
    assert sorted(len(r["text"].split()) for r in n.deduplicated(clash).collect()) in ([50, 50], [50, 51])
    assert n.classes(docs.limit(0)).count() == 0 and n.deduplicated(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(30)]
    edges = [(a, b) for a, b in edges if a != b]
    key = lambda i: i.to_bytes(4, "big")
    got = {int.from_bytes(r["key"], "big"): int.from_bytes(r["label"], "big") for r in n.components(spark.createDataFrame([(key(a), key(b)) for a, b in edges], "a binary, b binary")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_a_group_of_copies_far_from_its_original(spark, make_docs, prose):
    """Edited at random, copied again from edited ones, and in two variants: most pairs are near 0.7, no link may be lost and none made up."""
    rng = random.Random(12)
    base = prose(31, 120)
    texts = [base] + [edited(rng, base, rng.randrange(1, 14)) for _ in range(150)]
    for _ in range(3):
        variant = edited(rng, base, 5)
        texts += [edited(rng, variant, rng.randrange(0, 4)) for _ in range(30)]
    texts += [edited(rng, texts[rng.randrange(len(texts))], rng.randrange(1, 3)) for _ in range(60)]
    got = {r["doc_id"]: r["class_id"] for r in n.classes(make_docs(texts)).collect()}
    want = brute(list(enumerate(texts)))
    assert len(set(want.values())) > 40 and got == want


def test_hot_hubs_are_dealt_out(spark, make_docs, prose):
    rng = random.Random(13)
    base = prose(41, 60)
    texts = [f"{base} tail{i}" for i in range(60)] + [edited(rng, base, 3) for _ in range(20)]
    was, n.HUB_ROWS = n.HUB_ROWS, 7
    try:
        got = {r["doc_id"]: r["class_id"] for r in n.classes(make_docs(texts)).collect()}
    finally:
        n.HUB_ROWS = was
    assert got == brute(list(enumerate(texts)))


def test_recall_of_the_bands(prose):
    """Pairs at 0.8 to 0.85 share a band; far ones rarely do."""
    rng, met, far = random.Random(14), [], []
    for k in range(300):
        base = prose(9000 + k, 150)
        sets = [s for s, _ in n.shingles(pa.array([base, edited(rng, base, 3), prose(19000 + k, 150)]))]
        found = [set(n.buckets(s, np.ones(len(s), int)).tolist()) for s in sets]
        if 0.8 <= len(np.intersect1d(sets[0], sets[1])) / len(np.union1d(sets[0], sets[1])) <= 0.85:
            met.append(bool(found[0] & found[1]))
        far.append(bool(found[0] & found[2]))
    assert len(met) > 100 and np.mean(met) >= 0.99 and not any(far)


def test_nulls_long_texts_and_clashing_names(spark, make_docs, prose):
    long = prose(51, 25_000)
    docs = make_docs([long, long + " end", None, "", prose(52, 40), prose(52, 40)], ids=[1, 2, 3, 4, None, None])
    for c in ("key", "bands", "hash", "a", "b", "label", "class_id", "salt", "set", "diff", "near", "hub"):
        docs = docs.withColumn(c, F.lit(0))
    got = sorted(((r["doc_id"], r["class_id"]) for r in n.classes(docs).collect()), key=str)
    assert got == [(1, 1), (2, 1), (3, 3), (4, 3), (None, None), (None, None)]
    out = n.deduplicated(docs)
    assert out.columns == docs.columns and sorted((r["doc_id"] for r in out.collect()), key=str) == [1, 3, None]


def test_words_of_regular_sequences_have_different_hashes():
    from quern.llm import bytes_np as b

    words = []
    for power in range(6, 13):
        one, two = "a", "b"
        for _ in range(power):
            one, two = one + two, two + one
        words += [one, two]
    words += ["a" * k for k in range(1, 40)] + ["abcdefgh" * 2, "abcdefghhgfedcba", "hgfedcbaabcdefgh"]
    data, offsets = b.raw(pa.array(words))
    assert len(set(b.span_hashes(data, offsets[:-1], offsets[1:]).tolist())) == len(words)
    data, offsets = b.raw(pa.array(["ABC", "abc", ""]))
    low, exact = (b.span_hashes(data, offsets[:-1], offsets[1:], lower=x).tolist() for x in (True, False))
    assert low[0] == low[1] != low[2] and exact[0] != exact[1]
