import hashlib
import re

from pyspark.sql import functions as F

from quern.llm import decontaminate as d

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)):
            if x := tuple(w[k : k + 10]):
                windows.setdefault(x, set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    ids |= found
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_against_brute_force(spark, make_docs, prose):
    items = [(10, prose(1, 40)), (2, prose(2, 12)), (3, "only four words É"), (4, ""), (5, None), (6, "rep " * 14), (2, prose(2, 12)), (7, prose(1, 40) + " tail"), (8, "uno")]
    long = prose(9, 5000)
    texts = [
        None, "", "...", prose(1, 40), prose(1, 40).upper().replace(" ", " -- "), prose(5, 30) + " " + " ".join(prose(1, 40).split()[7:17]) + " x", " ".join(prose(1, 40).split()[7:16]), "rep " * 60, long + " only FOUR words É. " + long,
        prose(2, 11), " ".join(prose(2, 12).split()[:10]) + " " + " ".join(prose(2, 12).split()[2:]), "only four words é", " ".join(prose(1, 40).split()[20:30] + prose(1, 40).split()[:10]),
    ]
    ids = [*range(len(texts))]
    ids[1] = 0
    docs = make_docs(texts, ids=ids).withColumn("w", F.lit(1)).withColumn("item_ids", F.lit(2))
    table = spark.createDataFrame(items, "item_id long, text string")
    for few in (10**6, 0):
        d.BROADCAST_ROWS, was = few, d.BROADCAST_ROWS
        got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in d.contamination(docs, table).collect()), key=str)
        d.BROADCAST_ROWS = was
        assert got == brute(zip(ids, texts, strict=True), items)
    clean = d.clean(docs, table)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {r[0] for r in got if not r[5]}
    assert d.contamination(docs, table.limit(0)).filter("contaminated").count() == 0
    assert d.contamination(docs.limit(0), table).count() == 0
    assert not re.search("Python|Pandas|Arrow", d.contamination(docs, table)._jdf.queryExecution().executedPlan().toString())
