import re
from collections import Counter

from pyspark.sql import functions as F

from quern.llm import quality_rules as q

BLANK = "[\x20\x09-\x0d]+"


def brute(t):
    t = t or ""
    w = [x for x in re.split(BLANK, t) if x]
    lines = [x for x in t.split("\n") if re.sub(BLANK, "", x)]
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k + j for k in range(len(w) - 2) if tri[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
    n = dict(n_words=len(w), word_chars=sum(map(len, w)), n_symbols=sum(c in "#*$%&|<>" for c in t), n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(hit))
    return n | {"base_failed": len(w) < 50 or 100 * len(hit) > 50 * len(w)}


def test_statistics_against_brute_force(spark, make_docs, prose):
    texts = [None, "", "   \n ", "a", "a b c a b c", "x y z x y z x y", "a\x0b\x0cb\xa0c #*$", "one\n\none\n one\ntwo\none", prose(1, 400) + " 😀 é", "r " * 300, prose(2, 3000) + "\n" + prose(2, 3000), "|<>&% " * 60]
    ids = [0, 0, *range(2, len(texts))]
    got = q.judge(make_docs(texts, ids=ids).withColumn("kept", F.lit(1)))
    key = lambda d: sorted(map(str, d.items()))
    rows = [{k: r[k] for k in brute("")} | {"doc_id": r["doc_id"]} for r in got.collect()]
    assert sorted(map(key, rows)) == sorted(key(brute(t) | {"doc_id": i}) for i, t in zip(ids, texts, strict=True))
    assert q.judge(make_docs([])).count() == 0


def test_rules_find_what_is_bad(spark, make_docs, prose):
    good = [prose(i, 200).capitalize() + "." for i in range(80)]
    bad = [" ".join(w + "###" for w in prose(i, 100).split()) for i in range(6)] + [prose(i, 100).upper().replace(" ", "!! ") for i in range(6)] + [" | ".join(prose(i, 100).split()) for i in range(6)]
    got = {r["doc_id"]: r["kept"] for r in q.judge(make_docs(good + bad)).collect()}
    assert all(got[i] for i in range(80)) and not any(got[80 + i] for i in range(18))


def test_em_against_known_accuracies():
    import random

    rng = random.Random(4)
    counts = Counter()
    for _ in range(20_000):
        good = rng.random() < 0.8
        votes = tuple(q.ABSTAIN if rng.random() < 0.3 else (q.GOOD if (rng.random() < 0.85) == good else q.BAD) for _ in range(5))
        counts[votes] += 1
    prior, model = q.fit(list(counts.items()), 5)
    assert abs(prior - 0.8) < 0.05
    assert q.posterior((1,) * 5, prior, model) > 0.95 > 0.05 > q.posterior((0,) * 5, prior, model)


def test_no_python_on_the_way(spark, make_docs):
    plan = q.judge(make_docs(["a b"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_posterior_against_brute_force(spark, make_docs, prose):
    """Votes by plain Python from the raw texts, EM as a table of all documents, one by one."""
    import math

    rng = __import__("random").Random(3)
    texts = []
    for i in range(150):
        t = prose(i, rng.randrange(55, 200))
        texts.append([t, t.upper(), " ".join(w + "#" for w in t.split()), t.replace(" ", " ! | "), "\n".join([t[:60]] * 8), "ab " * 70 + t, " ".join(c for c in t if c != " ")][rng.choice((0, 0, 0, 0, 1, 2, 3, 4, 5, 6))])
    texts += [None, "", texts[0], "12 " * 60]

    def votes(t):
        t, n = t or "", brute(t)
        w = [x for x in re.split(BLANK, t) if x]
        lines = [x for x in t.split("\n") if re.sub(BLANK, "", x)]
        words, letters = max(1, len(w)), max(1, sum(c.isalpha() for c in t))
        size, prose_share = n["word_chars"] / words, letters / max(1, n["word_chars"])
        bad = [
            n["n_symbols"] > 0.2 * words, n["n_repeat_words"] > 0.35 * words, sum(c.isupper() for c in t) > 0.4 * letters, sum(c in "!|" for c in t) > 0.3 * words,
            n["n_dup_lines"] > 0.4 * max(1, len(lines)), len(set(w)) < 2 * math.sqrt(words), size < 2.5 or size > 12, prose_share < 0.8,
        ]
        good = [False] * 6 + [3 < size < 9, prose_share > 0.93]
        return [0 if x else 1 if y else 2 for x, y in zip(bad, good, strict=True)]

    cast = [votes(t) for t in texts]
    start = [[0.35, 0.25, 0.4], [0.02, 0.6, 0.38]]
    model, prior = [[r[:] for r in start] for _ in range(8)], 0.8

    def believed(v):
        a, b = prior, 1 - prior
        for k, x in enumerate(v):
            a, b = a * model[k][1][x], b * model[k][0][x]
        return a / (a + b)

    for _ in range(60):
        p = [believed(v) for v in cast]
        strength = 1 + 0.002 * len(cast)
        new = []
        for k in range(8):
            rule = []
            for truth in (0, 1):
                row = [strength * start[truth][x] + sum(q_ if truth else 1 - q_ for q_, v in zip(p, cast, strict=True) if v[k] == x) for x in range(3)]
                rule.append([x / sum(row) for x in row])
            rule[0][0], rule[1][1] = max(rule[0][0], rule[1][0]), max(rule[1][1], rule[0][1])
            new.append(rule)
        prior, model = min(0.995, max(0.3, (0.8 * 0 + sum(p) + prior) / (len(cast) + 1))), new
    got = {r["doc_id"]: r for r in q.judge(make_docs(texts)).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i]["posterior"] - believed(cast[i])) < 1e-6, i
        assert got[i]["kept"] == (not brute(t)["base_failed"] and believed(cast[i]) >= 0.5)
    assert {got[i]["kept"] for i in got} == {True, False}


def test_long_texts_ties_and_clashing_columns(spark, make_docs, prose):
    docs = make_docs([prose(1, 30_000), "a b c " * 5000, prose(2, 80), prose(2, 80)], ids=[1, 2, 3, 3])
    for c in ("w", "h", "s", "p", "t", "lines", "votes", "vote_prose", "posterior"):
        docs = docs.withColumn(c, F.lit(1))
    got = sorted(((r["doc_id"], r["n_words"], r["n_repeat_words"], r["kept"]) for r in q.judge(docs).collect()))
    assert got == [(1, 30_000, brute(prose(1, 30_000))["n_repeat_words"], True), (2, 15_000, 15_000, False), (3, 80, 0, True), (3, 80, 0, True)]
