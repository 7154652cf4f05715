import re

import numpy as np
import pyarrow as pa

from quern.llm import toxicity as t


def test_gradients():
    texts = t.Texts(pa.array(["abc de fgh " * 20 + "x", "", "hello wörld supercalifragilisticexpialidocious yes", "a b c"]))
    net = t.Network(np.sort(texts.hashes[:3]))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows = np.arange(len(texts.windows))

    class No:
        def random(self, n):
            return np.ones(n)

    _, g = net.gradient(texts, rows, rows % 2, No())
    for k, v in net.p.items():
        i = (ord("a"), 2) if k == "emb" else tuple(np.random.default_rng(1).integers(0, s) for s in v.shape)
        was, step = v[i], 1e-3
        v[i] = was + step
        up = net.gradient(texts, rows, rows % 2, No())[0]
        v[i] = was - step
        down = net.gradient(texts, rows, rows % 2, No())[0]
        v[i] = was
        assert abs(g[k][i] - (up - down) / (2 * step)) < 1e-5 + 0.02 * abs(g[k][i]), k


def test_every_word_is_in_windows_that_overlap():
    words = [f"w{i}" for i in range(100)]
    x = t.Texts(pa.array([" ".join(words), None, "one"]))
    assert x.counts.tolist() == [1 + -(-(100 - t.WINDOW) // t.STRIDE), 1, 1]
    of = x.windows[x.owner == 0]
    seen = np.bincount(of[of >= 0], minlength=len(x.hashes))
    assert (seen > 0).sum() == 100 and (x.windows[x.owner == 1] == -1).all()


def test_learns_and_scores_apart(spark, make_docs, prose):
    def toxic(i):
        w = prose(i, 120).split()
        for k in (20, 60, 90):
            w[k] = "zugg" + w[k][:2]
        return " ".join(w)

    texts = [toxic(i) if i % 2 else prose(i, 120) for i in range(120)] + [None, "", "  ", toxic(500) + " " + prose(501, 30_000)]
    docs = make_docs(texts)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(120)] + [(5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in t.score(docs.withColumn("score", docs["doc_id"]), labels).collect()}
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    held = [r for i, r in got.items() if r["held_out"] and i < 120]
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in held]) >= 0.9
    assert got[120]["score"] == got[121]["score"] == got[122]["score"]
    alone = t.score(docs.filter("doc_id in (1, 123)"), labels.limit(0)).collect()
    assert [r["score"] for r in alone] == [0.5, 0.5]
    kept = t.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id % 2 = 0 and doc_id < 120").count() >= 54
    assert t.score(docs.limit(0), labels).count() == 0


def test_batches_do_not_change_scores(prose):
    net = t.train([prose(i, 60) + (" zuggi" if i % 2 else "") for i in range(20)], [i % 2 for i in range(20)], epochs=2, least=0)
    texts = [prose(i, n) for i, n in enumerate((1, 31, 33, 500, 0))]
    whole = net.scores(pa.array(texts))
    assert np.allclose(whole, [net.scores(pa.array([x]))[0] for x in texts], atol=1e-5)


def by_loops(net, text):
    """The score of one text, from the description of the network: every number by itself."""
    import math

    from quern.llm import bytes_np as b

    p = {k: v.astype(float).tolist() for k, v in net.p.items()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    times = lambda v, m: [sum(v[i] * m[i][j] for i in range(len(v))) for j in range(len(m[0]))]

    def gru(xs, level, side):
        u, w, bias = p[f"{level}u{side}"], p[f"{level}x{side}"], p[f"{level}b{side}"]
        h = len(u)
        state, out = [0.0] * h, [None] * len(xs)
        for t in reversed(range(len(xs))) if side == "b" else range(len(xs)):
            x, rec = [a + c for a, c in zip(times(xs[t], w), bias, strict=True)], times(state, u)
            z, r = ([sigmoid(x[k * h + i] + rec[k * h + i]) for i in range(h)] for k in (0, 1))
            new = [math.tanh(x[2 * h + i] + r[i] * rec[2 * h + i]) for i in range(h)]
            state = [z[i] * state[i] + (1 - z[i]) * new[i] for i in range(h)]
            out[t] = state
        return out

    def pooled(xs, level):
        hs = [f + g for f, g in zip(gru(xs, level, "f"), gru(xs, level, "b"), strict=True)]
        weight = [math.exp(times([math.tanh(x) for x in times(h, p[f"{level}a"])], p[f"{level}v"])[0]) for h in hs]
        return [sum(w * h[i] for w, h in zip(weight, hs, strict=True)) / sum(weight) for i in range(len(hs[0]))]

    data = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    words = [w[k : k + t.PIECE] for w in re.findall(rb"[^\x20\x09-\x0d]+", data) for k in range(0, len(w), t.PIECE)]
    vectors = []
    for w in words:
        raw = np.frombuffer(w, np.uint8)
        (name,) = b.span_hashes(raw, np.array([0]), np.array([len(raw)]))
        place = net.vocabulary.tolist().index(int(name)) if int(name) in net.vocabulary.tolist() else len(net.vocabulary)
        vectors.append(p["word"][place] + pooled([p["emb"][c] for c in w], "c"))
    starts = range(0, max(1, len(words) - t.WINDOW + t.STRIDE), t.STRIDE)
    logits = [times(pooled(vectors[k : k + t.WINDOW], "w"), p["out"])[0] + p["bias"][0] for k in starts]
    seen = [max(logits), sum(map(sigmoid, logits)) / len(logits), math.log(len(logits)), 1.0]
    return sigmoid(sum(a * c for a, c in zip(seen, net.head, strict=True)))


def test_forward_pass_by_loops(prose):
    net = t.train([prose(i, 60) + (" zuggi" if i % 2 else "") for i in range(20)], [i % 2 for i in range(20)], epochs=3, least=0)
    texts = ["One", prose(1, 20) + " zuggi", prose(2, 33), "Größe " + prose(3, 70).upper() + " supercalifragilisticexpialidocious", "a\x0bb\u00a0c"]
    assert len(net.vocabulary) and np.allclose(net.scores(pa.array(texts)), [by_loops(net, x) for x in texts], atol=1e-4)


def test_without_labels_nothing_is_rejected_and_repeats_count_once(spark, make_docs, prose):
    docs = make_docs([prose(1, 40), prose(1, 40), None, ""], ids=[1, 1, 2, 3])
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert t.accepted(docs, labels.limit(0)).count() == 4
    got = sorted((r["doc_id"], r["score"]) for r in t.score(docs, labels).collect())
    assert len(got) == 4 and got[0] == got[1]
