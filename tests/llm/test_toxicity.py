import random

import numpy as np

from tidemark.llm import toxicity as tx

#: sf0.01 has about thirty toxic labels to learn from: too few to tell anything.
DIR = "/root/testdata/sf0.1"


def test_windows_cover_all_words():
    for n in (1, 31, 32, 33, 48, 49, 500):
        covered = {w for s in tx.starts(n) for w in range(s, min(n, s + tx.WINDOW))}
        assert covered == set(range(n)) and all(b - a <= tx.STRIDE for a, b in zip(tx.starts(n), list(tx.starts(n))[1:]))


def test_gradients_equal_differences():
    net, words, y = tx.Network(1), [[b"some", b"words"], [b"a"] * 32, [b"other", b"words", b"here"]], np.array([1, 0, 1.0])

    def loss():
        mask, x = np.zeros((3, tx.WINDOW)), np.zeros((3, tx.WINDOW, 2 * tx.SIZE))
        for k, w in enumerate(words):
            mask[k, : len(w)] = 1
        x[mask.astype(bool)] = net.inputs([a for w in words for a in w])
        logit, _ = net.pooled(net.projected(x), mask)
        return np.logaddexp(0, -logit * (2 * y - 1)).mean()

    for name, g in net.gradients(words, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was = net.p[name][at]
        net.p[name][at] = was + 1e-5
        up = loss()
        net.p[name][at] = was - 1e-5
        slope = (up - loss()) / 2e-5
        net.p[name][at] = was
        assert abs(slope - g[at]) < 1e-6


def test_scores(spark):
    draw = random.Random(3)
    plain, bad = [f"plain{k}" for k in range(50)], ["awful", "horrid"]
    rows = [(k, " ".join(draw.choices(plain, k=draw.choice([5, 60]))), 0) for k in range(300)] + [(300 + k, " ".join([*draw.choices(plain, k=40), draw.choice(bad), *draw.choices(plain, k=20)]), 1) for k in range(300)]
    docs = spark.createDataFrame([(i, t, "z", 1.5) for i, t, _ in rows], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    net = tx.learn(docs, labels)
    found = {r.doc_id: r.score for r in tx.score(docs, net).collect()}
    assert sum((found[i] >= 0.5) == y for i, _, y in rows) >= 590
    long = " ".join(plain * 2000)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "awful"), (4, long), (5, f"{long} horrid {long}"), (6, " \n"), (6, " \n")], "doc_id long, text string")
    by = {r.doc_id: r.score for r in tx.score(odd, net).collect()}
    assert by[1] == by[2] == by[6] < 0.5 and by[4] < 0.5 < by[5] and by[None] > 0.5
    assert tx.score(odd, net).count() == 7 and tx.score(odd.limit(0), net).count() == 0
    nothing = tx.learn(docs.limit(0), labels.limit(0))
    assert all(0 <= r.score < 0.5 for r in tx.score(odd, nothing).collect())


def test_held_out_documents(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    found = [r for r in tx.op6_toxicity(spark, DIR).where("held_out").collect() if r.doc_id in labels]
    ranks = np.argsort(np.argsort([r.score for r in found]))
    y = np.array([labels[r.doc_id] for r in found])
    assert (ranks[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum() > 0.9
    assert np.mean([r.predicted == labels[r.doc_id] for r in found]) > 0.95


def test_scores_equal_a_plain_loop_over_all_windows():
    draw = random.Random(9)
    net = tx.Network(2)
    texts = [" ".join(draw.choices(["some", "words,", "here", "x" * 20, "é", "-"], k=n)) for n in (1, 2, 31, 32, 33, 47, 48, 49, 200, 900)] + [None, "", " \n"]
    want = []
    for t in texts:
        words = tx.plain_words(t)
        best = -np.inf
        at = 0
        while True:
            own = words[at : at + tx.WINDOW]
            x = net.projected(net.inputs(own))[None]
            best = max(best, float(net.pooled(x, None)[0][0]))
            if at + tx.WINDOW >= len(words):
                break
            at = min(at + tx.STRIDE, len(words) - tx.WINDOW)
        want.append(best)
    assert np.allclose(tx.Scorer(net).logits(texts), want, atol=1e-4)


def test_long_texts_are_learned_from_all_over():
    words = [f"w{k}" for k in range(50_000)]
    own = tx.condensed(" ".join(words), 3200).split()
    assert len(own) <= 3200 + tx.WINDOW and own[0] == "w0" and own[-1] == "w49999"
    assert max(int(b[1:]) - int(a[1:]) for a, b in zip(own, own[1:])) < 1000
    assert tx.condensed("Some  Words", 3200) == "some words"
