import random
import re
from collections import Counter

import numpy as np

from tidemark.llm import decontaminate as dc


def brute(text, items):
    w, out = re.findall(r"\w+", (text or "").lower()), {}
    for i, t in items:
        v = re.findall(r"\w+", (t or "").lower())
        if i is None or not v:
            continue
        k = min(5, len(v))
        cut = lambda x: Counter(tuple(x[a : a + k]) for a in range(len(x) - k + 1))
        own = cut(v)
        for a in range(max(1, len(w) - len(v) + 1)):
            c = cut(w[a : a + len(v)])
            both = (c & own).total()
            if both and both >= 0.8 * (c | own).total():
                out[i] = max(out.get(i, 0), both / (c | own).total())
    return out


def test_found_items_equal_brute_force(spark):
    draw = random.Random(2)
    words = [f"w{k}" for k in range(400)] + ["the", "of"] * 40
    make = lambda n: draw.choices(words, k=n)
    items = [(k, " ".join(make(draw.choice([3, 6, 14, 30, 59])))) for k in range(40)] + [(90, None), (None, "w1 w2 w3 w4 w5 w6"), (91, ""), (92, "the the the the the the the")]
    rows = []
    for k in range(150):
        w = make(draw.choice([0, 10, 100, 400]))
        for _ in range(draw.choice([0, 1, 2])):
            item = draw.choice(items[:40])[1].split()
            if draw.random() < 0.4:
                item[draw.randrange(len(item))] = "changed"
            if draw.random() < 0.3:
                item = item[draw.choice([0, 1, 2]) :]
            at = draw.randrange(len(w) + 1)
            w = w[:at] + ([item[0].capitalize(), *item[1:]] if item else []) + w[at:]
        rows.append((k, ", ".join(w) if k % 3 else "\n".join(w)))
    rows += [(900, None), (901, ""), (None, items[3][1]), (902, "w9 " * 60_000 + items[4][1]), (902, "the " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", dc.F.lit(1)).withColumn("id", dc.F.lit("z"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = sorted(((r.doc_id, tuple(r["items"]), r.similarity) for r in dc.find_leaks(docs, benchmark).collect()), key=repr)
    want = sorted(((i, tuple(sorted(b)), max(b.values(), default=None)) for i, b in ((i, brute(t, items)) for i, t in rows)), key=repr)
    assert [x[:2] for x in found] == [x[:2] for x in want]
    assert all(a == b or abs(a - b) < 1e-9 for a, b in zip([x[2] for x in found], [x[2] for x in want]))
    left = dc.without_leaks(docs, benchmark)
    assert left.columns == docs.columns and left.count() == sum(not x[1] for x in want)
    assert dc.find_leaks(docs.limit(0), benchmark).count() == 0
    assert dc.find_leaks(docs, benchmark.limit(0)).where("size(items) > 0").count() == 0


def test_blocks_find_all_within_the_radius():
    draw = np.random.default_rng(1)
    prints = draw.integers(0, 2**64, 3000, np.uint64)
    index = dc.HammingBlocks(prints)
    for k in range(40):
        p = int(prints[k]) ^ sum(1 << int(b) for b in draw.choice(64, 23 - k % 4, replace=False))
        want = [j for j, q in enumerate(prints.tolist()) if (q ^ p).bit_count() <= dc.RADIUS]
        assert index.near(p) == want and k in want


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 1)
    benchmark = spark.createDataFrame([(1, "a b c d e f g"), (2, "h i j k l m n")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x a b c d e f g y"), (2, "a b c d e f g h i j k l m n"), (3, "none")], "doc_id long, text string")
    assert {r.doc_id: r["items"] for r in dc.find_leaks(docs, benchmark).collect()} == {1: [1], 2: [1, 2], 3: []}
    assert [r.doc_id for r in dc.without_leaks(docs, benchmark).collect()] == [3]


def test_items_in_another_order_are_found():
    draw = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    for length, cut in ((60, 30), (60, 12), (40, 8), (60, 2), (59, 48)):
        items = [(k, " ".join(draw.sample(words, length - k % 3))) for k in range(12)]
        own = dc.Items(items)
        for k in (0, 3):
            item = items[k][1].split()
            for before in (0, 1, 150):
                text = " ".join(draw.choices(words, k=before) + item[cut:] + item[:cut] + draw.choices(words, k=150))
                want = brute(text, items)
                found = own.leaks(text)
                assert k in want and found.keys() == want.keys() and all(abs(found[x] - want[x]) < 1e-9 for x in want)


def test_windows_with_enough_places():
    draw = random.Random(6)
    for _ in range(300):
        n, length = draw.randrange(1, 40), draw.randrange(1, 12)
        at = sorted(draw.sample(range(n), draw.randrange(n + 1)))
        need, starts = draw.randrange(1, length + 1), max(0, n - length + 1)
        assert dc.dense(at, length, need, starts) == [a for a in range(starts) if sum(a <= p < a + length for p in at) >= need]
