import random

from tidemark.llm import minmax


def brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
        sets.setdefault(i, []).append(s)
    ids = [i for i in sets if i is not None]
    at = {i: i for i in ids}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[x] for b in sets[y]):
                at[max(root(x), root(y))] = min(root(x), root(y))
    return {i: root(i) for i in ids}, sets


def test_groups_equal_brute_force(spark):
    draw = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    rows, k = [], 0
    for _ in range(25):
        base = draw.choices(words, k=draw.choice([1, 2, 3, 8, 40, 200]))
        for _ in range(draw.choice([1, 2, 3, 30])):  # chains of edits: links that centres alone don't find
            base = [draw.choice(words) if draw.random() < 0.03 else x for x in base]
            rows.append((k, " ".join(base).upper() if draw.random() < 0.2 else "\n".join(base)))
            k += draw.choice([1, 1, 7])
    draw.shuffle(rows)
    for size in (2, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        found = minmax.near_duplicates(docs, size=size).collect()
        want, sets = brute(rows, size, 80)
        assert {r.doc_id: r.component_id for r in found} == want
        assert all(r.n_shingles == len(sets[r.doc_id][0]) and r.kept == (r.doc_id == r.component_id) for r in found)


def test_rows(spark):
    rows = [(5, "a b c d e f", "x", 1), (2, "A b c\td e f", "y", 2), (2, "A b c\td e f", "y", 2), (9, None, "z", 3), (8, " \n", "z", 4), (None, "a b c d e f", "z", 5), (7, "x", "z", 6), (6, "x", None, None)]
    rows += [(1, "q " * 50_000 + "r", "z", 7), (4, "m n o", "z", 8), (4, "a b c d e f", "z", 9), (3, "m n o", "z", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, component_id int")
    found = minmax.near_duplicates(docs, size=2)
    by = {r.doc_id: r for r in found.collect()}
    assert found.count() == len(rows)
    assert {i: r.component_id for i, r in by.items()} == {5: 2, 2: 2, 9: 9, 8: 8, None: None, 7: 6, 6: 6, 1: 1, 4: 2, 3: 2}
    assert by[9].n_shingles == by[8].n_shingles == 0 and by[7].n_shingles == 1 and by[None].kept
    left = minmax.keep_one(docs, size=2)
    assert left.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in left.select("doc_id").collect()) == [(False, 1), (False, 2), (False, 6), (False, 8), (False, 9), (True, None)]
    assert minmax.near_duplicates(docs.limit(0)).count() == 0 and minmax.keep_one(docs.limit(0)).count() == 0


def test_estimates_are_unbiased():
    draw = random.Random(3)
    a = " ".join(f"t{k}" for k in range(1000))
    b = " ".join(f"t{k}" for k in range(111, 1111))
    x, y = (minmax.min_max(minmax.shingle_set(t, 1)) for t in (a, b))
    assert abs((x == y).mean() - 889 / 1111) < 0.1 and draw


def test_parities_never_rule_out_similar_sets():
    draw = random.Random(11)
    for n in (1, 2, 50, 300, 3000):
        for _ in range(20):
            a = [str(draw.random()) for _ in range(n)]
            b = [str(draw.random()) if draw.random() < 0.1 else w for w in a]
            x, y = (minmax.shingle_set(" ".join(t), 1) for t in (a, b))
            bits = sum(int(v).bit_count() for v in (minmax.parities(x) ^ minmax.parities(y)).view("u8"))
            assert bits <= len(set(x.tolist()) ^ set(y.tolist()))
