import random

from tidemark.llm import mixing


def test_shortages_go_to_siblings_before_ancestors():
    tokens = {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 1000}
    given = mixing.allocate(200, tokens, {}, ("d", "s"), 1)
    assert given == {("a", "x"): 10, ("a", "y"): 90, ("b", "x"): 100}
    given = mixing.allocate(2000, {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 5000}, {}, ("d", "s"), 2)
    assert given == {("a", "x"): 20, ("a", "y"): 40, ("b", "x"): 1940}
    assert mixing.shares(100, {"a": (3, 1e9), "b": (1, 1e9), "c": (0, 1e9)}) == {"a": 75, "b": 25, "c": 0}


def brute(rows, places, weights, budget, epochs):
    """copies by row: leaves from the recursive rule, prefixes by sorting."""
    n = [len((t or "").split()) for _, t, *_ in rows]
    leaf = [tuple(x or "" for x in r[2:4]) for r in rows]

    def give(amount, members, depth):
        if depth == 2:
            return {leaf[members[0]]: amount}
        kids = {}
        for m in members:
            kids.setdefault(leaf[m][depth], []).append(m)
        most = {k: epochs * sum(n[m] for m in ms) for k, ms in kids.items()}
        left, todo, got = min(amount, sum(most.values())), dict(kids), {}
        while todo:
            w = {k: weights.get(("d", "g")[depth], {}).get(k, 1.0) for k in todo}
            k = min(todo, key=lambda k: most[k] / w[k])
            got[k] = min(most[k], left * w[k] / sum(w.values()))
            left -= got[k]
            todo.pop(k)
        return {p: v for k, ms in kids.items() for p, v in give(got[k], ms, depth + 1).items()}

    given, out = give(budget * sum(n), list(range(len(rows))), 0), {}
    for one in set(leaf):
        own = [k for k in range(len(rows)) if leaf[k] == one]
        total = sum(n[k] for k in own)
        whole, rest = (int(given[one] // total), int(given[one] % total)) if total else (0, 0)
        used, full = 0, False
        by = {}
        for k in own:
            by.setdefault(places[whole][k], []).append(k)
        for h in sorted(by):
            used += sum(n[k] for k in by[h])
            full = full or used > rest
            for k in by[h]:
                out[k] = whole + (not full and rest > 0)
    return out


def test_copies_equal_brute_force(spark):
    draw = random.Random(4)
    rows = [(k, "w " * draw.choice([0, 1, 5, 40]), draw.choice(["p", "p", "p", "q", "r", None]), draw.choice(["en", "de", None])) for k in range(400)]
    rows += [(7, "w w w", "p", "en"), (None, "w w", "q", "de"), (900, None, "q", "de"), (901, "w " * 300_000, "big", "en")]
    docs = spark.createDataFrame([(*r, 1, k) for k, r in enumerate(rows)], "doc_id long, text string, d string, g string, leaf int, k0 int")
    keys = {"d": mixing.F.col("d"), "g": mixing.F.col("g")}
    places = {e: [r[0] for r in docs.select(mixing.order(7, mixing.F.lit(e), mixing.F.col("doc_id")), "k0").orderBy("k0").collect()] for e in range(4)}
    for weights, budget, epochs in (({"d": {"p": 1.0, "q": 5.0, "big": 0.001}, "g": {"en": 3.0}}, 0.001, 2.0), ({"d": {"q": 9.0}}, 1.0, 3.0), ({}, 0.5, 1.0)):
        found = {r.k0: r.copies for r in mixing.with_copies(docs, keys, weights, budget, epochs).collect()}
        assert found == brute(rows, places, weights, budget, epochs)
    out = mixing.mixed(docs, keys, weights, budget, epochs)
    assert out.columns == docs.columns and out.count() == sum(found.values())
    assert mixing.mixed(docs.limit(0), keys, {}).count() == 0


def test_budgets_equal_the_plain_rule(spark, monkeypatch):
    draw = random.Random(6)
    for weights, budget, epochs in (({"a": {"p": 3.0, "q": 0.0}, "b": {"x": 9.0}}, 0.3, 1.0), ({"c": {"1": 50.0}}, 1.0, 2.0), ({}, 5.0, 2.5)):
        tokens = {(draw.choice("pqr"), draw.choice("xyz"), str(k % 4)): draw.choice([0, 1, 10, 1000, 10**9]) for k in range(40)}
        leaves = spark.createDataFrame([(*leaf, n) for leaf, n in tokens.items()], "k0 string, k1 string, k2 string, n long")
        found = {tuple(r)[:3]: r.given for r in mixing.budgets(leaves, weights, ("a", "b", "c"), ["k0", "k1", "k2"], budget, epochs).collect()}
        want = mixing.allocate(budget * sum(tokens.values()), tokens, weights, ("a", "b", "c"), epochs)
        assert found.keys() == want.keys()
        assert all(abs(found[k] - want[k]) <= 1e-6 * max(1, want[k]) for k in want)


def test_many_leaves_are_joined(spark, monkeypatch):
    rows = [(k, "w " * (k % 7), f"d{k % 90}", "en") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copies string, g string")
    keys = {"d": mixing.F.col("copies"), "g": mixing.F.col("g")}
    out = [sorted(map(tuple, mixing.mixed(docs, keys, {}, 0.4, 1.0).collect()))]
    monkeypatch.setattr(mixing, "SENT_LEAVES", 10)
    out.append(sorted(map(tuple, mixing.mixed(docs, keys, {}, 0.4, 1.0).collect())))
    assert out[0] == out[1] and 100 < len(out[0]) < 600
