"""Random query trees: compiled plans against plain evaluation."""

import random

from pyspark.sql import Row

from tests.plain import Plain
from tidemark.operators.compile import compile_query
from tidemark.plans import ast
from tidemark.sources.catalog import Catalog

KEYS = {"a": ("id",), "b": ("id",), "c": ("x", "id")}
SHAPES = {"a": "id long, n long, s string, f boolean", "b": "id long, a long, n double, s string", "c": "x string, id long, b long, s string"}
TIES = {("a", "b"): ("id", "a"), ("b", "c"): ("id", "b"), ("a", "a"): ("n", "id"), ("b", "a"): ("a", "id"), ("c", "b"): ("b", "id"), ("a", "c"): ("s", "x")}


def tables(draw):
    some = lambda *v: draw.choice([None, *v])
    return {
        "a": [{"id": k, "n": some(*range(6)), "s": some("x", "Xy", "z%"), "f": some(True, False)} for k in range(8)],
        "b": [{"id": k, "a": some(*range(9)), "n": some(0.5, 2.0, -1.0), "s": some("x", "y")} for k in range(14)],
        "c": [{"x": some("x", "y"), "id": k, "b": some(*range(15)), "s": some("p", "q")} for k in range(20)],
    }


def literal(v):
    return {"type": "literal", "value": v}


def condition(draw, table, depth):
    names = [p.split()[0] for p in SHAPES[table].split(", ")]
    roll = draw.random()
    if roll < 0.2 and depth:
        return {"type": draw.choice(["and", "or"]), "conditions": [condition(draw, table, depth - 1) for _ in range(draw.randrange(3))]}
    if roll < 0.45 and depth:
        return {"type": "correlatedSubquery", "op": draw.choice(["EXISTS", "NOT EXISTS"]), "related": related(draw, table, depth - 1, "zsubq_e")}
    op = draw.choice(list(ast.OPERATORS))
    value = draw.choice([None, 2, 0.5, 1, "x", "X%", "y", "_", True])
    if "IN" in op:
        value = draw.choice([[], [1, 2, 5], ["x", "y"], [True, 3, "z%"]])
    return {"type": "simple", "op": op, "left": {"type": "column", "name": draw.choice(names)}, "right": literal(value)}


def related(draw, table, depth, alias):
    child = draw.choice([c for p, c in TIES if p == table])
    p, c = TIES[table, child]
    return {"correlation": {"parentField": [p], "childField": [c]}, "subquery": {**tree(draw, child, depth), "alias": alias}, "singular": False}


def tree(draw, table, depth):
    out = {"table": table}
    names = [p.split()[0] for p in SHAPES[table].split(", ")]
    if draw.random() < 0.6:
        out["where"] = condition(draw, table, depth)
    if draw.random() < 0.5:
        out["orderBy"] = [[c, draw.choice(["asc", "desc"])] for c in draw.sample(names, draw.choice([1, 2]))]
    if draw.random() < 0.3:
        out["limit"] = draw.choice([0, 1, 2, 5])
    if depth and draw.random() < 0.6:
        out["related"] = [related(draw, table, depth - 1, f"r{k}") for k in range(draw.choice([1, 2]))]
        if draw.random() < 0.3:
            out["related"][0]["singular"] = True
    return out


def plain(x):
    if isinstance(x, Row):
        return {k: plain(v) for k, v in x.asDict().items()}
    return [plain(v) for v in x] if isinstance(x, list) else x


def test_random_trees(spark):
    draw = random.Random(77)
    for _ in range(3):
        data = tables(draw)
        c = Catalog()
        for name, rows in data.items():
            shape = SHAPES[name]
            order = [p.split()[0] for p in shape.split(", ")]
            c.add(name, spark.createDataFrame([tuple(r[k] for k in order) for r in rows], shape), KEYS[name])
        own = Plain(data, KEYS)
        for _ in range(10):
            t = tree(draw, draw.choice("abc"), 2)
            found = [plain(r) for r in compile_query(ast.query(t), c).collect()]
            assert found == own.run(t), t
