"""Query trees evaluated row by row in plain Python: what compiled plans are compared with."""

from __future__ import annotations

import functools
import re

RANK = {bool: 1, int: 2, float: 2, str: 3}


def kind(v):
    return RANK[type(v)]


def same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and kind(a) == kind(b) and a == b)


def pattern(text, flags=0):
    return re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in text), re.DOTALL | flags)


def simple(row, op, left, v):
    x = row[left["name"]] if left["type"] == "column" else left["value"]
    if op == "IS":
        return same(x, v)
    if op == "IS NOT":
        return not same(x, v)
    if op in ("IN", "NOT IN"):
        return x is not None and any(same(x, y) for y in v if y is not None) == (op == "IN")
    if x is None or v is None:
        return False
    if "LIKE" in op:
        if not isinstance(x, str) or not isinstance(v, str):
            return False
        return bool(pattern(v, re.IGNORECASE if "ILIKE" in op else 0).fullmatch(x)) != op.startswith("NOT")
    if op in ("=", "!="):
        return same(x, v) == (op == "=")
    a, b = (kind(x), x if kind(x) == kind(v) else 0), (kind(v), v if kind(x) == kind(v) else 0)
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def before(a, b, order):
    """-1, 0 or 1: nulls are smallest."""
    for column, direction in order:
        x, y = a.get(column), b.get(column)
        c = 0 if same(x, y) else -1 if x is None else 1 if y is None else -1 if x < y else 1
        if c:
            return c if direction == "asc" else -c
    return 0


class Plain:
    """tables: name -> rows (dicts); keys: name -> key columns."""

    def __init__(self, tables, keys):
        self.tables, self.keys = tables, keys

    def holds(self, row, c):
        if c["type"] == "simple":
            return simple(row, c["op"], c["left"], c["right"]["value"])
        if c["type"] in ("and", "or"):
            return (all if c["type"] == "and" else any)(self.holds(row, x) for x in c["conditions"])
        found = self.existing(row, c["related"])
        return found == (c["op"] == "EXISTS")

    def existing(self, row, rel):
        """Is any row related? A junction's row counts if it leads somewhere."""
        rows = self.rows({**rel["subquery"], "orderBy": [], "related": []} | {"start": rel["subquery"].get("start")}, row, rel["correlation"])
        if rel.get("hidden"):
            rows = [r for r in rows if all(self.existing(r, x) for x in rel["subquery"].get("related", ()))]
        return bool(rows)

    def rows(self, q, parent=None, tie=None):
        rows = self.tables[q["table"]]
        if tie:
            pairs = list(zip(tie["parentField"], tie["childField"]))
            rows = [r for r in rows if all(parent[p] is not None and same(parent[p], r[c]) for p, c in pairs)]
        if q.get("where"):
            rows = [r for r in rows if self.holds(r, q["where"])]
        order = [tuple(o) for o in q.get("orderBy") or ()]
        order += [(k, "asc") for k in self.keys[q["table"]] if k not in {c for c, _ in order}]
        rows = sorted(rows, key=functools.cmp_to_key(lambda a, b: before(a, b, order)))
        if q.get("start"):
            rows = [r for r in rows if before(r, q["start"]["row"], order) >= (1 if q["start"].get("exclusive") else 0)]
        return rows if q.get("limit") is None else rows[: q["limit"]]

    def run(self, q, parent=None, tie=None):
        out = []
        for r in self.rows(q, parent, tie):
            own = dict(r)
            for rel in q.get("related") or ():
                found = self.run(rel["subquery"], r, rel["correlation"])
                if rel.get("hidden"):
                    inner = rel["subquery"]["related"][0]["subquery"]
                    found = [x for f in found for x in f[inner.get("alias") or inner["table"]]]
                name = rel["subquery"].get("alias") or rel["subquery"]["table"]
                own[name] = (found[0] if found else None) if rel.get("singular") else found
            out.append(own)
        return out
