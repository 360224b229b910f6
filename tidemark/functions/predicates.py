"""Comparisons of the query language as native columns, settled by declared types.

Two-valued: a comparison is true or false. Mixed types never reach Spark's coercion: an equality of
different types is false, an inequality true, an order follows the types' ranks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.ast import Group, QueryError, Simple

# fixed values: ranks of types in orders across types
RANKS = {"null": 0, "boolean": 1, "number": 2, "string": 3, "json": 4}
PATTERNS = ("LIKE", "NOT LIKE", "ILIKE", "NOT ILIKE")


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.StringType):
        return "string"
    return "null" if isinstance(t, T.NullType) else "time" if isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType) else "json"


def kind_of_literal(v) -> str:
    if v is None:
        return "null"
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, int | float) else "string" if isinstance(v, str) else "json"


def all_of(parts) -> Column:
    return reduce(lambda a, b: a & b, parts) if (parts := list(parts)) else F.lit(True)


def any_of(parts) -> Column:
    return reduce(lambda a, b: a | b, parts) if (parts := list(parts)) else F.lit(False)


def fits(kind: str, v) -> bool:
    """Can a literal be compared with a column of this kind? Times take their text form."""
    return kind == kind_of_literal(v) or (kind == "time" and isinstance(v, str))


def simple(c: Simple, schema: T.StructType, col) -> Column:
    if c.right.kind != "literal":
        raise QueryError("the right side of a comparison must be a literal")
    if c.left.kind == "column":
        if c.left.value not in schema.names:
            raise QueryError(f"unknown column {c.left.value}")
        left, kind = col(c.left.value), kind_of(schema[c.left.value].dataType)
    else:
        left, kind = F.lit(c.left.value), kind_of_literal(c.left.value)
    op, v = c.op, c.right.value
    if op in ("IS", "IS NOT"):
        same = left.eqNullSafe(F.lit(v)) if v is None or fits(kind, v) else F.lit(False)
        return same if op == "IS" else ~same
    if op in ("IN", "NOT IN"):
        if not isinstance(v, list | tuple):
            return F.lit(False)
        usable = [x for x in v if fits(kind, x)]
        if op == "IN":
            return left.isin(usable) if usable else F.lit(False)
        return left.isNotNull() & ~left.isin(usable) if usable else left.isNotNull()
    if v is None:
        return F.lit(False)
    if op in PATTERNS:
        if kind != "string" or not isinstance(v, str):
            return F.lit(False)
        pattern = v.replace("\\", "\\\\")  # a backslash is an ordinary character here
        found = left.ilike(pattern) if "ILIKE" in op else left.like(pattern)
        return ~found if op.startswith("NOT") else found
    if not fits(kind, v):
        if op in ("=", "!="):
            return left.isNotNull() if op == "!=" else F.lit(False)
        below = RANKS.get(kind, RANKS["json"]) < RANKS[kind_of_literal(v)]
        return left.isNotNull() if below == (op in ("<", "<=")) else F.lit(False)
    right = F.lit(v)
    return {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def predicate(c, schema: T.StructType, col, exists=None) -> Column:
    """A condition tree as a column; `exists` answers for correlated subqueries."""
    if isinstance(c, Group):
        parts = [predicate(x, schema, col, exists) for x in c.conditions]
        return all_of(parts) if c.kind == "and" else any_of(parts)
    if isinstance(c, Simple):
        return simple(c, schema, col)
    return exists(c)
