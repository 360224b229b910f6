"""The query tree and its JSON form.

A query is a table with optional conditions, related subqueries, ordering, cursor and limit:
{table, alias?, where?, related?, start?, limit?, orderBy?}. Trees are immutable.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from typing import Any

# fixed values: the operators of the JSON form
OPERATORS = ("=", "!=", "<", "<=", ">", ">=", "IS", "IS NOT", "IN", "NOT IN", "LIKE", "NOT LIKE", "ILIKE", "NOT ILIKE")
#: Generated aliases of EXISTS subqueries begin with this; such subqueries are not part of the result.
HIDDEN_PREFIX = "zsubq_"


class QueryError(ValueError):
    """The tree is not a valid query."""


@dataclass(frozen=True)
class Operand:
    """A column name or a literal."""

    kind: str
    value: Any

    def to_json(self) -> dict:
        return {"type": "column", "name": self.value} if self.kind == "column" else {"type": "literal", "value": self.value}


@dataclass(frozen=True)
class Simple:
    op: str
    left: Operand
    right: Operand

    def to_json(self) -> dict:
        return {"type": "simple", "op": self.op, "left": self.left.to_json(), "right": self.right.to_json()}


@dataclass(frozen=True)
class Group:
    """AND or OR of conditions; of none, true and false."""

    kind: str
    conditions: tuple

    def to_json(self) -> dict:
        return {"type": self.kind, "conditions": [c.to_json() for c in self.conditions]}


@dataclass(frozen=True)
class Related:
    """A subquery and the columns that tie it to its parent; `hidden` for a junction that is skipped in results."""

    parent: tuple[str, ...]
    child: tuple[str, ...]
    query: Query
    hidden: bool = False
    one: bool = False

    def to_json(self) -> dict:
        out = {"correlation": {"parentField": list(self.parent), "childField": list(self.child)}, "subquery": self.query.to_json()}
        return out | ({"hidden": True} if self.hidden else {}) | ({"singular": True} if self.one else {})

    @property
    def name(self) -> str:
        return (self.query.alias or self.query.table).removeprefix(HIDDEN_PREFIX)


@dataclass(frozen=True)
class Exists:
    op: str
    related: Related

    def to_json(self) -> dict:
        return {"type": "correlatedSubquery", "op": self.op, "related": self.related.to_json()}


@dataclass(frozen=True)
class Start:
    """A cursor: rows from `row` on, itself included unless exclusive. Absent columns are null."""

    row: dict
    exclusive: bool = False

    def to_json(self) -> dict:
        return {"row": self.row, "exclusive": self.exclusive}


@dataclass(frozen=True)
class Query:
    table: str
    alias: str | None = None
    where: Any = None
    related: tuple[Related, ...] = ()
    start: Start | None = None
    limit: int | None = None
    order_by: tuple[tuple[str, str], ...] = ()

    def to_json(self) -> dict:
        out: dict[str, Any] = {"table": self.table}
        out |= {"alias": self.alias} if self.alias else {}
        out |= {"where": self.where.to_json()} if self.where else {}
        out |= {"related": [r.to_json() for r in self.related]} if self.related else {}
        out |= {"start": self.start.to_json()} if self.start else {}
        out |= {"limit": self.limit} if self.limit is not None else {}
        return out | ({"orderBy": [list(o) for o in self.order_by]} if self.order_by else {})

    def dumps(self) -> str:
        """Canonical text: equal trees give equal texts."""
        return json.dumps(self.to_json(), sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    def tables(self) -> frozenset[str]:
        """Every table that the result depends on."""
        return frozenset({self.table}).union(*(r.query.tables() for r in (*self.related, *(e.related for e in exists_in(self.where)))))

    def but(self, **changes) -> Query:
        return replace(self, **changes)


def exists_in(condition) -> list[Exists]:
    if isinstance(condition, Group):
        return [e for c in condition.conditions for e in exists_in(c)]
    return [condition] if isinstance(condition, Exists) else []


def operand(x: dict) -> Operand:
    if x.get("type") == "column":
        return Operand("column", x["name"])
    if x.get("type") == "literal":
        return Operand("literal", tuple(x["value"]) if isinstance(x["value"], list) else x["value"])
    raise QueryError(f"not a column or literal: {x}")


def condition(x: dict):
    kind = x.get("type")
    if kind == "simple":
        if x["op"] not in OPERATORS:
            raise QueryError(f"unknown operator {x['op']}")
        return Simple(x["op"], operand(x["left"]), operand(x["right"]))
    if kind in ("and", "or"):
        return Group(kind, tuple(map(condition, x["conditions"])))
    if kind == "correlatedSubquery":
        if x["op"] not in ("EXISTS", "NOT EXISTS"):
            raise QueryError(f"unknown operator {x['op']}")
        return Exists(x["op"], related(x["related"]))
    raise QueryError(f"unknown condition {kind}")


def related(x: dict) -> Related:
    tie = x["correlation"]
    if len(tie["parentField"]) != len(tie["childField"]) or not tie["parentField"]:
        raise QueryError("parentField and childField must have the same length, one at least")
    return Related(tuple(tie["parentField"]), tuple(tie["childField"]), query(x["subquery"]), bool(x.get("hidden")), bool(x.get("singular")))


def query(x: dict | str) -> Query:
    """A tree from its JSON form. `schema`, `flip` and `scalar` are accepted and have no effect."""
    x = json.loads(x) if isinstance(x, str) else x
    start = x.get("start")
    order = tuple((f, d) for f, d in x.get("orderBy") or ())
    if bad := [d for _, d in order if d not in ("asc", "desc")]:
        raise QueryError(f"unknown direction {bad[0]}")
    if (limit := x.get("limit")) is not None and limit < 0:
        raise QueryError("limit must not be negative")
    return Query(
        x["table"],
        x.get("alias"),
        condition(x["where"]) if x.get("where") else None,
        tuple(map(related, x.get("related") or ())),
        Start(dict(start["row"]), bool(start.get("exclusive"))) if start else None,
        limit,
        order,
    )
