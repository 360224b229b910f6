"""A fluent, schema-aware way to write queries."""

from __future__ import annotations

import inspect
from dataclasses import dataclass, field

from tidemark.plans.ast import HIDDEN_PREFIX, Exists, Group, Operand, Query, QueryError, Related, Simple, Start
from tidemark.sources.catalog import Catalog, Hop


def compare(column: str, op, *value) -> Simple:
    """compare('n', 5) is equality; compare('n', '>', 5) names the operator."""
    op, literal = (op, value[0]) if value else ("=", op)
    literal = tuple(literal) if isinstance(literal, list | set | frozenset) else literal
    return Simple(op, Operand("column", column), Operand("literal", literal))


def all_of(*conditions) -> Group:
    return Group("and", conditions)


def any_of(*conditions) -> Group:
    return Group("or", conditions)


@dataclass(frozen=True)
class Builder:
    """Each call gives a new builder; the old one stays as it is."""

    catalog: Catalog
    tree: Query
    singular: bool = False

    def where(self, column, *rest) -> Builder:
        """A comparison, or a condition; further calls are joined by AND in one flat group."""
        new = column if not isinstance(column, str) else compare(column, *rest)
        old = self.tree.where
        both = new if old is None else all_of(*(old.conditions if isinstance(old, Group) and old.kind == "and" else (old,)), new)
        return self._but(where=both)

    def where_exists(self, name: str, change=None, negated: bool = False, visible: bool = False) -> Builder:
        return self.where(self.exists(name, change, negated, visible))

    def exists(self, name: str, change=None, negated: bool = False, visible: bool = False) -> Exists:
        """The condition that some (or no) row is related; a visible one is also part of the result."""
        alias = name if visible else f"{HIDDEN_PREFIX}{name}"
        return Exists("NOT EXISTS" if negated else "EXISTS", self._chain(name, change, alias))

    def related(self, name: str, change=None) -> Builder:
        return self._but(related=(*self.tree.related, self._chain(name, change, name)))

    def order_by(self, column: str, direction: str = "asc") -> Builder:
        return self._but(order_by=(*self.tree.order_by, (column, direction)))

    def limit(self, n: int) -> Builder:
        return self._but(limit=n)

    def one(self) -> Builder:
        return Builder(self.catalog, self.tree.but(limit=1), True)

    def start(self, row: dict, exclusive: bool = False) -> Builder:
        return self._but(start=Start(row, exclusive))

    def build(self) -> Query:
        return self.tree

    def _but(self, **changes) -> Builder:
        return Builder(self.catalog, self.tree.but(**changes), self.singular)

    def _chain(self, name: str, change, alias: str) -> Related:
        """One hop, or two over a junction whose own rows are hidden."""
        hops = self.catalog[self.tree.table].relationships.get(name)
        if not hops:
            raise QueryError(f"{self.tree.table} has no relationship {name}")
        if len(hops) > 2:
            raise QueryError(f"{name} has {len(hops)} hops; a relationship has one, or two over a junction")
        last = Builder(self.catalog, Query(hops[-1].table))
        last = change(last) if change else last
        query = last.tree.but(alias=alias)
        for hop in hops[:0:-1]:
            query = Query(hops[0].table, alias, related=(Related(hop.parent, hop.child, query, False, hop.one or last.singular),))
        return Related(hops[0].parent, hops[0].child, query, len(hops) > 1, hops[0].one or last.singular)


@dataclass
class Registry:
    """Named queries and mutators: a name and arguments instead of a tree."""

    catalog: Catalog
    queries: dict = field(default_factory=dict)
    mutators: dict = field(default_factory=dict)

    def from_(self, table: str) -> Builder:
        if table not in self.catalog:
            raise QueryError(f"unknown table {table}")
        return Builder(self.catalog, Query(table))

    def query(self, name: str, check=None):
        """Decorator: fn(builder_of, *args) -> builder. `check` sees the arguments first and may raise."""
        return lambda fn: self.queries.setdefault(name, (fn, check)) and fn

    def mutator(self, name: str, check=None):
        """Decorator: fn(*args) -> list of row operations."""
        return lambda fn: self.mutators.setdefault(name, (fn, check)) and fn

    def resolve(self, name: str, *args, ctx=None) -> Query:
        """The tree of a named query. ctx: who asks; goes to functions with a parameter of that name."""
        fn, check = self._found(self.queries, name)
        if check:
            check(*args)
        return fn(self.from_, *args, **self._ctx(fn, ctx)).build()

    def mutate(self, name: str, *args, ctx=None) -> list[dict]:
        """The row operations of a named mutation."""
        fn, check = self._found(self.mutators, name)
        if check:
            check(*args)
        out = list(fn(*args, **self._ctx(fn, ctx)))
        for o in out:
            if o.get("op") not in ("insert", "upsert", "update", "delete") or o.get("table") not in self.catalog:
                raise QueryError(f"not an operation on a known table: {o}")
            if missing := [k for k in self.catalog[o["table"]].key if k not in o.get("row", {})]:
                raise QueryError(f"{name} leaves out the key column {missing[0]}")
        return out

    @staticmethod
    def _ctx(fn, ctx) -> dict:
        return {"ctx": ctx} if "ctx" in inspect.signature(fn).parameters else {}

    @staticmethod
    def _found(known: dict, name: str):
        if name not in known:
            raise QueryError(f"unknown name {name}")
        return known[name]


def hop(parent: str | tuple, table: str, child: str | tuple, one: bool = False) -> Hop:
    wide = lambda x: (x,) if isinstance(x, str) else tuple(x)
    return Hop(wide(parent), table, wide(child), one)
