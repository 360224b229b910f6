"""Query trees as DataFrame plans.

Conjunctions of EXISTS become semi and anti joins; EXISTS under OR becomes a join with the distinct
keys of the subquery and a flag. Related rows are ordered arrays, aggregated by key on the child's
side before they are joined; of children of parents that conditions or limits narrow, only those of
such parents. Limits by parent are row numbers, for which Catalyst filters within each task first.
Nothing runs here: a plan comes out.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordering import from_cursor, sort_columns, total_order
from tidemark.functions.predicates import all_of, predicate
from tidemark.plans.ast import HIDDEN_PREFIX, Exists, Group, Query, Related, exists_in
from tidemark.sources.catalog import Catalog

ROW = "__row"  # place among the rows of one parent


def key_names(n: int, tag: str) -> list[str]:
    return [f"__{tag}{k}" for k in range(n)]


class Compiler:
    def __init__(self, catalog: Catalog):
        self.catalog, self.numbers = catalog, count()

    def filtered(self, q: Query) -> tuple[DataFrame, list[tuple[str, str]]]:
        """Rows of the table that pass start and where, and the total order."""
        df = self.catalog[q.table].load()
        order = total_order(q, self.catalog[q.table].key, df.columns)
        if q.start:
            df = df.where(from_cursor(order, q.start.row, q.start.exclusive))
        return (self.where(df, q.where) if q.where is not None else df), order

    def where(self, df: DataFrame, condition) -> DataFrame:
        parts = condition.conditions if isinstance(condition, Group) and condition.kind == "and" else (condition,)
        plain = [c for c in parts if not exists_in(c)]
        if plain:
            df = df.where(all_of(predicate(c, df.schema, F.col) for c in plain))
        for c in parts:
            if isinstance(c, Exists):
                df = self.semi(df, c)
            elif exists_in(c):
                df = self.flagged(df, c)
        return df

    def child_keys(self, e: Related, tag: str) -> DataFrame | None:
        """The child's correlation keys; None if its limit is 0, so that it has no rows."""
        if e.query.limit == 0:
            return None
        child, _ = self.filtered(e.query)
        if e.hidden:
            for r in e.query.related:
                child = self.semi(child, Exists("EXISTS", r))
        return child.select(*(F.col(c).alias(n) for c, n in zip(e.child, key_names(len(e.child), tag), strict=True)))

    def semi(self, df: DataFrame, e: Exists) -> DataFrame:
        keys = self.child_keys(e.related, f"e{next(self.numbers)}_")
        if keys is None:
            return df if e.op == "NOT EXISTS" else df.where(F.lit(False))
        on = all_of(F.col(p) == F.col(n) for p, n in zip(e.related.parent, keys.columns, strict=True))
        return df.join(keys, on, "left_semi" if e.op == "EXISTS" else "left_anti")

    def flagged(self, df: DataFrame, condition) -> DataFrame:
        names, flags = df.columns, {}
        for e in exists_in(condition):
            tag = f"e{next(self.numbers)}_"
            keys = self.child_keys(e.related, tag)
            if keys is None:
                flags[id(e)] = F.lit(e.op == "NOT EXISTS")
                continue
            own = keys.columns
            keys = keys.dropna().distinct().withColumn(f"{tag}found", F.lit(True))
            df = df.join(keys, all_of(F.col(p) == F.col(n) for p, n in zip(e.related.parent, own, strict=True)), "left")
            found = F.col(f"{tag}found").isNotNull()
            flags[id(e)] = found if e.op == "EXISTS" else ~found
        return df.where(predicate(condition, df.select(*names).schema, F.col, lambda e: flags[id(e)])).select(*names)

    def rows(self, q: Query, by: tuple[str, ...] = (), parents: DataFrame | None = None, narrow: bool = False, only: DataFrame | None = None) -> tuple[DataFrame, list[tuple[str, str]], dict[str, str]]:
        """Rows with their related arrays, limited; with `by`, ROW is the place in each group.

        Related arrays have names of their own until the end, given in the last value: a relationship may
        have the name of a column, whose place it then takes in the result. parents: values of `by` that
        rows are wanted for, all if None; narrow: such values are few; only: keys of the rows wanted.
        """
        df, order = self.filtered(q)
        if only is not None:
            df = matching(df, only, self.catalog[q.table].key, "left_semi")
        if parents is not None:
            keys = parents.toDF(*key_names(len(by), f"p{next(self.numbers)}_"))
            df = df.join(keys, all_of(F.col(c) == F.col(k) for c, k in zip(by, keys.columns, strict=True)), "left_semi")
        narrow = narrow or parents is not None or only is not None or q.where is not None or q.start is not None or (q.limit is not None and not by)
        if by:
            df = df.withColumn(ROW, F.row_number().over(Window.partitionBy(*by).orderBy(*sort_columns(order))))
            df = df.where(F.col(ROW) <= q.limit) if q.limit is not None else df
        elif q.limit is not None:
            df = df.orderBy(*sort_columns(order)).limit(q.limit)
        seen = [e.related for e in exists_in(q.where) if e.op == "EXISTS" and e.related.query.alias and not e.related.query.alias.startswith(HIDDEN_PREFIX)]
        given = {}
        for r in (*q.related, *seen):
            df, given[r.name] = self.attach(df, r, narrow)
        return df, order, given

    def reached(self, q: Query, changed: dict[str, DataFrame]) -> DataFrame | None:
        """Keys of the query's rows that changed rows can affect; None if none can.

        changed: by table, rows before and after their change. A changed child affects the parents that
        have the values of its correlation columns, which then affect theirs.
        """
        key = self.catalog[q.table].key
        found = [changed[q.table].select(*key)] if q.table in changed else []
        for r in (*q.related, *(e.related for e in exists_in(q.where))):
            values = self.touched_values(r, changed)
            if values is not None:
                names = key_names(len(r.parent), f"t{next(self.numbers)}_")
                own = values.toDF(*names)
                on = all_of(F.col(p) == F.col(n) for p, n in zip(r.parent, names, strict=True))
                found.append(self.catalog[q.table].load().join(own, on, "left_semi").select(*key))
        return reduce(DataFrame.union, found).distinct() if found else None

    def touched_values(self, r: Related, changed: dict[str, DataFrame]) -> DataFrame | None:
        """Values of the child's correlation columns for which changed rows can change what is related."""
        child = r.query
        found = [changed[child.table].select(*r.child)] if child.table in changed else []
        below = (*child.related, *(e.related for e in exists_in(child.where)))
        if any(b.query.tables() & changed.keys() for b in below):
            deeper = self.reached(child, changed)
            found.append(matching(self.catalog[child.table].load(), deeper, self.catalog[child.table].key, "left_semi").select(*r.child))
        return reduce(DataFrame.union, found).dropna().distinct() if found else None

    @staticmethod
    def shown(df: DataFrame, given: dict[str, str]) -> list:
        """The columns of a result."""
        return [F.col(c) for c in df.columns if c != ROW and c not in given and c not in given.values()] + [F.col(own).alias(name) for name, own in given.items()]

    def attach(self, df: DataFrame, r: Related, narrow: bool) -> tuple[DataFrame, str]:
        """Adds the ordered array of related rows, or the first one; empty (or null) without any."""
        child, _, given = self.rows(r.query, r.child, df.select(*r.parent) if narrow else None)
        keys = key_names(len(r.child), f"r{next(self.numbers)}_")
        if r.hidden:
            inner = r.query.related[0]
            values = F.array(F.col(given[inner.name])) if inner.one else F.col(given[inner.name])
            lists = child.select(*(F.col(c).alias(k) for c, k in zip(r.child, keys, strict=True)), ROW, values.alias("v"))
            lists = lists.dropna(subset=keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(ROW, "v"))).alias("all"))
            got = F.filter(F.flatten(F.transform("all", lambda x: x["v"])), lambda x: x.isNotNull())
        else:
            body = F.struct(*self.shown(child, given))
            lists = child.select(*(F.col(c).alias(k) for c, k in zip(r.child, keys, strict=True)), ROW, body.alias("v"))
            lists = lists.dropna(subset=keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(ROW, "v"))).alias("all"))
            got = F.transform("all", lambda x: x["v"])
        own = keys[0].replace("__r", "__related")
        lists = lists.select(*keys, got.alias(own))
        on = all_of(F.col(p) == F.col(k) for p, k in zip(r.parent, keys, strict=True))
        out = df.join(lists, on, "left").drop(*keys)
        value = F.get(own, F.lit(0)) if r.one else F.coalesce(own, F.array())
        return out.withColumn(own, value), own

    def run(self, q: Query, reverse: bool = False, ordered: bool = True, only: DataFrame | None = None) -> DataFrame:
        if reverse:
            turned = total_order(q, self.catalog[q.table].key, self.catalog[q.table].load().columns)
            q = q.but(order_by=tuple((f, "desc" if d == "asc" else "asc") for f, d in turned))
        df, order, given = self.rows(q, only=only)
        df = df.orderBy(*sort_columns(order)) if ordered else df
        return df.select(*self.shown(df, given))


def matching(df: DataFrame, keys: DataFrame, key: tuple[str, ...], how: str) -> DataFrame:
    """`df` joined with rows of `keys` that have the same key, nulls included; `how` is a semi or anti join."""
    own = keys.select(*(F.col(k).alias(f"__m{n}") for n, k in enumerate(key)))
    return df.join(own, all_of(F.col(k).eqNullSafe(F.col(f"__m{n}")) for n, k in enumerate(key)), how)


def compile_query(q: Query, catalog: Catalog, reverse: bool = False, ordered: bool = True, only: DataFrame | None = None) -> DataFrame:
    """The query's result: its rows in total order, related rows as arrays of structs.

    ordered: False leaves the rows as they come, for results that are stored; only: keys of the rows
    that are wanted, of a query without start and limit.
    """
    return Compiler(catalog).run(q, reverse, ordered, only)


def bounded(df: DataFrame, most: int) -> DataFrame:
    """Refuses a result of more than `most` rows; counts no further than that."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return df


def unnested(df: DataFrame, name: str, prefix: str = "") -> DataFrame:
    """One row for each related row, with its place in `ord`; parents without any have null there."""
    names = [c for c in df.columns if c != name]
    fields = df.schema[name].dataType.elementType.names
    out = df.select(*names, F.posexplode_outer(name).alias("ord", "__v"))
    return out.select(*names, (F.col("ord") + 1).alias("ord"), *(F.col(f"__v.{f}").alias(f"{prefix}{f}") for f in fields))
