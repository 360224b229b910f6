"""Total orders and cursors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.predicates import all_of, any_of
from tidemark.plans.ast import Query, QueryError


def total_order(q: Query, key: tuple[str, ...], names: list[str]) -> list[tuple[str, str]]:
    """The query's order, completed by the key's missing columns, ascending."""
    order = list(q.order_by)
    order += [(k, "asc") for k in key if k not in {f for f, _ in order}]
    if bad := [f for f, _ in order if f not in names]:
        raise QueryError(f"unknown column {bad[0]}")
    return order


def sort_columns(order, col=F.col, reverse: bool = False) -> list[Column]:
    """Nulls come first ascending and last descending."""
    return [col(f).asc_nulls_first() if (d == "asc") != reverse else col(f).desc_nulls_last() for f, d in order]


def after(column: Column, direction: str, v) -> Column:
    """Strictly behind v in one direction."""
    if direction == "asc":
        return column.isNotNull() if v is None else column > F.lit(v)
    return F.lit(False) if v is None else (column < F.lit(v)) | column.isNull()


def from_cursor(order, row: dict, exclusive: bool, col=F.col, reverse: bool = False) -> Column:
    """Rows behind the cursor in the total order, with the row itself unless exclusive."""
    turn = {"asc": "desc", "desc": "asc"}
    order = [(f, turn[d] if reverse else d) for f, d in order]
    same = [col(f).eqNullSafe(F.lit(row.get(f))) for f, _ in order]
    parts = [all_of([*same[:k], after(col(f), d, row.get(f))]) for k, (f, d) in enumerate(order)]
    return any_of(parts if exclusive else [*parts, all_of(same)])
