"""Tables by name, with keys, types and relationships."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class Hop:
    parent: tuple[str, ...]
    table: str
    child: tuple[str, ...]
    one: bool = False


@dataclass
class TableDef:
    """load gives the table's rows when a query is compiled; key identifies a row, nulls included."""

    name: str
    load: Callable[[], DataFrame]
    key: tuple[str, ...]
    relationships: dict[str, tuple[Hop, ...]] = field(default_factory=dict)

    def relate(self, name: str, *hops: Hop) -> TableDef:
        self.relationships[name] = hops
        return self

    def schema(self) -> T.StructType:
        return self.load().schema


def logical(t: T.DataType) -> str:
    """The type that clients see."""
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.NumericType | T.DateType | T.TimestampType | T.TimestampNTZType):
        return "number"  # times as milliseconds
    return "string" if isinstance(t, T.StringType) else "json"


class Catalog(dict):
    """name -> TableDef."""

    def add(self, name: str, source: DataFrame | Callable[[], DataFrame], key) -> TableDef:
        key = (key,) if isinstance(key, str) else tuple(key)
        self[name] = TableDef(name, source if callable(source) and not isinstance(source, DataFrame) else lambda: source, key)
        return self[name]

    @classmethod
    def parquet(cls, spark: SparkSession, folder: str, keys: dict[str, tuple[str, ...] | str]) -> Catalog:
        """Tables read when they are used: no files are listed for tables that no query names."""
        found = cls()
        for name, key in keys.items():
            found.add(name, lambda name=name: spark.read.parquet(f"{folder}/{name}.parquet"), key)
        return found

    def declare(self, spark: SparkSession, name: str, columns: T.StructType | str, key) -> TableDef:
        """An empty table of the given columns, until rows are added under its name."""
        shape = T._parse_datatype_string(columns) if isinstance(columns, str) else columns
        own = (key,) if isinstance(key, str) else tuple(key)
        if missing := [k for k in own if k not in shape.names]:
            raise ValueError(f"{name} has no column {missing[0]}")
        return self.add(name, spark.createDataFrame([], shape), own)

    def client_schema(self, names=None) -> dict:
        """Tables with the logical types of their columns, their keys and relationships, as JSON for clients."""
        out = {}
        for name in sorted(names or self):
            t = self[name]
            columns = {f.name: {"type": logical(f.dataType), "optional": f.nullable and f.name not in t.key} for f in t.schema().fields}
            hops = {n: [{"sourceField": list(h.parent), "destTable": h.table, "destField": list(h.child), "cardinality": "one" if h.one else "many"} for h in hs] for n, hs in sorted(t.relationships.items())}
            out[name] = {"columns": columns, "primaryKey": list(t.key), "relationships": hops}
        return {"tables": out}

    def check(self) -> None:
        """Raises ValueError where a relationship names a table or a column that is not there, or columns that don't pair."""
        for name, t in self.items():
            for relation, hops in t.relationships.items():
                at = name
                for h in hops:
                    if h.table not in self:
                        raise ValueError(f"{name}.{relation}: unknown table {h.table}")
                    if len(h.parent) != len(h.child) or not h.parent:
                        raise ValueError(f"{name}.{relation}: columns don't pair")
                    for table, own in ((at, h.parent), (h.table, h.child)):
                        if bad := [c for c in own if c not in self[table].schema().names]:
                            raise ValueError(f"{name}.{relation}: {table} has no column {bad[0]}")
                    at = h.table

    def lookup(self, name: str, key: tuple) -> DataFrame:
        """The row of a key; null parts match null."""
        from functools import reduce

        df, own = self[name].load(), self[name].key
        return df.where(reduce(lambda a, b: a & b, (df[c].eqNullSafe(v) for c, v in zip(own, key, strict=True))))
