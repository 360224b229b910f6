"""Row patches: results as flat sets of rows, and what a client must put and delete to follow them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.ast import Query
from tidemark.sources.catalog import Catalog


def flat(result: DataFrame, query: Query, catalog: Catalog) -> DataFrame:
    """(table, row_id, row, fingerprint) of every row in a result tree, each once.

    row_id and row are JSON with columns by name; a row's own columns only, related rows stand alone.
    """
    parts = [_rows(result, query.table, {r.name for r in query.related}, catalog)]
    for r in query.related:
        if r.name not in result.columns:
            continue
        kind = result.schema[r.name].dataType
        nested = result.select(F.explode(r.name).alias("v") if isinstance(kind, T.ArrayType) else F.col(r.name).alias("v")).where("v is not null").select("v.*")
        inner = r.query.related[0].query if r.hidden else r.query
        parts.append(flat(nested, inner, catalog))
    return reduce(DataFrame.union, parts).dropDuplicates(["table", "row_id"])


def _rows(df: DataFrame, table: str, nested: set[str], catalog: Catalog) -> DataFrame:
    names = sorted(c for c in df.columns if c not in nested)
    text = lambda own: F.to_json(F.struct(*own), {"ignoreNullFields": "false"})
    return df.select(F.lit(table).alias("table"), text(catalog[table].key).alias("row_id"), text(names).alias("row")).withColumn("fingerprint", F.sha2("row", 256))


def referenced(sets: dict[str, DataFrame]) -> DataFrame:
    """Rows of several results, each once, with the number of results that hold it."""
    every = reduce(DataFrame.union, sets.values())
    return every.groupBy("table", "row_id").agg(F.max("row").alias("row"), F.max("fingerprint").alias("fingerprint"), F.count("*").alias("refs"))


def patches(old: DataFrame, new: DataFrame) -> DataFrame:
    """(op, table, row_id, row) from what a client holds (table, row_id, fingerprint) to the rows it should hold.

    Unchanged rows are left out; a row goes only when no result holds it any more.
    """
    o = old.select("table", "row_id", F.col("fingerprint").alias("was"))
    both = o.join(new.select("table", "row_id", "row", "fingerprint"), ["table", "row_id"], "full_outer")
    op = F.when(F.col("fingerprint").isNull(), "del").when(~F.col("was").eqNullSafe(F.col("fingerprint")), "put")
    return both.select(op.alias("op"), "table", "row_id", "row").where("op is not null")


def applied(rows: DataFrame, patch: DataFrame) -> DataFrame:
    """What a client holds, (table, row_id, row), after patches (n, op, table, row_id, row) in order of n.

    `put` sets a row; `update` sets the columns that its row has and keeps the others, and does nothing
    where there is no row; `del` removes it; `clear` removes all before it.
    """
    last = patch.where("op = 'clear'").agg(F.coalesce(F.max("n"), F.lit(-1)).alias("cleared"))
    steps = rows.select(F.lit(-1).cast("long").alias("n"), F.lit("put").alias("op"), "table", "row_id", "row").union(patch.where("op <> 'clear'").select(F.col("n").cast("long"), "op", "table", "row_id", "row"))
    steps = steps.join(F.broadcast(last), (F.col("n") > F.col("cleared")) | ((F.col("n") == -1) & (F.col("cleared") == -1)))  # one row
    own = F.array_sort(F.collect_list(F.struct("n", "op", "row")))
    values = lambda row: F.from_json(row, "map<string,variant>")  # noqa: E731  # values keep their types
    merge = lambda old, new: F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
    nothing = F.lit(None).cast("map<string,variant>")
    step = lambda held, s: F.when(s["op"] == "put", values(s["row"])).when(s["op"] == "del", nothing).otherwise(F.when(held.isNotNull(), merge(held, values(s["row"]))))
    held = steps.groupBy("table", "row_id").agg(own.alias("all")).select("table", "row_id", F.aggregate("all", nothing, step).alias("m"))
    names = F.array_sort(F.map_keys("m"))
    row = F.map_from_arrays(names, F.transform(names, lambda k: F.element_at("m", k)))  # columns by name, as in `flat`
    return held.where("m is not null").select("table", "row_id", F.to_json(row, {"ignoreNullFields": "false"}).alias("row"))
