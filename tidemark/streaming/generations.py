"""Tables kept as a base and the changes since, a small generation for each batch.

A generation has a row for each key that its batch changed: the row that the key has now, or that it has
none. Reading takes the newest generation of a key, else the base. After MOST generations the table is
written anew as a base, so reading and writing both stay in proportion to what changes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.compile import matching

MOST = 8


def newest(spark: SparkSession, paths: list[str], key: tuple[str, ...]) -> DataFrame:
    """(row, gone) of each key in any generation, from the last that has it."""
    if len(paths) == 1:
        return spark.read.parquet(paths[0])
    every = reduce(DataFrame.union, (spark.read.parquet(p).withColumn("g", F.lit(n)) for n, p in enumerate(paths)))
    own = every.groupBy(F.struct(*(F.col(f"row.{k}") for k in key)).alias("k")).agg(F.max_by(F.struct("row", "gone"), "g").alias("v"))
    return own.select("v.row", "v.gone")


def read(spark: SparkSession, base: str, deltas: list[str], key: tuple[str, ...]) -> DataFrame:
    """The table's rows now."""
    rows = spark.read.parquet(base)
    if not deltas:
        return rows
    last = newest(spark, deltas, key)
    return matching(rows, last.select("row.*"), key, "left_anti").unionByName(last.where("not gone").select("row.*"))


def delta(keys: DataFrame, rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """A generation: `rows` are what `keys` have now; keys without a row are gone."""
    own = keys.select(*(F.col(k).alias(f"__m{n}") for n, k in enumerate(key))).distinct()
    on = reduce(lambda a, b: a & b, (F.col(f"__m{n}").eqNullSafe(F.col(f"row.{k}")) for n, k in enumerate(key)))
    both = own.join(rows.select(F.struct(*rows.columns).alias("row"), F.lit(True).alias("there")), on, "left")
    names = dict(zip(key, own.columns, strict=True))
    row = F.struct(*((F.col(names[c]) if c in names else F.col(f"row.{c}")).alias(c) for c in rows.columns))
    return both.select(row.alias("row"), F.col("there").isNull().alias("gone"))
