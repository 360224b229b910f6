"""Tables of a database as a source of initial contents, by Spark's JDBC reader.

A read is split over tasks by ranges of a numeric column, so no task and no connection reads a whole
table. Columns can come as the database's own texts and be decoded here, by the names of their types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.decoding import decoded


def jdbc_table(spark: SparkSession, url: str, table: str, columns: list[str] | None = None, split_by: str | None = None, splits: int = 8, fetch: int = 10_000, where: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Rows of a table. columns: those read, all if None; split_by: a numeric column whose range, asked for
    first, is dealt over `splits` tasks; where: a condition that the database applies. An empty table, or
    one whose `split_by` is null throughout, is read by one task; rows with a null there are read by the first."""
    made = lambda: spark.read.format("jdbc").options(url=url, fetchsize=str(fetch), **(options or {}))
    text = f"select {', '.join(columns) if columns else '*'} from {table}" + (f" where {where}" if where else "")
    if split_by:
        low, high = made().option("query", f"select min({split_by}) as low, max({split_by}) as high from {table}" + (f" where {where}" if where else "")).load().first()
        if low is not None and low < high:
            return made().options(dbtable=f"({text}) t", partitionColumn=split_by, lowerBound=str(int(low)), upperBound=str(int(high) + 1), numPartitions=str(splits)).load()
    return made().option("query", text).load()


def decoded_table(raw: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """A table of texts with its columns decoded; kinds: column -> the database's type."""
    return raw.select(*(decoded(F.col(c), kinds[c]).alias(c) if c in kinds else F.col(c) for c in raw.columns))
