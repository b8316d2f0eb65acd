"""Order-dependent and ranking combinators over DataFrames; rows are ordered by an explicit column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key; null keys are one group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def possession_changes(df: DataFrame) -> DataFrame:
    """Adds `changed`: the next event of the match is of another possession, or there is none, or either is unknown."""
    after = F.lead("possession_id").over(Window.partitionBy("match_id").orderBy("seq"))
    return df.withColumn("changed", F.coalesce(F.col("possession_id") != after, F.lit(True)))


def next_value(column: Column, partition: str, order: str) -> Column:
    """The first non-null value from this row on."""
    return F.first(column, ignorenulls=True).over(Window.partitionBy(partition).orderBy(order).rowsBetween(0, Window.unboundedFollowing))


def average_rank(column: str, *partition: str) -> Column:
    """Share of the average rank among non-null values, ties averaged; null for null."""
    ordered, ties, whole = Window.partitionBy(*partition).orderBy(F.col(column).asc_nulls_last()), Window.partitionBy(*partition, column), Window.partitionBy(*partition)
    value = (F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)) / F.count(column).over(whole)
    return F.when(F.col(column).isNotNull(), value)


def strict_percentile(column: str, *partition: str) -> Column:
    """100 times the share of values below this one."""
    return 100.0 * (F.rank().over(Window.partitionBy(*partition).orderBy(column)) - 1) / F.count(F.lit(1)).over(Window.partitionBy(*partition))


def min_max(column: str, *partition: str) -> Column:
    """100 times the place between the least and the greatest value; 0 if all are equal."""
    w = Window.partitionBy(*partition)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return F.when(high > low, (F.col(column) - low) / (high - low) * 100.0).otherwise(0.0)


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def share(count: str, *partition: str) -> Column:
    """Percent of the partition's total."""
    return 100.0 * F.col(count) / F.sum(count).over(Window.partitionBy(*partition))


def best_of(columns: dict[str, Column | str], floor: float = -1.0) -> Column:
    """The name of the greatest of several columns; the first named wins ties. Null, and what is no greater than `floor`, is
    out; null if nothing is left."""
    each = [F.struct((F.col(c) if isinstance(c, str) else c).cast("double").alias("v"), F.lit(-i).alias("i"), F.lit(n).alias("name")) for i, (n, c) in enumerate(columns.items())]
    return F.array_max(F.filter(F.array(*each), lambda x: x["v"] > floor))["name"]


def united(key: str, **parts: DataFrame) -> DataFrame:
    """A full join of tables with at most one row a key, as one aggregation of their union: a struct column for each table,
    null where it has no row. Tables that come from one source need no renaming for it, as they do in joins."""
    rows = None
    for name, df in parts.items():
        mine = df.select(key, F.struct(*(c for c in df.columns if c != key)).alias(name))
        rows = mine if rows is None else rows.unionByName(mine, allowMissingColumns=True)
    return rows.groupBy(key).agg(*(F.first(n, ignorenulls=True).alias(n) for n in parts))
