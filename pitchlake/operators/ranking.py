"""Row numbers, running totals and ranks of whole tables and of groups of any size, in pieces of a range sort.

A piece is what one task of a range sort holds. Each is numbered or summed on its own; the totals of the pieces, as many
rows as there are pieces, give each its start. No window spans a table or a group: only pieces.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

_ROW = (1 << 33) - 1


def in_pieces(df: DataFrame, *order: Column) -> DataFrame:
    """`df` range-sorted and written, with _piece (ascending along the order) and _place (the row's place in its piece)."""
    at = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranged.withColumns({"_piece": F.shiftright(at, 33).cast("int"), "_place": at.bitwiseAND(F.lit(_ROW))}), "pieces")


def numbered(df: DataFrame, *order: Column, name: str = "row") -> DataFrame:
    """Adds the row number over the whole table, from 0. Rows that tie in `order` get numbers in no particular order."""
    return running_totals(df, {}, *order, name=name)


def running_totals(df: DataFrame, sums: Mapping[str, str], *order: Column, name: str = "row") -> DataFrame:
    """Adds to each row its number `name` (from 0), and for each new: column of `sums` the total of the column over all
    rows before it. Null counts as 0; an empty table stays empty."""
    pieces = in_pieces(df, *order)
    totals = pieces.groupBy("_piece").agg(F.count(F.lit(1)).alias(name), *(F.coalesce(F.sum(c), F.lit(0)).alias(new) for new, c in sums.items()))
    names, starts = [name, *sums], []
    before = [0] * len(names)
    for r in sorted(totals.collect()):  # a row a piece
        starts.append((r["_piece"], *before))
        before = [b + r[c] for b, c in zip(before, names, strict=True)]
    types = {f.name: f.dataType.simpleString() for f in totals.schema.fields}
    first = df.sparkSession.createDataFrame(starts, "_piece int, " + ", ".join(f"`_first_{c}` {types[c]}" for c in names))
    earlier = Window.partitionBy("_piece").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    out = pieces.withColumn(name, F.col("_place"))
    if sums:
        out = out.withColumns({new: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for new, c in sums.items()})
    out = out.join(F.broadcast(first), "_piece")
    return out.select(*df.columns, *((F.col(c) + F.col(f"_first_{c}")).alias(c) for c in names))


def rank_table(df: DataFrame, value: str, *groups: str) -> DataFrame:
    """Per group and value: ties (its rows), below (the group's rows with a lower value), dense (its place among the
    distinct values, from 1), of (the group's rows), distinct (its distinct values), low and high (its least and greatest).
    Null isn't ranked."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("ties"))
    pieces = in_pieces(counts, *(F.col(c) for c in (*groups, value)))
    earlier = Window.partitionBy(*groups, "_piece").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    inside = pieces.withColumns({"_below": F.coalesce(F.sum("ties").over(earlier), F.lit(0)), "_dense": F.count("ties").over(earlier) + 1})
    totals = pieces.groupBy(*groups, "_piece").agg(
        F.sum("ties").alias("_n"), F.count("ties").alias("_d"), F.min(value).alias("_low"), F.max(value).alias("_high")
    )
    whole = Window.partitionBy(*groups)  # as many rows as the group has pieces
    before = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *(F.col(c).alias(f"_g{i}") for i, c in enumerate(groups)), F.col("_piece").alias("_p"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_d0"),
        F.sum("_n").over(whole).alias("of"), F.sum("_d").over(whole).alias("distinct"), F.min("_low").over(whole).alias("low"),
        F.max("_high").over(whole).alias("high")
    )
    same = [F.col("_piece") == F.col("_p"), *(F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(groups))]
    return inside.join(totals, same).select(
        *groups, value, "ties", (F.col("_below") + F.col("_n0")).alias("below"), (F.col("_dense") + F.col("_d0")).cast("long").alias("dense"), "of",
        "distinct", "low", "high"
    )


#: A group of no more rows than this is ranked by windows, in one task.
WINDOW_ROWS = 1 << 20


def rank_windows(df: DataFrame, value: str, *groups: str) -> DataFrame:
    """Adds to `df` what rank_table tells, by windows over whole groups: for groups of a size that fits a task."""
    whole, ties = Window.partitionBy(*groups), Window.partitionBy(*groups, value)
    order = whole.orderBy(F.col(value).asc_nulls_last())
    dense = F.dense_rank().over(order).cast("long")
    x = df.withColumns({"ties": F.count(value).over(ties), "below": (F.rank().over(order) - 1).cast("long"), "dense": dense})
    x = x.withColumns({"of": F.count(value).over(whole), "low": F.min(value).over(whole), "high": F.max(value).over(whole)})
    return x.withColumn("distinct", F.max(F.when(F.col(value).isNotNull(), F.col("dense"))).over(whole))


def ranked(df: DataFrame, value: str, *groups: str, most_rows: int | None = None, **columns: Column) -> DataFrame:
    """Adds `columns`, expressions over the value and what rank_table tells of it, which are null where the value is.

    most_rows: what no group has more rows than, if that is known. Where it is at most WINDOW_ROWS the ranks are windows, and
    nothing is computed yet. Otherwise they are joined on from rank_table; `df` is read twice then: pass a written or plain
    table."""
    if most_rows is not None and most_rows <= WINDOW_ROWS:
        known = F.col(value).isNotNull()
        return rank_windows(df, value, *groups).select(*df.columns, *(F.when(known, e).alias(n) for n, e in columns.items()))
    table = rank_table(df, value, *groups)
    keys = [*groups, value]
    table = table.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), *(e.alias(n) for n, e in columns.items()))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    return df.join(table, same, "left").select(*df.columns, *columns)


def reverse_blocks(df: DataFrame, size: int, *order: Column, name: str = "block") -> DataFrame:
    """Adds the number of the row's block of `size` rows, counted from the end of `order`: the last rows are block 1. `order`
    is given backwards, last row first."""
    x = numbered(df, *order, name="_back")
    return x.withColumn(name, F.floor(F.col("_back") / size).cast("long") + 1).drop("_back")


def average_share() -> Column:
    """The average rank of tied values as a share of the group."""
    return (F.col("below") + 1 + (F.col("ties") - 1) / F.lit(2.0)) / F.col("of")


def strict_percent() -> Column:
    """100 times the share of lower values."""
    return 100.0 * F.col("below") / F.col("of")


def dense_from_top() -> Column:
    """The dense rank, greatest value first."""
    return (F.col("distinct") - F.col("dense") + 1).cast("long")
