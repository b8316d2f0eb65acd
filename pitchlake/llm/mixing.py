"""Mixing sources to target weights by systematic sampling.

A source's expected copies of a document are its target over its size. They are summed up along an order of the source's
documents, one random offset is added, and a document is taken once for each integer that the running sum crosses. The
order is by size, so that the words taken stay within about one largest document of the target; equal sizes are ordered
by a hash of id and text, so that reruns agree.

As all documents of a source expect equally many copies, the running sum is the document's number times that rate. The
number comes in three steps, none of which holds a source: the counts by size of each source, those by leading digits of
the hash among documents of one size, and the documents of one size and one prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import numbered, running_totals
from ..sources.scratch import written
from .base import read_table

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
#: A group of documents of one size and prefix has about as many rows at most (a sixteenth on average).
GROUP_ROWS = 1 << 20


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """sizes: source, source_size (distinct sources). Adds target: by code point of the source, null last, the weights in
    turn share the sum of all sizes; a target stops at `most` times its source's size, and the rest is shared by weight
    among the others, until none is above.

    Sources are filled in the order in which they stop: the first that stays under its bound sets the share of one weight
    for all that follow. Everything works on one row a source; only the total and that share go to the driver."""
    by_name = numbered(sizes, F.col("source").isNull(), F.col("source"), name="place")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    weighed = by_name.withColumn("weight", turn).withColumn("bound", most * F.col("source_size"))
    filled = written(
        running_totals(weighed, {"bound_before": "bound", "weight_before": "weight"}, F.col("bound") / F.col("weight"), F.col("place"), name="turn"), "sources"
    )
    total, whole = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    share = (F.lit(total) - F.col("bound_before")).cast("double") / (F.lit(whole) - F.col("weight_before"))
    level = filled.where(share * F.col("weight") <= F.col("bound")).agg(F.min_by(share, "turn")).first()[0] or 0.0
    return filled.select("source", "source_size", F.least(F.col("bound").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def _digits(c: Column, n: int) -> Column:
    return F.conv(F.substring(c, 1, n), 16, 10).cast("long")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """Per row: id, size (words; null text: 0), source_size (words of the row's source), target (its source's), taken (words
    that the mix takes of the row, repeats counted), source and copies (`most` at most).

    A null source is a source of its own, and an empty one another. Ids may repeat or be null; rows equal in id, source and
    text are interchangeable. Texts may be of any length: only their words are counted and their hash taken. Documents
    without words are numbered like others and add nothing. An empty table gives no rows; extra columns are not read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    identity = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary"))).cast("binary"))
    rows = written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), identity.alias("h")
        ), "sized"
    )
    n, prefix = rows.count(), 0
    while n >> (4 * prefix) > GROUP_ROWS and prefix < 8:
        prefix += 1
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    # a null source can't be joined on as it is
    key = lambda c="source": F.coalesce(F.concat(F.lit("="), c), F.lit("")).alias("s")
    rows = rows.select("doc_id", "source", key(), "size", F.substring("h", 1, prefix).alias("lead"), "h")
    groups = rows.groupBy("s", "size", "lead").agg(F.count(F.lit(1)).alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.withColumn("first", before(Window.partitionBy("s", "size").orderBy("lead"))).withColumnRenamed("n", "in_lead")
    of_size = rows.groupBy("s", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("smaller", before(Window.partitionBy("s").orderBy("size"))).drop("n")
    offset = _digits(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))).cast("binary")), 4) / 65536.0
    rate = goals.select(
        key(), "source_size", "target", offset.alias("offset"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate")
    )
    starts = groups.join(of_size, ["s", "size"]).join(rate, "s").drop("in_lead")
    place = F.row_number().over(Window.partitionBy("s", "size", "lead").orderBy("h", "doc_id")) + F.col("first") + F.col("smaller")
    crossed = lambda i: F.floor(i * F.col("rate") + F.col("offset"))
    x = rows.join(starts, ["s", "size", "lead"]).withColumn("place", place)
    copies = F.least(crossed(F.col("place")) - crossed(F.col("place") - 1), F.lit(most)).cast("long")
    return x.withColumn("copies", copies).select(
        F.col("doc_id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.col("source").alias(source_col),
        "copies"
    )


def op12_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as size, md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as h
  from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source is null, source) - 1 as place from d group by source
), w as (
  select *, case place % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 3 * source_size as bound from s
), f as (
  select *, row_number() over o as turn,
    cast(sum(source_size) over () - coalesce(sum(bound) over (o rows between unbounded preceding and 1 preceding), 0) as double)
      / cast(sum(weight) over () - coalesce(sum(weight) over (o rows between unbounded preceding and 1 preceding), 0) as double) as share
  from w window o as (order by bound / weight, place)
), l as (
  select coalesce(arg_min(share, turn) filter (share * weight <= bound), 0e0) as level from f
), t as (
  select source, source_size, least(cast(bound as double), level * weight) as target,
    cast(('0x' || substr(md5('0:' || coalesce(source, '')), 1, 4)) as bigint) / 65536e0 as u
  from f, l
), p as (
  select doc_id, size, source_size, target, d.source, u, case when source_size > 0 then target / source_size else 0e0 end as rate,
    row_number() over (partition by d.source order by size, h, doc_id) as place
  from d join t on d.source is not distinct from t.source
), c as (
  select *, least(cast(floor(place * rate + u) - floor((place - 1) * rate + u) as bigint), 3) as copies from p
)
select doc_id, size, source_size, target, copies * size as taken, source, copies from c
"""
