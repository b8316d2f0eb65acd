"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A seed mask looks at some words of a window and ignores the others, so a substituted word at an ignored position doesn't
hide a match. Every window of the benchmark items and of the documents is hashed under each mask; the two are joined on
the hash, and around each hit the words on the same diagonal are compared, which tolerates substitutions anywhere.

The masks lose no overlap: those of MASKS leave one intact whichever two words of a 13-word window differ; for shorter
items, and other windows and tolerances, the words are dealt out to one mask more than words may differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import materialize, read_table

#: For windows of 13 words of which two may differ: the word offsets that each mask compares; the span of all is SPAN words.
MASKS = ((0, 1, 3, 4, 7, 9), (0, 2, 3, 5, 8, 9), (0, 1, 4, 6, 7, 9))
SPAN = 10
#: Seeds and items go to all executors only while they are fewer and smaller than this; beyond, the join shuffles.
MOST_SEEDS, MOST_ITEM_BYTES = 200_000, 32 << 20


def _words(text: str) -> F.Column:
    return F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), "")


def masks_of(length: int, tolerance: float) -> tuple[tuple[tuple[int, ...], ...], int, int]:
    """Masks for windows of `length` words, the words that they span, and how many words may differ."""
    may = int(length * tolerance)
    if (length, may) == (13, 2):
        return MASKS, SPAN, may
    return tuple(tuple(range(r, length, may + 1)) for r in range(may + 1)), length, may


def _seeds(words: str, lengths: list[int], window: int, tolerance: float, beyond: bool) -> F.Column:
    """For each length, as (w, seeds), all seed hashes of an array of words, those of one place together, as many as masks;
    null where a mask reaches over the array's ends. Each word is hashed once, for all lengths.

    With `beyond`, a length under `window` (a whole item, which may lack words at either end of a text) begins as many places
    before the text as words may differ, and ends as far beyond."""

    def at(h: F.Column, i: F.Column, length: int, m: int, mask: tuple[int, ...], edge: int) -> F.Column:
        own = [F.get(h, i + o) for o in mask]
        seed = F.xxhash64(F.lit(length), F.lit(m), *own)
        return F.when(own[0].isNotNull() & own[-1].isNotNull(), seed) if edge else seed

    def of_length(h: F.Column, length: int) -> F.Column:
        masks, span, may = masks_of(length, tolerance)
        edge = may if beyond and length < window else 0
        last = F.size(h) - span + edge
        places = F.transform(
            F.sequence(F.lit(-edge), F.greatest(last, F.lit(-edge))),
            lambda i: F.array(*(at(h, i, length, m, mask, edge) for m, mask in enumerate(masks)))
        )
        seeds = F.when((last >= -edge) & (F.size(h) > 0), F.flatten(places))
        return F.struct(F.lit(length).alias("w"), seeds.alias("seeds"))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.element_at(F.transform(F.array(hashes), lambda h: F.array(*(of_length(h, n) for n in lengths))), 1)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, tolerance: float = 0.2, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", by_text: bool = False
) -> DataFrame:
    """Pairs of a document and a benchmark item that overlap: id, item id, n_equal, n_window.

    Words are runs of letters and digits in lower case. An overlap: of some `window` consecutive words of the item (all,
    if it has fewer) at most the share `tolerance` differs from the document's words, or lies beyond its ends. n_equal is
    the most equal words in such a window around a seed hit. An item of under five words must be there word for word.
    Null and empty texts have no words and no pairs. Null ids are kept as one id; repeated rows give one pair, as do
    ties of windows. `by_text`: pairs are of an id and a text, and the text's xxhash64 comes out as h. An empty table on
    either side gives no rows. Extra columns are not read. Of a very long text the words are one array in memory; it is
    read twice, and crosses the network once if anything in it is hit."""
    whose = ["doc_id", "h"] if by_text else ["doc_id"]
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("item_text")).where("item_text is not null").select(
        "item_id", F.xxhash64("item_text").alias("item_h"), _words("item_text").alias("item")
    ).where(F.size("item") > 0).distinct()
    items = materialize(items.withColumn("w", F.least(F.lit(window), F.size("item"))), "items")
    width, count = items.agg(
        F.coalesce(F.sum(F.expr("aggregate(item, 0L, (n, x) -> n + length(x))")), F.lit(0)), F.coalesce(F.sum(F.size("item")), F.lit(0))
    ).first()
    small = len(MASKS) * count <= MOST_SEEDS and width <= MOST_ITEM_BYTES
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("doc_text")).where("doc_text is not null")
    tokens = own.select("doc_id", F.xxhash64("doc_text").alias("h"), _words("doc_text").alias("words"))
    lengths = sorted(r["w"] for r in items.select("w").distinct().collect())  # `window` values at most
    found = None
    if lengths:
        # (length, masks, span, places before a text): a row a length
        shapes = [(n, len(masks), span, may if n < window else 0) for n in lengths for masks, span, may in [masks_of(n, tolerance)]]
        shape = F.element_at(F.create_map(*(c for n, k, span, edge in shapes for c in (F.lit(n), F.struct(F.lit(k).alias("n"), F.lit(span).alias("span"), F.lit(edge).alias("edge"))))), F.col("w"))
        known = items.select("item_id", "item_h", "w", F.explode(_seeds("item", lengths, window, tolerance, False)).alias("s")).where("s.w = w").select(
            "item_id", "item_h", "w", F.posexplode("s.seeds").alias("j", "seed")
        )
        spots = known.withColumn("shape", shape).select("seed", "item_id", "item_h", F.floor(F.col("j") / F.col("shape.n")).cast("int").alias("j"), "shape.*").distinct()
        # the documents are read and their words hashed once, whatever the lengths of the items
        places = tokens.select("doc_id", "h", F.explode(_seeds("words", lengths, window, tolerance, True)).alias("s")).select(
            "doc_id", "h", F.posexplode("s.seeds").alias("i", "seed")
        ).where("seed is not null")
        found = places.join(F.broadcast(spots) if small else spots, "seed").select(
            "doc_id", "h", (F.floor(F.col("i") / F.col("n")) - F.col("edge")).cast("int").alias("i"), "item_id", "item_h", "j", "span"
        ).distinct()
    if found is None:
        h = [T.StructField("h", T.LongType())] if by_text else []
        counts = [T.StructField(c, T.LongType()) for c in ("n_equal", "n_window")]
        ids = T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(item_col, benchmark.schema[item_col].dataType)
        return docs.sparkSession.createDataFrame([], T.StructType([ids[0], *h, ids[1], *counts]))
    hits = materialize(found, "seed-hits")
    # texts cross the network once, at every size, and are cut into words only where something was hit
    spot = hits.withColumnsRenamed({"doc_id": "hit_id", "h": "hit_h"})
    same = [F.col("doc_id").eqNullSafe(F.col("hit_id")), F.col("h") == F.col("hit_h")]
    texts = own.withColumn("h", F.xxhash64("doc_text"))
    hit_texts = texts.join(spot.select("hit_id", "hit_h").distinct().hint("merge"), same, "left_semi").select("doc_id", "h", _words("doc_text").alias("words"))
    of_item = items.select(F.col("item_id").alias("own_id"), F.col("item_h").alias("own_h"), "item", "w")
    mine = [F.col("item_id").eqNullSafe(F.col("own_id")), F.col("item_h") == F.col("own_h")]
    around = hit_texts.join(spot.hint("merge"), same).join(F.broadcast(of_item) if small else of_item, mine)
    # the item's words before and after the seed that some window with it has, cut to the document
    shape = around.withColumn(
        "lo", F.greatest(F.col("j") - (F.col("w") - F.col("span")), F.lit(0))
    ).withColumn("hi", F.least(F.col("j") + F.col("w"), F.size("item")))
    near = shape.select(
        *whose, "item_id", "w", F.slice("item", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("a"),
        F.expr("transform(sequence(lo, hi - 1), p -> if(i - j + p < 0, null, get(words, i - j + p)))").alias("b")
    )
    equal = near.select(*whose, "item_id", "w", F.expr("zip_with(a, b, (x, y) -> if(x <=> y, 1, 0))").alias("e"))
    best = equal.select(
        *whose, "item_id", F.col("w").cast("long").alias("n_window"),
        F.expr("array_max(transform(sequence(1, size(e) - w + 1), s -> aggregate(slice(e, s, w), 0, (n, x) -> n + x)))").cast("long").alias("n_equal")
    )
    enough = best.where(F.col("n_window") - F.col("n_equal") <= F.floor(F.col("n_window") * tolerance))
    # an id may stand for items of several lengths: the best of the longest window
    out = enough.groupBy(*whose, "item_id").agg(F.max(F.struct("n_window", "n_equal")).alias("x")).select(*whose, "item_id", "x.n_equal", "x.n_window")
    return out.withColumnsRenamed({"doc_id": id_col, "item_id": item_col})


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def _sql_hits() -> str:
    """Pairs of places with equal words under a mask, for items of 13 words and more, and of each smaller number."""
    out = []
    for length in range(1, 14):
        masks, span, may = masks_of(length, 0.2)
        edge = 0 if length == 13 else may
        kind = "len(item) >= 13" if length == 13 else f"len(item) = {length}"
        last = "len(item) - 9" if length == 13 else "1"
        b = f"(select item_id, item, unnest(range(0, {last})) as j from b where {kind})"
        d = f"(select doc_id, words, unnest(range({-edge}, len(words) - {span} + {edge} + 1)) as i from d where len(words) >= {span - 2 * edge} and exists (select 1 from b where {kind}))"
        for mask in masks:
            on = " and ".join(f"words[i + {o + 1}] = item[j + {o + 1}]" for o in mask)
            out.append(f"select doc_id, words, i, item_id, item, j, {span} as span from {d} join {b} on {on} where i + {mask[0]} >= 0")
    return " union ".join(out)


#: The same rows in DuckDB SQL; seeds are compared as text.
OP1_SQL = (
    r"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as words from documents where text is not null),
b as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as item from benchmark where text is not null),
hits as ("""
    + _sql_hits()
    + r"""),
s as (select *, least(13, len(item)) as w, greatest(j - (least(13, len(item)) - span), 0) as lo, least(j + least(13, len(item)), len(item)) as hi from hits),
e as (select doc_id, item_id, w, list_transform(range(lo, hi), lambda p: case when i - j + p >= 0 and i - j + p < len(words) and words[i - j + p + 1] = item[p + 1] then 1 else 0 end) as e from s),
best as (select doc_id, item_id, w, list_max(list_transform(range(1, len(e) - w + 2), lambda s: list_sum(e[s:s + w - 1]))) as n from e),
found as (select doc_id, item_id, w, max(n) as n from best where w - n <= floor(w * 0.2) group by 1, 2, 3)
select doc_id, item_id, cast(n as bigint) as n_equal, cast(w as bigint) as n_window from found qualify row_number() over (partition by doc_id, item_id order by w desc) = 1
"""
)
