"""Substring dedup by sliding sentence spans.

Texts are cut into units: sentences, and these after commas, semicolons and colons. A span is a run of consecutive
units: from each unit on the fewest, two at least, that have LEAST_WORDS words. Spans are hashed and grouped by hash
over all documents; of each hash that occurs more than once the first span, by (doc_id, position), stays, and the units
that any other span covers are removed. Grouping a hash combines on the map side, so a passage in a third of all
documents costs one row a task there; where rows meet their hash's first place again, those of the most frequent hashes
get it by broadcast and are not dealt out by hash. (A hash that isn't among MOST_HOT has at most a MOST_HOT-th of all rows.)

A repeat of 51 words holds such a span wherever it begins, if its units are of usual length. Where punctuation is rare
it may not; with `windows` (the pipeline's stage) runs of WORDS words are compared as well, which begin at
content-defined points, one at least in every WINDOW words, so every repeat of WORDS + WINDOW - 1 words is seen.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import ROLLING, chunks, materialize, mix, most_frequent, read_table, text_bytes, tidied

LEAST = -(2**63)
MARKS = b".!?,;:"
LEAST_WORDS = 30
#: Hashes that more rows have, MOST_HOT of the most frequent at most, go to all executors with their first place.
HOT_ROWS, MOST_HOT = 10_000, 4_096
#: A run of words, and of so many neighbouring runs the one with the least hash is compared: together 49 words.
WORDS, WINDOW = 34, 16


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word in the bytes of texts end to end, and whether it begins a unit.

    A word ends at white space and after a run of MARKS; a unit ends after MARKS and at a line end."""
    n = len(raw)
    solid = ~np.isin(raw, np.frombuffer(b" \t\r\n", np.uint8))
    mark = np.isin(raw, np.frombuffer(MARKS, np.uint8))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= edge[1:n] | ~solid[:-1] | (mark[:-1] & ~mark[1:])
    last = np.ones(n, bool)
    last[:-1] = edge[1:n] | ~solid[1:] | begins[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(solid & last) + 1
    lines = np.concatenate([[0], np.cumsum(raw == 0x0A)])
    opens = np.ones(len(starts), bool)
    before = ends[:-1]
    opens[1:] = mark[before - 1] | (lines[starts[1:]] > lines[before])
    opens[np.searchsorted(starts, offsets[:-1])[np.diff(np.searchsorted(starts, offsets)) > 0]] = True
    return starts, ends, opens


def passage_spans(raw: np.ndarray, offsets: np.ndarray, least_words: int, windows: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts end to end: text, first word, number of words and hash of every run that is compared."""
    none = np.zeros(0, np.int64)
    if not len(raw):
        return none, none, none, none
    starts, ends, opens = word_bounds(raw, offsets)
    if not len(starts):
        return none, none, none, none
    first = np.searchsorted(starts, offsets)  # the texts' first words
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    sums = ROLLING.sums(ROLLING.between(ROLLING.sums(raw), starts, ends))
    heads = np.flatnonzero(opens)
    tails = np.append(heads[1:], len(starts))
    unit = np.cumsum(opens) - 1  # of each word
    text = of[heads]
    low, high = np.searchsorted(text, text, "left"), np.searchsorted(text, text, "right")
    here = np.arange(len(heads))
    reach = heads + least_words - 1  # the last word that must be in the run
    fits = reach < first[text + 1]
    until = np.maximum(np.where(high - low > 1, here + 1, here), unit[np.minimum(reach, len(starts) - 1)])
    fits &= until < high
    a, b = heads[fits], tails[until[fits]]
    if windows:
        at = np.flatnonzero(np.arange(len(starts)) + WORDS <= first[of + 1])
        if len(at) >= WINDOW:
            keys = mix(ROLLING.between(sums, at, at + WORDS) + np.uint64(0x2545F4914F6CDD1D))
            q = np.flatnonzero(of[at[: len(at) - WINDOW + 1]] == of[at[WINDOW - 1 :]])
            least = np.lib.stride_tricks.sliding_window_view(keys, WINDOW).argmin(axis=1)
            picked = at[np.unique(q + least[q])]
            a, b = np.concatenate([a, picked]), np.concatenate([b, picked + WORDS])
    both = np.unique((a << 32) | (b - a))
    a, k = both >> 32, both & 0xFFFFFFFF
    return of[a], a - first[of[a]], k, ROLLING.between(sums, a, a + k).view(np.int64)


def remove_repeated_passages(
    docs: DataFrame, least_words: int = LEAST_WORDS, windows: bool = False, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """Per row of `docs`: id, text (what stays), n_words, n_removed (words), and the columns `keep`.

    Words compare in lower case, whatever the white space between them; it goes with the word before it, and at a
    text's beginning with the first. A text of one unit is one span if it has `least_words`; a text with fewer words is
    not compared. Of each run that occurs more than once the first, by (doc_id, position), stays. With `windows`, of a
    repeat of WORDS + WINDOW - 1 words or more, WORDS at least go, and what no run covers, fewer than WINDOW words at
    either end, may stay. A null text stays null with 0 words; an empty one stays empty. Rows equal in id and text are
    one document to this operator: neither is a later copy of the other. A null id sorts before all others. An empty
    table gives no rows. Other columns, whatever their names, are not read. A very long text is in memory as a whole, with
    some tens of bytes a word."""
    kept_as = {c: f"keep{i}" for i, c in enumerate(keep)}
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("id"), F.xxhash64(text_col).alias("h"), F.col(id_col).alias("own_id"),
        F.col(text_col).alias("text"), *(F.col(c).alias(n) for c, n in kept_as.items())
    )

    def spans_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(text_bytes(batch.column(2))[1], 1 << 19):
                part = batch.slice(a, b - a)
                raw, offsets = text_bytes(pa.array([(t or "").lower() for t in part.column(2).to_pylist()], pa.large_string()))
                doc, pos, n, x = passage_spans(raw, offsets, least_words, windows)
                if len(doc):
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(doc)), part.column(1).take(pa.array(doc)), pa.array(pos << 32 | n), pa.array(x)],
                        names=["id", "h", "run", "x"]
                    )

    spans = base.select("id", "h", "text").mapInArrow(tidied(spans_of), "id long, h long, run long, x long")
    place = F.struct("id", "h", "run")
    often = materialize(spans.groupBy("x").agg(F.count("*").alias("n")).where("n > 1"), "repeated-hashes")
    hot = F.broadcast(most_frequent(often.where(F.col("n") > HOT_ROWS), MOST_HOT).select("x", F.lit(True).alias("hot")))
    # rows of a hot hash are known to repeat: in the join they lie where their document's hash says, and meet nothing
    key = F.when(F.col("hot"), F.xxhash64("id", "h", "run")).otherwise(F.col("x"))
    again = often.select(F.col("x").alias("key"), F.lit(True).alias("again"))
    met = spans.join(hot, "x", "left").withColumn("key", key).join(again, "key", "left").where("hot or again")
    repeated = materialize(met.select("id", "h", "run", "x", F.coalesce("hot", F.lit(False)).alias("hot")), "repeated-runs")
    firsts = lambda rows: rows.groupBy("x").agg(F.min(place).alias("first"))  # noqa: E731  combines on the map side
    some, rest = repeated.where("hot"), repeated.where("not hot")
    later = some.join(F.broadcast(firsts(some)), "x").union(rest.join(firsts(rest), "x")).where(place != F.col("first"))
    gone = later.groupBy("id", "h").agg(F.collect_set("run").alias("gone"))
    joined = base.join(gone, ["id", "h"], "left").select("own_id", "text", "gone", *kept_as.values())

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for a, b in chunks(offsets, 1 << 19):
                part = batch.slice(a, b - a)
                data, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts = word_bounds(data, at)[0] if len(data) else np.zeros(0, np.int64)
                first = np.searchsorted(starts, at)
                texts, removed = part.column(1).to_pylist(), [0] * (b - a)
                for i, runs in enumerate(part.column(2).to_pylist()):
                    if runs:
                        n, runs = int(first[i + 1] - first[i]), np.array(runs, np.int64)
                        edges = np.bincount(runs >> 32, minlength=n + 1) - np.bincount((runs >> 32) + (runs & 0xFFFFFFFF), minlength=n + 1)
                        covered = np.cumsum(edges)[:n] > 0
                        pieces = np.concatenate([at[i : i + 1], starts[first[i] + 1 : first[i + 1]], at[i + 1 : i + 2]])
                        texts[i] = data[at[i] : at[i + 1]][np.repeat(~covered, np.diff(pieces))].tobytes().decode()
                        removed[i] = int(covered.sum())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(texts, pa.string()), pa.array(np.diff(first).astype(np.int64)), pa.array(removed, pa.int64()), *part.columns[3:]],
                    names=["own_id", "text", "n_words", "n_removed", *kept_as.values()]
                )

    kept = "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for c, n in kept_as.items())
    out = joined.mapInArrow(tidied(rebuild), f"own_id {docs.schema[id_col].dataType.simpleString()}, text string, n_words long, n_removed long{kept}")
    return out.withColumnsRenamed({"own_id": id_col, "text": text_col} | {n: c for c, n in kept_as.items()})


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The same rows in DuckDB SQL; spans are compared as text, not by hash.
OP9_SQL = r"""
with u as (
  select doc_id, text, regexp_extract(coalesce(text, ''), '^[ \t\r\n]*') as lead,
    regexp_extract_all(regexp_replace(coalesce(text, ''), '^[ \t\r\n]+', ''), '[^.!?,;:\n]*(?:[.!?,;:]+|\n)[ \t\r\n]*|[^.!?,;:\n]+') as u
  from documents),
w as (select *, list_transform(u, lambda x: list_filter(regexp_split_to_array(lower(x), '[ \t\r\n]+'), lambda y: y <> '')) as w from u),
n as (select *, flatten(w) as words, list_transform(w, lambda x: len(x)) as n, flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(w[i], lambda x: i))) as unit from w),
heads as (select doc_id, text, words, unit, len(u) as k, i, cast(coalesce(list_sum(n[1:i - 1]), 0) as bigint) as a from (select *, unnest(range(1, len(u) + 1)) as i from n)),
ends as (select *, greatest(case when k > 1 then i + 1 else i end, unit[a + 30]) as j from heads where a + 30 <= len(words)),
spans as (select doc_id, text, a, i, j, array_to_string(words[a + 1:len(unit) - list_position(list_reverse(unit), j) + 1], ' ') as x from ends where j <= k),
later as (select *, row_number() over (partition by x order by doc_id, a) as r from spans),
gone as (select doc_id, text, list(distinct q) as d from (select doc_id, text, unnest(range(i, j + 1)) as q from later where r > 1) group by 1, 2)
select n.doc_id,
  case when d is null then n.text else (case when list_contains(d, 1) then '' else lead end) || array_to_string([x for x, i in u if not list_contains(d, i)], '') end as text,
  cast(len(words) as bigint) as n_words,
  cast(coalesce(list_sum(list_transform(d, lambda q: n[q])), 0) as bigint) as n_removed
from n left join gone on n.doc_id = gone.doc_id and n.text is not distinct from gone.text
"""
