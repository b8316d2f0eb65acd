"""How the sources of a language differ: divergences of their term distributions, in whole numbers.

Terms are cut out of the concatenated UTF-8 buffer of a batch by a lookup table over bytes: a term is a run of ASCII
letters and bytes above 127. xxhash brings equal slices together, and each slice is compared with its group's first.
Counts by (language, source, term) are combined in the task and shuffled once, by (language, term), so that document
frequencies, and the sums over a language, need no further exchange.

Pairs of sources are compared in blocks of terms: a block's counts are a sparse matrix by source (CSR); for each other
source, the divergences of all its entries are computed at once and summed by `reduceat`. A term that neither source has
adds the same to a pair everywhere, so a block costs (sources x entries), not (sources x sources x terms). Where a language
has many sources, the pairs are dealt out as tiles of TILE x TILE.

All arithmetic is in 64-bit integers: a probability is in billionths.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import chunks, materialize, ragged, read_table, text_bytes

CHUNK_BYTES = 2 << 20
#: Rows that a task combines before it sends them on.
PENDING_ROWS = 1 << 20
#: Entries of a block of terms, on average, and sources on each side of a tile.
BLOCK_ROWS, TILE = 1 << 18, 512
SCALE = 1_000_000_000

#: What a byte becomes in a term: ASCII letters in lower case, bytes above 127 as they are; 0 is no part of a term.
BYTE = np.zeros(256, np.uint8)
BYTE[0x41:0x5B] = BYTE[0x61:0x7B] = np.arange(0x61, 0x7B)
BYTE[0x80:] = np.arange(0x80, 0x100)


def slices(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The folded buffer, and where each term begins and ends in it. No term goes over the edge of a text."""
    folded = BYTE[raw]
    inside = folded != 0
    begins, ends = inside.copy(), np.zeros(len(raw) + 1, bool)
    begins[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    ends[1:] = inside
    ends[:-1] &= ~inside
    cut = edges[inside[edges] & inside[edges - 1]]
    ends[cut] = True
    return folded, starts, np.flatnonzero(ends)


def distinct(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct slices, and the number of its own for each: grouped by hash, then compared byte for byte; one that differs
    from its group's first gets a number by its bytes."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    _, at, back = np.unique(hashes, return_index=True, return_inverse=True)
    names = [words[i] for i in at.tolist()]
    same = np.fromiter(map(eq, words, map(names.__getitem__, back.tolist())), bool, len(words))
    own: dict[bytes, int] = {}
    for i in np.flatnonzero(~same).tolist():
        if words[i] not in own:
            own[words[i]] = len(names)
            names.append(words[i])
        back[i] = own[words[i]]
    return names, back


def _counted(part: pa.RecordBatch) -> pa.Table:
    """lang, source, term, n and docs of a few MB of documents."""
    lang, source = (part.column(i).dictionary_encode() for i in (1, 2))
    raw, offsets = text_bytes(part.column(0))
    folded, starts, ends = slices(raw, offsets)
    data = folded.tobytes()
    names, term = distinct([data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    size, sources = max(1, len(names)), max(1, len(source.dictionary))
    doc = np.searchsorted(offsets, starts, "right") - 1
    each, n = np.unique(doc * size + term, return_counts=True)  # a term of a document
    doc, term = np.divmod(each, size)
    group = lang.indices.to_numpy().astype(np.int64)[doc] * sources + source.indices.to_numpy().astype(np.int64)[doc]
    key = group * size + term
    order = np.argsort(key, kind="stable")
    keys, first, docs = np.unique(key[order], return_index=True, return_counts=True)
    group, term = np.divmod(keys, size)
    sums = np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)
    return pa.table(
        {
            "lang": lang.dictionary.take(pa.array(group // sources)), "source": source.dictionary.take(pa.array(group % sources)),
            "term": pa.array(names, pa.binary()).cast(pa.string()).take(pa.array(term)), "n": pa.array(sums.astype(np.int64)), "docs": pa.array(docs.astype(np.int64))
        }
    )


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (text, lang, source) to counts: equal keys are combined until PENDING_ROWS rows have come together."""
    pending: list[pa.Table] = []
    rows = 0

    def combined() -> pa.Table:
        x = pa.concat_tables(pending).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return x.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for a, b in chunks(text_bytes(batch.column(0))[1], CHUNK_BYTES):
            pending.append(_counted(batch.slice(a, b - a)))
            rows += pending[-1].num_rows
            if rows >= PENDING_ROWS:
                x = combined()
                pending, rows = ([x], x.num_rows) if x.num_rows < PENDING_ROWS // 2 else ([], 0)
                if not pending:
                    yield from x.to_batches(1 << 16)
    if pending:
        yield from combined().to_batches(1 << 16)


def probability(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * n / total), by long division, so that nothing overflows where total is below 9e15."""
    q, r = F.call_function("div", n, total), n % total
    for _ in range(3):
        r = r * 1000
        q, r = q * 1000 + F.call_function("div", r, total), r % total
    return q + 1


def probabilities(n: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """The same for arrays; `total` is positive."""
    q, r = np.divmod(n, total)
    for _ in range(3):
        more, r = np.divmod(r * 1000, total)
        q = q * 1000 + more
    return q + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def block_pairs(source: np.ndarray, term: np.ndarray, n: np.ndarray, terms: int, left: np.ndarray, right: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Divergences of each source in `left` from each in `right`, summed over a block's `terms` terms.

    (source, term, n): the counts above zero of sources in either list, as numbers; totals: N + V of every source."""
    order = np.lexsort((term, source))
    source, term = source[order], term[order]
    p = probabilities(n[order] + 1, totals[source])
    zero = probabilities(np.ones(len(totals), np.int64), totals)
    row = np.searchsorted(source, np.arange(len(totals) + 1))  # the CSR matrix: (row, term, p)
    has = np.diff(row)
    out = np.zeros((len(left), len(right)), np.int64)
    some = np.flatnonzero(has[left] > 0)
    # the entries of the sources in `left`, one source after another
    mine = ragged(row[left[some]], has[left[some]])
    first = np.cumsum(has[left[some]]) - has[left[some]]
    own, at, none = p[mine], term[mine], np.repeat(zero[left[some]], has[left[some]])
    dense = np.empty(terms, np.int64)
    for j, r in enumerate(right.tolist()):
        a, b = row[r], row[r + 1]
        dense[:] = zero[r]
        dense[term[a:b]] = p[a:b]
        both = divergence(zero[left], zero[r])
        # where left has none: all of the block, less where it has some
        value = both * (terms - (b - a))
        if b > a:
            value += divergence(zero[left][:, None], p[a:b][None, :]).sum(1) if len(left) * (b - a) <= 1 << 22 else np.array([divergence(z, p[a:b]).sum() for z in zero[left]])
        if len(some):
            value[some] += np.add.reduceat(divergence(own, dense[at]) - divergence(none, dense[at]), first)
        out[:, j] = value
    return out


def audit(
    docs: DataFrame, least_docs: int = 3, top: int = 200, block_rows: int = BLOCK_ROWS, tile: int = TILE, text_col: str = "text", lang_col: str = "lang",
    source_col: str = "source"
) -> DataFrame:
    """Per (lang, source): part `pair`, its divergence from each other source of the language over all kept terms, and part
    `term`, the `top` terms that it has more often than the language, by their share in the divergence from it.

    Kept are the terms in at least `least_docs` documents (rows) of a language. Null text, lang and source count as ''. A
    source without terms takes part; where a language keeps no term, all its pairs are 0. Ties are ordered by item. Texts
    may be of any length: nothing but a chunk's terms is held. Repeated rows are documents of their own. An empty table
    gives no rows; other columns aren't read. Returns lang, source, part, item, value, rank.

    The list of sources with their sums is broadcast: a row for each (lang, source), of which the result has a row for each
    pair, so that it is no larger than the square root of the result."""
    spark = docs.sparkSession
    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    x = docs.select(plain(text_col).alias("text"), plain(lang_col).alias("lang"), plain(source_col).alias("source"))
    counts = x.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")  # a row a source
    kept = materialize(
        counts.withColumns({"docs": F.sum("docs").over(of_term), "in_lang": F.sum("n").over(of_term)}).where(F.col("docs") >= least_docs).select(
            "lang", "source", "term", "n", "in_lang", (F.row_number().over(of_term.orderBy("source")) == 1).alias("first")
        ), "terms"
    )
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if("first").alias("v"))
    groups = x.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["n", "v"])
    whole = Window.partitionBy("lang")
    groups = groups.select(
        "lang", "source", (F.row_number().over(whole.orderBy("source")) - 1).alias("i"), "n", F.sum("v").over(whole).alias("v"), F.sum("n").over(whole).alias("lang_n"),
        F.count(F.lit(1)).over(whole).alias("sources")
    )
    groups = materialize(groups, "sources")
    return _pairs(spark, kept, groups, block_rows, tile).unionByName(_terms(kept, groups, top))


def _ranked(x: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return x.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    x = kept.join(groups.select("lang", "source", F.col("n").alias("own"), "v", "lang_n"), ["lang", "source"])
    p, q = probability(F.col("n") + 1, F.col("own") + F.col("v")), probability(F.col("in_lang") + 1, F.col("lang_n") + F.col("v"))
    x = x.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    return _ranked(x.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value")), "term").where(F.col("rank") <= top)


def _pairs(spark: SparkSession, kept: DataFrame, groups: DataFrame, block_rows: int, tile: int) -> DataFrame:
    rows = groups.collect()  # a row for each (lang, source)
    by_lang: dict[str, dict] = {}
    for r in sorted(rows):
        g = by_lang.setdefault(r["lang"], {"sources": [], "n": [], "v": r["v"]})
        g["sources"].append(r["source"])
        g["n"].append(r["n"])
    known = spark.sparkContext.broadcast(by_lang)
    blocks = max(1, -(-kept.count() // block_rows))
    k = F.call_function("div", F.col("i"), F.lit(tile))
    last = F.call_function("div", F.col("sources") - 1, F.lit(tile))
    x = kept.join(groups.select("lang", "source", "i", "sources"), ["lang", "source"])
    # the tiles that have the source's own stripe on either side
    across = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda t: F.array(F.struct(k.alias("a"), t.alias("b")), F.struct(t.alias("a"), k.alias("b"))))
    x = x.withColumns({"tiles": F.array_distinct(F.flatten(across)), "block": F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")})
    x = x.select("lang", F.col("i").cast("int").alias("i"), "term", "n", "block", F.explode("tiles").alias("t"))
    x = x.select("lang", "i", "term", "n", "block", F.col("t.a").cast("int").alias("a"), F.col("t.b").cast("int").alias("b"))

    def compare(table: pa.Table) -> pa.Table:
        lang, a, b = (table.column(c)[0].as_py() for c in ("lang", "a", "b"))
        g = known.value[lang]
        size = len(g["sources"])
        left, right = (np.arange(t * tile, min((t + 1) * tile, size)) for t in (a, b))
        # the sources of the tile only, numbered anew
        both = np.union1d(left, right)
        totals = np.array(g["n"], np.int64)[both] + g["v"]
        term = table.column("term").combine_chunks().dictionary_encode()
        names = term.dictionary
        value = block_pairs(
            np.searchsorted(both, table.column("i").to_numpy()), term.indices.to_numpy().astype(np.int64), table.column("n").to_numpy(), len(names),
            np.searchsorted(both, left), np.searchsorted(both, right), totals
        )
        # terms that no source of the tile has aren't here: `audit` adds them by their number
        i, j = np.meshgrid(left, right, indexing="ij")
        n = i.size
        return pa.table(
            {
                "lang": pa.array([lang] * n), "i": pa.array(i.ravel().astype(np.int32)), "j": pa.array(j.ravel().astype(np.int32)), "value": pa.array(value.ravel()),
                "terms": pa.array(np.full(n, len(names), np.int64))
            }
        )

    part = x.groupBy("lang", "a", "b", "block").applyInArrow(compare, "lang string, i int, j int, value long, terms long")
    part = part.where("i <> j").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    side = lambda c, s: groups.select("lang", F.col("i").cast("int").alias(c), F.col("source").alias(s), (F.col("n") + F.col("v")).alias(f"{s}_total"), "v")
    pairs = side("i", "source").join(side("j", "item").drop("v"), "lang").where("i <> j").join(part, ["lang", "i", "j"], "left").na.fill(0, ["value", "terms"])
    p, q = (probability(F.lit(1).cast("long"), F.col(f"{s}_total")) for s in ("source", "item"))
    rest = F.when(F.col("v") > F.col("terms"), (F.col("v") - F.col("terms")) * F.call_function("div", (p - q) * (p - q), q)).otherwise(0)
    return _ranked(pairs.select("lang", "source", "item", (F.col("value") + rest).cast("long").alias("value")), "pair")


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with d as (
  select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
), w as (select k, lang, source, unnest(terms) as term from d),
kept as (select lang, term, count(*) as n from w group by all having count(distinct k) >= 3),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by all),
v as (select g.lang, count(kept.term) as v, coalesce(sum(kept.n), 0) as n from (select distinct lang from g) g left join kept using (lang) group by all),
t as (select g.lang, g.source, coalesce(sum(c.n), 0) as n from g left join c using (lang, source) group by all),
p as (
  select t.lang, t.source, kept.term, coalesce(c.n, 0) as n,
    cast(1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (t.n + v.v) as bigint) as p,
    cast(1 + (1000000000::hugeint * (kept.n + 1)) // (v.n + v.v) as bigint) as q
  from t join v using (lang) join kept using (lang) left join c on c.lang = t.lang and c.source = t.source and c.term = kept.term
), pt as (
  select lang, source, 'term' as part, term as item, (p - q) * (p - q) // q as value from p where n > 0 and p > q
), pp as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), pr as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join pp on pp.lang = a.lang and pp.source = a.source and pp.item = b.source
), u as (
  select lang, source, part, item, cast(value as bigint) as value from pr union all select lang, source, part, item, cast(value as bigint) from pt
)
select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from u
qualify part = 'pair' or rank <= 200
"""
