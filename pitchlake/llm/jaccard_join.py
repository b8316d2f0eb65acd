"""N-gram Jaccard join: documents whose sets of word shingles are alike, exactly.

Equal sets are one class, and classes are compared. Each class's shingles are put in a rare-first order (by a table of
the most frequent shingles, of bounded size, counted over all documents; then by hash). Two sets that are alike share a
shingle within the first few of that order, the prefix. The prefixes are joined on the shingle; pairs must pass the
length and the positional filter there, and a suffix filter: a shingle that both have is the pivot, and the parities of
the numbers of shingles in ranges of hashes (twice as many as shingles) bound how many after the pivot are in one suffix
only. What is left is compared, whole sets, once a pair.

Only connected groups are asked for, so pairs that are connected already needn't be compared. First each class is
compared with the one list head it meets most often (heads are the classes that share the most shingles, so a group
meets few of them). Then classes of a list that are in different groups meet. Such a pair comes out of the lists only
where a run of shingles that both have begins (the shared shingle before it is not the same), not at each of them; and
not where both were compared with one head and their distances to it differ by more than linked sets can (the Jaccard
distance obeys the triangle inequality). No filter drops a pair that links.

Lists of BIG rows or more join with sketches of the sets, so that only pairs that may link come out of them. Those of LARGE
are dealt out by the sizes of sets and, where many classes are outside the main group, in parts of OTHERS of them. A shingle in
many sets (kind HOT, by the table) is dealt out by class as well, and its head is found by an aggregate
that combines on the map side, so no list is held or sorted in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import ROLLING, chunks, discard, materialize, mix, most_frequent, read_table, text_bytes, tidied
from .graph import components

LEAST = -(2**63)
#: Document ids go to all executors only up to this many; beyond, the join shuffles.
MOST_IDS = 1_000_000
#: Kinds of shingles: not in the table of frequent ones; in it; in it and in so many documents that its list is dealt out.
RARE, FREQUENT, HOT = 0, 1, 2
HOT_FROM, HOT_PARTS = 1_000, 1_024
#: So many partners of a class are compared with it in one place.
PART = 128
#: 64-bit numbers in a set's sketch.
SKETCH = 8
#: In lists of BIG rows pairs must pass the sketches to come out; in those of LARGE the classes outside the main group are
#: dealt into parts of OTHERS.
BIG, LARGE, OTHERS = 32, 8_192, 1_024
#: So many shingles are counted together for a partition's summary; what occurs once in a block isn't frequent.
BLOCK = 1 << 20


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, in rising order, end to end; and their n + 1 offsets."""
    n = len(raw)
    docs = len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    blank = np.ones(n + 1, bool)
    blank[:n] = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, blank[: n - 1]
    starts = np.flatnonzero(~blank[:n] & (before | edge[:n]))
    ends = np.flatnonzero(~blank[:n] & (blank[1:] | edge[1:])) + 1
    hashes = ROLLING.between(ROLLING.sums(low), starts, ends)
    each = np.diff(np.searchsorted(starts, offsets))
    first = np.cumsum(each) - each
    rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for j in range(words):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + len(rolled)]
    rolled = mix(rolled)
    out = []
    for i, m in zip(first.tolist(), each.tolist(), strict=True):
        if m >= words:
            out.append(np.unique(rolled[i : i + m - words + 1]))
        elif m:
            h = np.full(1, m, np.uint64)
            for j in range(m):
                h = h * np.uint64(0xA0761D6478BD642F) + hashes[i + j]
            out.append(mix(h))
        else:
            out.append(hashes[:0])
    sizes = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)
    return np.concatenate(out), sizes


def set_hash(shingles: np.ndarray) -> int:
    """One 64-bit number for a set."""
    x = mix(shingles + np.uint64(0x632BE59BD9B4E019))
    total = int(np.bitwise_xor.reduce(x)) + 3 * int(x.sum(dtype=np.uint64)) + len(x)
    return int(mix(np.array([total % 2**64], np.uint64)).view(np.int64)[0])


def parities(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Of each set the parities of how many shingles are in each of `bins` ranges of hashes (by the leading bits): sets x bins.

    Bits that differ between two sets are at most the shingles in only one of them."""
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    place = np.repeat(np.arange(len(sets)) * bins, [len(s) for s in sets]) + (flat >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    return (np.bincount(place, minlength=len(sets) * bins) & 1).astype(np.uint8).reshape(len(sets), bins)


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, list[bytes | None]]:
    """Parities in 64 * SKETCH ranges, as SKETCH numbers a set end to end; and in twice as many ranges as shingles, for sets that are larger than that."""
    coarse = np.packbits(parities(sets, 64 * SKETCH), axis=1, bitorder="little").view(np.int64).ravel()
    return coarse, [np.packbits(parities([s], 1 << (2 * len(s) - 1).bit_length()), bitorder="little").tobytes() if len(s) > 32 * SKETCH else None for s in sets]


def _each_set(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        raw, offsets = text_bytes(batch.column(1))
        for a, b in chunks(offsets, 1 << 19):
            flat, at = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
            yield batch.slice(a, b - a), [flat[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


class Jaccard:
    """percent: two sets link when 100 * intersection >= percent * union."""

    def __init__(self, percent: int = 75, words: int = 5, table_size: int = 1 << 18, summary_size: int = 1 << 16) -> None:
        self.percent, self.words, self.table_size, self.summary_size = percent, words, table_size, summary_size

    def keys(self, base: DataFrame) -> DataFrame:
        """A row a document (id, class, n, sketch, fine, and what else `base` has beside the text) and rows of the partitions' summaries (class null, id: shingle, n: documents with it)."""
        words, most = self.words, self.summary_size
        more = [f for f in base.schema if f.name not in ("id", "text")]

        def fold(kept: np.ndarray, counts: np.ndarray, block: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            found, times = np.unique(np.concatenate([*block, kept[:0]]), return_counts=True)
            new = (times >= 2) | np.isin(found, kept)
            kept, back = np.unique(np.concatenate([kept, found[new]]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, times[new]]), len(kept)).astype(np.int64)
            if len(kept) > 2 * most:
                counts = counts - np.sort(counts)[-most]
                kept, counts = kept[counts > 0], counts[counts > 0]
            return kept, counts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept, counts, block, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
            names = ["id", "class", "n", "sketch", "fine", *(f.name for f in more)]
            for part, sets in _each_set(batches, words):
                n = np.array([len(s) for s in sets], np.int64)
                coarse, fine = sketches(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([set_hash(s) if len(s) else 0 for s in sets], pa.int64()), pa.array(n),
                        pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * SKETCH, coarse), pa.array(fine, pa.binary()),
                        *part.columns[2:]
                    ],
                    names=names
                )
                block += sets
                size += int(n.sum())
                if size >= BLOCK:
                    kept, counts = fold(kept, counts, block)
                    block, size = [], 0
            kept, counts = fold(kept, counts, block)
            if len(kept):
                rest = [pa.nulls(len(kept), part.column(2 + i).type) for i in range(len(more))]
                yield pa.RecordBatch.from_arrays(
                    [
                        _long(kept), pa.nulls(len(kept), pa.int64()), pa.array(counts), pa.nulls(len(kept), pa.list_(pa.int64())),
                        pa.nulls(len(kept), pa.binary()), *rest
                    ],
                    names=names
                )

        kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in more)
        return base.select("id", "text", *(f.name for f in more)).mapInArrow(tidied(run), f"id long, class long, n long, sketch array<long>, fine binary{kinds}")

    def frequent(self, keys: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The most frequent shingles (rising) and their counts: `table_size` at most."""
        counted = materialize(keys.where("class is null").groupBy("id").agg(F.sum("n").alias("n")), "shingle-counts")
        top = most_frequent(counted, self.table_size).toPandas()
        discard(counted)
        h, n = top["id"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
        order = np.argsort(h)
        return h[order], n[order]

    def prefixes(self, base: DataFrame, table: tuple[np.ndarray, np.ndarray]) -> DataFrame:
        """(g, class, n, pos, kind): the rare-first prefix of each class; a class may come from several tasks."""
        shared, words, percent = base.sparkSession.sparkContext.broadcast(table), self.words, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, times = shared.value
            seen: set[int] = set()
            for _, sets in _each_set(batches, words):
                rows: list[tuple] = []
                for s in sets:
                    n = len(s)
                    if not n or (c := set_hash(s)) in seen:
                        continue
                    seen.add(c)
                    p = n - (percent * n + 99) // 100 + 1
                    often = np.zeros(n, np.int64)
                    if len(known):
                        i = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        often = np.where(known[i] == s, times[i], 0)
                    first = np.argsort(often, kind="stable")[:p]
                    often = often[first]
                    rows.append((s[first], c, n, np.where(often >= HOT_FROM, HOT, often > 0)))
                if len(seen) > 200_000:
                    seen.clear()
                if rows:
                    sets_, classes, sizes, kinds = zip(*rows, strict=True)
                    size = np.array([len(s) for s in sets_])
                    pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    repeat = lambda x, t, size=size: pa.array(np.repeat(np.array(x, t), size))
                    yield pa.RecordBatch.from_arrays(
                        [
                            _long(np.concatenate(sets_)), repeat(classes, np.int64), repeat(sizes, np.int32), pa.array(pos.astype(np.int32)),
                            pa.array(np.concatenate(kinds).astype(np.int8))
                        ],
                        names=["g", "class", "n", "pos", "kind"]
                    )

        return base.select("id", "text").mapInArrow(tidied(run), "g long, class long, n int, pos int, kind byte")

    def may_link(self, a: str, b: str) -> Column:
        """The length and the positional filter for two prefix rows with the same shingle.

        What both sets have before it is in both prefixes, so it is among the shared shingles before it."""
        n, m, i, j, p, q = (F.col(f"{t}{x}").cast("long") for x in ("n", "pos", "before") for t in (a, b))
        short, long = F.least(n, m), F.greatest(n, m)
        most = F.least(p, q) + F.least(n - i, m - j)  # common ones before, here and after at most
        return (100 * short >= self.percent * long) & ((100 + self.percent) * most >= self.percent * (n + m))

    def suffixes_near(self, pairs: DataFrame) -> DataFrame:
        """The suffix filter for `pairs` of sets (a, b) that share the pivot g: what is in one of them only bounds what both have.

        All hashes above a rare pivot's come after it in either set, so ranges of hashes above its own are in the suffixes."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stay = []
                for r in batch.select(batch.schema.names[2:]).to_pylist():
                    fine = r["a_fine"] is not None and r["b_fine"] is not None
                    x, y = (
                        np.unpackbits(
                            np.frombuffer(r[f"{t}_fine"], np.uint8) if fine else np.array(r[f"{t}_sketch"], np.int64).view(np.uint8),
                            bitorder="little"
                        ) for t in "ab"
                    )
                    bins = min(len(x), len(y))
                    x, y = (v.reshape(bins, -1).sum(axis=1) & 1 for v in (x, y))
                    differ = x != y
                    total = r["a_n"] + r["b_n"]
                    near = (100 + percent) * int(differ.sum()) <= (100 - percent) * total
                    if near and r["kind"] == RARE:
                        after = int(differ[((r["g"] % 2**64) >> (64 - bins.bit_length() + 1)) + 1 :].sum())
                        most = 2 * (min(r["a_before"], r["b_before"]) + 1) + (r["a_n"] - r["a_pos"] - 1) + (r["b_n"] - r["b_pos"] - 1) - after  # twice what both can have
                        near = (100 + percent) * most >= 2 * percent * total
                    stay.append(near)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(stay, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

        return pairs.mapInArrow(tidied(run), "a long, b long")

    def verify(self, base: DataFrame, keys: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        """`pairs` (a, b: classes) compared: a, b, apart (their Jaccard distance), link.

        Of a pair the class with more partners is the hub. Texts, which are smaller than their sets, are sent to their
        hubs; a hub's partners are dealt into parts of about PART, and each part gets the hub's text first."""
        percent, words = self.percent, self.words
        degree = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("k"))
        wanted = keys.where("class is not null").join(degree, "class").groupBy("class").agg(F.min("id").alias("id"), F.max("k").alias("k"))
        wanted = materialize(wanted, f"{name}-wanted")
        ids = wanted.select("id").distinct()
        if wanted.count() <= MOST_IDS:
            ids = F.broadcast(ids)
        of = lambda x: wanted.select(F.col("class").alias(x), F.struct("k", "class", "id").alias(f"{x}_"))
        sides = pairs.join(of("a"), "a").join(of("b"), "b").select(F.greatest("a_", "b_").alias("x"), F.least("a_", "b_").alias("y"))
        parts = F.ceil(F.col("x.k") / PART).cast("int")
        sides = materialize(sides.select("x", "y", parts.alias("parts"), F.pmod(F.xxhash64("y.class"), parts).cast("int").alias("part")), f"{name}-sides")
        hubs = sides.select("x", "part").distinct().select(
            F.col("x.id").alias("id"), F.col("x.class").alias("hub"), "part", F.lit(0).alias("role"), F.col("x.class").alias("class")
        )
        sent = hubs.union(sides.select("y.id", F.col("x.class").alias("hub"), "part", F.lit(1).alias("role"), "y.class"))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hub, mine, last = None, None, None
            for part, sets in _each_set(batches, words):
                found: list[tuple] = []
                for s, h, p, role, c in zip(sets, *(part.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                    if (h, p, c) == last or set_hash(s) != c:  # a repeated row, or another text with this id
                        continue
                    last = h, p, c
                    if role == 0:
                        hub, mine = (h, p), s.copy()
                        continue
                    if hub != (h, p):
                        raise ValueError("a part without its hub")
                    both = np.concatenate([s, mine])
                    both.sort()
                    same = int((both[1:] == both[:-1]).sum())
                    union = len(both) - same
                    found.append((min(h, c), max(h, c), 1 - same / union, 100 * same >= percent * union))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*found, strict=True)], names=["a", "b", "apart", "link"])

        texts = base.join(ids, "id", "left_semi").join(sent.hint("merge"), "id").select("id", "text", "hub", "part", "role", "class")
        dealt = texts.repartition("hub", "part").sortWithinPartitions("hub", "part", "role", "class")
        out = materialize(dealt.mapInArrow(tidied(compare), "a long, b long, apart double, link boolean"), f"{name}-compared")
        discard(wanted, sides)
        return out

    def links(self, base: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(keys, links between classes that connect whatever any links connect)."""
        keys = materialize(self.keys(base), "shingle-keys")
        rows = self.prefixes(base, self.frequent(keys)).withColumn(
            "salt", F.when(F.col("kind") == HOT, F.pmod("class", F.lit(HOT_PARTS))).otherwise(0).cast("int")
        )
        by_shingle = Window.partitionBy("g", "salt").orderBy("class")
        head = by_shingle.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        around = rows.withColumns({"least": F.first("class").over(head), "next": F.lead("class").over(by_shingle)})
        last = F.col("next").isNull() | (F.col("next") != F.col("class"))  # of a class's rows, which are alike
        met = (F.col("kind") == HOT) | (F.col("least") != F.col("class")) | F.col("next").isNotNull()
        shared = around.where(last & met).select("g", "class", "n", "pos", "kind")
        # before: a class's shared shingles before this one; prev: the last of them; k: all of them
        of_class = Window.partitionBy("class")
        in_order = of_class.orderBy("pos")
        postings = materialize(
            shared.withColumns({"before": F.row_number().over(in_order) - 1, "prev": F.lag("g").over(in_order), "k": F.count("*").over(of_class)}),
            "postings"
        )
        first = materialize(self._head_pairs(postings), "first-pairs")
        met_first = first.select(F.least("class", "head").alias("a"), F.greatest("class", "head").alias("b")).distinct()
        compared = self.verify(base, keys, met_first, "first")
        groups = components(compared.where("link"))
        # star: the one class that a class was compared with at first, and how far it is
        star = first.select(
            "class", "head", F.least("class", "head").alias("a"), F.greatest("class", "head").alias("b")
        ).join(compared, ["a", "b"]).select("class", "head", "apart")
        labels = groups.withColumnRenamed("node", "class").join(star, "class", "full")
        known = postings.drop("k").join(labels.hint("merge"), "class", "left").withColumns(
            {"component": F.coalesce("component", "class"), "apart": F.coalesce("apart", F.lit(0.0)), "head": F.coalesce("head", "class")}
        )
        known = materialize(known, "known")
        lists = known.groupBy("g", "kind", "component").agg(F.count("*").alias("k")).groupBy("g", "kind").agg(
            F.count("*").alias("parts"), F.sum("k").alias("rows"), F.max_by("component", F.struct("k", "component")).alias("main"), F.max("k").alias("of_main")
        ).where("parts > 1").select("g", "kind", "main", "rows", (F.col("rows") - F.col("of_main")).alias("others"))
        # what is told of HOT lists goes to all executors (no more of them than the table has), so their rows stay where they are
        cold = known.where(F.col("kind") != HOT).join(lists.where(F.col("kind") != HOT).drop("kind"), "g")
        hot = known.where(F.col("kind") == HOT).join(F.broadcast(lists.where(F.col("kind") == HOT).drop("kind")), "g")
        mixed = materialize(cold.unionByName(hot), "mixed")
        sketch = keys.where("n > 0").groupBy("class").agg(F.first("sketch").alias("sketch"), F.first("fine").alias("fine"))
        small = mixed.where(F.col("rows") < BIG)
        big = mixed.where(F.col("rows") >= BIG).join(sketch.select("class", "sketch").hint("merge"), "class")
        usual, large = big.where(F.col("rows") < LARGE), big.where(F.col("rows") >= LARGE)
        apart = sum((F.bit_count(F.get("l_sketch", F.lit(i)).bitwiseXOR(F.get("r_sketch", F.lit(i)))) for i in range(SKETCH)), F.lit(0))
        even = (100 + self.percent) * apart <= (100 - self.percent) * (F.col("l_n") + F.col("r_n")).cast("long")
        pairs = self._crossing(small, F.lit(True)).union(self._crossing(usual, even)).union(self._crossing(large, even, OTHERS)).groupBy("a", "b").agg(F.min("x").alias("x"))
        pairs = pairs.join(met_first, ["a", "b"], "left_anti")
        flat = materialize(
            pairs.select(
                "a", "b", F.col("x.kind").alias("kind"), F.col("x.g").alias("g"),
                *(F.col(f"x.{t}_.{c}").alias(f"{t}_{c}") for t in "ab" for c in ("n", "pos", "before"))
            ),
            "candidates"
        )
        of = lambda t: sketch.toDF(t, f"{t}_sketch", f"{t}_fine").hint("merge")
        near = self.suffixes_near(flat.join(of("a"), "a").join(of("b"), "b").select("a", "b", *flat.columns[2:], "a_sketch", "b_sketch", "a_fine", "b_fine"))
        rest = materialize(near, "rest-pairs")
        discard(postings, known, mixed, flat)
        links = compared.where("link").select("a", "b")
        if rest.isEmpty():
            return keys, links
        return keys, links.union(self.verify(base, keys, rest, "rest").where("link").select("a", "b"))

    def _crossing(self, mixed: DataFrame, even: Column, others: int = 0) -> DataFrame:
        """(a, b, x): pairs of classes of a list that are in different groups and pass the filters, with the place where they met.

        With `others`, a list is joined by sizes of sets, as sets of very different sizes don't link, and its classes outside
        the main group are dealt into parts of about so many, each of which meets all classes of like size."""
        columns = [c for c in ("class", "n", "pos", "before", "prev", "component", "head", "apart", "sketch") if c in mixed.columns]
        # one of a pair is always outside its list's main group
        left = mixed.where("component <> main").select("g", "kind", *(F.col(c).alias(f"l_{c}") for c in columns))
        right = mixed.select("g", "main", *(F.col(c).alias(f"r_{c}") for c in columns))
        on = ["g"]
        if others:
            # sets that link are at most one step of this scale apart (a little wider than their greatest ratio)
            step = F.floor(F.log(F.col("n").cast("double")) / (1.0001 * math.log(100 / min(self.percent, 99)))).cast("int")
            parts = F.greatest(F.ceil(F.col("others") / others), F.lit(1)).cast("int")
            mixed = mixed.withColumns({"step": step, "parts": parts})
            left = mixed.where("component <> main").select(
                "g", "kind", "step", F.pmod(F.xxhash64("class"), "parts").cast("int").alias("part"), *(F.col(c).alias(f"l_{c}") for c in columns)
            )
            right = mixed.select("g", "main", "parts", F.explode(F.array(*(F.col("step") + i for i in (-1, 0, 1)))).alias("step"), *(F.col(c).alias(f"r_{c}") for c in columns))
            right = right.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).drop("parts")
            on = ["g", "step", "part"]
        once = (F.col("r_component") == F.col("main")) | (F.col("l_class") < F.col("r_class"))
        begins = ~F.col("l_prev").eqNullSafe(F.col("r_prev")) | F.col("l_prev").isNull()
        within = (F.col("l_head") != F.col("r_head")) | (F.abs(F.col("l_apart") - F.col("r_apart")) <= (100 - self.percent) / 100 + 1e-9)
        met = left.join(right.hint("merge"), on).where(
            (F.col("l_component") != F.col("r_component")) & once & begins & within & self.may_link("l_", "r_") & even
        )
        turn = F.col("l_class") < F.col("r_class")
        side = lambda x, y: F.struct(*(F.when(turn, F.col(f"{x}{c}")).otherwise(F.col(f"{y}{c}")).alias(c) for c in ("n", "pos", "before")))
        return met.select(
            F.least("l_class", "r_class").alias("a"), F.greatest("l_class", "r_class").alias("b"),
            F.struct("kind", "g", side("l_", "r_").alias("a_"), side("r_", "l_").alias("b_")).alias("x")
        )

    def _head_pairs(self, postings: DataFrame) -> DataFrame:
        """(class, head): the head that a class meets most often in its lists; none for a class that meets no other.

        A list's head is its class with the most shared shingles; an original has more of them than its edited copies.
        The heads of HOT lists, as many as the table of frequent shingles has at most, go to all executors."""
        columns = ("class", "n", "pos", "before")
        order = Window.partitionBy("g").orderBy(F.desc("k"), "class").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cold = postings.where(F.col("kind") != HOT).withColumns({f"_{c}": F.first(c).over(order) for c in columns})
        hot = postings.where(F.col("kind") == HOT)
        heads = hot.groupBy("g").agg(
            F.max_by(F.struct(*columns), F.struct("k", "class")).alias("h")
        ).select("g", *(F.col(f"h.{c}").alias(f"_{c}") for c in columns))
        headed = cold.unionByName(hot.join(F.broadcast(heads), "g"))
        met = headed.where((F.col("_class") != F.col("class")) & self.may_link("", "_")).groupBy("class", "_class").agg(F.count("*").alias("times"))
        return met.groupBy("class").agg(F.max_by("_class", F.struct("times", "_class")).alias("head"))


def near_duplicates(docs: DataFrame, percent: int = 75, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, n_shingles (size of its set) and component_id, the least id that links reach.

    Texts compare in lower case (A-Z only); words are runs of other bytes than blank, tab and line ends. A text with
    fewer than `words` words is one shingle; a null text, or one without words, has none and links with nothing: its
    component is its own id. Rows with equal ids are documents of their own, with that id. A null id comes before all
    others, and stays null where it is a component's least. An empty table gives no rows. Extra columns are not read. Ties
    of distance or size don't matter: only groups come out. A very long text is in memory with its set, eight bytes a word
    and some; two of them where they are compared."""
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("id"), F.col(text_col).alias("text"))
    keys, links = Jaccard(percent, words).links(base)
    groups = components(links).withColumnRenamed("node", "class")
    rows = keys.where("class is not null")
    classes = rows.where("n > 0").groupBy("class").agg(F.min("id").alias("least")).join(groups, "class", "left").withColumn(
        "component", F.coalesce("component", "class")
    )
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.select("class", "component").join(least, "component").select("class", "component_id")
    back = lambda c: F.nullif(c, F.lit(LEAST))
    kind = docs.schema[id_col].dataType
    return rows.join(named, "class", "left").select(
        back(F.col("id")).cast(kind).alias(id_col), F.col("n").alias("n_shingles"),
        back(F.coalesce("component_id", "id")).cast(kind).alias("component_id")
    )


def surplus(docs: DataFrame, percent: int = 75, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which rows go so that one of each group of `near_duplicates` stays: id, h (xxhash64 of the text), stays, copies.

    A row here stands for the `copies` rows of `docs` with that id (null is an id) and text. Only rows here with
    `stays` false, or true with copies > 1, come out: of the first kind all rows go, of the second all but one. In each
    group the one with the least (id, h) stays, a null id before all others; a text without words is its own group. Very
    long texts and empty tables: as in `near_duplicates`."""
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    keys, links = Jaccard(percent, words).links(base)
    rows = keys.where("class is not null").groupBy("id", "h", "class").agg(F.count("*").alias("copies"), F.max("n").alias("n"))
    groups = components(links).withColumnRenamed("node", "class")
    named = rows.join(groups, "class", "left").withColumn("component", F.coalesce("component", "class"))
    place = F.struct("id", "h")
    first = named.where("n > 0").groupBy("component").agg(F.min(place).alias("first"))
    marked = named.join(first, "component", "left").withColumn("stays", (F.col("n") == 0) | (place == F.col("first")))
    return marked.where("not stays or copies > 1").select(F.nullif("id", F.lit(LEAST)).cast(docs.schema[id_col].dataType).alias(id_col), "h", "stays", "copies")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
