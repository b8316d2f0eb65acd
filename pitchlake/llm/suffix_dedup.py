"""Suffix-array dedup by longest-previous-factor arrays, over a sparse suffix array.

Only some suffixes are sorted: every window of `length` bytes chooses its anchor, the place in it whose KGRAM bytes have
the least hash, so windows with equal bytes choose the same place. Anchors that begin with the same KGRAM are brought
together and put in suffix order, and what stands before them in the order of the reversed prefixes. Common prefixes of
neighbours in both orders say, for windows that begin d bytes before their anchors, which suffixes from there agree. In
that order the previous and the next smaller text position give each suffix's longest earlier match (LPF); its mirror
gives the longest later match. A window is a later copy if its LPF is `length`; the chain of earlier matches ends at
its first copy. It is repeated at all if its LPF or the mirror is `length`.

What an anchor's windows span is its content. Contents that are equal (by 62-bit hashes of the content and of its
KGRAM) are counted first, combining on the map side, and sorted once; copies of a key's only content need no order but
that of their positions. A key with more than HOT contents is split: of its windows, those with d in a band share all
bytes but the band's width with their copies, and are dealt out by these; what a content holds of the band is counted as
a content again, and ordered in the same way. A part that has more than HOT contents still is split into narrower bands,
down to single windows, whose copies are all one content. So no task orders more than HOT contents of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import ROLLING, chunks, discard, materialize, mix, ragged, read_table, text_bytes

KGRAM = 32
LEAST = -(2**63)
PIECE_BYTES = 1 << 20
#: A key with more contents is split, into bands of so many places before the anchor; each width divides the one before.
HOT, BANDS = 8_192, (64, 8, 1)
#: Rows of (id, ranges) go to all executors only up to this many bytes; beyond, the join shuffles.
MOST_BYTES = 32 << 20
_SECOND = np.uint64(0xE7037ED1A0B428DB)


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of (document, first byte, end) with PIECE_BYTES together; longer documents are cut, with length - 1 bytes in common."""
    docs, firsts, ends, total = [], [], [], 0
    for i in np.flatnonzero(np.diff(offsets) >= length).tolist():
        a, end = int(offsets[i]), int(offsets[i + 1])
        while True:
            b = min(end, a + PIECE_BYTES)
            docs.append(i)
            firsts.append(a)
            ends.append(b)
            total += b - a
            if total >= PIECE_BYTES:
                yield np.array(docs), np.array([firsts, ends])
                docs, firsts, ends, total = [], [], [], 0
            if b == end:
                break
            a = b - length + 1
    if docs:
        yield np.array(docs), np.array([firsts, ends])


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (document, first window, last window, anchor, key, content): windows and anchors as bytes from the document's begin."""
    width = length - KGRAM + 1
    low = np.uint64((1 << 24) - 1)
    for docs, (firsts, ends) in _pieces(offsets, length):
        size = ends - firsts
        begin = np.cumsum(size) - size
        data = np.concatenate([raw[a:b] for a, b in zip(firsts.tolist(), ends.tolist(), strict=True)])
        n = len(data)
        sums = ROLLING.sums(data)
        at = np.arange(n - KGRAM + 1)
        gram = ROLLING.between(sums, at, at + KGRAM)
        m = (gram & ~low) | at.astype(np.uint64)
        w = 1
        while 2 * w <= width:
            m = np.minimum(m[:-w], m[w:])
            w *= 2
        if w < width:
            m = np.minimum(m[: len(m) - (width - w)], m[width - w :])
        where = (m & low).astype(np.int64)  # the anchor of the window that begins here
        count = size - length + 1
        window = np.arange(int(count.sum())) + np.repeat(begin - (np.cumsum(count) - count), count)
        part = np.repeat(np.arange(len(docs)), count)
        chosen = where[window]
        new = np.ones(len(window), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (part[1:] != part[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(window)) - 1
        s, e, p, own = window[head], window[tail], chosen[head], part[head]
        content = mix(ROLLING.between(sums, s, e + length) + (p - s).astype(np.uint64) * _SECOND)
        shift = firsts[own] - offsets[docs[own]] - begin[own]
        yield docs[own], s + shift, e + shift, p + shift, gram[p], content


def _smaller(positions: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The previous row with a smaller position (-1: none), and the common prefix with it; common[i] is that of i - 1 and i.

    All rows step at once: if the row reached is greater, the row that it has reached itself is next."""
    reach, least = np.arange(len(positions)) - 1, common.copy()
    open_ = np.flatnonzero(reach >= 0)
    while len(open_ := open_[positions[reach[open_]] > positions[open_]]):
        at = reach[open_]
        least[open_], reach[open_] = np.minimum(least[open_], least[at]), reach[at]
        open_ = open_[reach[open_] >= 0]
    least[reach < 0] = 0
    return reach, least


def previous_factors(positions: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes in suffix order, with their text positions and common[i], the common prefix of i - 1 and i: the length
    of the longest match with an earlier position (LPF), and a row that has it (-1 where LPF is 0)."""
    n = len(positions)
    before, one = _smaller(positions, common)
    mirrored = np.concatenate([[0], common[:0:-1]]) if n else common
    after, two = (x[::-1] for x in _smaller(positions[::-1], mirrored))
    after = np.where(after >= 0, n - 1 - after, -1)
    lpf = np.maximum(one, two)
    return lpf, np.where(lpf == 0, -1, np.where(one >= two, before, after))


def _common(rows: list[bytes], group: np.ndarray, width: int) -> np.ndarray:
    """Common prefixes of neighbouring rows, -1 where another group begins."""
    m = len(rows)
    sizes = np.array([len(x) for x in rows], np.int64)
    wide = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in rows), np.uint8).reshape(m, width) if width else np.zeros((m, 0), np.uint8)
    out = np.full(m, -1, np.int64)
    if m > 1:
        differ = wide[1:] != wide[:-1]
        at = np.where(differ.any(axis=1), differ.argmax(axis=1), width) if width else np.zeros(m - 1, np.int64)
        out[1:] = np.where(group[1:] == group[:-1], np.minimum(at, np.minimum(sizes[1:], sizes[:-1])), -1)
    return out


def repeated_windows(
    group: np.ndarray, copies: np.ndarray, place: np.ndarray, before: list[bytes], after: list[bytes], first: np.ndarray, last: np.ndarray,
    length: int
) -> list[tuple[int, int, int, int]]:
    """Rows in order of (group, after): (row, d, d of the end, row with the first place) for runs of repeated windows.

    before: the bytes before the anchor, from right to left; first, last: the least and the greatest d; place: the order of text positions."""
    m = len(group)
    if not m:
        return []
    right = _common(after, group, length)
    # what is repeated with other bytes before the anchor left out of account: nothing else can be
    inner = np.maximum(right, 0)
    longest = np.maximum(previous_factors(place, inner)[0], previous_factors(-place, inner)[0])
    longest = np.where(copies > 1, length, longest)
    most = int(last.max())
    by_left = np.array(sorted(range(m), key=lambda i: (group[i], before[i])), np.int64)
    left = _common([before[i] for i in by_left], group[by_left], max(len(x) for x in before))
    winner = np.full((m, most + 2), -1, np.int64)
    run = np.empty(m, np.int64)
    for d in range(most + 1):
        rows = np.flatnonzero((first <= d) & (last >= d) & (longest >= length - d))
        if not len(rows):
            continue
        run[by_left] = np.cumsum(left < d)  # rows with the same d bytes before the anchor
        order = rows[np.argsort(run[rows], kind="stable")]  # of the suffixes from d bytes before the anchor
        agree = np.cumsum(right < length - d)[order]
        same = np.zeros(len(order), np.int64)
        same[1:] = np.where((agree[1:] == agree[:-1]) & (run[order[1:]] == run[order[:-1]]), length, 0)
        lpf, earlier = previous_factors(place[order], same)
        later, _ = previous_factors(-place[order], same)
        found = np.flatnonzero((lpf >= length) | (later >= length) | (copies[order] > 1))
        if not len(found):
            continue
        root = np.where(lpf >= length, earlier, np.arange(len(order)))
        while (root[root] != root).any():
            root = root[root]
        winner[order[found], d] = order[root[found]]
    flat = winner.ravel()
    change = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    until = np.append(change[1:], len(flat))
    keep = flat[change] >= 0
    wide = most + 2
    return [(int(a // wide), int(a % wide), int((b - 1) % wide), int(flat[a])) for a, b in zip(change[keep], until[keep], strict=True)]


class SuffixDedup:
    def __init__(self, length: int = 400, hot: int = HOT) -> None:
        if length < 2 * KGRAM:
            raise ValueError(f"a length under {2 * KGRAM} has no anchors")
        self.length, self.hot = length, hot

    def _anchors(self, base: DataFrame) -> DataFrame:
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, offsets = text_bytes(batch.column(2))
                ids, hashes = (batch.column(i).to_numpy() for i in (0, 1))
                for doc, s, e, p, key, content in anchors(raw, offsets, length):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[doc]), pa.array(hashes[doc]), pa.array(p), pa.array((p - e).astype(np.int16)),
                            pa.array((p - s).astype(np.int16)), pa.array(key.view(np.int64)), pa.array(content.view(np.int64))
                        ],
                        names=["id", "h", "p", "d0", "d1", "key", "content"]
                    )

        return base.mapInArrow(run, "id long, h long, p long, d0 short, d1 short, key long, content long")

    def _at_texts(self, base: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
        """The texts of `wanted` (id, h, p, d0, d1 and `columns`), each with its rows as `places`."""
        mine = wanted.groupBy("id", "h").agg(F.collect_list(F.struct("p", "d0", "d1", *columns)).alias("places"))
        return base.join(mine, ["id", "h"]).select("id", "h", "text", "places")

    def _contexts(self, base: DataFrame, wanted: DataFrame) -> DataFrame:
        """The bytes around the anchors of `wanted` (key, part, content, copies, id, h, p, d0, d1)."""
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in chunks(text_bytes(batch.column(2))[1]):
                    part = batch.slice(a, b - a)
                    rows = []
                    for i, h, text, places in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
                        for x in places:
                            p, d0, d1 = x["p"], x["d0"], x["d1"]
                            rows.append((x["key"], x["content"], x["copies"], i, h, p, x["part"], d0, d1, data[p - d1 : p][::-1], data[p : p + length - d0]))
                    if rows:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), CONTEXT.types, strict=True)], schema=CONTEXT
                        )

        return self._at_texts(base, wanted, "key", "part", "content", "copies").mapInArrow(run, CONTEXT_SQL)

    def _split(self, base: DataFrame, wanted: DataFrame, band: int) -> DataFrame:
        """A row for each band of `band` places that the windows of a row of `wanted` reach, with that as part0 and content0:
        part is the hash of what all windows of the band have in common, content that of what they span."""
        length, step = self.length, PIECE_BYTES // (8 * self.length)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, offsets = text_bytes(batch.column(2))
                places = batch.column(3).flatten()
                doc = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(3).offsets.to_numpy()))
                ids, hashes = (batch.column(i).to_numpy() for i in (0, 1))
                for a in range(0, len(places), step):
                    rows = places.slice(a, step)
                    col = dict(zip((f.name for f in rows.type), (x.to_numpy() for x in rows.flatten()), strict=True))
                    own = doc[a : a + len(rows)]
                    p, d0, d1 = (col[c].astype(np.int64) for c in ("p", "d0", "d1"))
                    size = d1 + length - d0
                    sums = ROLLING.sums(raw[ragged(offsets[own] + p - d1, size)])
                    first, count = d0 // band, d1 // band - d0 // band + 1
                    of = np.repeat(np.arange(len(rows)), count)
                    k = ragged(first, count)
                    lo, hi = np.maximum(d0[of], band * k), np.minimum(d1[of], band * k + band - 1)
                    at = (np.cumsum(size) - size + d1)[of]  # the anchor
                    common = ROLLING.between(sums, at - band * k, at + length - band * k - band + 1)
                    part = mix(common + (k << 8 | band).astype(np.uint64) * _SECOND)
                    content = mix(ROLLING.between(sums, at - hi, at - lo + length) + hi.astype(np.uint64) * _SECOND)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(pa.array(col[c][of]) for c in ("key", "part", "content", "copies")), pa.array(part.view(np.int64)), pa.array(content.view(np.int64)),
                            pa.array(ids[own][of]), pa.array(hashes[own][of]), pa.array(p[of]), pa.array(lo.astype(np.int16)), pa.array(hi.astype(np.int16))
                        ],
                        names=["key", "part0", "content0", "copies", "part", "content", "id", "h", "p", "d0", "d1"]
                    )

        return self._at_texts(base, wanted, "key", "part", "content", "copies").mapInArrow(
            run, "key long, part0 long, content0 long, copies long, part long, content long, id long, h long, p long, d0 short, d1 short"
        )

    def _in_suffix_order(self, contexts: DataFrame) -> DataFrame:
        """(key, part, content, lo, hi, id0, h0, p0): windows lo..hi before the anchor are repeated, first at the anchor p0 of id0."""
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            size = 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                held.append(batch)
                size += batch.num_rows
                if size < 8_000:
                    continue
                table = pa.Table.from_batches(held).combine_chunks()
                keys, parts = (table.column(c).to_numpy() for c in ("key", "part"))
                cut = int(np.flatnonzero((keys != keys[-1]) | (parts != parts[-1])).max(initial=-1)) + 1
                if cut:
                    yield solve(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size = table.num_rows - cut
            if held:
                yield solve(pa.Table.from_batches(held).combine_chunks())

        def solve(table: pa.Table) -> pa.RecordBatch:
            new = np.ones(table.num_rows, bool)  # rows that are equal in id and text give a content more than once
            key, part, content = (table.column(c).to_numpy() for c in ("key", "part", "content"))
            new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
            group = np.cumsum(new)
            _, one = np.unique(np.stack([group, content]), axis=1, return_index=True)
            one.sort()
            table, group = table.take(one), group[one]
            col = {c: table.column(c).to_numpy() for c in ("key", "part", "content", "copies", "id", "h", "p", "lo", "hi")}
            place = np.empty(table.num_rows, np.int64)
            place[np.lexsort((col["p"], col["h"], col["id"]))] = np.arange(table.num_rows)
            runs = repeated_windows(
                group, col["copies"], place, table.column("before").to_pylist(), table.column("after").to_pylist(), col["lo"].astype(np.int64),
                col["hi"].astype(np.int64), length
            )
            row, lo, hi, win = (np.array(x, np.int64) for x in zip(*runs, strict=True)) if runs else (np.zeros(0, np.int64),) * 4
            return pa.RecordBatch.from_arrays(
                [pa.array(col[c][row]) for c in FOUND[:3]] + [pa.array(x.astype(np.int16)) for x in (lo, hi)] + [pa.array(col[c][win]) for c in ("id", "h", "p")],
                names=FOUND
            )

        dealt = contexts.repartition("key", "part").sortWithinPartitions("key", "part", "after")
        return dealt.mapInArrow(run, FOUND_SQL)

    def _repeated(self, base: DataFrame, contents: DataFrame, bands: tuple[int, ...], written: list[DataFrame]) -> DataFrame:
        """As `_in_suffix_order`, of contents (key, part, content, copies, id, h, p, d0, d1). `written`: gets what is to be discarded afterwards."""
        keys = contents.groupBy("key", "part").agg(F.sum("copies").alias("n"), F.count("*").alias("contents")).where("n > 1").drop("n")
        shared = materialize(contents.join(keys, ["key", "part"]), "shared")
        written.append(shared)
        # one content only: all its windows are repeated, in its copies
        alone = shared.where("contents = 1").select(
            "key", "part", "content", F.col("d0").alias("lo"), F.col("d1").alias("hi"), F.col("id").alias("id0"), F.col("h").alias("h0"),
            F.col("p").alias("p0")
        )
        some = shared.where("contents > 1")
        large = some.where(F.col("contents") > self.hot)
        if not bands or large.isEmpty():
            return alone.union(self._in_suffix_order(self._contexts(base, some)))
        found = alone.union(self._in_suffix_order(self._contexts(base, some.where(F.col("contents") <= self.hot))))
        pieces = materialize(self._split(base, large, bands[0]), "pieces")
        written.append(pieces)
        held = pieces.groupBy("key", "part", "content").agg(F.sum("copies").alias("copies"), F.min(F.struct("id", "h", "p", "d0", "d1")).alias("first"))
        inner = self._repeated(base, held.select("key", "part", "content", "copies", "first.*"), bands[1:], written)
        back = pieces.select("key", "part0", "content0", "part", "content").join(inner, ["key", "part", "content"])
        # rows that are equal in id and text have a piece more than once
        return found.union(back.select("key", "part0", "content0", "lo", "hi", "id0", "h0", "p0").distinct())

    def ranges(self, base: DataFrame, keep_first: bool) -> DataFrame:
        """(id, h, ranges): the byte ranges to remove from each document that has any."""
        places = materialize(self._anchors(base), "anchors")
        contents = places.groupBy("key", "content").agg(F.count("*").alias("copies"), F.min(F.struct("id", "h", "p", "d0", "d1")).alias("first"))
        written = [places]
        found = self._repeated(base, contents.select("key", F.lit(0).cast("long").alias("part"), "content", "copies", "first.*"), BANDS, written).drop("part")
        hits = places.select("id", "h", "p", "key", "content").join(found, ["key", "content"])
        if keep_first:
            hits = hits.where(~((F.col("id") == F.col("id0")) & (F.col("h") == F.col("h0")) & (F.col("p") == F.col("p0"))))
        span = F.struct((F.col("p") - F.col("hi")).alias("a"), (F.col("p") - F.col("lo") + self.length).alias("b"))
        out = materialize(hits.groupBy("id", "h").agg(F.array_sort(F.collect_set(span)).alias("ranges")), "ranges")
        discard(*written)
        return out


CONTEXT_SQL = "key long, content long, copies long, id long, h long, p long, part long, lo short, hi short, before binary, after binary"
CONTEXT = pa.schema([(x.split()[0], {"long": pa.int64(), "short": pa.int16(), "binary": pa.binary()}[x.split()[1]]) for x in CONTEXT_SQL.split(", ")])
FOUND = ["key", "part", "content", "lo", "hi", "id0", "h0", "p0"]
FOUND_SQL = "key long, part long, content long, lo short, hi short, id0 long, h0 long, p0 long"


def remove_repeats(docs: DataFrame, length: int = 400, keep_first: bool = True, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary, what stays).

    Texts are UTF-8 bytes. A byte goes if a string of `length` bytes that covers it also begins elsewhere, in this or
    another document, in the input as it is; with `keep_first` only if it begins earlier, by (id, position), so one copy
    of everything stays. A cut may fall within a character, hence `kept` is binary. A null text counts as empty. Rows
    equal in id and text are copies of each other; with `keep_first` they count as one document. A null id comes before
    all others. An empty table gives no rows. Extra columns are not read. A very long text is looked at in pieces of
    PIECE_BYTES, with `length` - 1 bytes in common; only where bytes are cut out is it in memory as a whole."""
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("id"), F.xxhash64(text_col).alias("h"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    ranges = SuffixDedup(length, hot).ranges(base, keep_first)
    size = ranges.agg(F.count("*"), F.sum(F.size("ranges"))).first()
    if 40 * size[0] + 40 * (size[1] or 0) <= MOST_BYTES:
        ranges = F.broadcast(ranges)
    joined = base.withColumn(
        "own", F.nullif("id", F.lit(LEAST)).cast(docs.schema[id_col].dataType)
    ).join(ranges, ["id", "h"], "left").select("own", "text", "ranges")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for a, b in chunks(offsets):
                rows = []
                for i, found in zip(range(a, b), batch.column(2).slice(a, b - a).to_pylist(), strict=True):
                    data = raw[offsets[i] : offsets[i + 1]].tobytes()
                    if not found:
                        rows.append((len(data), 0, 0, data))
                        continue
                    merged = [[found[0]["a"], found[0]["b"]]]
                    for x in found[1:]:
                        if x["a"] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], x["b"])
                        else:
                            merged.append([x["a"], x["b"]])
                    edges = [0, *(e for m in merged for e in m), len(data)]
                    kept = b"".join(data[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                    rows.append((len(data), len(data) - len(kept), len(merged), kept))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        *(pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))
                    ],
                    names=["own", "n_bytes", "n_removed", "n_spans", "kept"]
                )

    out = joined.mapInArrow(rebuild, f"own {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("own", id_col)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"), keep_first=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
