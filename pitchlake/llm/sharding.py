"""Sharding by histogram sort.

Rows are ordered by (hash of the text, doc_id), so equal texts lie side by side. Splitters that cut this order into
shards of equal bytes are found without sorting the table: each round counts, in every partition, the exact bytes and
rows below some candidate keys, sums the counts, and narrows each splitter's interval, until every splitter is within
the tolerance of its target (or no key lies between). Then the rows are exchanged once.

Each shard is cut into further pieces in the same way, so the exchange and the numbering run in many tasks; the exact
row counts of the pieces give every piece its first slot.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import materialize, read_table

LOW, SPAN = -(2**63), 2**64
PROBES = 48
MOST_PIECES = 1 << 16


def _split(key: int) -> tuple[int, int]:
    return (key >> 64) + LOW, (key & (SPAN - 1)) + LOW


def _sorted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, d, s = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("k", "d", "size"))
    order = np.lexsort((d, k))
    return k[order], d[order], s[order]


def _below(k: np.ndarray, d: np.ndarray, probes: list[int]) -> np.ndarray:
    """For each probe, the number of rows of the sorted batch with a key below it."""
    pk, pd = (np.array(x, np.int64) for x in zip(*map(_split, probes), strict=True))
    lo, hi = np.searchsorted(k, pk, "left"), np.searchsorted(k, pk, "right")
    for i in np.flatnonzero(lo < hi).tolist():  # only probes that fall on a key of the batch need the second part
        lo[i] += np.searchsorted(d[lo[i] : hi[i]], pd[i], "left")
    return lo.astype(np.int64)


def _histogram(keyed: DataFrame, probes: list[int]) -> list[tuple[int, int, int | None, int | None]]:
    """Exact (bytes, rows) below each probe, and the least and greatest key from it to the next probe (None: no row).

    A task folds its batches and emits a row a probe at most; the result has one row a probe, however large the table is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(probes)
        size, rows, seen = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        k0, d0, k1, d1 = (np.zeros(n, np.int64) for _ in range(4))
        for batch in batches:
            if not batch.num_rows:
                continue
            k, d, s = _sorted(batch)
            at = _below(k, d, probes)
            size += np.concatenate([[0], np.cumsum(s)])[at]
            rows += at
            until = np.append(at[1:], len(k))
            has = np.flatnonzero(until > at)
            a, z = at[has], until[has] - 1
            less = ~seen[has] | (k[a] < k0[has]) | ((k[a] == k0[has]) & (d[a] < d0[has]))
            more = ~seen[has] | (k[z] > k1[has]) | ((k[z] == k1[has]) & (d[z] > d1[has]))
            k0[has[less]], d0[has[less]] = k[a[less]], d[a[less]]
            k1[has[more]], d1[has[more]] = k[z[more]], d[z[more]]
            seen[has] = True
        some = np.flatnonzero(rows | seen)
        mask = ~seen[some]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(size[some]), pa.array(rows[some]), *(pa.array(x[some], mask=mask) for x in (k0, d0, k1, d1))],
            names=["i", "b", "r", "k0", "d0", "k1", "d1"]
        )

    rows = (
        keyed.mapInArrow(count, "i int, b long, r long, k0 long, d0 long, k1 long, d1 long").groupBy("i")
        .agg(
            F.sum("b").alias("b"), F.sum("r").alias("r"), F.min(F.when(F.col("k0").isNotNull(), F.struct("k0", "d0"))).alias("x"),
            F.max(F.when(F.col("k1").isNotNull(), F.struct("k1", "d1"))).alias("y")
        ).collect()
    )
    join = lambda x: None if x is None else ((x[0] - LOW) << 64) | (x[1] - LOW)
    out: list = [(0, 0, None, None)] * len(probes)
    for r in rows:
        out[r["i"]] = (r["b"], r["r"], join(r["x"]), join(r["y"]))
    return out


def find_splitters(keyed: DataFrame, total: int, targets: list[int], tolerances: list[int]) -> list[int]:
    """Keys with about `targets` bytes below them. A splitter is settled within its tolerance, or when its interval has no key left to try."""
    interval = [(0, SPAN * SPAN - 1, 0, total) for _ in targets]  # key, key, bytes below either
    best: list[tuple[int, int]] = [(abs(t), 0) if t <= total - t else (abs(total - t), SPAN * SPAN - 1) for t in targets]
    open_ = [i for i in range(len(targets)) if best[i][0] > tolerances[i]]
    each = max(4, min(PROBES, MOST_PIECES * 4 // max(1, len(open_))))
    while open_:
        probes = set()
        for i in open_:
            lo, hi, _, _ = interval[i]
            probes |= {lo + (hi - lo) * j // (each + 1) for j in range(each + 2)} | {lo, hi, min(hi, lo + 1)}
        ordered = sorted(probes)
        counted = list(zip(ordered, _histogram(keyed, ordered), strict=True))
        for i in open_:
            lo, hi, _, _ = interval[i]
            own = counted[bisect_left(ordered, lo) : bisect_right(ordered, hi)]
            best[i] = min(best[i], *((abs(b - targets[i]), p) for p, (b, *_) in own))
            under = [(p, x) for p, x in own if x[0] <= targets[i]]
            over = [p for p, x in own if x[0] > targets[i]]
            p, (_, _, least, most) = under[-1]
            # the keys in [p, next probe) are all that is left: cut at the least, or after one of them
            if least is None or best[i][0] <= tolerances[i]:
                interval[i] = (0, 0, 0, 0)
            else:
                top = min(over[0] if over else hi, most + 1)
                interval[i] = (least, top, 0, 0) if top - least > 1 and (least, top) != (lo, hi) else (0, 0, 0, 0)
        open_ = [i for i in open_ if interval[i] != (0, 0, 0, 0)]
    return [p for _, p in best]


def shard_by_bytes(
    docs: DataFrame, shards: int = 8, tolerance: float = 0.0005, piece_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Put every row into one of `shards` shards of nearly equal bytes.

    Size: UTF-8 bytes of the text plus 1; a null text has size 1 and the checksum of an empty one. Equal texts lie side
    by side in one shard, cut only where a splitter falls among them. A null id sorts first. Rows equal in both text and
    id are interchangeable: they stay together and their slots are in no particular order. An empty table gives no
    rows. Other columns of `docs` are not read. A very long text is read once, for its size and hashes. Returns id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("k"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(LOW)).alias("d")
        ), "shard-keys"
    )
    total = keyed.agg(F.sum("size")).first()[0] or 0
    per = max(8, min(max(8, MOST_PIECES // shards), -(-total // (shards * piece_bytes))))
    pieces = shards * per
    targets = [total * i // pieces for i in range(1, pieces)]
    tight, loose = max(1, int(total / shards * tolerance)), max(1, total // pieces // 10)
    cuts = find_splitters(keyed.select("k", "d", "size"), total, targets, [loose if i % per else tight for i in range(1, pieces)])
    for i in range(1, len(cuts)):
        cuts[i] = max(cuts[i], cuts[i - 1])
    rows = [0, *(r for _, r, _, _ in _histogram(keyed.select("k", "d", "size"), cuts))] if total else [0] * pieces
    first = [rows[i] - rows[i // per * per] for i in range(pieces)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = [np.array(x, np.int64) for x in zip(*map(_split, cuts), strict=True)]
        for batch in batches:
            k, d = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("k", "d"))
            lo, hi = np.searchsorted(bounds[0], k, "left"), np.searchsorted(bounds[0], k, "right")
            piece = hi.astype(np.int32)
            for i in np.flatnonzero(lo < hi):
                piece[i] = lo[i] + np.searchsorted(bounds[1][lo[i] : hi[i]], d[i], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(piece)], names=[*batch.schema.names, "piece"])

    placed = keyed.mapInArrow(place, "doc_id long, size long, text_crc32 long, k long, d long, piece int")
    slot = F.row_number().over(Window.partitionBy("piece").orderBy("k", "d")) - 1
    starts = docs.sparkSession.createDataFrame(list(enumerate(first)), "piece int, first long")  # as many rows as pieces, MOST_PIECES at most
    numbered = placed.repartition(pieces, "piece").withColumn("slot", slot).join(F.broadcast(starts), "piece")
    shard = F.floor(F.col("piece") / per).cast("int").alias("shard")
    return numbered.select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), shard,
        (F.col("slot") + F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op8_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(read_table(spark, sf_dir, "documents"))
