"""Packing of token sequences by bounded-space online best fit.

Each partition keeps a fixed number of open windows. A document's full windows leave at once; its rest goes into the
open window with the least room that still takes it. When none takes it and all places are in use, the fullest window
is emitted and a new one opened. The windows left open at the end of each partition are then merged with each other,
fullest first, in groups of bounded size.

Tokens come from the tokenizer's own encoding of each distinct pre-token, kept in a bounded cache of the worker.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .base import chunks, materialize, ragged, read_table, text_bytes, tidied
from .pretoken import Cache, Pretokens

CHUNK_BYTES = 2 << 20
MERGE_GROUP = 1 << 15
#: Pre-tokens in a worker's cache, and those that it keeps from one task to the next.
CACHE_SIZE, CACHE_KEPT = 1 << 19, 1 << 16
#: Longer pre-tokens (code points) aren't kept in the worker's cache, so that it is bounded in bytes.
MOST_CHARS = 256
_KEPT: dict = {}


def _tools(path: str) -> tuple[Tokenizer, Pretokens, Cache, np.ndarray]:
    """The tokenizer, its cuts, the worker's cache and the bytes of each id."""
    if path not in _KEPT:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; more threads wait for each other
        lib = Tokenizer.from_file(path)
        names = lib.get_vocab(with_added_tokens=False)
        widths = np.zeros(max(names.values()) + 1, np.int64)
        widths[list(names.values())] = list(map(len, names))  # a byte-level vocabulary writes each byte as one character
        _KEPT[path] = lib, Pretokens(False, tuple(x.content for x in lib.get_added_tokens_decoder().values())), Cache(CACHE_SIZE), widths
    return _KEPT[path]


def _encode_words(lib: Tokenizer, widths: np.ndarray, words: list[str], joined: bool) -> list[bytes]:
    """Ids of each pre-token, encoded together: as the words of one input, or `joined` as one text, for those of a blank
    and letters, which the tokenizer's pattern cuts apart again. Where a word's ids end follows from their bytes."""
    source = "".join(words) if joined else words
    ids = np.array(lib.encode_batch_fast([source], is_pretokenized=not joined, add_special_tokens=False)[0].ids, np.uint32)
    until = np.cumsum(widths[ids])
    edges = np.cumsum([len(w.encode()) for w in words])
    ends = np.searchsorted(until, edges) + 1
    if len(ids) != ends[-1] or (until[ends - 1] != edges).any():  # an id that isn't its bytes: each on its own
        return [np.array(e.ids, np.uint32).tobytes() for e in lib.encode_batch_fast([[w] for w in words], is_pretokenized=True, add_special_tokens=False)]
    raw, ends = ids.tobytes(), (4 * ends).tolist()
    return [raw[x:y] for x, y in zip([0, *ends], ends, strict=False)]


def encode_ids(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, end to end, and the n + 1 offsets: equal to the tokenizer's without added special tokens."""
    lib, pre, cache, widths = _tools(path)
    odd = pre.odd(texts)
    plain = ["" if o else t for t, o in zip(texts, odd, strict=True)]
    code, starts, ends, each = pre.cut(plain)
    joined = "".join(plain)
    at, back = pre.distinct(code, starts, ends)
    words = [joined[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
    ids = cache.get_all(words)
    miss = [k for k, x in enumerate(ids) if x is None]
    led = [words[k][0] == " " and words[k][1:].isalpha() for k in miss]
    for kind in (True, False):
        mine = [k for k, x in zip(miss, led, strict=True) if x is kind]
        for a in range(0, len(mine), 4_096):
            some = mine[a : a + 4_096]
            names = [words[k] for k in some]
            new = _encode_words(lib, widths, names, kind)
            for k, x in zip(some, new, strict=True):
                ids[k] = x
            if max(map(len, names)) > MOST_CHARS:
                short = [i for i, w in enumerate(names) if len(w) <= MOST_CHARS]
                names, new = [names[i] for i in short], [new[i] for i in short]
            cache.add(names, new)
    flat = np.frombuffer(b"".join(ids), np.uint32)
    n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    begin = np.cumsum(n) - n
    length = n[back]
    out = flat[ragged(begin[back], length)]
    running = np.concatenate([[0], np.cumsum(length)])
    edge = np.concatenate([[0], np.cumsum(each)])
    offsets = running[edge]
    if any(odd):
        whole = {
            i: np.array(e.ids, "<u4") for i,
            e in zip(
                (i for i, o in enumerate(odd) if o),
                lib.encode_batch_fast([t for t, o in zip(texts, odd, strict=True) if o], add_special_tokens=False), strict=True
            )
        }
        parts = [whole.get(i, out[offsets[i] : offsets[i + 1]]) for i in range(len(texts))]
        out, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return out, offsets


class Windows:
    """The open windows of one partition: best fit by a sorted list of (room, number)."""

    def __init__(self, size: int, places: int) -> None:
        self.size, self.places, self.next = size, places, 0
        self.rooms: list[tuple[int, int]] = []

    def number(self) -> int:
        self.next += 1
        return self.next - 1

    def put(self, row: int, length: int) -> tuple[int, int, int | None]:
        """Window and offset of a piece; the window that was emitted for it, if any."""
        k, closed = bisect_left(self.rooms, (length, -1)), None
        if k < len(self.rooms):
            room, window = self.rooms.pop(k)
        else:
            if len(self.rooms) >= self.places:
                closed = self.rooms.pop(0)[1]
            room, window = self.size, self.number()
        if room > length:
            insort(self.rooms, (room - length, window))
        return window, self.size - room, closed


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, places: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are the tokenizer's and then `end_id`, so a null or empty text is one piece of one id. Equal ids
    or rows are packed once for each row. A null id stays null. An empty table gives no rows; extra columns are not
    read. Windows of equal room are taken by number. A very long text is encoded as a whole, in memory of many times its size.
    Sequence ids are unique, not dense; the last, partly filled ones may be padded to a smaller power of two."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, part_id = Windows(size, places), TaskContext.get().partitionId() << 36
        for batch in batches:
            _, edges = text_bytes(batch.column(1))
            for a, b in chunks(edges, CHUNK_BYTES):
                part = batch.slice(a, b - a)
                ids, offsets = encode_ids([t or "" for t in part.column(1).to_pylist()], path)
                raw, tail = memoryview(ids.tobytes()), np.uint32(end_id).astype("<u4").tobytes()
                rows: list[tuple] = []
                for doc, lo, hi in zip(part.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    total = hi - lo + 1
                    for start in range(0, total, size):
                        length = min(size, total - start)
                        crc = zlib.crc32(raw[4 * (lo + start) : 4 * min(hi, lo + start + length)])
                        if start + length == total:
                            crc = zlib.crc32(tail, crc)
                        if length == size:
                            window, offset = open_.number(), 0
                        else:
                            window, offset, _ = open_.put(len(rows), length)
                        rows.append((doc, start, length, crc, total, part_id + window, offset, 0))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names=[*NAMES, "room"])
        _tools(path)[2].trim(CACHE_KEPT)
        if open_.rooms:  # a row for each window left open, with its room
            n = len(open_.rooms)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, none, none, pa.array([part_id + w for _, w in open_.rooms]), none, pa.array([r for r, _ in open_.rooms])],
                names=[*NAMES, "room"]
            )

    placed = materialize(docs.mapInArrow(tidied(place), PIECE + ", room long"), "packed")
    left = placed.where("room > 0").select("sequence_id", "room")
    groups = max(1, -(-left.count() // MERGE_GROUP))

    def merge(table: pa.Table) -> pa.Table:
        """Best fit of whole windows, fullest first."""
        ids, rooms = (np.array(table.column(c)) for c in ("sequence_id", "room"))
        merged, free = [], []
        for i in np.lexsort((ids, rooms)):
            used = size - int(rooms[i])
            k = bisect_left(free, (used, -1))
            room, into = free.pop(k) if k < len(free) else (size, int(ids[i]))
            merged.append((int(ids[i]), into, size - room))
            if room > used:
                insort(free, (room - used, into))
        return pa.table({n: pa.array(list(c), pa.int64()) for n, c in zip(("old", "into", "shift"), zip(*merged, strict=True), strict=True)})

    keyed = left.withColumn("g", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)))
    moved = keyed.groupBy("g").applyInArrow(merge, "old long, into long, shift long")
    out = placed.where("room = 0").join(moved, F.col("sequence_id") == F.col("old"), "left")
    return out.select(
        F.col("doc_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", F.coalesce("into", "sequence_id").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).cast("long").alias("offset")
    )


NAMES = [x.split()[0] for x in PIECE.split(", ")]


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
