"""Token counts by a two-tier lookup on the map side.

First pass: every partition counts its pre-tokens in a summary of bounded size. What occurs once in a batch of 1 MB
isn't counted there, and when the summary is full, all counts are lowered until half of it is free; so a pre-token may be
missing from the table, which costs its encoding as a miss, not a wrong count. The summaries are summed, and of at most `table_size` of the most frequent pre-tokens the token counts are broadcast in a hash table by
pre-token. Those above MOST_CHARS stay out of summaries, table and caches, so that these are bounded in bytes. Second
pass: each batch looks its distinct pre-tokens up there, then in the worker's own bounded cache, and encodes what is
left. No pre-token of a text is shuffled; only the summaries are, at most `summary_size` rows a partition.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .base import chunks, discard, materialize, most_frequent, read_table, text_bytes
from .pretoken import Cache, Pretokens

CHUNK_BYTES = 1 << 20
#: Longer pre-tokens (code points) get into no summary.
MOST_CHARS = 256
_KEPT: dict = {}


def _tools(path: str) -> tuple[Tokenizer, Pretokens]:
    if path not in _KEPT:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; more threads wait for each other
        lib = Tokenizer.from_file(path)
        _KEPT[path] = lib, Pretokens(True, tuple(x.content for x in lib.get_added_tokens_decoder().values()))
    return _KEPT[path]


def _batches(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        i = batch.schema.get_field_index(text_col)
        _, offsets = text_bytes(batch.column(i))
        for a, b in chunks(offsets, CHUNK_BYTES):
            part = batch.slice(a, b - a)
            yield part, [t or "" for t in part.column(i).to_pylist()]


def _encode_lengths(lib: Tokenizer, words: list[str]) -> list[int]:
    out: list[int] = []
    for i in range(0, len(words), 20_000):
        out += [len(e.ids) for e in lib.encode_batch_fast(words[i : i + 20_000], add_special_tokens=False)]
    return out


def _word_lengths(lib: Tokenizer, words: list[str]) -> np.ndarray:
    """Token counts of single pre-tokens: as the words of one input they cost one encoding together."""
    out = [np.zeros(0, np.int64)]
    for i in range(0, len(words), 4_096):
        some = words[i : i + 4_096]
        found = lib.encode(some, is_pretokenized=True, add_special_tokens=False)
        out.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(some)))
    return np.concatenate(out)


def frequent_lengths(docs: DataFrame, path: str, table_size: int, summary_size: int, text_col: str) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of all documents, `table_size` at most."""

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pre = _tools(path)
        kept: dict[str, int] = {}
        for _, texts in _batches(batches, text_col):
            plain = [t for t, o in zip(texts, pre.odd(texts), strict=True) if not o]
            code, starts, ends, _ = pre.cut(plain)
            joined = "".join(plain)
            at, back = pre.distinct(code, starts, ends)
            n = np.bincount(back, minlength=len(at))
            # what can't get into the summary needs no text, unless it is there already
            room = np.sort(n)[-summary_size] if len(n) > summary_size else 0
            short = np.flatnonzero((ends[at] - starts[at] <= MOST_CHARS) & ((n >= max(2, room)) | bool(kept)))
            for s, e, k in zip(starts[at[short]].tolist(), ends[at[short]].tolist(), n[short].tolist(), strict=True):
                word = joined[s:e]
                if k >= max(2, room) or word in kept:
                    kept[word] = kept.get(word, 0) + k
            if len(kept) > summary_size:
                less = sorted(kept.values())[-summary_size // 2]
                kept = {w: k - less for w, k in kept.items() if k > less}
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["word", "n"])

    counted = materialize(docs.select(text_col).mapInArrow(summarize, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "pre-tokens")
    words = [r["word"] for r in most_frequent(counted, table_size).select("word").collect()]
    discard(counted)
    lib, pre = _tools(path)
    # alone, a word must still be one pre-token
    whole = [w for w, o in zip(words, pre.odd(words), strict=True) if not o]
    alone = pre.cut(whole)[3]
    whole = [w for w, n in zip(whole, alone.tolist(), strict=True) if n == 1]
    return dict(zip(whole, _word_lengths(lib, whole).tolist(), strict=True))


def count_tokens(
    docs: DataFrame, path: str, limit: int = 2048, table_size: int = 1 << 15, summary_size: int = 1 << 15, cache_size: int = 1 << 18,
    id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit. A null text counts as empty: 0 and 0. Ids may repeat or be
    null: one row comes out for each that goes in. An empty table gives no rows. Extra columns are not read."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, table_size, summary_size, "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, pre = _tools(path)
        known: dict[str, int] = table.value
        cache: Cache = _KEPT.setdefault(("lengths", path), Cache(cache_size))
        for part, texts in _batches(batches, "text"):
            odd = np.array(pre.odd(texts), bool)
            plain = ["" if o else t for t, o in zip(texts, odd, strict=True)]
            code, starts, ends, each = pre.cut(plain)
            joined = "".join(plain)
            at, back = pre.distinct(code, starts, ends)
            words = [joined[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            n = list(map(known.get, words))
            rest = [k for k, x in enumerate(n) if x is None]
            for k, x in zip(rest, cache.get_all([words[k] for k in rest]), strict=True):
                n[k] = x
            miss = [k for k in rest if n[k] is None]
            if miss:
                new = _word_lengths(lib, [words[k] for k in miss]).tolist()
                for k, x in zip(miss, new, strict=True):
                    n[k] = x
                short = [k for k in miss if len(words[k]) <= MOST_CHARS]
                cache.add([words[k] for k in short], [n[k] for k in short])
            n = np.array(n, np.int64)
            running = np.concatenate([[0], np.cumsum(n[back])])
            edge = np.concatenate([[0], np.cumsum(each)])
            total = running[edge[1:]] - running[edge[:-1]]
            if odd.any():
                total[odd] = _encode_lengths(lib, [t for t, o in zip(texts, odd, strict=True) if o])
            size = np.diff(text_bytes(part.column(1))[1])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(size), pa.array(total), pa.array(total > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("doc_id", id_col)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
