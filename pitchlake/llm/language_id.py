"""Language ID by language-bitmask n-gram filters.

Training counts the character n-grams of every labelled training document, by language, and keeps for each language
those above a rate. They go into one bit-sliced Bloom filter: a table with a bit for each language in every slot, so
that ANDing the slots at an n-gram's places gives all languages that contain it at once. A text's n-grams are looked up,
a popcount for each language counts its hits, and the hits expected by chance (from how full its bit plane is) are
taken off.

The model is bounded by `min_rate`: a language has at most 1 / min_rate n-grams with such a rate, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import chunks, discard, materialize, mix, read_table, text_bytes, tidied
from .pretoken import LETTER, character_classes

SIZES = (3, 4)
PROBES = 3
_KEPT: dict = {}


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in lower case, each run of other characters as one blank, a blank at either end; and the offsets."""
    if "classes" not in _KEPT:
        _KEPT["classes"] = character_classes()
    padded = [f" {t.lower()} " for t in texts]
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.concatenate([[0], np.cumsum([len(t) for t in padded], dtype=np.int64)])
    letter = _KEPT["classes"][code] == LETTER
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[edges[:-1]] = True
    return np.where(letter, code, 0x20)[keep], np.concatenate([[0], np.cumsum(keep)])[edges]


def grams(code: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, the hashes of the n-grams in order, and the document each is from; none crosses documents."""
    doc = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    c = code.astype(np.uint64)
    for n in SIZES:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x1F35A94B6D2E9) + c[j : len(c) - n + 1 + j]
        inside = doc[: len(h)] == doc[n - 1 :]
        yield mix(h[inside]) >> np.uint64(1), doc[: len(h)][inside]


@dataclass
class Filter:
    languages: list[str]
    words: np.ndarray  # uint64, 2**k slots x as many words as the languages need
    false_rate: np.ndarray  # of each language

    def places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        low, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        for j in range(PROBES):
            yield (low + np.uint64(j) * step) & np.uint64(len(self.words) - 1)

    def masks(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that contain it, as bits."""
        out = np.full((len(h), self.words.shape[1]), 2**64 - 1, np.uint64)
        for p in self.places(h):
            out &= self.words[p]
        return out

    def hits(self, h: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """Documents x languages: the popcount of each language's bit over a document's n-grams. `doc` is in rising order."""
        out = np.zeros((docs, len(self.languages)), np.int64)
        if len(h) and self.languages:
            used = (len(self.languages) + 7) // 8
            bits = np.unpackbits(self.masks(h).view(np.uint8)[:, :used], axis=1, bitorder="little", count=len(self.languages))
            first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            out[doc[first]] = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        return out


def build_filter(sets: dict[str, np.ndarray]) -> Filter:
    """At least 16 slots an n-gram of the largest language keep each bit plane sparse."""
    languages = sorted(sets)
    size = 1 << max(12, int(16 * max(map(len, sets.values()), default=1)).bit_length())
    out = Filter(languages, np.zeros((size, max(1, -(-len(languages) // 64))), np.uint64), np.zeros(len(languages)))
    for i, name in enumerate(languages):
        word, bit = i // 64, np.uint64(i % 64)
        for p in out.places(sets[name]):
            out.words[p, word] |= np.uint64(1) << bit
        out.false_rate[i] = float((out.words[:, word] >> bit & np.uint64(1)).mean()) ** PROBES
    return out


def train(labelled: DataFrame, min_rate: float = 5e-6, share: float = 0.0) -> Filter:
    """The filter from all rows (text, lang) of `labelled`; rows without lang don't count.

    A language's set: its n-grams with a rate of `min_rate` at least, so 1 / `min_rate` at most, which bounds the filter.
    With `share`, those go whose rate is under that share of the highest in any language; it is off, so that the filter gives
    all languages that contain an n-gram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(text_bytes(batch.column(0))[1], 1 << 19):
                part = batch.slice(a, b - a)
                langs = np.array(part.column(1).to_pylist(), object)
                texts = part.column(0).to_pylist()
                for name in sorted(set(langs)):
                    found = [h for h, _ in grams(*letters_of([texts[i] or "" for i in np.flatnonzero(langs == name)]))]
                    keys, n = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"]
                    )

    counted = materialize(
        labelled.where("lang is not null").select("text", "lang").mapInArrow(
            tidied(count), "lang string, gram long, n long"
        ).groupBy("gram", "lang").agg(F.sum("n").alias("n")),
        "gram-counts"
    )
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counted.join(F.broadcast(totals), "lang").select("gram", "lang", (F.col("n") / F.col("total")).alias("rate"))  # totals: a row a language
    kept = rates.groupBy("gram").agg(F.collect_list(F.struct("lang", "rate")).alias("x")).select(
        "gram", F.explode(F.filter("x", lambda e: e["rate"] >= min_rate)).alias("e"), F.array_max(F.transform("x", lambda e: e["rate"])).alias("top")
    )
    rows = kept.where(F.col("e.rate") >= share * F.col("top")).select("e.lang", "gram").toPandas()
    names = [r["lang"] for r in totals.collect()]
    discard(counted)
    return build_filter({name: rows.loc[rows["lang"] == name, "gram"].to_numpy(np.int64).astype(np.uint64) for name in names})


def predict(docs: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Per row: id (or the columns `keep`), lang_pred, score (0 to 1: the corrected share of the text's n-grams that the
    language contains).

    `und` with score 0 for a null text or one without letters, or if nothing was learned; ties go to the language first
    by name. Columns that aren't named here are not read; repeated rows come out repeated. An empty table gives no rows. A
    very long text is in memory as a whole, with some tens of bytes a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Filter = shared.value
        for batch in batches:
            for a, b in chunks(text_bytes(batch.column(0))[1], 1 << 19):
                part = batch.slice(a, b - a)
                k = b - a
                n, got = np.zeros(k, np.int64), np.zeros((k, len(m.languages)), np.int64)
                for h, doc in grams(*letters_of([t or "" for t in part.column(0).to_pylist()])):
                    n += np.bincount(doc, minlength=k)
                    got += m.hits(h, doc, k)
                share = (got / np.maximum(n, 1)[:, None] - m.false_rate) / (1 - m.false_rate)
                some = (n > 0) & bool(m.languages)
                best = share.argmax(axis=1) if m.languages else np.zeros(k, np.int64)
                name = [m.languages[i] if s else "und" for i, s in zip(best.tolist(), some.tolist(), strict=True)]
                score = np.where(some, np.clip(share[np.arange(k), best], 0, 1), 0.0) if m.languages else np.zeros(k)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(name, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    out = list(keep) or [id_col]
    names = [f"k{i}" for i in range(len(out))]
    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, out, strict=True))
    own = docs.select(F.col(text_col).alias("text"), *(F.col(c).alias(n) for n, c in zip(names, out, strict=True)))
    return own.mapInArrow(tidied(run), f"{kinds}, lang_pred string, score double").withColumnsRenamed(dict(zip(names, out, strict=True)))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = predict(docs, train(docs.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
