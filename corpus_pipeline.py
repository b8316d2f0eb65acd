"""A corpus-cleaning pipeline made of the operators in pitchlake/llm."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.llm.base import discard, materialize, read_table
from pitchlake.llm.decontamination import find_leaks
from pitchlake.llm.jaccard_join import surplus
from pitchlake.llm.language_id import held_out, predict, train
from pitchlake.llm.packing import pack
from pitchlake.llm.sentence_spans import remove_repeated_passages

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose n-grams the best language covers by less is none of the learned languages. On sf0.1, in the languages
#: learned, no document is under 0.3 (the least score is 0.32) and 2 of 10,000 under 0.4; text in none of them is to go.
LEAST_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those that are `und` (null or letterless texts) or below LEAST_SCORE go.
    Learned from the labelled rows that aren't held out. Rows are judged one by one: null, repeated and clashing ids and
    other columns play no part. Nothing is learned from an empty table, and nothing comes out."""
    found = predict(docs, train(docs.where(~held_out())), keep=COLUMNS)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(COLUMNS)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """`docs` without the rows whose id and text (as its hash h) are in `gone`; null is an id like others.
    The join shuffles at every size, so that its figures grow with the input."""
    same = [F.col("doc_id").eqNullSafe(F.col("gone_id")), F.xxhash64("text") == F.col("gone_h")]
    return docs.join(gone.select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")).hint("merge"), same, "left_anti")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links connect, one with the least id stays, a null id before others; of equal ids, the one
    with the least hash of its text. Of rows equal in id and text one stays, also where the text has no words; if
    they differ in other columns, the one with the least of those. Documents that only share an id are apart."""
    marks = materialize(surplus(docs), "surplus")
    repeated = marks.where("stays").select("doc_id", "h")
    left = _without(docs, marks).select(COLUMNS)
    if repeated.isEmpty():
        return left
    same = [F.col("doc_id").eqNullSafe(F.col("many_id")), F.xxhash64("text") == F.col("many_h")]
    many = docs.join(repeated.select(F.col("doc_id").alias("many_id"), F.col("h").alias("many_h")), same, "left_semi")
    rest = COLUMNS[2:]
    one = many.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("rest")).select("doc_id", "text", *(f"rest.{c}" for c in rest))
    return left.union(one.select(COLUMNS))


def repeated_sentences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without spans and passages that repeat earlier ones, by (doc_id, place); a text that loses all its words goes.
    Null and empty texts stay; rows equal in id and text are one document, and all stay or change alike; a null id comes
    before others."""
    left = remove_repeated_passages(docs, windows=True, keep=["lang", "source", "n_chars"])
    return left.where("n_removed = 0 or length(trim(text)) > 0").withColumn(
        "n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))
    ).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item. Null, empty and wordless texts stay; of rows that share an id only
    those with a leaking text go, null being an id like others; with an empty benchmark all stay."""
    leaks = find_leaks(docs, read_table(spark, sf_dir, "benchmark"), by_text=True).select("doc_id", "h").distinct()
    return _without(docs, leaks).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' tokens, packed: a row a piece. A null or empty text is one piece of one token; rows may repeat."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language-id", language_id),
    ("jaccard-join", one_of_each_group),
    ("sentence-spans", repeated_sentences),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: None: language ID is trained, and packing needs a tokenizer; neither can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each result is written as Parquet and read again for the next, and deleted once
    the next is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs
