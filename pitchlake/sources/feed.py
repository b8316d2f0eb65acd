"""Landed event feeds, as the source delivers them or a line an event; what can't be read is set aside, what didn't come is
listed, and what is new is added to an event store without touching the rest."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ingest import EVENTS, flatten, missing_paths, split_corrupt

CORRUPT = "_corrupt"
#: The match of a file, where its body names none: the last number in the file's name.
FILE_MATCH = r"(\d+)\D*$"


class Feed(NamedTuple):
    """events: typed rows in order (`seq`). rejected: file and text of what isn't an event or a document of events."""

    events: DataFrame
    rejected: DataFrame


def _reader(spark: SparkSession, schema: str, path: str, whole: bool) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "multiLine": whole}
    return spark.read.schema(f"{schema}, {CORRUPT} string").options(**options).json(path)


def _event_columns(raw: DataFrame, prefix: str = "") -> list[Column]:
    kind = raw.schema if not prefix else raw.schema[prefix.rstrip(".")].dataType
    return flatten(T.StructType([f for f in kind.fields if f.name != CORRUPT]), prefix)


def read_lines(spark: SparkSession, path: str) -> Feed:
    """One event a line, as `read_events` reads it; a line that isn't JSON, or has text where a whole number belongs, is
    rejected and in no aggregate. Files may be of any size: they are split by lines."""
    raw = _reader(spark, EVENTS, path, False)
    file = F.col("_metadata.file_path")
    seq = F.struct(file.alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    good, bad = split_corrupt(raw.withColumns({"seq": seq, "file": file}), CORRUPT, "id")
    return Feed(good.select("seq", *_event_columns(raw)), bad.select("file", F.col(CORRUPT).alias("text")))


def read_documents(spark: SparkSession, path: str, whole: bool = True) -> Feed:
    """One document a match, {"matchId": ..., "events": [...]}: a row an event, in the order of the list (`seq`: file, place).

    The match is the body's, or the event's, or the last number in the file's name. A document is read as a whole by one
    task, so files, not bytes, are what is dealt out; a match is a few MB. A file that isn't such JSON is rejected; one
    without events has no rows.

    Many matches are better landed as a document a line, many in a file: with `whole` false, files are split by lines, a line
    that isn't such JSON is rejected alone, and a file's name says nothing of the match (`seq`: file, begin of the split,
    document, place)."""
    item = ",".join(f.replace(" ", ":", 1) for f in _fields(EVENTS))
    raw = _reader(spark, f"matchId long, events array<struct<{item}>>", path, whole)
    named = F.regexp_extract("_metadata.file_name", FILE_MATCH, 1).try_cast("long") if whole else F.lit(None).cast("long")
    at = {} if whole else {"start": F.col("_metadata.file_block_start"), "document": F.monotonically_increasing_id()}
    marked = raw.withColumns({"file": F.col("_metadata.file_path"), "named": named, **at})
    good, bad = split_corrupt(marked, CORRUPT, "matchId")
    rows = good.select(F.col("matchId").alias("body"), "named", "file", *at, F.posexplode("events").alias("place", "e"))
    match = F.coalesce("body", "e.matchId", "named")
    columns = [match.alias("matchId") if f == "matchId" else c for f, c in zip(_names(raw), _event_columns(rows, "e."), strict=True)]
    events = rows.select(F.struct("file", *at, F.col("place").cast("long").alias("row")).alias("seq"), *columns)
    names = [c.removeprefix("e_") for c in events.columns]
    return Feed(events.toDF(*names), bad.select("file", F.col(CORRUPT).alias("text")))


def _fields(schema: str) -> list[str]:
    """Top-level fields of a schema text."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]


def _names(raw: DataFrame) -> list[str]:
    """Names of the flattened event columns of a document."""

    def leaves(kind: T.StructType, prefix: str) -> list[str]:
        return [x for f in kind.fields for x in (leaves(f.dataType, f"{prefix}{f.name}.") if isinstance(f.dataType, T.StructType) else [f"{prefix}{f.name}"])]

    return leaves(raw.schema["events"].dataType.elementType, "")


def missing_matches(schedule: DataFrame, events: DataFrame, match: str = "matchId") -> DataFrame:
    """Scheduled matches that sent no event."""
    return schedule.join(events.select(match).distinct(), match, "left_anti")


# ---- stores

def _folders(spark: SparkSession, path: str) -> str | None:
    """The column that names the folders of the store at `path`; None where nothing is stored yet."""
    if missing_paths(spark, [path]):
        return None
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatusIterator(at)
    while listed.hasNext():
        name, named, _ = listed.next().getPath().getName().partition("=")
        if named:
            return name
    return None


def append_matches(events: DataFrame, path: str, match: str = "matchId", replace: bool = False, together: int = 1) -> None:
    """Add to the Parquet store at `path`, a folder a match, the matches that aren't there yet; the others' files stay as
    they are, so loading a feed twice changes nothing. With `replace`, the feed's matches take the place of those there.

    A file a match costs more than its rows where there are many small matches. With `together`, a folder (column
    `<match>_by<together>`) holds the matches whose numbers have the same quotient by it, in a file a load; `replace` then
    writes the folders of the feed's matches anew. A store keeps the layout that it began with: another one is refused.

    Events without a match can't be told from those of a later load: they are refused."""
    spark = events.sparkSession
    if not events.where(F.col(match).isNull()).isEmpty():
        raise ValueError(f"events without {match}")
    folder = match if together == 1 else f"{match}_by{together}"
    there = _folders(spark, path)
    if there not in (None, folder):
        raise ValueError(f"the folders of {path} are by {there}, not by {folder}")
    in_folder = {} if together == 1 else {folder: F.expr(f"`{match}` div {together}")}
    new = events.withColumns(in_folder)
    if there and not replace:
        new = new.join(spark.read.parquet(path).select(match).distinct(), match, "left_anti")
    if there and replace and together > 1:
        stored = spark.read.parquet(path).withColumns(in_folder)
        kept = stored.join(new.select(folder).distinct(), folder, "left_semi").join(new.select(match).distinct(), match, "left_anti")
        new = new.unionByName(kept, allowMissingColumns=True)
    # a folder goes to one task, and so a match into one file
    dealt = new.repartition(folder)
    mode = "append" if together > 1 and not replace else "overwrite"
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(folder).parquet(path)


def store_by_match(events: DataFrame, table: str, buckets: int = 64, path: str | None = None, match: str = "match_id", order: str = "seq") -> DataFrame:
    """Write `events` as a table bucketed by match, a file a bucket, rows of a match in order, and read it: windows and
    groupings within a match need no exchange over it. Choose `buckets` so that a bucket fits a task."""
    writer = events.repartition(buckets, match).sortWithinPartitions(match, order).write.mode("overwrite").bucketBy(buckets, match)
    if isinstance(events.schema[order].dataType, T.AtomicType):
        writer = writer.sortBy(match, order)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return events.sparkSession.table(table)
