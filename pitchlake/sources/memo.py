"""Results kept between queries: by name, parameters and the versions of the files they came from."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def file_versions(spark: SparkSession, paths: Sequence[str]) -> tuple[tuple[str, int, int], ...]:
    """(file, bytes, time of change) of all files below `paths`, in any store that Spark reads. No job runs."""
    out = []
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(conf)
        files = fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


class Memo:
    """At most `most` results in memory and on disk. A result is computed by the first action on it, and again if its
    parameters or its files are others; the one that wasn't asked for longest leaves first and is freed.

    Unlike a cache by name alone, no parameter is left out of the key, so a stale result is never returned."""

    def __init__(self, spark: SparkSession, most: int = 16) -> None:
        self.spark, self.most = spark, most
        self.kept: OrderedDict[tuple, tuple[tuple, DataFrame]] = OrderedDict()

    def get(self, name: str, build: Callable[..., DataFrame], paths: Sequence[str], **parameters) -> DataFrame:
        """`build(**parameters)`, which reads `paths`, or what it returned before."""
        key = (name, json.dumps(parameters, sort_keys=True, default=repr))
        versions = file_versions(self.spark, paths)
        if key in self.kept and self.kept[key][0] == versions:
            self.kept.move_to_end(key)
            return self.kept[key][1]
        self.drop(key)
        result = build(**parameters).persist(StorageLevel.MEMORY_AND_DISK)
        self.kept[key] = versions, result
        while len(self.kept) > self.most:
            self.drop(next(iter(self.kept)))
        return result

    def drop(self, key: tuple) -> None:
        if key in self.kept:
            self.kept.pop(key)[1].unpersist(blocking=True)

    def clear(self) -> None:
        for key in list(self.kept):
            self.drop(key)
