"""Shared plumbing: reading tables, tables written to the shared folder, batches of text as byte arrays."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a local session (tests) gets one of
    its own, and any other an error, as no folder of one machine is seen by all."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="spark-llm-")
    return _OWN_DIR[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete what `materialize` wrote, once all that reads it is written itself."""
    for df in written:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def tidied(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`task`, and when it has ended, what it freed goes back to the system. Workers stay for the next tasks; what they hold on
    to would be missing beside the JVM, also in stages without Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return run


def most_frequent(counted: DataFrame, most: int, n: str = "n") -> DataFrame:
    """The rows of `counted` with the greatest `n`: all above a threshold that lets `most` rows through at most.

    The threshold comes from a histogram over the leading bits of n, so that no more rows than that ever meet."""
    size = F.length(F.bin(n))
    level = size.cast("long") * 64 + F.call_function("shiftright", F.col(n), F.greatest(size - 6, F.lit(0)))
    left, least = most, None
    for r in sorted(counted.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect(), reverse=True):
        left -= r["rows"]
        if left < 0:
            break
        least = r["level"]
    return counted.where(level >= least) if least is not None else counted.limit(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a batch, end to end, and their n + 1 offsets. Null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents [i, j) with at most `limit` bytes together (one document at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges [start, start + length)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class Rolling:
    """62-bit hashes of any substring in constant time: two polynomials modulo the prime 2**31 - 1 with bases of their own.

    A prime modulus has no strings that cancel out whatever the base is, as those modulo 2**64 have."""

    PRIME, SHIFT = np.uint64(2**31 - 1), np.uint64(31)
    BASES = (1_186_940_521, 1_847_306_993)

    def __init__(self) -> None:
        rng = np.random.default_rng(20240229)
        self.value = rng.integers(1, 2**31 - 1, (2, 256), dtype=np.uint64)
        self.power = self.unpower = np.ones((2, 1), np.uint32)

    def _grow(self, n: int) -> None:
        if self.power.shape[1] < n:
            n = max(n, 1 << 16)
            self.power, self.unpower = (np.stack([self._powers(b if up else pow(b, -1, int(self.PRIME)), n) for b in self.BASES]) for up in (True, False))

    def _powers(self, base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint32)
        k = 1
        while k < n:
            m = min(k, n - k)
            out[k : k + m] = out[:m].astype(np.uint64) * np.uint64(pow(base, k, int(self.PRIME))) % self.PRIME
            k *= 2
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Running sums for `between`; values are bytes, or 64-bit numbers that are well mixed already."""
        n = len(values)
        self._grow(n + 1)
        out = np.zeros((2, n + 1), np.uint64)
        for i in range(2):
            x = self.value[i][values] if values.dtype == np.uint8 else (values >> np.uint64(33 * i)) & self.PRIME
            x = x * self.power[i, :n]
            np.cumsum((x & self.PRIME) + (x >> self.SHIFT), out=out[i, 1:])  # fits for 2**31 values
        return out

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        one, two = ((sums[i][end] - sums[i][start]) % self.PRIME * self.unpower[i][start] % self.PRIME for i in range(2))
        return mix(mix((one << self.SHIFT | two) + np.uint64(1)) + (end - start).astype(np.uint64))


#: One for all that is hashed in a worker, as its tables of powers are as long as the longest text so far.
ROLLING = Rolling()


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))
