"""What several operators share: shared-folder checkpoints and hashing of words in numpy."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python task handles at once, whatever the size of Arrow's batches; a longer text goes alone.
CHUNK_BYTES = 4_000_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the session, spark.checkpoint.dir. Where there is none, a temporary one is set if the session is local; on a
    cluster, whose machines don't share one, that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="voltspan-checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder; survives lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def fresh(spark: SparkSession) -> str:
    """The path of a new table in the shared folder."""
    return f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"


def discard(spark: SparkSession, at: str) -> None:
    """Deletes a table that `fresh` named; what was made from it must have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, tidy: bool = False, codec: str = "snappy", at: str | None = None) -> DataFrame:
    """Cuts the lineage with a table in the shared folder, at a path of `fresh`; its columns are compressed, unlike a checkpoint's
    rows. tidy: the shuffle files of the job that writes it go when it has ended; df is not to be run again."""
    at = at or fresh(df.sparkSession)
    conf, tidies = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(tidies)
    conf.set(tidies, "true" if tidy else before)
    try:
        df.write.option("compression", codec).parquet(at)
    finally:
        conf.set(tidies, before)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: A value that more than one row in so many has is frequent; there are fewer such values than this.
HEAVY = 1000


def join_apart(left: DataFrame, right: DataFrame, on: str, frequent: DataFrame) -> DataFrame:
    """The inner join on a column that right has once each. frequent: the few values (under HEAVY, whatever the input) that many of left's rows have.

    Left rows of frequent values meet a broadcast of right's rows of them where they are, so that no value lands in one task; the
    others are shuffled.
    """
    often = F.broadcast(frequent.select(on))
    return left.join(F.broadcast(right.join(often, on, "left_semi")), on).unionByName(left.join(often, on, "left_anti").join(right, on))


def join_spread(left: DataFrame, right: DataFrame, on: str, total: int) -> DataFrame:
    """join_apart where right has the number n of left's rows with the value; total: of all of them. Column n goes. Only
    values that are frequent pass the driver: the others meet in a merge join, whatever their size."""
    frequent = F.col("n") > total / HEAVY
    rest = left.join(F.broadcast(right.where(frequent).select(on)), on, "left_anti").join(right.where(~frequent).drop("n").hint("merge"), on)
    return left.join(F.broadcast(right.where(frequent).drop("n")), on).unionByName(rest)


def unused(df: DataFrame, name: str) -> str:
    """A name like `name` that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def chunks(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Slices of consecutive rows of about `limit` bytes together."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def lists(values: list[np.ndarray]) -> pa.ListArray:
    """An array of lists of 64-bit numbers; the numbers are copied once."""
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *values])))


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def give_back() -> None:
    """Returns freed memory to the system: a Python worker stays for a while when its task has ended, beside the tasks of the next stage."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def struct(**fields: str) -> T.StructType:
    """A struct type from names and simple type names; needs no session, so that a module can use it while it is imported."""
    kinds = {"string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType()}
    return T.StructType([T.StructField(k, kinds[v]) for k, v in fields.items()])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one positions of the runs of bytes that aren't white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word data[start:end]: a sum of random byte values by powers of an odd base, mixed."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power = powers(_BASE, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power, out=total[1:])
    inverse = powers(np.uint64(pow(int(_BASE), -1, 2**64)), len(data))
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` consecutive word hashes (none if there are fewer)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64(0xD6E8FEB86659FD93)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(base, len(words)), out=total[1:])
    inverse = powers(np.uint64(pow(int(base), -1, 2**64)), n)
    return mix((total[width:] - total[:n]) * inverse)
