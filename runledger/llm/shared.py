"""What the operators of this folder share: the cluster's shared folder and table reading."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import shared_dir

#: Rows and bytes in one Arrow batch handed to Python.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20
#: Keys or ids that are broadcast to filter rows (16 bytes each, so 16 MB); the words of the bitmap that filters for more (16 MB in bits).
BROADCAST_KEYS, FILTER_WORDS = 1_000_000, 1 << 21
#: A key of more rows than this is not shuffled by itself; the salts that its rows are spread over where it must be.
HOT, SALTS = 2_048, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of this session's Arrow batches from here on, where they may be larger, so that executors
    and Python workers hold few long texts at once. A text that is longer by itself is a batch of its own."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f over batches; at the end of a task its Python worker, which lives on for other tasks, gives back what f's caches and batches took."""

    @functools.wraps(f)
    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return run


class Workspace:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if _scopes:
            _scopes[-1].append(self)

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables that no DataFrame in use reads; without names, all of them."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for folder in [f"{self.root}/{name}" for name in names] or [self.root]:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


_scopes: list[list[Workspace]] = []


@contextmanager
def temporary() -> Iterator[None]:
    """Drops the workspaces made inside the block when it ends: results must have been written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for work in _scopes.pop():
            work.drop()


def small(df: DataFrame, most: int) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, which its caller knows the width of; else df as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str], count: str = "n") -> DataFrame:
    """rows joined with keys (one row per key, with the number of its rows in a column that is dropped).

    Keys of more than HOT rows are broadcast, so that none of them fills one task of the shuffle that joins the others;
    there can be no more of them than rows / HOT. Beyond BROADCAST_KEYS of them one shuffle joins all, and
    adaptive execution splits the skewed partitions.
    """
    hot = keys.where(F.col(count) > HOT)
    n_hot = hot.limit(BROADCAST_KEYS + 1).count()
    if n_hot == 0 or n_hot > BROADCAST_KEYS:
        return rows.join(keys.drop(count), on)
    hot = F.broadcast(hot.drop(count))
    cold = rows.join(hot.select(*on), on, "left_anti").join(keys.where(F.col(count) <= HOT).drop(count), on)
    return rows.join(hot, on).unionByName(cold)


def among(df: DataFrame, column: str, keys: DataFrame, most: int | None = None) -> DataFrame:
    """The rows of df whose column is in keys (one column of that name, distinct).

    Up to `most` keys are broadcast. More are first hashed into a bitmap of at most FILTER_WORDS words, which is
    broadcast and drops most other rows of df where they are read; only what passes is joined by a shuffle.
    """
    n = keys.count()
    if n <= (BROADCAST_KEYS if most is None else most):
        return df.join(F.broadcast(keys), column, "left_semi")
    words = max(1, min(FILTER_WORDS, n // 4))
    h = F.xxhash64(F.lit(41), column)
    word, mark = F.pmod(h, F.lit(words)), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))
    bitmap = keys.groupBy(word.alias("_word")).agg(F.bit_or(mark).alias("_marks"))
    maybe = df.join(F.broadcast(bitmap), (word == F.col("_word")) & (mark.bitwiseAND(F.col("_marks")) != 0), "left_semi")
    return maybe.join(keys, column, "left_semi")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 0 modulo 5; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
