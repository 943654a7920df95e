"""Shared scratch tables: what a job must not lose with an executor is written where all machines can read it."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Rows that go to a Python worker at once; bounds its memory when texts are long.
BATCH_ROWS = 256
#: A bitmap has 16 bits or more for each value, but at least 2**LEAST_BITS and at most 2**MOST_BITS bits; a value that
#: shares a bit with another only costs work.
LEAST_BITS, MOST_BITS = 20, 30
_own: dict[str, str] = {}
#: Folders of scratch tables, oldest first.
_roots: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder that the session names; one of our own only where none is set and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local["):
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="tidemark-")
        return _own[app]
    raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which its worker gives back the memory that it doesn't use. Workers are kept for later tasks, beside
    those of other steps."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # only some C libraries have it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


class Scratch:
    """Tables of one run under the shared folder.

    ``save`` writes a DataFrame as Parquet and returns it as read back, with its lineage cut; ``drop`` deletes the
    tables that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        ship(spark)
        self.spark = spark
        self.root = f"{shared_root(spark).rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        # a step's shuffle files go when it is over, and don't pile up until the driver collects its garbage
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")

        _roots.append(self.root)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(table))
        return self.load(table, df)

    def load(self, table: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.path(table))
            path.getFileSystem(conf).delete(path, True)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of steps that are over: it does so when its driver collects garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def mark() -> int:
    """A point in time, for ``sweep``."""
    return len(_roots)


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Deletes the scratch tables that were begun since that mark. Nothing that is yet to be read may come from them."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for root in _roots[since:]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(conf).delete(path, True)
    del _roots[since:]


def _hashes(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashes(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashes(f.dataType) for f in kind.fields)
    return not isinstance(kind, T.MapType | T.VariantType)


def row_key(docs: DataFrame) -> Column:
    """A row's hash, of the values of all columns that have a hash: maps have none, so rows that differ only in them share
    it."""
    cols = [F.col(f"`{f.name}`") for f in docs.schema.fields if _hashes(f.dataType)]
    # a hash passes over nulls, so where they are is hashed too
    return F.xxhash64(F.array(*(c.isNull() for c in cols)), *cols)


class Bitmap:
    """Places of 64-bit values by their leading bits."""

    def __init__(self, words: np.ndarray, bits: int) -> None:
        self.words, self.bits = words, bits

    @classmethod
    def of(cls, values: DataFrame) -> Bitmap:
        """Of values' one column. What comes to the driver is at most 2**bits / 64 words."""
        h = values.columns[0]
        bits = min(MOST_BITS, max(LEAST_BITS, (16 * values.count()).bit_length()))
        place = F.shiftrightunsigned(h, 64 - bits)
        rows = values.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned({h}, {64 - bits}), 64) as int))").alias("b"))
        got = rows.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        out = np.zeros(1 << (bits - 6), dtype=np.uint64)
        out[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
        return cls(out, bits)

    def has(self, values: np.ndarray) -> np.ndarray:
        place = values >> np.uint64(64 - self.bits)
        return (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0
