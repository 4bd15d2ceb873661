"""What the operators share: the cluster's shared folder, and Arrow batches cut to a bounded size."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one call of a batch function gets, unless a single row is longer.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the context's own; without either there is nowhere that all machines see."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        # One machine, so its own folder is shared.
        there = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(there)
    return there


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: lineage is cut and a lost executor loses nothing."""
    path = stored_path(df.sparkSession, name)
    df.write.options(**(options or {"compression": "zstd"})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table of :func:`stored` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def released(spark: SparkSession) -> None:
    """Lets go of the shuffle files of queries that are done, which otherwise stay until the driver happens to collect garbage."""
    for _ in range(2):  # what the first round lets go of holds the shuffles, which the second finds; they go in a thread of their own
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def extended(df: DataFrame, **more: str) -> T.StructType:
    """The schema of ``df`` with columns added."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in more.items())).fields])


def ddl(df: DataFrame, column: str) -> str:
    """The type of a column as a schema string has it, with names of fields quoted."""

    def of(kind: T.DataType) -> str:
        if isinstance(kind, T.StructType):
            return f"struct<{','.join(f'`{f.name}`:{of(f.dataType)}' for f in kind.fields)}>"
        if isinstance(kind, T.ArrayType):
            return f"array<{of(kind.elementType)}>"
        if isinstance(kind, T.MapType):
            return f"map<{of(kind.keyType)},{of(kind.valueType)}>"
        return kind.simpleString()

    return of(df.schema[column].dataType)


def trimmed() -> None:
    """Gives back what this process has freed: a Python worker outlives its task, and idle ones count to their executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def cut(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` whose ``column`` holds about ``most`` bytes each; every row is in one of them."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64) // most
    edges = np.concatenate([[0], np.flatnonzero(np.diff(ends)) + 1, [batch.num_rows]]).tolist()
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def map_text(df: DataFrame, key: str, text: str, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str, most: int = SLICE_BYTES, more: tuple[Column, ...] = ()) -> DataFrame:
    """``fn`` over slices with the two columns ``key`` and ``text``, and ``more``, whatever else ``df`` carries."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, "text", most):
                yield from fn(part)
        trimmed()

    return df.select(F.col(key).alias("key"), F.col(text).alias("text"), *more).mapInArrow(run, schema)
