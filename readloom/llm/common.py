"""Shared pieces: staged tables, Arrow access to texts, row identity."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in slices of about this many bytes, whatever Arrow batch they arrive in.
SLICE_BYTES = 1 << 20
#: Stands for a null id inside an operator: it sorts before every other id.
NULL_ID = -(2**63)


def stage_root(spark: SparkSession) -> str:
    """The shared folder for staged tables: spark.checkpoint.dir, or in local mode a folder of this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark.sparkContext, "_readloom_stage", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="readloom-")
        spark.sparkContext._readloom_stage = own
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/readloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast(spark: SparkSession, value):
    """A function for the executors that gives the value. It is sent by value, classes included."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)


def id_key(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as make it new to df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets, without making Python strings. Nulls have no bytes."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:
        lengths = np.diff(at) * column.is_valid().to_numpy(zero_copy_only=False)
        if lengths.sum() != at[-1] - at[0]:
            raw = np.concatenate([raw[a : a + k] for a, k in zip(at[:-1], lengths)] or [raw[:0]])
            return raw, np.concatenate([[0], np.cumsum(lengths)])
    return raw[at[0] : at[-1]], at - at[0]


def give_back() -> None:
    """Free memory goes back to the system at the end of a task: a worker process lives on and shares its executor's limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of at most `limit` bytes of text; one longer text is a piece of its own."""
    for batch in batches:
        _, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
            yield batch.slice(i, min(j, n) - i)
            i = j
    give_back()


def col_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
