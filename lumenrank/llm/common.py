"""What the operators share: the shared folder, written tables, and small Arrow helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folder import new_path, shared_dir  # noqa: F401

#: Bytes of text that a Python worker takes at a time, whatever the size of an Arrow batch.
SLICE_BYTES = 4 << 20


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends there and an executor's loss costs nothing before it."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id's text divides by 5 are never learned from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def release() -> None:
    """Gives freed memory back to the system; Python workers wait for later tasks and would keep it beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that ``column`` holds about ``limit`` bytes in each, or one row if that is longer. Freed memory is given back before the first, when
    what the worker's last task held is gone at last, and after the last."""
    release()
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start, done = 0, 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(start, end - start)
            start, done = end, int(size[end - 1])
    batch = size = None
    release()


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (last: intercept) of a ridge-penalised logistic fit by damped Newton steps."""
    a = np.column_stack([x, np.ones(len(y))])
    beta = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6

    def loss(b: np.ndarray) -> float:
        z = a @ b
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + (penalty * b * b).sum() / 2)

    now = loss(beta)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -500, 500)))
        grad = a.T @ (w * (p - y)) + penalty * beta
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9)
        step, t = np.linalg.solve(hess, grad), 1.0
        while t > 1e-4 and loss(beta - t * step) > now:
            t /= 2
        beta = beta - t * step
        was, now = now, loss(beta)
        if was - now < 1e-9:
            break
    return beta


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))
