"""Helpers that the training-data operators share: size-checked broadcasts, the tables; and, from ``pixelmill.tables``, the
cluster's shared folder and lineage cuts."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..tables import cut, local_path, make_dirs, new_path, read_bytes, remove, scope, shared_dir, write_bytes

__all__ = ["cut", "lean", "local_path", "make_dirs", "new_path", "read_bytes", "remove", "scope", "shared_dir", "small", "table", "write_bytes"]

#: Most rows (of a few dozen bytes each) that a join side may have to be broadcast, and most bytes where rows' sizes are
#: told; beyond it the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def small(df: DataFrame, weight: str | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``BROADCAST_ROWS`` rows (or ``BROADCAST_BYTES`` by its column
    ``weight``), else as it is (the join then shuffles).

    ``df`` must be cheap to count: a table that was cut, or a scan; files are counted by their footers.
    """
    fits = df.count() <= BROADCAST_ROWS if weight is None else df.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0] <= BROADCAST_BYTES
    return F.broadcast(df) if fits else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task for ``mapInArrow`` that gives freed memory back to the system at its end: workers live on and take other
    tasks, and would hold what the largest one needed."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            import ctypes

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
            if trim:
                trim(0)

    return run
