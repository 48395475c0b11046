"""Helpers shared by the training-data operators: shared storage, text columns, Arrow slices."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import _LIMIT as BATCH_LIMIT
from ..ship import BATCH_BYTES, ship
from ..storage import Stash, shared_dir  # noqa: F401  the operators take them from here

T = TypeVar("T")

#: The white space that separates words in the contracts: space and \t to \r.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


#: What a worker process keeps between tasks, by name: vocabularies and their caches.
_kept: dict[str, object] = {}


def resource(name: str, make: Callable[[], T]) -> T:
    """What make() returns, made once and kept until a task that does not use it runs in this process."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def only(uses: str) -> None:
    """Drops all resources but the one named."""
    for name in [n for n in _kept if n != uses]:
        del _kept[name]


def in_arrow(df: DataFrame, f, schema, uses: str = "") -> DataFrame:
    """df.mapInArrow, with this package sent to the executors.

    A worker process serves many tasks. One that does not use a resource drops it, so that no stage pays for the
    vocabulary of another; freed memory goes back to the system.
    """
    ship(df.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(uses)
        release_memory()
        yield from f(batches)
        release_memory()

    return df.mapInArrow(tidy, schema)


def small_batches(spark: SparkSession, most_bytes: int = 1 << 20) -> None:
    """Arrow batches of a chain of stages: smaller than those of a single query, for what each stage leaves behind adds up. A limit set for the session holds."""
    if spark.conf.get(BATCH_LIMIT, None) in (None, str(BATCH_BYTES)):
        spark.conf.set(BATCH_LIMIT, str(most_bytes))


def release_memory() -> None:
    """Hands freed memory back to the system: workers are kept, and what one task used should not count against the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def free_name(df: DataFrame, want: str) -> str:
    """A column name that df does not have, so that extra columns cannot clash."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want += "_"
    return want


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about most_bytes of text each (one longer text stands alone)."""
    import numpy as np
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
