"""What several operators share: the shared folder, written intermediate tables, table access, names that can't clash."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneforge.plans.storage import shared_dir, table, written

__all__ = ["cached", "guarded", "parts", "shared_dir", "table", "using", "written"]

_caches: dict[str, Callable[[], None]] = {}


def cached(owner: str, clear: Callable[[], None]) -> None:
    """Tells how a Python worker forgets what `owner` keeps from task to task."""
    _caches[owner] = clear


_last = [""]


def using(owner: str) -> None:
    """At the beginning of a task: workers serve one operator after another, keep only the last one's caches, and give memory back when it changes."""
    if _last[0] == owner:
        return
    _last[0] = owner
    for name, clear in _caches.items():
        if name != owner:
            clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def parts(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` bytes, so that what goes back to Spark comes in small pieces too."""
    for batch in batches:
        rows = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def guarded(docs: DataFrame, needed: Sequence[str], f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """f(docs) with all columns of docs but the needed ones under names that clash with nothing, and afterwards the columns of docs alone, under their own names."""
    names = {c: c if c in needed else f"_kept_{k}" for k, c in enumerate(docs.columns)}
    out = f(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])
