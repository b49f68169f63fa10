"""What a Python worker keeps from task to task, and what it gives back.

Spark uses a worker again for other operators. Each operator names the cached tables that it
needs; those that another one left behind are emptied first, and memory that a task no longer
uses goes back to the system when it ends.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

_held: set = set()


def hold(*tables) -> None:
    """tables: functions with a cache (lru_cache) that this worker is to keep from now on."""
    for t in _held - set(tables):
        t.cache_clear()
    _held.clear()
    _held.update(tables)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def task(*tables) -> Callable:
    """Decorates a function from batches to batches, as mapInArrow takes it."""

    def wrap(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
        @wraps(f)
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hold(*tables)
            try:
                yield from f(batches)
            finally:
                give_back()

        return run

    return wrap
