"""What a Python worker keeps from task to task.

Spark reuses workers, so what one operator leaves in them counts while the next one runs: tables of words or
tokens, and freed memory that the allocators of Arrow and C hold back.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa

_kept: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """This worker's object of the key, for all its tasks until another key is asked for: a worker keeps one at a time."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Gives freed memory back to the system, where the allocators can do so."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a mapInArrow, which gives freed memory back when its task ends."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return task
