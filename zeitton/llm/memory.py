"""Memory of Python workers, which Spark keeps for later tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def release() -> None:
    """Hand memory back that is free, but kept by the allocators of Arrow and of the C library, where it has such a call."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """For functions over the batches of a task: when the last one is done, free memory goes back to the system.

    Else a worker holds on to the most that one of its tasks needed, idle ones too, beside the tasks that follow.
    """

    @wraps(function)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            release()

    return run
