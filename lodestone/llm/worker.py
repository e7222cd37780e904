"""What a Python worker remembers from task to task."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from functools import wraps
from types import ModuleType

import pyarrow as pa


def give_back() -> None:
    """What is free in this Python process goes back to the system; the allocators keep it otherwise, also in workers that idle."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def memory_of(owner: str) -> dict:
    """The memory of one owner in this Python process; what the process kept for another owner is let go.

    Workers are used again by later stages, so that what they remember must not add up. This package
    travels inside the task closure, so its own globals are new for every task.
    """
    kept = sys.modules.setdefault("_lodestone_worker", ModuleType("_lodestone_worker")).__dict__
    if kept.get("owner") != owner:
        kept["owner"], kept["memory"] = owner, {}
        gc.collect()
        give_back()
    return kept["memory"]


def tidy(owner: str) -> Callable:
    """For functions of `mapInArrow`: a task begins without what other owners kept in its worker, and leaves nothing free behind."""

    def decorate(task: Callable) -> Callable:
        @wraps(task)
        def run(batches: Iterator[pa.RecordBatch], *args, **options) -> Iterator[pa.RecordBatch]:
            memory_of(owner)
            yield from task(batches, *args, **options)
            give_back()

        return run

    return decorate
