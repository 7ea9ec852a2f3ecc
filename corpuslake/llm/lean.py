"""Python workers that give their memory back.

Workers are used again by later tasks, of any stage. What a task kept in module
globals (memos, tables of powers) and what the allocators hold for it would stay
until the session ends, so that each stage's peak adds to those of stages before.
``lean`` wraps the function of a mapInArrow: when its task ends, those memos are
emptied and free memory goes back to the system.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from functools import wraps

import pyarrow as pa

_ends: list[Callable[[], None]] = []


def at_end(function: Callable[[], None]) -> Callable[[], None]:
    """Call ``function`` whenever a lean task of this worker ends."""
    _ends.append(function)
    return function


def release() -> None:
    for f in _ends:
        f()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run):
    """A function of batches whose task leaves nothing behind in its worker."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
