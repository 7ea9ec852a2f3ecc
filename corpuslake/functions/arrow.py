"""Python workers that give their memory back when a task ends; workers live on, and so would what their allocators keep."""

from __future__ import annotations

import ctypes
import gc
from functools import wraps

import pyarrow as pa


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """A function of batches that leaves nothing behind in its worker."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
