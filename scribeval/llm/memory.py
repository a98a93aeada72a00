"""Giving memory back between pieces of work.

Python workers live on from task to task.  The C allocator keeps what large
arrays have left behind, so a worker would hold its highest mark for good and
several kinds of work would add up in one executor.
"""

from __future__ import annotations

import ctypes
import time

import pyarrow as pa

EVERY_S = 0.3
_last = 0.0

try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def release(now: bool = False) -> None:
    """Hand free memory back to the system, at most every EVERY_S seconds."""
    global _last
    at = time.monotonic()
    if now or at - _last >= EVERY_S:
        _last = at
        pa.default_memory_pool().release_unused()
        if _trim is not None:
            _trim(0)
