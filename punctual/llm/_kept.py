"""What a Python worker keeps between tasks.

A worker serves every operator in turn for as long as the application runs, so
tables that one of them keeps would add to the memory of all later ones.  They
are kept for one operator at a time.
"""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

_VALUES: dict = {}


def kept(key, make):
    """The value made for ``key``, from an earlier task of this worker if nothing else was kept since."""
    if key not in _VALUES:
        release()
        _VALUES[key] = make()
    return _VALUES[key]


def release() -> None:
    """Gives back what earlier tasks of this worker kept."""
    if not _VALUES:
        return
    _VALUES.clear()
    gc.collect()  # states of a machine point at each other
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc
