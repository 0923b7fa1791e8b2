"""What Python workers keep from task to task.

Spark reuses a worker for tasks of different operators. What one of them keeps for its next task (a vocabulary, the
words it has encoded) is let go when a task of another begins there, so a chain of stages holds one's at a time.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_kept: dict[str, Callable[[], None]] = {}


def turn(operator: str, free: Callable[[], None] | None = None) -> None:
    """A task of ``operator`` begins in this worker; ``free`` lets go of what it will keep."""
    others = [k for k in _kept if k != operator]
    for k in others:
        _kept.pop(k)()
    if free:
        _kept[operator] = free
    if others:
        give_back()


def give_back() -> None:
    """Return free memory to the system, where allocators can do so."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
