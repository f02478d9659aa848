"""What a Python worker keeps between tasks: the caches of one operator at a time.

Workers outlive their tasks. Freed memory is given back when a task starts and ends, so that
a worker's size follows what it holds and not the largest task it ever ran.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_kept: dict[tuple[str, str], Any] = {}


def release() -> None:
    """Give freed memory back to the system, where its allocator offers that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def start(owner: str) -> None:
    """Begin a task of ``owner``: what tasks of other operators kept is let go."""
    others = [k for k in _kept if k[0] != owner]
    for k in others:
        del _kept[k]
    release()


def kept(owner: str, name: str, make: Callable[[], Any]) -> Any:
    """The value ``name`` of ``owner``, made once while its tasks follow each other."""
    if any(k[0] != owner for k in _kept):
        start(owner)
    if (owner, name) not in _kept:
        _kept[owner, name] = make()
    return _kept[owner, name]


def tidy(owner: str):
    """Decorate a function from batches to batches that runs in the tasks of ``owner``."""

    def decorate(run):
        @functools.wraps(run)
        def wrapped(batches):
            start(owner)
            try:
                yield from run(batches)
            finally:
                release()

        return wrapped

    return decorate
