"""State that outlives a task in a reused Python worker.

The library's functions travel to the workers by value, so their module globals start afresh with
each task. Loaded tokenizers and tables of known words are kept under a name of their own instead.
A worker that is lost or not reused just builds them again.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")


class Numbers(dict):
    """word or piece -> number, in the order they are met."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def per_worker(key: Hashable, make: Callable[[], T], slot: str | None = None) -> T:
    """The value made first for ``key`` in this process.

    A slot holds one value: asking for another key of the same slot lets go of the last one, so
    large tables do not pile up over the stages and runs that share a worker.
    """
    held = sys.modules.setdefault("_bellwire_worker_state", types.ModuleType("_bellwire_worker_state")).__dict__
    slot = slot or str(key)
    if slot not in held or held[slot][0] != key:
        held.pop(slot, None)
        held[slot] = (key, make())
    return held[slot][1]


def lean(out: Iterator[T], *stale: str) -> Iterator[T]:
    """``out``; before it the values of the ``stale`` slots go, after it free memory goes back to the system.

    A worker waits for more tasks while other stages run, and keeps what its allocators hold until then.
    """
    held = sys.modules.setdefault("_bellwire_worker_state", types.ModuleType("_bellwire_worker_state")).__dict__
    for slot in stale:
        held.pop(slot, None)
    yield from out
    pa.default_memory_pool().release_unused()
    # Only glibc has it; elsewhere memory goes back as the allocator likes.
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)
