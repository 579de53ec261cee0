"""Memory that a Python worker keeps between batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import TypeVar

import pyarrow as pa

Batch = TypeVar("Batch")


def give_back() -> None:
    """Return to the system what Arrow's and the C library's allocators hold and nothing uses."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def trimmed(batches: Iterator[Batch]) -> Iterator[Batch]:
    """The same batches; before the next is read, unused memory is given back.

    Workers live on between tasks and stages, several beside one executor;
    what each keeps for later adds up.
    """
    for batch in batches:
        yield batch
        del batch
        give_back()
