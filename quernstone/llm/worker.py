"""What a Python worker keeps between tasks. Workers are used again, also by other operators, so there is one slot: when
another operator begins, what the one before kept is dropped and its memory goes back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_SLOT: dict[str, Any] = {}


def keep(owner: str, make: Callable[[], Any]) -> Any:
    """The owner's object, made if it isn't there; nobody else's stays."""
    if owner not in _SLOT:
        release()
        _SLOT[owner] = make()
    return _SLOT[owner]


def release() -> None:
    """Called where an operator that keeps nothing begins. What was freed goes back to the system, not to a later task of
    this process only: the allocators would hold on to hundreds of MB beside the executor's own heap."""
    _SLOT.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)
