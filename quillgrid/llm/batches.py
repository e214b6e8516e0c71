"""What Python workers hold: small slices of Arrow batches, and one table of things already worked out."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa

SLICE_ROWS = 500
HOLDER = "_quillgrid_worker_holder"


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in order, a few at a time: texts become Python objects slice by slice."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def keep_one(key: Hashable, make: Callable[[], Any]) -> Any:
    """The object of ``key``, kept from task to task of one worker until another key is asked for.

    This module travels with each task and is made anew there, so the object hangs
    on a module of the worker itself. Workers outlive stages: what one operator has
    kept must not stay when the next one runs.
    """
    holder = sys.modules.setdefault(HOLDER, types.ModuleType(HOLDER))
    kept = holder.__dict__.setdefault("kept", {})
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def keep_none() -> None:
    """Give up what the worker has kept, before work that needs the memory."""
    holder = sys.modules.get(HOLDER)
    if holder is not None:
        holder.__dict__.pop("kept", None)
