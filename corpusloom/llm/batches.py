"""Memory of Python workers: slices of Arrow batches, so that few texts are Python strings at once, and what tasks leave."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTES = 1 << 20


def parts(b: pa.RecordBatch, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of b whose texts have at most `most` bytes together, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield b.slice(at, to - at)
        at = to


def lean(run: Callable) -> Callable:
    """run, a function of mapInArrow, that gives what it freed back to the system at its end: workers are used again, by other stages too."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped
