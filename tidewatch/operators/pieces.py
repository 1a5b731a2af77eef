"""Arrow batches in pieces of bounded size, for work whose arrays follow the elements of a list."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ELEMENTS = 500_000  # list elements worked on at a time: 4 MB a number array


def pieces(batches: Iterable[pa.RecordBatch], column: str, size: int = ELEMENTS) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in slices whose lists of ``column`` hold about ``size`` elements at most.

    A batch is bounded in rows only, and a row may be a whole book.  A row is never cut: one with
    more elements is a slice of its own.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, end - at)
            at = end
