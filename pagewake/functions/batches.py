"""Arrow batches in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a worker takes in hand at a time; a longer text stands alone.
PIECE = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: int, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of the batches in order, each of about `size` bytes of the text column, one row at least.

    A batch of Spark's holds up to 64 MB; what is made of it at once should not be several times that.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes, dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist(), len(batch)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if end > start:
                yield batch.slice(start, end - start)
