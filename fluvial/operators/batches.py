"""Arrow batches of rows with list columns as padded matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

def padded(column: pa.Array, fill: float, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A list column as a matrix, which of its places are there, and the lists' lengths."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    there = np.arange(max(1, size.max(initial=0))) < size[:, None]
    out = np.full(there.shape, fill, kind)
    out[there] = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return out, there, size


def parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of sections (p1, p2) whose two matrices have ``most`` places together (one row at least)."""
    for batch in batches:
        longest = max((pc.max(pc.list_value_length(batch.column(p))).as_py() or 1 for p in ("p1", "p2")), default=1) if batch.num_rows else 1
        size = max(1, most // (2 * longest))
        for a in range(0, batch.num_rows, size):
            yield batch.slice(a, size)


def kinds(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
