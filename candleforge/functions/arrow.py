"""Arrow columns of lists as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def lists(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """The rows of a column of lists; a missing number is not a number."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return [row for part in parts if len(part) for row in np.split(part.flatten().to_numpy(zero_copy_only=False), np.cumsum(part.value_lengths().to_numpy())[:-1])]
