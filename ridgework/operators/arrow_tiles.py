"""Moving tile rows between Arrow batches and numpy blocks inside a task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

# Cells handled at once by a kernel; keeps its temporaries near 32 MB each.
CELLS_AT_ONCE = 1 << 22


def slices(batches: Iterable[pa.RecordBatch], cells_per_tile: int) -> Iterator[pa.RecordBatch]:
    """Cut incoming batches so that no kernel call sees more than ``CELLS_AT_ONCE`` cells."""
    step = max(CELLS_AT_ONCE // cells_per_tile, 1)
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def numbers(values: pa.Array) -> np.ndarray:
    """A numeric Arrow array as numpy; NULL doubles turn into NaN."""
    return values.to_numpy(zero_copy_only=False)


def tile_block(batch: pa.RecordBatch, tile_size: int, name: str = "cells") -> np.ndarray:
    """The cells of all tiles in a batch, shaped (tile, row, column), NoData as NaN."""
    flat = numbers(column(batch, name).flatten())
    return flat.reshape(batch.num_rows, tile_size, tile_size)


def list_array(block: np.ndarray) -> pa.Array:
    """One list per leading index of ``block``; NaN turns into NULL."""
    count = block.shape[0]
    width = block.size // count if count else 0
    values = pa.array(np.ascontiguousarray(block, dtype=np.float64).ravel(), from_pandas=True)
    offsets = pa.array(np.arange(count + 1, dtype=np.int32) * np.int32(width))
    return pa.ListArray.from_arrays(offsets, values)


def tile_batch(batch: pa.RecordBatch, block: np.ndarray) -> pa.RecordBatch:
    """Tile rows with the keys of ``batch`` and new cells."""
    return pa.RecordBatch.from_arrays(
        [column(batch, "col"), column(batch, "row"), list_array(block)], ["col", "row", "cells"]
    )


def members(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For a list array: the row each element belongs to, and the elements themselves."""
    lengths = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(values)), lengths), values.flatten()
