"""Reading vector columns from Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def usable(batch: pa.RecordBatch, column: str) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows whose vector is whole (not null, not empty, no null or non-finite component) and their vectors as a matrix.

    All whole vectors of a table must have one length; others are an error.
    """
    lists = batch.column(batch.schema.get_field_index(column))
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()  # null lists give nothing
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes NaN
    bad = np.zeros(len(lengths) + 1, np.int64)
    if len(values):
        owner = np.repeat(np.arange(len(lengths)), lengths)
        np.add.at(bad, owner[~np.isfinite(values)], 1)
    good = (lengths > 0) & (bad[:-1] == 0)
    if not good.any():
        return batch.slice(0, 0), np.zeros((0, 0))
    size = lengths[good][0]
    if (lengths[good] != size).any():
        raise ValueError("vectors of different lengths")
    if good.all():
        return batch, values.reshape(-1, size)
    return batch.filter(pa.array(good)), values[np.repeat(good, lengths)].reshape(-1, size)
