"""Vector columns of Arrow batches as numpy matrices."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector in a list<double> column, without the rows that are null or empty or
    hold null or non-finite entries."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    broken = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    length = np.diff(offsets)
    good = (broken[offsets[1:]] == broken[offsets[:-1]]) & (length > 0) & column.is_valid().to_numpy(zero_copy_only=False)
    for n in np.unique(length[good]):
        rows = np.flatnonzero(good & (length == n))
        yield rows, flat[offsets[rows][:, None] + np.arange(n)] + 0.0   # a negative zero becomes zero


def digest(data: bytes) -> bytes:
    """Key of equal vectors."""
    return hashlib.blake2b(data, digest_size=16).digest()


def stacked(raw: list[bytes]) -> np.ndarray:
    """Vectors of one length from their bytes."""
    return np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)
