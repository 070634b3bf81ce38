"""Vectors as integers, for operators whose results are exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Components are under 2^25 in size, so that sums of squares, and of components over 2^37 rows, are exact in 64 bits.
LARGEST = 1 << 25
#: Below this, products of matrices of doubles are exact up to 512 components.
_EXACT = 1 << 21


def integers(table: DataFrame, scale: int, vector: str, *others: str) -> DataFrame:
    """The other columns and x array<long>, floor(scale * component), of rows whose vector is not null and not empty, nor holds null or a number that is not finite."""
    held = table.select(*others, F.col(vector).cast("array<double>").alias("v"))
    fine = held.where("v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity'))")
    return fine.select(*others, F.expr(f"transform(v, x -> floor(x * {scale}D))").alias("x"))


def checked(x: np.ndarray) -> np.ndarray:
    """x; components of LARGEST or more are an error."""
    if x.size and (x.max() >= LARGEST or x.min() <= -LARGEST):
        raise ValueError("a component is too large")
    return x


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of longs, all of one length, as a matrix."""
    return checked(np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(column), -1))


def binaries(rows: np.ndarray) -> pa.Array:
    """One binary value for each row."""
    data = np.ascontiguousarray(rows)
    return pa.array([r.tobytes() for r in data], pa.binary())


def from_binaries(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The exact squared distance of each row of x from each row of c."""
    if x.shape[1] <= 512 and max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < _EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1) if len(c) else np.zeros((len(x), 0), np.int64)


def up(x: np.ndarray) -> np.ndarray:
    """Above x by more than its rounding error."""
    return x * (1 + 1e-12) + 1e-12


def down(x: np.ndarray) -> np.ndarray:
    """Below x by more than its rounding error, and not below 0."""
    return np.maximum(x * (1 - 1e-12) - 1e-12, 0)


def floats_below(x: np.ndarray) -> np.ndarray:
    """The largest 32-bit numbers that are not above x, at least 0."""
    y = np.minimum(x, np.finfo(np.float32).max).astype(np.float32)
    return np.maximum(np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y), np.float32(0))
