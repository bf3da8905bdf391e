"""Whole-volume steps on the array of a scan's row that array lambdas would spend minutes on.

Each is an Arrow function over a batch of rows: a scan stays in its row, Spark bounds a batch in bytes, and nothing is unfolded or
shuffled. Null arrays and null parameters give null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import col

Dims = tuple[int, int, int]
VOXELS = 1 << 16


def _values(c: pa.Array) -> list:
    return [x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in c] if pa.types.is_list(c.type) else c.to_pylist()


def each(fn: Callable, *columns) -> Column:
    """fn of the first column's array and the other columns' values, row by row; null where one of them is."""

    @F.arrow_udf("array<double>")
    def run(boxes: pa.Array, *rest: pa.Array) -> pa.Array:
        out = []
        for v, *x in zip(boxes, *(_values(r) for r in rest), strict=True):
            known = v.is_valid and not any(p is None for p in x)
            out.append(fn(v.values.to_numpy(zero_copy_only=False).astype(float), *x).ravel() if known else None)
        return pa.array(out, pa.list_(pa.float64()))

    return run(*[col(c) for c in columns])


def batched(fn: Callable, dims: Dims, data, *params) -> Column:
    """fn of a stack (rows, *dims) and of the stacked parameters, for rows without a null; at most VOXELS voxels at a time."""
    size = int(np.prod(dims))

    @F.arrow_udf("array<double>")
    def run(boxes: pa.Array, *rest: pa.Array) -> pa.Array:
        values = [_values(r) for r in rest]
        known = [i for i, v in enumerate(boxes) if v.is_valid and not any(x[i] is None for x in values)]
        out: list = [None] * len(boxes)
        step = max(1, VOXELS // size)
        for a in range(0, len(known), step):
            rows = known[a : a + step]
            stack = boxes.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), *dims)
            for i, x in zip(rows, fn(stack, *(np.array([v[i] for i in rows]) for v in values)), strict=True):
                out[i] = x.ravel()
        return pa.array(out, pa.list_(pa.float64()))

    return run(*[col(c) for c in (data, *params)])


def trilinear(v: np.ndarray, points: list[np.ndarray], border: str = "zero") -> np.ndarray:
    """Values of a stack of volumes at three stacks of coordinates; outside is zero or the nearest edge."""
    lows, parts = [], []
    stack = np.arange(len(v))[:, None, None, None]
    for p, n in zip(points, v.shape[1:], strict=True):
        p = np.clip(p, 0, n - 1) if border == "edge" else p
        lows.append(np.floor(p).astype(np.int64))
        parts.append(p - lows[-1])
    out = np.zeros(np.broadcast_shapes(*(p.shape for p in points)))
    for corner in np.ndindex(2, 2, 2):
        w, at = 1.0, []
        for c, low, f, n in zip(corner, lows, parts, v.shape[1:], strict=True):
            k = low + c
            w = w * np.where((k >= 0) & (k < n), f if c else 1 - f, 0.0)
            at.append(np.clip(k, 0, n - 1))
        out += w * v[(stack, *np.broadcast_arrays(*at))]
    return out


def gather_box(data, dims: Dims, matrix: list[Column], out_dims: Dims | None = None, border: str = "zero") -> Column:
    """Trilinear resampling: output voxel (x, y, z) reads the source point A (x, y, z) + b; `matrix` is A|b, row by row, 12 columns or numbers."""
    size = out_dims or dims

    def read(v: np.ndarray, m: np.ndarray) -> np.ndarray:
        x, y, z = np.ogrid[: size[0], : size[1], : size[2]]
        a = lambda k: m[:, k, None, None, None]
        return trilinear(v, [a(k) * x + a(k + 1) * y + a(k + 2) * z + a(k + 3) for k in (0, 4, 8)], border)

    return batched(read, dims, data, F.array(*[c.cast("double") if isinstance(c, Column) else F.lit(float(c)) for c in matrix]))


def warp_box(data, dims: Dims, theta: list[str], flipped=None, border: str = "zero") -> Column:
    """One geometric map: the volume is mirrored along x where `flipped`, then read through theta (t00 .. t23, rows S-I, A-P, L-R) in
    normalised coordinates."""

    def read(v: np.ndarray, t: np.ndarray, mirrored: np.ndarray) -> np.ndarray:
        n = dict(zip("xyz", dims, strict=True))
        at = dict(zip("xyz", np.ogrid[: dims[0], : dims[1], : dims[2]], strict=True))
        g = {a: (at[a] + 0.5) / n[a] * 2 - 1 for a in "xyz"}
        a = lambda k: t[:, k, None, None, None]
        row = lambda i: a(4 * i) * g["z"] + a(4 * i + 1) * g["y"] + a(4 * i + 2) * g["x"] + a(4 * i + 3)
        back = lambda s, a: ((s + 1) * n[a] - 1) / 2
        x = back(row(2), "x")
        return trilinear(v, [np.where(mirrored[:, None, None, None], dims[0] - 1 - x, x), back(row(1), "y"), back(row(0), "z")], border)

    return batched(read, dims, data, F.array(*[F.col(c) for c in theta]), F.lit(False) if flipped is None else flipped)


def linear_weights(n: int, m: int) -> np.ndarray:
    """(m, n): linear interpolation of n samples at m, grids sharing their outer edges, end samples held."""
    p = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    low = np.floor(p).astype(int)
    out = np.zeros((m, n))
    np.add.at(out, (np.arange(m), low), 1 - (p - low))
    np.add.at(out, (np.arange(m), np.minimum(low + 1, n - 1)), p - low)
    return out


def degrade_box(data, dims: Dims, sizes) -> Column:
    """Each axis down to sizes[axis] samples and back: the loss of a coarser grid. sizes is an array column."""

    def lose(v: np.ndarray, small: list[int]) -> np.ndarray:
        v = v.reshape(dims)
        for a, (n, m) in enumerate(zip(dims, small, strict=True)):
            v = np.moveaxis(np.tensordot(linear_weights(m, n) @ linear_weights(n, m), v, (1, a)), 0, a)
        return v

    return each(lose, data, sizes)
