"""Neighbourhood filters as per-axis row frames on dense grids.

Partition the input by `uid` once (`by_scan`): hash(uid) already satisfies windows partitioned by
(uid, other axes), so every later pass sorts locally and nothing moves again. A frame never exceeds one
line of one scan. Frames count rows, so a missing cell would silently widen them; `densify` fills a
sparse grid first and `assert_dense` checks it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.scalars import col
from .boxes import VOXELS, batched
from ..session import cut


SCAN_ROWS = 200_000


def scan_parts(df: DataFrame, each: int = 1) -> int:
    """How many partitions hold about SCAN_ROWS rows each when every row of df (frozen, or cheap to count) unfolds into `each`; at least as many
    as the session shuffles to. A chain of passes keeps a sort of the whole partition open for each, so a partition must not grow with the table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() * each // SCAN_ROWS))


def by_scan(df: DataFrame, parts: int | None = None) -> DataFrame:
    return df.repartition(parts, "uid") if parts else df.repartition("uid")


def densify(df: DataFrame, dims: dict[str, int], value: str = "v", scans: DataFrame | None = None) -> DataFrame:
    """Every cell of every scan's grid, zero where the sparse input has none."""
    base = (scans if scans is not None else df).select("uid").distinct()
    for axis, n in dims.items():
        base = base.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    joined = base.join(df.select("uid", *dims, value), ["uid", *dims], "left")
    return joined.withColumn(value, F.coalesce(value, F.lit(0.0)))


def assert_dense(df: DataFrame, dims: dict[str, int]) -> DataFrame:
    """Raise at run time if a scan does not have exactly one row per cell."""
    want = math.prod(dims.values())
    n = F.count(F.lit(1)).over(Window.partitionBy("uid"))
    checked = df.withColumn("_ok", F.assert_true(n == want, F.lit("grid is not dense")))
    return checked.where(F.col("_ok").isNull()).drop("_ok")


def line(axes: list[str], axis: str, extra: tuple[str, ...] = ()):
    """Window over one line of a scan along `axis`.

    Rows unfolded from arrays arrive in runs that are already sorted by line, which the sort exploits.
    """
    return Window.partitionBy("uid", *extra, *[a for a in axes if a != axis]).orderBy(axis)


def frame(df: DataFrame, axes: list[str], value: str, fn, k: int, extra: tuple[str, ...] = (), only: list[str] | None = None) -> DataFrame:
    """Apply fn (F.min, F.max, F.sum) over a centred window of radius k along each axis in turn."""
    for axis in only or axes:
        df = df.withColumn(value, fn(value).over(line(axes, axis, extra).rowsBetween(-k, k)))
    return df


def frames(df: DataFrame, axes: list[str], filters: dict[str, tuple], extra: tuple[str, ...] = ()) -> DataFrame:
    """Several filters {column: (fn, radius)} in one sort per axis instead of one per filter and axis."""
    for axis in axes:
        keep = [c for c in df.columns if c not in filters]
        w = line(axes, axis, extra)
        df = df.select(*keep, *[fn(c).over(w.rowsBetween(-k, k)).alias(c) for c, (fn, k) in filters.items()])
    return df


def closing(df: DataFrame, axes: list[str], value: str, k: int) -> DataFrame:
    return frame(frame(df, axes, value, F.max, k), axes, value, F.min, k)


def kernel(sigma: float, taps: int | None = None) -> list[float]:
    """Normalised Gaussian weights; 2*floor(3*sigma)+1 taps unless given."""
    n = taps or 2 * int(3 * sigma) + 1
    w = [math.exp(-0.5 * ((i - n // 2) / sigma) ** 2) for i in range(n)]
    s = sum(w)
    return [x / s for x in w]


def smooth(
    df: DataFrame, axes: list[str], value: str, sigma: float, border: str = "zero", taps: int | None = None,
    extra: tuple[str, ...] = (), only: list[str] | None = None, weights: list[Column] | None = None,
) -> DataFrame:
    """Separable Gaussian; outside the grid is zero or the nearest edge. `weights` may be columns."""
    w = weights or [F.lit(c) for c in kernel(sigma, taps)]
    half = len(w) // 2
    for axis in only or axes:
        win = line(axes, axis, extra)
        whole = win.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first = F.first(value).over(whole) if border == "replicate" else F.lit(0.0)
        last = F.last(value).over(whole) if border == "replicate" else F.lit(0.0)
        total: Column = F.lit(0.0)
        for j, c in zip(range(-half, half + 1), w):
            if j < 0:
                cell = F.coalesce(F.lag(value, -j).over(win), first)
            elif j > 0:
                cell = F.coalesce(F.lead(value, j).over(win), last)
            else:
                cell = F.col(value)
            total = total + c * cell
        df = df.withColumn(value, total)
    return df


def convolved(v: np.ndarray, weights: np.ndarray, border: str, axes: tuple[int, ...]) -> np.ndarray:
    """One volume filtered along each of axes in turn; outside is zero or the nearest edge."""
    half = len(weights) // 2
    for a in axes:
        pad = [(half, half) if k == a else (0, 0) for k in range(v.ndim)]
        wide = np.pad(v, pad, mode="edge" if border == "replicate" else "constant")
        n, at = v.shape[a], [slice(None)] * v.ndim
        out = np.zeros(v.shape)
        for k, c in enumerate(weights):
            at[a] = slice(k, k + n)
            out += c * wide[tuple(at)]
        v = out
    return v


def smooth_box(data, dims: tuple[int, ...], sigma, border: str = "zero", taps: int | None = None, only: tuple[int, ...] | None = None) -> Column:
    """Separable Gaussian of a volume (or image) in its row-major array: nothing is unfolded, sorted or moved.

    sigma is a number, or a column if `taps` is given. Interpreted array lambdas take about 0.3 microseconds a tap, so this is an Arrow
    function: a scan is one row, batches are bounded in bytes, and a pass over an axis is one array operation per tap. A null array or sigma
    gives null.
    """
    axes = tuple(range(len(dims))) if only is None else only
    if not isinstance(sigma, Column):
        w = np.array(kernel(sigma, taps))
        return batched(lambda v: convolved(v, w, border, tuple(a + 1 for a in axes)), dims, data)

    @F.arrow_udf("array<double>")
    def run(boxes: pa.Array, sigmas: pa.Array) -> pa.Array:
        out = []
        for v, s in zip(boxes, sigmas.to_pylist(), strict=True):
            if not v.is_valid or s is None:
                out.append(None)
                continue
            out.append(convolved(v.values.to_numpy(zero_copy_only=False).astype(float).reshape(dims), np.array(kernel(s, taps)), border, axes).ravel())
        return pa.array(out, pa.list_(pa.float64()))

    return run(col(data), sigma)


def erosion_depth(df: DataFrame, axes: list[str], value: str, steps: int, name: str = "depth") -> DataFrame:
    """Sum of the first `steps` successive 3^d erosions.

    k erosions with radius one equal one minimum filter of radius k, so there is no iteration: on the
    last axis all radii are taken in one pass over the lines of the previous one.
    """
    cols = [f"_e{k}" for k in range(1, steps + 1)]
    df = df.select("*", *[F.col(value).alias(c) for c in cols])
    for axis in axes:
        win = line(axes, axis)
        keep = [c for c in df.columns if c not in cols]
        df = df.select(*keep, *[F.min(c).over(win.rowsBetween(-k, k)).alias(c) for k, c in enumerate(cols, 1)])
    total: Column = F.lit(0.0)
    for c in cols:
        total = total + F.col(c)
    return df.withColumn(name, total).drop(*cols)


def eroded(v: np.ndarray, steps: int) -> np.ndarray:
    """Sum of the first `steps` successive 3^d erosions of each of a stack of maps or volumes; outside counts for nothing."""
    total = np.zeros(v.shape)
    for _ in range(steps):
        for a in range(1, v.ndim):
            low = np.take(v, range(1, v.shape[a]), axis=a), np.take(v, range(v.shape[a] - 1), axis=a)
            v = v.copy()
            inner = [slice(None)] * v.ndim
            inner[a] = slice(0, -1)
            np.minimum(v[tuple(inner)], low[0], out=v[tuple(inner)])
            inner[a] = slice(1, None)
            np.minimum(v[tuple(inner)], low[1], out=v[tuple(inner)])
        total += v
    return total


def on_grids(df: DataFrame, dims: dict[str, int], value: str, fn, name: str) -> DataFrame:
    """Adds `name`, fn of the stacked grids (scans, *dims) of `value`. df is partitioned by uid and has one row per cell of each scan.

    Rows are sorted inside their partition and read as grids, whole scans at a time; a missing or repeated cell raises.
    """
    size, axes = math.prod(dims.values()), list(dims)
    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        step = max(1, VOXELS // size) * size

        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            at = 0
            for a, n in dims.items():
                at = at * n + t.column(a).to_numpy()
            uid = t.column("uid").to_numpy().reshape(-1, size)
            if (at.reshape(-1, size) != np.arange(size)).any() or (uid != uid[:, :1]).any():
                raise ValueError("grid is not dense, or not partitioned by uid")
            new = fn(t.column(value).to_numpy().astype(float).reshape(-1, *dims.values()))
            yield from t.append_column(name, pa.array(new.ravel())).combine_chunks().to_batches()

        rows = 0
        for b in it:
            held.append(b)
            rows += b.num_rows
            if rows >= step:
                t = pa.Table.from_batches(held)
                cut_ = rows // size * size
                yield from out(t.slice(0, cut_))
                held, rows = t.slice(cut_).to_batches(), rows - cut_
        if rows:
            if rows % size:
                raise ValueError("grid is not dense, or not partitioned by uid")
            yield from out(pa.Table.from_batches(held))

    return df.sortWithinPartitions("uid", *axes).mapInArrow(run, schema)


def offsets_join(df: DataFrame, axes: list[str], offsets: list[tuple[int, ...]], aggs: dict[str, Column]) -> DataFrame:
    """Sparse stencil: scatter every cell to its neighbours, then combine per target cell.

    The offset list is a literal array, so this is a narrow step; the combine is partial before it shuffles.
    """
    off = F.explode(F.array(*[F.struct(*[F.lit(o).alias(a) for a, o in zip(axes, t)]) for t in offsets]))
    s = df.withColumn("_o", off)
    for a in axes:
        s = s.withColumn(a, F.col(a) + F.col(f"_o.{a}"))
    return s.drop("_o").groupBy("uid", *axes).agg(*[c.alias(n) for n, c in aggs.items()])


def grow(seed: DataFrame, mask: str, axes: list[str], steps: int, value: str = "rec", per_job: int = 5) -> DataFrame:
    """Geodesic growth: repeat rec = min(dilate(rec, 1), mask) until nothing changes or `steps` is reached."""
    done, cur = 0, cut(seed)
    parts = scan_parts(cur)
    while done < steps:
        todo = min(per_job, steps - done)
        nxt = by_scan(cur, parts).withColumn("_was", F.col(value))
        for _ in range(todo):
            nxt = frame(nxt, axes, value, F.max, 1).withColumn(value, F.least(F.col(value), F.col(mask)))
        nxt = cut(nxt)
        done += todo
        moved = nxt.where(f"{value} <> _was").limit(1).count()
        cur = nxt.drop("_was")
        if not moved:
            break
    return cur
