"""Connected components of sparse masks, faces only.

A scan's cells are brought together once. There they are cut into straight segments, and segments that touch are united; what is
left to settle is a graph of segments, some hundred times smaller than the mask.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def united(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of the component of each of n nodes, for edges a-b: the larger root hooks onto the smaller, then paths are halved."""
    root = np.arange(n)
    while len(a):
        lo, hi = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = lo < hi
        a, b, lo, hi = a[open_], b[open_], lo[open_], hi[open_]
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def face_labels(cell: np.ndarray, dims: tuple[int, ...]) -> np.ndarray:
    """Smallest cell number of the face-connected component of each cell; cells are distinct row-major positions in a grid of dims."""
    order = np.argsort(cell, kind="stable")
    c = cell[order]
    if not len(c):
        return c
    new = np.concatenate([[True], (np.diff(c) != 1) | (c[1:] % dims[-1] == 0)])
    seg = np.cumsum(new) - 1
    first = c[new]
    pairs, stride = [], dims[-1]
    for n in dims[-2::-1]:
        # a cell's neighbour one line further on; the last line of an axis has none
        here = np.flatnonzero(c // stride % n < n - 1)
        at = np.minimum(np.searchsorted(c, c[here] + stride), len(c) - 1)
        hit = c[at] == c[here] + stride
        x, y = seg[here[hit]], seg[at[hit]]
        keep = np.concatenate([np.ones(min(len(x), 1), bool), (np.diff(x) != 0) | (np.diff(y) != 0)])
        pairs.append((x[keep], y[keep]))
        stride *= n
    a, b = (np.concatenate(p) if pairs else np.zeros(0, np.int64) for p in (zip(*pairs, strict=True) if pairs else ((), ())))
    out = np.empty(len(c), np.int64)
    out[order] = first[united(a, b, len(first))[seg]]
    return out


def components(mask: DataFrame, axes: dict[str, int], keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds `label`, the smallest cell number of the component. Cells are given once per scan.

    One shuffle, by uid; a scan's cells are bounded by its grid.
    """
    names, dims = list(axes), tuple(axes.values())
    rows = mask.select("uid", *names, *keep)

    def label(t: pa.Table) -> pa.Table:
        cell = np.zeros(t.num_rows, np.int64)
        for a, n in axes.items():
            cell = cell * n + t.column(a).to_numpy()
        return t.append_column("label", pa.array(face_labels(cell, dims), pa.int64()))

    return rows.groupBy("uid").applyInArrow(label, StructType([*rows.schema.fields, StructField("label", LongType())]))


def largest(labelled: DataFrame) -> DataFrame:
    """Cells of the largest component of each scan, the smallest label first on ties. Windows keep the partitioning by uid."""
    n = F.count(F.lit(1)).over(Window.partitionBy("uid", "label"))
    sized = labelled.withColumn("_size", F.struct(n.alias("n"), (-F.col("label")).alias("k")))
    best = sized.withColumn("_best", F.max("_size").over(Window.partitionBy("uid")))
    return best.where("_size = _best").drop("_size", "_best")


def fill_holes(mask: DataFrame, axes: dict[str, int], scans: DataFrame) -> DataFrame:
    """Mask plus every background component that does not touch the border."""
    names = list(axes)
    grid = scans.select("uid").distinct()
    for a in names:
        grid = grid.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(axes[a] - 1))))
    back = components(grid.join(mask.select("uid", *names), ["uid", *names], "left_anti"), axes)
    edge = F.lit(False)
    for a in names:
        edge = edge | (F.col(a) == 0) | (F.col(a) == axes[a] - 1)
    open_ = F.max(edge).over(Window.partitionBy("uid", "label"))
    holes = back.withColumn("_open", open_).where(~F.col("_open")).select("uid", *names)
    return mask.select("uid", *names).unionByName(holes)
