"""Count-min sketches of hashes, made per partition and merged by shard.

Each of `depth` rows counts the hashes that fall in each of 2**bits cells. A flushed part of a partition sends the sorted cells it has
met, as byte gaps; shards of cells are added up in parallel, and only one bit per cell (met at least twice) is kept. A hash that
occurs twice is always reported; the share of single hashes that is reported too falls with the width. The width follows the number
of hashes up to MAX_BITS, so what is broadcast is bounded; past that bound more single hashes pass, and none is lost.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, partitions, passing
from .words import U, mix

DEPTH = 2
MIN_BITS, MAX_BITS = 16, 29
SHARD_BITS = 8
FLUSH = 2_000_000
ROWS = 100_000
PART = 4_000_000
FETCH = 1 << 21


def width_bits(n: int) -> int:
    """About two cells per hash and row, within the bounds."""
    return int(min(MAX_BITS, max(MIN_BITS, np.rint(np.log2(max(2 * n, 2))))))


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(h + U(row * 0x632BE59BD9B4E019 & (2**64 - 1))) >> U(64 - bits)).astype(np.int64)


def squeeze(x: np.ndarray) -> bytes:
    """Sorted non-negative integers as byte gaps; larger gaps follow as 32-bit values."""
    d = np.diff(x, prepend=0)
    big = d >= 255
    return struct.pack("<I", len(x)) + np.where(big, 255, d).astype(np.uint8).tobytes() + d[big].astype("<u4").tobytes()


def expand(raw: bytes) -> np.ndarray:
    n = struct.unpack_from("<I", raw)[0]
    d = np.frombuffer(raw, np.uint8, n, 4).astype(np.int64)
    d[d == 255] = np.frombuffer(raw, "<u4", offset=4 + n)
    return np.cumsum(d)


class Repeated:
    """Bits of the cells that were met at least twice."""

    def __init__(self, rows: np.ndarray, bits: int):
        self.rows, self.bits = rows, bits

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Which hashes may occur twice."""
        out = np.ones(len(h), bool)
        for r in range(len(self.rows)):
            c = cells(h[out], r, self.bits)
            out[out] = (self.rows[r][c >> 3] >> (c & 7).astype(np.uint8)) & 1 > 0
        return out


def merged(docs: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, depth: int = DEPTH, least: int = 2) -> Repeated:
    """Sketch of all hashes that `hashes` yields for the batches of docs; reports those met at least `least` (1 or 2) times."""
    low = bits - SHARD_BITS

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # only cells are held, so memory is bounded by PART
        held = np.empty((depth, PART), np.uint32)
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for r in range(depth):
                c = held[r, :size]
                c.sort()
                cut = np.searchsorted(c, (np.arange(1 << SHARD_BITS | 1) << low).astype(np.uint32))
                some = np.flatnonzero(np.diff(cut))
                yield batch(line=np.full(len(some), r, np.int32), shard=some.astype(np.int32), cells=pa.array([squeeze(c[cut[k] : cut[k + 1]] - np.uint32(int(k) << low)) for k in some], pa.binary()))

        for b in it:
            for h in hashes(b):
                while len(h):
                    some = h[: PART - size]
                    for r in range(depth):
                        held[r, size : size + len(some)] = cells(some, r, bits)
                    size, h = size + len(some), h[len(some) :]
                    if size == PART:
                        yield from flush()
                        size = 0
        if size:
            yield from flush()

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in it:
            for r, k, raw in zip(b.column("line").to_pylist(), b.column("shard").to_pylist(), b.column("cells"), strict=True):
                c = expand(raw.as_py())
                t = total.setdefault((r, k), np.zeros(1 << low, np.uint8))
                first = np.flatnonzero(np.diff(c, prepend=-1))
                many = np.diff(np.append(first, len(c)))
                u = c[first]
                t[u] = np.minimum(2, t[u] + np.minimum(many, 2))
        for (r, k), t in total.items():
            yield batch(line=pa.array([r], pa.int32()), shard=pa.array([k], pa.int32()), twice=pa.array([np.packbits(t >= least, bitorder="little").tobytes()], pa.binary()))

    made = arrow_map(docs, part, "line int, shard int, cells binary").repartition(partitions(docs.sparkSession), "line", "shard")
    rows = np.zeros((depth, max(1, 1 << bits >> 3)), np.uint8)
    step = 1 << low >> 3
    with passing(docs.sparkSession) as keep:
        # shards are added up in parallel first: what is fetched is fetched partition by partition, each about FETCH bytes
        for x in keep(arrow_map(made, add, "line int, shard int, twice binary")).coalesce(-(-rows.nbytes // FETCH)).toLocalIterator():
            rows[x["line"], x["shard"] * step : (x["shard"] + 1) * step] = np.frombuffer(x["twice"], np.uint8)
    return Repeated(rows, bits)


def id_filter(ids: DataFrame) -> Repeated:
    """Filter of bounded size for the ids of a table (doc_id, not null): holds all of them, and some others."""

    def hashes(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield mix(b.column("doc_id").to_numpy().astype(U))

    return merged(ids.select("doc_id"), hashes, width_bits(4 * ids.count()), least=1)


def may_hold(ids: DataFrame) -> Callable[[str], Column]:
    """A boolean expression over an id column: false only where ids does not hold it. A null is not held."""
    shared = ids.sparkSession.sparkContext.broadcast(id_filter(ids))

    def test(x: pd.Series) -> pd.Series:
        null = x.isna()
        return pd.Series(shared.value(mix(x.fillna(0).to_numpy().astype(np.int64).astype(U)))) & ~null

    return F.pandas_udf(test, "boolean")


def text_bytes(docs: DataFrame) -> int:
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
