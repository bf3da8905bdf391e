"""Packing by length patterns: few-document patterns that fill a sequence, fitted to the length histogram by non-negative least squares.

Everything global happens on the histogram of lengths, whose size is bounded by the capacity (4096 counters): patterns of at
most `parts` binned lengths that add up to the capacity are enumerated, their repeat counts fitted to the binned histogram,
rounded down to what is there and laid out with exact lengths (the last slot takes the longest length that still fits). What
remains is placed by best fit, again per length and not per piece. The result is a plan: which ranks of a length go to which
run of sequences and at what offset. Spark ranks the pieces of each length and looks them up in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, batch, cut, documents
from .tokens import default_vocabulary, encoder
from .words import slices

CAPACITY = 4096


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Minimise |a x - b| over x >= 0 by the active-set method."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    gradient = a.T @ b
    tol = 1e-9 * max(1.0, float(np.abs(gradient).max(initial=0)))
    for _ in range(rounds or 10 * a.shape[0] + 30):
        open_ = ~passive & (gradient > tol)
        if not open_.any():
            break
        passive[np.argmax(np.where(open_, gradient, -np.inf))] = True
        while True:
            z = np.zeros(n)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            bad = passive & (z <= 0)
            if not bad.any():
                break
            step = np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300))
            x += step * (z - x)
            passive &= x > 1e-12
            x[~passive] = 0
        x = z
        gradient = a.T @ (b - a @ x)
    return x


def patterns(total: int, parts: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of at most `parts` positive integers that add up to total."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, most: int, head: tuple[int, ...]) -> None:
        if not left:
            out.append(head)
        elif len(head) < parts:
            for v in range(min(left, most), 0, -1):
                if v * (parts - len(head)) < left:
                    break
                grow(left - v, v, (*head, v))

    grow(total, total, ())
    return out


@dataclass
class Run:
    """`n` sequences alike: slot (length, first rank) of sequence j takes that length's piece of rank first + j."""

    slots: list[tuple[int, int]]
    n: int


class Layout:
    def __init__(self, hist: dict[int, int], capacity: int):
        self.left = {k: v for k, v in hist.items() if v}
        self.sizes = sorted(self.left)
        self.rank = dict.fromkeys(hist, 0)
        self.capacity, self.runs = capacity, []

    def take(self, length: int, n: int) -> tuple[int, int]:
        first = self.rank[length]
        self.rank[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.sizes.remove(length)
        return length, first

    def best(self, room: int, least: int = 1) -> int | None:
        """Longest length that is left and fits."""
        i = bisect_left(self.sizes, room + 1) - 1
        return self.sizes[i] if i >= 0 and self.sizes[i] >= least else None

    def pattern(self, uppers: tuple[int, ...], width: int, repeats: int) -> None:
        """Lay out a pattern of binned lengths as often as asked, or as the histogram allows."""
        while repeats > 0:
            lengths, used = [], {}
            for u in uppers[:-1]:
                room = u
                while (v := self.best(room, u - width + 1)) is not None and self.left[v] <= used.get(v, 0):
                    room = v - 1
                if v is None:
                    return
                lengths.append(v)
                used[v] = used.get(v, 0) + 1
            room = self.capacity - sum(lengths)
            while (v := self.best(room)) is not None and self.left[v] <= used.get(v, 0):
                room = v - 1
            if v is not None:
                lengths.append(v)
                used[v] = used.get(v, 0) + 1
            n = min(repeats, *(self.left[v] // k for v, k in used.items()))
            self.runs.append(Run([self.take(v, n) for v in lengths], n))
            repeats -= n

    def residual(self) -> None:
        """Best fit in falling length, per length: the fullest run of sequences with room is filled first."""
        rooms: dict[int, list[Run]] = {}
        keys: list[int] = []

        def put(run: Run) -> None:
            room = self.capacity - sum(v for v, _ in run.slots)
            if room:
                if room not in rooms:
                    rooms[room] = []
                    insort(keys, room)
                rooms[room].append(run)

        for r in self.runs:
            put(r)
        while self.sizes:
            v = self.sizes[-1]
            i = bisect_left(keys, v)
            if i == len(keys):
                most = self.capacity // v
                c = self.left[v]
                n, k = (c // most, most) if c >= most else (1, c)
                run = Run([self.take(v, n) for _ in range(k)], n)
                self.runs.append(run)
                put(run)
                continue
            room = keys[i]
            run = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                keys.pop(i)
            n = min(run.n, self.left[v])
            if n < run.n:
                rest = Run([(a, b + n) for a, b in run.slots], run.n - n)
                self.runs.append(rest)
                put(rest)
                run.n = n
            run.slots.append(self.take(v, n))
            put(run)


def plan(hist: dict[int, int], capacity: int = CAPACITY, bins: int = 64, parts: int = 4) -> list[Run]:
    """Runs of sequences that hold every length of the histogram as often as it occurs."""
    out = Layout(hist, capacity)
    if capacity in out.left:
        out.runs.append(Run([out.take(capacity, n := hist[capacity])], n))
    width = -(-capacity // bins)
    grid = capacity // width
    total = np.zeros(grid)
    for v, c in out.left.items():
        total[min(-(-v // width), grid) - 1] += c
    forms = patterns(grid, parts)
    a = np.zeros((grid, len(forms)))
    for j, f in enumerate(forms):
        for v in f:
            a[v - 1, j] += 1
    if total.any():
        x = nnls(a, total)
        for j in sorted(np.flatnonzero(x >= 0.5).tolist(), key=lambda j: forms[j], reverse=True):
            out.pattern(tuple(v * width for v in forms[j]), width, int(x[j] + 0.5))
    out.residual()
    return out.runs


def pieces(docs: DataFrame, vocabulary: str, capacity: int) -> DataFrame:
    """Pieces of every whole text (null: empty): doc_id, piece, start, length, ids_crc32, and the rank among the part's pieces of that length."""

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(vocabulary), np.zeros(capacity + 1, np.int64)
        for b in it:
            part, did = b.column("part"), b.column("doc_id")
            for s in slices(b.column("text")):
                ids, first = enc.encode(s)
                wire, count = ids.astype("<u4"), np.diff(first)
                k = -(-count // capacity)
                doc = np.repeat(np.arange(s.n), k)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
                start = piece * capacity
                length = np.minimum(count[doc] - start, capacity)
                lo = (first[:-1][doc] + start).tolist()
                order = np.argsort(length, kind="stable")
                run = length[order]
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - np.searchsorted(run, run) + seen[run]
                seen += np.bincount(length, minlength=capacity + 1)
                at = pa.array(doc + s.row)
                yield batch(
                    doc_id=did.take(at), part=part.take(at), piece=piece.astype(np.int32), start=start, length=length, rank=rank,
                    ids_crc32=np.array([zlib.crc32(wire[i : i + n]) for i, n in zip(lo, length.tolist(), strict=True)], np.int64),
                )

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.spark_partition_id().alias("part"))
    return arrow_map(rows, encode, "doc_id long, part int, piece int, start long, length long, rank long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, bins: int = 64, parts: int = 4) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of docs is packed, repeated rows each on their own; a null id stays null; an empty or null text is one piece of
    the end id. No row, no sequence.
    """
    p = cut(pieces(docs, vocabulary or default_vocabulary(), capacity))
    per = p.groupBy("part", "length").agg(F.count("*").alias("n"))
    hist = dict(per.groupBy("length").agg(F.sum("n")).collect())  # at most `capacity` rows
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    slot = []
    base = 0
    for run in plan(hist, capacity, bins, parts):
        offset = 0
        for v, first in run.slots:
            slot.append((v, first, base, offset))
            offset += v
        base += run.n
    table = np.array(sorted(slot), np.int64).reshape(-1, 4)
    key = table[:, 0] * (1 << 44) + table[:, 1]

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rank = b.column("rank").to_numpy() + b.column("before").to_numpy()
            i = np.searchsorted(key, b.column("length").to_numpy() * (1 << 44) + rank, "right") - 1
            yield batch(
                **{c: b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")},
                sequence_id=table[i, 2] + rank - table[i, 1], offset=table[i, 3],
            )

    return arrow_map(p.join(before, ["part", "length"]), place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
