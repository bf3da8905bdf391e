"""Token files in patched frame-of-reference blocks.

A segment holds consecutive documents in ascending id order: header, byte offset of every block, then blocks of 256 values.
A block stores its minimum, the differences packed at the width that a percentile of them needs, and the values beyond that
width as exceptions (place, value). Document ids, token counts and token ids are three such streams. Segments are rows of a
Parquet folder in shared storage, so Spark's committer decides which attempt of a lost task counts, and any reader that Spark
has can open them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import arrow_map, batch, documents, partitions
from .tokens import default_vocabulary, encoder
from .words import slices

BLOCK = 256
_MAGIC = b"PFOR1\0\0\0"


def pack(values: np.ndarray, percentile: float = 0.95) -> bytes:
    """One stream of unsigned 32-bit values: count, block starts, blocks."""
    n = len(values)
    blocks = -(-n // BLOCK)
    v = np.zeros(blocks * BLOCK, np.uint32)
    v[:n] = values
    if n < len(v):
        v[n:] = values[-1]
    v = v.reshape(blocks, BLOCK)
    low = v.min(1) if blocks else np.zeros(0, np.uint32)
    d = v - low[:, None]
    at = min(BLOCK - 1, int(percentile * BLOCK))
    width = np.zeros(blocks, np.uint8)
    if blocks:
        width[:] = np.ceil(np.log2(np.partition(d, at, 1)[:, at].astype(np.float64) + 1))
    over = (d.astype(np.uint64) >> width.astype(np.uint64)[:, None]) > 0
    count = over.sum(1)
    body: list = [b""] * blocks
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        bits = np.unpackbits(d[rows].astype("<u4").view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2, count=int(w), bitorder="little")
        packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
        for r, p in zip(rows.tolist(), packed, strict=True):
            body[r] = p.tobytes()
    br, bc = np.nonzero(over)
    cuts = np.concatenate([[0], np.cumsum(count)])
    place, extra = bc.astype(np.uint8), d[br, bc].astype("<u4")
    out = []
    for r in range(blocks):
        a, b = cuts[r], cuts[r + 1]
        out.append(struct.pack("<IBH", int(low[r]), int(width[r]), int(count[r])) + body[r] + place[a:b].tobytes() + extra[a:b].tobytes())
    starts = np.cumsum([0, *map(len, out)]).astype("<u4")
    return struct.pack("<II", n, blocks) + starts.tobytes() + b"".join(out)


def unpack(raw: bytes, only: tuple[int, int] | None = None) -> tuple[np.ndarray, int]:
    """Values of a stream (or those of blocks only[0]..only[1]) and the bytes it takes."""
    n, blocks = struct.unpack_from("<II", raw)
    starts = np.frombuffer(raw, "<u4", blocks + 1, 8)
    base = 8 + 4 * (blocks + 1)
    lo, hi = only or (0, blocks)
    heads = [struct.unpack_from("<IBH", raw, base + int(s)) for s in starts[lo:hi]]
    low = np.array([h[0] for h in heads], np.uint32)
    width = np.array([h[1] for h in heads], np.int64)
    count = np.array([h[2] for h in heads], np.int64)
    buf = np.frombuffer(raw, np.uint8)
    v = np.zeros((hi - lo, BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            size = BLOCK * int(w) // 8
            packed = buf[(base + starts[lo + rows].astype(np.int64) + 7)[:, None] + np.arange(size)]
            bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, int(w))
            full = np.zeros((len(rows), BLOCK, 16 if w <= 16 else 32), np.uint8)
            full[:, :, : int(w)] = bits
            v[rows] = np.packbits(full, axis=2, bitorder="little").view("<u2" if w <= 16 else "<u4")[:, :, 0]
    for r in np.flatnonzero(count):
        at = base + int(starts[lo + r]) + 7 + BLOCK * int(width[r]) // 8
        c = int(count[r])
        v[r, np.frombuffer(raw, np.uint8, c, at)] = np.frombuffer(raw, "<u4", c, at + c)
    v += low[:, None]
    end = min(n, hi * BLOCK) - lo * BLOCK
    return v.reshape(-1)[: max(end, 0)], base + int(starts[-1])


def write_segment(doc_ids: np.ndarray, null: np.ndarray, counts: np.ndarray, ids: np.ndarray, start: int, percentile: float) -> bytes:
    """start: ids in earlier segments of the same part."""
    u = np.where(null, 0, doc_ids).astype(np.int64).view(np.uint64)
    streams = [(u >> np.uint64(32)).astype(np.uint32), u.astype(np.uint32), null.astype(np.uint32), counts.astype(np.uint32), ids]
    return _MAGIC + struct.pack("<Q", start) + b"".join(pack(s, percentile) for s in streams)


def read_segment(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Document ids, their null flags, token counts, token ids and the start."""
    if raw[:8] != _MAGIC:
        raise ValueError("not a token segment")
    at, got = 16, []
    for _ in range(5):
        v, size = unpack(raw[at:])
        got.append(v)
        at += size
    hi, lo, null, counts, ids = got
    return ((hi.astype(np.uint64) << np.uint64(32)) | lo).view(np.int64), null.astype(bool), counts, ids, struct.unpack_from("<Q", raw, 8)[0]


SEGMENT_BYTES = 1 << 20


def write_tokens(docs: DataFrame, path: str, vocabulary: str, percentile: float = 0.95) -> None:
    """Encode every whole text (null: empty), append END_ID, write segments in ascending doc_id order (null ids first, repeated ids in any order)."""
    n = partitions(docs.sparkSession)

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, start, seq = encoder(vocabulary), 0, 0
        for b in it:
            part = b.column("part").to_numpy()
            ids_ = b.column("doc_id")
            null, doc = np.asarray(ids_.is_null()), np.asarray(ids_.fill_null(0))
            for s in slices(b.column("text"), SEGMENT_BYTES):
                ids, first = enc.encode(s)
                r = slice(s.row, s.row + s.n)
                yield batch(
                    part=part[s.row : s.row + 1],
                    seq=pa.array([seq], pa.int64()),
                    n_docs=pa.array([s.n], pa.int64()),
                    n_ids=pa.array([len(ids)], pa.int64()),
                    payload=pa.array([write_segment(doc[r], null[r], np.diff(first), ids, start, percentile)], pa.binary()),
                )
                start, seq = start + len(ids), seq + 1

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id())
    arrow_map(ordered, write, "part int, seq long, n_docs long, n_ids long, payload binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of token files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids. Only one total per part goes to the driver."""
    table = spark.read.parquet(path)
    totals = dict(table.groupBy("part").agg(F.sum("n_ids")).collect())
    before, run = {}, 0
    for p in sorted(totals):
        before[p], run = run, run + totals[p]

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part, raw in zip(b.column("part").to_pylist(), b.column("payload"), strict=True):
                doc, null, counts, ids, start = read_segment(raw.as_py())
                stop = np.cumsum(counts, dtype=np.int64)
                first = stop - counts
                wire = ids.astype("<u4")
                cols = {
                    "doc_id": pa.array(doc, pa.int64(), mask=null),
                    "start": first + start + before[part],
                    "n_tokens": counts.astype(np.int64),
                    "ids_crc32": np.array([zlib.crc32(wire[i:j]) for i, j in zip(first.tolist(), stop.tolist(), strict=True)], np.int64),
                }
                if with_ids:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(np.append(first, stop[-1:]).astype(np.int32)), pa.array(ids.astype(np.int64)))
                yield batch(**cols)

    return arrow_map(table.select("part", "payload"), read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, default_vocabulary())
    return read_tokens(spark, path)
