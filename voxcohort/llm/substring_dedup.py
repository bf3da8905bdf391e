"""Repeated word windows across documents, by a count-min prefilter.

Pass one sketches the distinct windows of every document and merges the sketches. Pass two groups exactly the windows that the sketch
takes for repeated. A task first settles what it can see: of the documents of a flushed part that hold a window, all but the one
with the least id are covered already, so one row per window and part is shuffled, however many documents share it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sketch
from .common import arrow_map, batch, documents
from .words import SPACED, Slice, Words, joined, rolling, signed, slices, words_of

SIZE = 13
RUN = 1 << 24


def runs(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive positions per document, of pairs sorted by document and position: document, first, length."""
    cut = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(pos, prepend=-9) != 1))
    return doc[cut], pos[cut], np.diff(np.append(cut, len(doc)))


def split_runs(row: np.ndarray, first: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same runs in pieces of at most `most`, so that first and length fit in one number."""
    pieces = -(-n // most)
    of = np.repeat(np.arange(len(n)), pieces)
    k = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return row[of], first[of] + k * most, np.minimum(most, n[of] - k * most)


def covered(n: int, start: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Which of n places lie in [start, start + size) of any start."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, np.minimum(start + size, n), -1)
    return np.cumsum(d[:n]) > 0


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("sig"))


def marks(docs: DataFrame, size: int = SIZE, most: int = RUN) -> DataFrame:
    """Per document and text hash (doc_id, sig): runs of window starts that also start in a document of smaller id, as first * most + length;
    a run of `most` or more is several."""
    d = _own(docs).where("doc_id is not null")

    def distinct(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        for s in slices(b.column("text")):
            w = words_of(s, SPACED)
            h, ok = rolling(w, size)
            doc, h = w.doc[: len(h)][ok], h[ok]
            order = np.lexsort((h, doc))
            new = np.ones(len(h), bool)
            new[1:] = (np.diff(h[order]) != 0) | (np.diff(doc[order]) != 0)
            yield h[order[new]]

    spark = docs.sparkSession
    bits = sketch.width_bits(sketch.text_bytes(d) // 6)
    twice = spark.sparkContext.broadcast(sketch.merged(d.select("text"), distinct, bits))

    def group(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            """Windows are held by place in the slice and row of the slice; ids and text hashes are held per row."""
            first = np.cumsum([0, *(len(x[3]) for x in held)])
            row = np.concatenate([x[1] + np.int32(f) for x, f in zip(held, first)])
            h, pos, did, sig = (np.concatenate([x[k] for x in held]) for k in (0, 2, 3, 4))
            held.clear()
            order = np.lexsort((did[row], h))
            head = np.ones(len(h), bool)
            hs = h[order]
            head[1:] = hs[1:] != hs[:-1]
            del hs
            ds = did[row[order]]
            heads = np.flatnonzero(head)
            mine = ds == np.repeat(ds[heads], np.diff(np.append(heads, len(ds))))
            del ds, head
            own, late = np.sort(order[mine]), order[~mine]
            del order, mine
            for k in range(0, len(own), sketch.ROWS):
                at = own[k : k + sketch.ROWS]
                yield batch(h=signed(h[at]), doc_id=did[row[at]], sig=sig[row[at]], run=pos[at].astype(np.int64) * most + 1)
            del own, h
            late = late[np.lexsort((pos[late], sig[row[late]], did[row[late]]))]
            text = np.cumsum((np.diff(did[row[late]], prepend=0) != 0) | (np.diff(sig[row[late]], prepend=0) != 0))
            r, p, n = split_runs(*runs(text, pos[late].astype(np.int64)), most - 1)
            at = late[np.searchsorted(text, r)]
            for k in range(0, len(r), sketch.ROWS):
                a, of = at[k : k + sketch.ROWS], slice(k, k + sketch.ROWS)
                yield batch(h=pa.nulls(len(a), pa.int64()), doc_id=did[row[a]], sig=sig[row[a]], run=p[of] * most + n[of])

        for b in it:
            did, sig = b.column("doc_id").to_numpy(), b.column("sig").to_numpy()
            for s in slices(b.column("text")):
                w = words_of(s, SPACED)
                h, ok = rolling(w, size)
                at = np.flatnonzero(ok)
                at = at[twice.value(h[at])]
                of = slice(s.row, s.row + s.n)
                held.append((h[at], w.doc[at].astype(np.int32), (at - w.first[w.doc[at]]).astype(np.int32), did[of].copy(), sig[of].copy()))
                count += len(at)
                if count >= sketch.FLUSH:
                    yield from flush()
                    count = 0
        if count:
            yield from flush()

    rows = arrow_map(d, group, "h long, doc_id long, sig long, run long")
    far = rows.where("h is not null").withColumn("least", F.min("doc_id").over(Window.partitionBy("h"))).where("doc_id > least")
    near = rows.where("h is null")
    return far.select("doc_id", "sig", "run").unionByName(near.select("doc_id", "sig", "run")).groupBy("doc_id", "sig").agg(F.collect_list("run").alias("runs"))


def remove(docs: DataFrame, size: int = SIZE, most: int = RUN) -> DataFrame:
    """docs' doc_id with n_words, n_removed, kept_sha256 and kept (the words that stay, joined by one space).

    A word goes if a window of `size` words over it also starts in a document with a smaller id. Null or empty texts have no words.
    Rows with one id are one document as to order: neither is before the other. A null id is before nothing and keeps its words.
    """
    d = _own(docs).join(marks(docs, size, most), ["doc_id", "sig"], "left").select("doc_id", "text", "runs")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            spans = b.column("runs")
            for s in slices(b.column("text")):
                w: Words = words_of(s, SPACED)
                keep = np.ones(len(w), bool)
                for i in range(s.n):
                    x = spans[s.row + i]
                    if x.is_valid:
                        a, e, r = int(w.first[i]), int(w.first[i + 1]), x.values.to_numpy()
                        keep[a:e] = ~covered(e - a, r // most, r % most + size - 1)
                yield from _answer(b, s, w, keep)

    return arrow_map(d, cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def _answer(b: pa.RecordBatch, s: Slice, w: Words, keep: np.ndarray) -> Iterator[pa.RecordBatch]:
    data, first = joined(w, s, keep)
    n = np.diff(w.first)
    gone = np.concatenate([[0], np.cumsum(~keep)])[w.first]
    view = memoryview(np.ascontiguousarray(data))
    cut = first.tolist()
    yield batch(
        doc_id=b.column("doc_id").slice(s.row, s.n),
        n_words=n,
        n_removed=np.diff(gone),
        kept_sha256=[hashlib.sha256(view[i:j]).hexdigest() for i, j in zip(cut, cut[1:])],
        kept=pa.StringArray.from_buffers(s.n, pa.py_buffer(first.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(documents(spark, sf_dir)).drop("kept")
