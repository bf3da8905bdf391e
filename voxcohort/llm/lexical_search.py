"""Ranked search over bit-sliced Bloom signatures.

The index is a table of blocks. A block holds up to `BLOCK_DOCS` documents of one size class: a Bloom signature per document, stored by
bit (slice s holds bit s of every document of the block, so the slices of a term are a few bytes each), and the documents' terms with
their counts. A document's signature holds a term once for each power of two that its count reaches, so the slices tell not only
whether a term may be there but also below which power of two its count lies.

A query ANDs the slices of its terms: a document without a term may look as if it held it, never the other way round. Weights times the
largest contribution each count may have, summed over the terms, bound a document's score from above. A task keeps the best k of every
item so far and rescores exactly, from the stored counts, all documents whose bound reaches the k-th best: none is left out unless k
others of the same task are provably better. What tasks return (at most k per item each) is ranked once more.

Contributions are 64-bit integers, so bounds and scores carry no rounding. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import arrow_map, batch, documents
from .words import ALNUM_LOWER, U, mix, slices, words_of

TOP = 10
HASHES = 3
BITS_PER_KEY = 8
BLOCK_DOCS = 256
BLOCK_BYTES = 1 << 19
ROW_GROUP = 16 << 20
ENTRIES = 20_000
STEP = 2048
_LEVEL = U(0xA0761D6478BD642F)
_SEED = 0xE7037ED1A0B428DB
SCHEMA = "doc_ids array<bigint>, n binary, ends binary, terms binary, counts binary, bits int, slices binary"


def keyed(terms: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    """Signature key of a term at a level: it stands for a count of 2**level or more."""
    return mix(terms ^ (np.asarray(level).astype(U) * _LEVEL))


def places(keys: np.ndarray, bits: int, row: int) -> np.ndarray:
    return (mix(keys + U(row * _SEED & (2**64 - 1))) >> U(64 - bits)).astype(np.int64)


class _Class:
    """Documents of one size class that wait for their block."""

    def __init__(self, bits: int):
        self.bits, self.ids, self.n, self.terms, self.counts, self.size = bits, [], [], [], [], 0

    def add(self, doc_id, n: int, terms: np.ndarray, counts: np.ndarray) -> bool:
        self.ids.append(doc_id)
        self.n.append(n)
        self.terms.append(terms)
        self.counts.append(counts)
        self.size += 12 * len(terms)
        return len(self.ids) >= BLOCK_DOCS or self.size >= BLOCK_BYTES

    def block(self) -> pa.RecordBatch:
        size = np.array([len(t) for t in self.terms])
        terms, counts, doc = np.concatenate(self.terms), np.concatenate(self.counts), np.repeat(np.arange(len(size)), size)
        on = np.zeros((1 << self.bits, -(-len(size) // 8) * 8), bool)
        level = 0
        here = np.arange(len(terms))
        while len(here):
            keys = keyed(terms[here], level)
            for r in range(HASHES):
                on[places(keys, self.bits, r), doc[here]] = True
            level += 1
            here = here[counts[here] >= 1 << level]
        raw = lambda x: pa.array([x.tobytes()], pa.binary())
        return batch(
            doc_ids=pa.array([self.ids], pa.list_(pa.int64())), n=raw(np.array(self.n, np.int64)), ends=raw(np.cumsum(size)), terms=raw(terms),
            counts=raw(counts.astype(np.uint32)), bits=pa.array([self.bits], pa.int32()), slices=raw(np.packbits(on, axis=1, bitorder="little")),
        )


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: dict[int, _Class] = {}
    for b in it:
        ids = b.column("doc_id")
        for s in slices(b.column("text")):
            w = words_of(s, ALNUM_LOWER)
            order = np.lexsort((w.hash, w.doc))
            h, d = w.hash[order], w.doc[order]
            new = np.flatnonzero(np.concatenate([np.ones(min(len(h), 1), bool), (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
            tf = np.diff(np.append(new, len(h)))
            h, d = h[new], d[new]
            levels = np.frexp(tf.astype(float))[1]
            first = np.searchsorted(d, np.arange(s.n + 1))
            total = np.concatenate([[0], np.cumsum(levels)])
            for k in np.flatnonzero(np.diff(first)).tolist():
                i, j = first[k], first[k + 1]
                bits = int(total[j] - total[i] - 1).bit_length() + BITS_PER_KEY.bit_length() - 1
                group = waiting.setdefault(bits, _Class(bits))
                # copies, or the whole slice would stay in memory with them
                if group.add(ids[s.row + k].as_py(), int(w.first[k + 1] - w.first[k]), h[i:j].copy(), tf[i:j].copy()):
                    yield waiting.pop(bits).block()
    for group in waiting.values():
        yield group.block()


def build(docs: DataFrame) -> DataFrame:
    """Index of docs (doc_id, text) as rows of SCHEMA. Documents without a term (null, empty) have nothing to be found by and are left out;
    every other row is a document of its own, also where ids repeat or are null. A text of any length is one document of a block."""
    return arrow_map(docs.select("doc_id", "text"), _blocks, SCHEMA)


def stored(index: DataFrame, path: str) -> DataFrame:
    """The index written to a folder every executor can read, in row groups small enough to be read one at a time."""
    index.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return index.sparkSession.read.schema(index.schema).parquet(path)


@dataclass
class Query:
    """Terms of a block of items: those of item i are first[i]:first[i + 1], each once and in order."""

    ids: list[int | None]
    terms: np.ndarray
    first: np.ndarray


def item_blocks(items: DataFrame, entries: int = ENTRIES) -> Iterator[Query]:
    """Rows of items (item_id, text) with a term, in blocks of about `entries` terms; a larger item is a block of its own."""
    ids, terms, size = [], [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        s = next(slices(pa.array([r["text"] or ""], pa.string())))
        t = np.unique(words_of(s, ALNUM_LOWER).hash)
        if not len(t):
            continue
        if ids and size + len(t) > entries:
            yield Query(ids, np.concatenate(terms), np.cumsum([0, *map(len, terms)]))
            ids, terms, size = [], [], 0
        ids.append(r["item_id"])
        terms.append(t)
        size += len(t)
    if ids:
        yield Query(ids, np.concatenate(terms), np.cumsum([0, *map(len, terms)]))


class Block:
    """A row of the index."""

    def __init__(self, row: dict):
        self.ids = row["doc_ids"]
        self.n = np.frombuffer(row["n"], np.int64)
        self.ends = np.frombuffer(row["ends"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.counts = np.frombuffer(row["counts"], np.uint32)
        self.bits = row["bits"]
        self.slices = np.frombuffer(row["slices"], np.uint8).reshape(1 << self.bits, -1)

    def document(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        i, j = self.ends[k - 1] if k else 0, self.ends[k]
        return self.terms[i:j], self.counts[i:j]

    def most(self, terms: np.ndarray) -> np.ndarray:
        """(terms, documents): a count that no document exceeds; 0 where the term is surely absent."""
        out = np.zeros((len(terms), len(self.ids)), np.int64)
        here = np.arange(len(terms))
        may = np.full((len(terms), self.slices.shape[1]), 255, np.uint8)
        level = 0
        while len(here):
            keys = keyed(terms[here], level)
            for r in range(HASHES):
                may &= self.slices[places(keys, self.bits, r)]
            some = may.any(1)
            here, may = here[some], may[some]
            level += 1
            on = np.unpackbits(may, axis=1, count=len(self.ids), bitorder="little").astype(bool)
            out[here] = np.where(on, (1 << level) - 1, out[here])
        return out


def blocks_of(it: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[dict]:
    for b in it:
        for i in range(b.num_rows):
            yield {c: b.column(c)[i].as_buffer() if pa.types.is_binary(b.schema.field(c).type) else b.column(c)[i].as_py() for c in columns}


def contribution(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * count // (1000 * count + 8 * m)


def frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """In how many documents each of the sorted distinct terms is."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, total = shared.value, np.zeros(len(shared.value), np.int64)
        for row in blocks_of(it, ("terms",)):
            t = np.frombuffer(row["terms"], np.uint64)
            at = np.minimum(np.searchsorted(terms, t), len(terms) - 1)
            total += np.bincount(at[terms[at] == t], minlength=len(terms))
        some = np.flatnonzero(total)
        yield batch(term=some, df=total[some])

    out = np.zeros(len(terms), np.int64)
    for r in arrow_map(index.select("terms"), count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def sizes(index: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.frombuffer(row["n"], np.int64) for row in blocks_of(it, ("n",))]
        yield batch(docs=pa.array([sum(map(len, n))], pa.int64()), terms=pa.array([sum(int(x.sum()) for x in n)], pa.int64()))

    r = arrow_map(index.select("n"), count, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return r["docs"] or 0, r["terms"] or 0


class Best:
    """The k best of one item: highest score, then least id, null ids last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def floor(self) -> int:
        """The least score that may still enter."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, score: int, doc_id) -> None:
        bisect.insort(self.rows, (-score, doc_id is None, doc_id or 0))
        del self.rows[self.k :]


def bounds(block: Block, q: Query, weight: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(items, documents): what no document's score exceeds."""
    out = np.zeros((len(q.ids), len(block.ids)), np.int64)
    item = np.repeat(np.arange(len(q.ids)), np.diff(q.first))
    for a in range(0, len(q.terms), STEP):
        part = slice(a, a + STEP)
        value = weight[part, None] * contribution(block.most(q.terms[part]), m)
        heads = np.flatnonzero(np.diff(item[part], prepend=-1))
        out[item[part][heads]] += np.add.reduceat(value, heads, axis=0)
    return out


def search_block(block: Block, q: Query, weight: np.ndarray, n_docs: int, n_terms: int, best: list[Best]) -> int:
    """Enter the block's documents in best; returns how many were rescored."""
    m = 10 + 90 * block.n * n_docs // n_terms
    upper, scored = bounds(block, q, weight, m), 0
    for i in np.flatnonzero(upper.max(1) >= np.array([b.floor for b in best])).tolist():
        mine = slice(q.first[i], q.first[i + 1])
        for k in np.argsort(-upper[i], kind="stable").tolist():
            if upper[i, k] < best[i].floor:
                break
            terms, counts = block.document(k)
            at = np.minimum(np.searchsorted(terms, q.terms[mine]), len(terms) - 1)
            tf = np.where(terms[at] == q.terms[mine], counts[at].astype(np.int64), 0)
            score = int((weight[mine] * contribution(tf, m[k])).sum())
            scored += 1
            if score >= best[i].floor:
                best[i].add(score, block.ids[k])
    return scored


def search(index: DataFrame, items: DataFrame, top: int = TOP, entries: int = ENTRIES) -> DataFrame:
    """item_id, rank, doc_id, score of the `top` best documents of the index for each row of items (item_id, text).

    Every row of items is a query of its own, also where ids repeat or are null; one without a term (null, empty text) has no row, and
    neither have scores of 0. Equal scores: least doc_id first, null ids last. Items are sent to the tasks in blocks of about `entries` terms,
    and each block of items passes over the index once more.
    """
    spark = index.sparkSession
    n_docs, n_terms = sizes(index)
    found, start = None, 0
    for q in item_blocks(items, entries) if n_docs else ():
        terms, at = np.unique(q.terms, return_inverse=True)
        df = frequencies(index, terms)[at]
        weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        shared = spark.sparkContext.broadcast((q, weight, n_docs, n_terms, start, top))

        def part(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q, weight, n_docs, n_terms, start, top = shared.value
            best = [Best(top) for _ in q.ids]
            for row in blocks_of(it, ("doc_ids", "n", "ends", "terms", "counts", "bits", "slices")):
                search_block(Block(row), q, weight, n_docs, n_terms, best)
            rows = [(start + i, q.ids[i], None if null else doc_id, -s) for i, b in enumerate(best) for s, null, doc_id in b.rows]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield batch(**{name: pa.array(c, pa.int64()) for name, c in zip(("_item", "item_id", "doc_id", "score"), columns, strict=True)})

        one = arrow_map(index, part, "_item long, item_id long, doc_id long, score long")
        found = one if found is None else found.unionAll(one)
        start += len(q.ids)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = stored(build(documents(spark, sf_dir)), scratch_path(spark, "index"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
