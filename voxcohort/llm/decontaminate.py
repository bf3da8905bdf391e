"""Benchmark decontamination by retrieval.

The test items are an inverted index with BM25 impacts, divided by each item's own full score, so one threshold serves all items.
Every passage of every text is a query, answered by block-max WAND: lists are skipped by term bounds, then by block bounds, and
every item at or above the threshold comes back. Hits are verified by the share of the item's question and answer word trigrams that
the passage holds; where the answer is too short for a share to mean much, the share of the whole item's trigrams does as well. Upper
bounds over all items spare hopeless queries: a passage is queried only if its words could reach the threshold together, and its
trigrams the shares of some question and of some answer, or of some item with a short answer. The index is built in blocks of items with a byte bound; all texts
are queried against each block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, batch, documents, freeze
from .words import ALNUM_LOWER, Slice, Words, rolling, slices, words_of

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.6
# an answer of so many distinct trigrams keeps 0.6 of them when one word is changed; a shorter one may not
ANSWER_GRAMS = 8
BLOCK_ITEMS = 16
INDEX_BYTES = 32 << 20
_SLOTS = 20
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


def question_answer(text: str) -> tuple[str, str]:
    """An item's last sentence is its answer, what precedes it the question; a single sentence is both."""
    parts = [p for p in _SENTENCE.split(text.strip()) if p.strip()]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def _grams(text: str) -> tuple[int, np.ndarray]:
    """Word trigrams of a text, or the whole text if it is shorter; with the number of words in a gram."""
    w = words_of(next(slices(pa.array([text]))), ALNUM_LOWER)
    k = min(3, len(w))
    return k, np.unique(rolling(w, k)[0]) if k else np.zeros(0, np.uint64)


_NONE = (0, np.zeros(0, np.uint64))


@dataclass
class Postings:
    items: list[int]
    impact: list[float]
    last: list[int]
    peak: list[float]
    bound: float


@dataclass
class Index:
    ids: np.ndarray
    terms: np.ndarray
    lists: list[Postings]
    slot: np.ndarray
    longest: int
    question: list[tuple[int, np.ndarray]]
    answer: list[tuple[int, np.ndarray]]
    whole: list[tuple[int, np.ndarray]]
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass
class Corpus:
    """Of all items with a word: their number, mean and largest length in words; and the frequencies of a block's terms among all items."""

    n: int
    mean: float
    longest: int
    terms: np.ndarray
    df: np.ndarray


def build(ids: list[int], texts: list[str | None], every: Corpus | None = None) -> Index | None:
    """Index of items; items without a word are left out, None if none remains. every: what all items hold, if these are only some."""
    s = [x for x in slices(pa.array([t or "" for t in texts], pa.string()), 1 << 40)]
    if not s:
        return None
    w = words_of(s[0], ALNUM_LOWER)
    size = np.diff(w.first)
    keep = np.flatnonzero(size)
    if not len(keep):
        return None
    pair, tf = np.unique(np.stack([w.hash, w.doc.astype(np.uint64)], 1), axis=0, return_counts=True)
    terms, start, df = np.unique(pair[:, 0], return_index=True, return_counts=True)
    every = every or Corpus(len(keep), float(size[keep].mean()), int(size.max()), terms, df)
    n, mean = every.n, every.mean
    among = every.df[np.searchsorted(every.terms, terms)]
    idf = np.log(1 + (n - among + 0.5) / (among + 0.5))
    item = pair[:, 1].astype(np.int64)
    impact = np.repeat(idf, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / mean))
    impact /= np.bincount(item, impact, minlength=len(ids))[item]
    lists = []
    for a, k in zip(start.tolist(), df.tolist(), strict=True):
        x, v = item[a : a + k], impact[a : a + k]
        cuts = np.arange(0, k, BLOCK_ITEMS)
        lists.append(Postings(x.tolist(), v.tolist(), x[np.minimum(cuts + BLOCK_ITEMS, k) - 1].tolist(), np.maximum.reduceat(v, cuts).tolist(), float(v.max())))
    slot = np.zeros(1 << _SLOTS, np.float32)
    np.maximum.at(slot, (terms >> np.uint64(64 - _SLOTS)).astype(np.int64), np.array([p.bound for p in lists], np.float32))
    qa = [question_answer(t or "") for t in texts]
    question, answer = [_grams(q) for q, _ in qa], [_grams(a) for _, a in qa]
    whole = [_grams(t or "") if k < 3 or len(g) < ANSWER_GRAMS else _NONE for t, (k, g) in zip(texts, answer, strict=True)]
    # of every gram, the largest share of a question, of an answer and of a whole item that it can be; a question or answer without words always counts as held
    grams = {}
    for k in (1, 2, 3):
        g = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for n, x in question + answer + whole if n == k)]))
        if len(g):
            most = np.zeros((3, len(g)))
            for side, qa_ in enumerate((question, answer, whole)):
                for n, x in qa_:
                    if n == k:
                        at = np.searchsorted(g, x)
                        most[side, at] = np.maximum(most[side, at], 1 / len(x))
            seen = np.zeros(1 << _SLOTS, bool)
            seen[(g >> np.uint64(64 - _SLOTS)).astype(np.int64)] = True
            grams[k] = (g, seen, most)
    return Index(np.array(ids, np.int64), terms, lists, slot, every.longest, question, answer, whole, grams)


def block_max_wand(lists: list[Postings], threshold: float) -> list[tuple[int, float]]:
    """All items whose summed impacts reach the threshold."""
    out = []
    cur = [[p.items[0], 0, p] for p in lists]  # item, position, list
    while cur:
        cur.sort(key=lambda c: c[0])
        total, pivot = 0.0, -1
        for i, c in enumerate(cur):
            total += c[2].bound
            if total >= threshold - 1e-9:
                pivot = i
                break
        if pivot < 0:
            break
        target = cur[pivot][0]
        while pivot + 1 < len(cur) and cur[pivot + 1][0] == target:
            pivot += 1
        peak, reach = 0.0, 1 << 62
        for c in cur[: pivot + 1]:
            p, b = c[2], c[1] // BLOCK_ITEMS
            while b < len(p.last) and p.last[b] < target:
                b += 1
            if b < len(p.last):
                peak += p.peak[b]
                reach = min(reach, p.last[b])
        if peak >= threshold - 1e-9:
            if cur[0][0] == target:
                score = sum(c[2].impact[c[1]] for c in cur[: pivot + 1])
                if score >= threshold - 1e-9:
                    out.append((target, score))
                goal, moved = target + 1, cur[: pivot + 1]
            else:
                goal, moved = target, [c for c in cur[: pivot + 1] if c[0] < target]
        else:
            beyond = cur[pivot + 1][0] if pivot + 1 < len(cur) else 1 << 62
            goal, moved = max(min(reach + 1, beyond), target + 1 if reach >= 1 << 62 else 0), cur[: pivot + 1]
        for c in moved:
            p, at = c[2], c[1]
            b = at // BLOCK_ITEMS
            while b < len(p.last) and p.last[b] < goal:
                b += 1
                at = b * BLOCK_ITEMS
            while at < len(p.items) and p.items[at] < goal:
                at += 1
            c[1] = at
            c[0] = p.items[at] if at < len(p.items) else -1
        cur = [c for c in cur if c[0] >= 0]
    return out


def hits(index: Index, s: Slice, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[int, int, float, float, float, int]]:
    """(document, item, score, question share, answer share, first word of the passage), the best passage per document and item.

    Passages are twice the longest item and start one longest item apart, so every copy of an item lies within one.
    """
    w: Words = words_of(s, ALNUM_LOWER)
    if not len(w):
        return []
    bound = np.concatenate([[0.0], np.cumsum(index.slot[(w.hash >> np.uint64(64 - _SLOTS)).astype(np.int64)], dtype=np.float64)])
    size = np.diff(w.first)
    many = np.maximum(1, -(-size // index.longest) - 1) * (size > 0)
    doc = np.repeat(np.arange(s.n), many)
    a = w.first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * index.longest
    b = np.minimum(a + 2 * index.longest, w.first[doc + 1])
    live = bound[b] - bound[a] >= threshold - 1e-6
    if overlap > 0:
        could = np.zeros((3, len(doc)))
        for side, qa in enumerate((index.question, index.answer)):
            could[side] = 1.0 if any(not k for k, _ in qa) else 0.0
        for k, (known, seen, most) in index.grams.items():
            g, ok = rolling(w, k)
            at = np.flatnonzero(ok & seen[(g >> np.uint64(64 - _SLOTS)).astype(np.int64)])
            i = np.minimum(np.searchsorted(known, g[at]), len(known) - 1)
            at, i = at[known[i] == g[at]], i[known[i] == g[at]]
            lo_, hi_ = np.searchsorted(at, a), np.searchsorted(at, np.maximum(b - k + 1, a))
            for side in (0, 1, 2):
                run = np.concatenate([[0.0], np.cumsum(most[side, i])])
                could[side] += run[hi_] - run[lo_]
        could = could >= overlap - 1e-6
        live &= (could[0] & could[1]) | could[2]
    best: dict[tuple[int, int], tuple] = {}
    for i in np.flatnonzero(live).tolist():
        lo, hi = int(a[i]), int(b[i])
        h = np.unique(w.hash[lo:hi])
        t = np.searchsorted(index.terms, h)
        t[t == len(index.terms)] = 0
        found = block_max_wand([index.lists[x] for x in t[index.terms[t] == h].tolist()], threshold)
        if not found:
            continue
        part = Words(w.data, w.start[lo:hi], w.end[lo:hi], w.hash[lo:hi], np.array([0, hi - lo]), np.zeros(hi - lo, np.int64))
        grams = {k: rolling(part, k)[0] for k in index.grams}
        for item, score in found:
            share = [float(np.isin(g, grams[k]).mean()) if k else 1.0 for k, g in (index.question[item], index.answer[item])]
            k, g = index.whole[item]
            if min(share) >= overlap or (k and float(np.isin(g, grams[k]).mean()) >= overlap):
                key = (int(doc[i]), item)
                if key not in best or best[key][2] < score:
                    best[key] = (*key, score, *share, lo - int(w.first[doc[i]]))
    return sorted(best.values())


def _terms(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice of items: each term and how many of them hold it; and, with a null term, items with a word, all their words and the most of one."""
    for b in it:
        for s in slices(b.column("text")):
            w = words_of(s, ALNUM_LOWER)
            size = np.diff(w.first)
            pair = np.unique(np.stack([w.hash, w.doc.astype(np.uint64)], 1), axis=0)
            term, df = np.unique(pair[:, 0], return_counts=True)
            yield batch(
                term=pa.array([None, *term.view(np.int64).tolist()], pa.int64()), df=np.append((size > 0).sum(), df).astype(np.int64),
                words=np.append(size.sum(), np.zeros(len(df), np.int64)), longest=np.append(size.max(initial=0), np.zeros(len(df), np.int64)),
            )


def index_blocks(items: DataFrame, index_bytes: int) -> Iterator[Index]:
    """Indexes of blocks of items, each of about index_bytes of text at most; only one block is on the driver at a time.

    Every block is weighed with the lengths and term frequencies of all items, so scores do not depend on how the items are cut.
    """
    items = items.where("item_id is not null").select(F.col("item_id").cast("long"), "text")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(size) // index_bytes + 1
    if blocks > 1:
        counted = "term long, df long, words long, longest long"
        freq = freeze(arrow_map(items.select("text"), _terms, counted).groupBy("term").agg(*(F.sum(c).alias(c) for c in ("df", "words")), F.max("longest").alias("longest")))
        n, words, longest = freq.where("term is null").select("df", "words", "longest").first() or (0, 0, 0)
    for i in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i)
        rows = sorted(block.collect(), key=lambda r: r["item_id"])
        every = None
        if rows and blocks > 1 and n:
            own = arrow_map(block.select("text"), _terms, counted).where("term is not null").select("term").distinct()
            got = freq.join(own, "term", "left_semi").select("term", "df").toArrow()
            terms, df = got.column("term").to_numpy().view(np.uint64), got.column("df").to_numpy()
            order = np.argsort(terms)
            every = Corpus(n, words / n, longest, terms[order], df[order])
        if rows and (index := build([r["item_id"] for r in rows], [r["text"] for r in rows], every)):
            yield index


def find(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Verified leaks: doc_id, item_id, score, question_overlap, answer_overlap, first_word; a row per document row and item.

    Both overlaps reach `overlap`, or the answer has fewer than ANSWER_GRAMS trigrams and the whole item's overlap does.
    Null or empty texts and items match nothing. Rows that repeat are answered one by one. No items: no rows.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
    out = spark.createDataFrame([], schema)
    for index in index_blocks(items, index_bytes):
        shared = spark.sparkContext.broadcast(index)

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ix = shared.value
            for b in it:
                did = b.column("doc_id")
                for s in slices(b.column("text")):
                    if got := hits(ix, s, threshold, overlap):
                        c = list(zip(*got, strict=True))
                        yield batch(
                            doc_id=did.take(pa.array(np.array(c[0]) + s.row)), item_id=ix.ids[list(c[1])], score=np.array(c[2]), question_overlap=np.array(c[3]),
                            answer_overlap=np.array(c[4]), first_word=np.array(c[5], np.int64),
                        )

        out = out.union(arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, schema))
    return out


def remove(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs without the rows that hold a verified leak; nothing is shuffled."""
    spark = docs.sparkSession
    for index in index_blocks(items, index_bytes):
        shared = spark.sparkContext.broadcast(index)

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in it:
                keep = np.ones(b.num_rows, bool)
                for s in slices(b.column("text")):
                    keep[[s.row + h[0] for h in hits(shared.value, s, threshold, overlap)]] = False
                yield b.filter(pa.array(keep))

        docs = arrow_map(docs, run, docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
