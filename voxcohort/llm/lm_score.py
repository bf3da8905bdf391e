"""Language-model scores from an Elias-Fano n-gram trie that is as large as the corpus asks and never whole in one place.

Documents are dealt to chunks. A chunk sends its distinct words and word pairs with their training counts, packed per shard of words;
that is at once what the model is trained on and what the chunk will ask of it. A shard adds the counts up, smooths them, and builds
its part of the trie: first words in order, pointers to their successors and the successors themselves as monotone sequences in
Elias-Fano form, probabilities in eight bits, all in a memory-mapped file. It answers every chunk's questions by successor search
within the context's range, and a chunk scores its documents from the answers.

Smoothing: p(w | v) = max(c(vw) - D, 0) / (c(v) + K) + (K + D T(v)) / (c(v) + K) p(w), T(v) the successors of v, and p(w) the
add-0.1 unigram. Words are 64-bit hashes; successors are told apart within their context by 32 bits.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, documents, freeze, held_out, partitions
from .sketch import text_bytes
from .words import SPACED_LOWER, U, slices, words_of

D, K = 0.75, 20.0
ADD = 0.1
CHUNK_BYTES = 8 << 20
SHARD_BYTES = 16 << 20
_END, _START = U(0x9FB21C651E98DF25), U(0x2545F4914F6CDD1D)
_STEPS = 8.0


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary; built into a file and mapped back."""

    def __init__(self, values: np.ndarray, file):
        n = len(values)
        top = int(values[-1]) if n else 0
        self.n, self.low = n, max(0, (top // max(n, 1)).bit_length() - 1)
        lows = values & U((1 << self.low) - 1)
        bits = np.unpackbits(lows.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, count=self.low, bitorder="little") if n and self.low else np.zeros(0, np.uint8)
        high = (values >> U(self.low)).astype(np.int64)
        unary = np.zeros((int(high[-1]) if n else 0) + n + 1, np.uint8)
        unary[high + np.arange(n)] = 1
        self._low = _mapped(file, np.concatenate([np.packbits(bits.reshape(-1), bitorder="little"), np.zeros(8, np.uint8)]))
        self._high = _mapped(file, np.packbits(unary, bitorder="little"))
        self.size = len(unary)

    def open(self) -> "EliasFano":
        """Directories for search: place of each value, and first value of each high part."""
        unary = np.unpackbits(self._high, count=self.size, bitorder="little")
        self.ones = np.flatnonzero(unary)
        zeros = np.flatnonzero(unary == 0)
        self.bucket = np.concatenate([[0], zeros - np.arange(len(zeros))])
        self.words = np.ndarray(max(0, len(self._low) - 7), "<u8", self._low, strides=(1,))
        return self

    def get(self, i: np.ndarray) -> np.ndarray:
        out = (self.ones[i] - i).astype(U) << U(self.low)
        if self.low:
            at = i * self.low
            out |= (self.words[at >> 3].astype(U) >> (at & 7).astype(U)) & U((1 << self.low) - 1)
        return out

    def successor(self, x: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of the first value >= x, by halving within the values of its high part; end bounds the answer."""
        h = np.minimum((x >> U(self.low)).astype(np.int64), len(self.bucket) - 1)
        lo, hi = np.minimum(self.bucket[h], end), np.minimum(self.bucket[np.minimum(h + 1, len(self.bucket) - 1)], end)
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            less = self.get(mid) < x[todo]
            lo[todo[less]] = mid[less] + 1
            hi[todo[~less]] = mid[~less]
            todo = todo[lo[todo] < hi[todo]]
        return lo


def _mapped(file, a: np.ndarray) -> np.ndarray:
    """The array written to the end of a file and mapped from there."""
    file.seek(0, 2)
    at = file.tell()
    file.write(a.tobytes())
    file.flush()
    return np.memmap(file, np.uint8, "r", at, (len(a) * a.itemsize,)).view(a.dtype) if len(a) else a


def quantise(p: np.ndarray) -> np.ndarray:
    """Probabilities as codes 1..255, eight to a factor of two; 0 is none."""
    return np.where(p > 0, np.clip(np.rint(-np.log2(np.maximum(p, 1e-300)) * _STEPS) + 1, 1, 255), 0).astype(np.uint8)


def restore(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 2.0 ** (-(code.astype(np.float64) - 1) / _STEPS), 0.0)


class Trie:
    """Two levels over one shard: words, and successors of each word."""

    def __init__(self, words: np.ndarray, count: np.ndarray, degree: np.ndarray, after: np.ndarray, pair_count: np.ndarray, d: float, k: float):
        self.file = tempfile.TemporaryFile()
        total = np.add.reduceat(np.append(pair_count, 0), np.minimum(np.cumsum(degree) - degree, len(pair_count))) * (degree > 0) if len(degree) else np.zeros(0)
        row = np.repeat(np.arange(len(words)), degree)
        self.first = EliasFano(words - words[0] if len(words) else words, self.file).open()
        self.base = words[0] if len(words) else U(0)
        self.pointer = EliasFano(np.concatenate([[0], np.cumsum(degree)]).astype(U), self.file).open()
        # a successor is stored relative to its context: context number, then 32 bits
        self.next = EliasFano((row.astype(U) << U(32)) | after.astype(U), self.file).open()
        self.count = _mapped(self.file, count.astype(np.int64))
        self.value = _mapped(self.file, quantise(np.maximum(pair_count - d, 0) / (total[row] + k)))
        self.back = _mapped(self.file, quantise((k + d * degree) / (total + k)))

    def word(self, h: np.ndarray) -> np.ndarray:
        """Number of each word, -1 where it is not there."""
        n = self.first.n
        if not n:
            return np.full(len(h), -1)
        x = h - self.base
        i = self.first.successor(x, np.full(len(h), n))
        ok = (h >= self.base) & (i < n)
        ok[ok] = self.first.get(i[ok]) == x[ok]
        return np.where(ok, i, -1)

    def pair(self, word: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Code of each successor of a word number, 0 where it was not seen."""
        out = np.zeros(len(word), np.uint8)
        at = np.flatnonzero(word >= 0)
        lo, hi = self.pointer.get(word[at]).astype(np.int64), self.pointer.get(word[at] + 1).astype(np.int64)
        x = (word[at].astype(U) << U(32)) | after[at].astype(U)
        i = np.maximum(self.next.successor(x, hi), lo)
        ok = i < hi
        ok[ok] = self.next.get(i[ok]) == x[ok]
        out[at[ok]] = self.value[i[ok]]
        return out


@dataclass
class Chunk:
    """Tokens of a chunk's documents: distinct words and pairs, and each token's place among them."""

    doc: np.ndarray
    size: np.ndarray
    words: np.ndarray
    word: np.ndarray
    context: np.ndarray
    pairs: np.ndarray
    pair: np.ndarray


def read_chunk(t: pa.Table) -> Chunk:
    parts, row = [], 0
    for s in slices(t.column("text")):
        w = words_of(s, SPACED_LOWER)
        tok = np.empty(len(w) + s.n, U)
        before = np.empty(len(w) + s.n, U)
        at = np.arange(len(w)) + w.doc
        ends = w.first[1:] + np.arange(s.n)
        tok[at], tok[ends] = w.hash, _END
        before[1:] = tok[:-1]
        before[w.first[:-1] + np.arange(s.n)] = _START
        parts.append((tok, before, np.repeat(np.arange(s.n) + row, np.diff(w.first) + 1), np.diff(w.first) + 1))
        row += s.n
    if not parts:
        parts = [(np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    tok, before, doc, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    words, inv = np.unique(np.concatenate([tok, [_START]]), return_inverse=True)
    word = inv[:-1]
    context = np.where(before == _START, inv[-1], np.concatenate([[0], word[:-1]]) if len(word) else word)
    pairs, pair = np.unique((context.astype(U) << U(32)) | (tok >> U(32)), return_inverse=True)
    return Chunk(doc, size, words, word, context, pairs, pair)


def _cuts(c: Chunk, shard_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shards that a chunk's words fall in, with bounds in its words and pairs."""
    shard = (c.words >> U(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(c.words), np.int64)
    some = np.unique(shard)
    lo = np.append(np.searchsorted(shard, some), len(shard))
    return some, lo, np.searchsorted((c.pairs >> U(32)).astype(np.int64), lo)


_WIDTHS = {1: np.dtype(np.uint8), 4: np.dtype("<u4"), 8: np.dtype("<u8")}


def _small(x: np.ndarray) -> bytes:
    """Counts in the fewest of 1, 4 or 8 bytes that all fit in, after a byte that says which."""
    top = int(x.max()) if len(x) else 0
    n = 1 if top < 1 << 8 else 4 if top < 1 << 32 else 8
    return bytes([n]) + x.astype(_WIDTHS[n]).tobytes()


def _counts(raw: pa.Buffer) -> np.ndarray:
    return np.frombuffer(raw, _WIDTHS[raw[0]], offset=1).astype(np.int64)


_ASK = "chunk long, shard int, words binary, count binary, degree binary, after binary, pair_count binary"
_REPLY = "chunk long, shard int, count binary, back binary, value binary, tokens long, distinct long"


def score(docs: DataFrame, held: Column, d: float = D, k: float = K, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The rows where `held` is true teach nothing. Null or empty texts are one end token. Repeated rows count and are answered each.
    """
    spark = docs.sparkSession
    size = text_bytes(docs)
    n_chunks = int(max(1, -(-size // chunk_bytes), min(partitions(spark), -(-size // (1 << 20)))))
    bits = int(max(0, np.ceil(np.log2(max(1, size / shard_bytes)))))
    if size > (1 << 20):
        bits = max(bits, int(np.log2(partitions(spark))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).alias("chunk"))

    def ask(key: tuple, t: pa.Table) -> pa.Table:
        c = read_chunk(t)
        learn = ~np.asarray(t.column("held_out"))[c.doc]
        count = np.bincount(c.word[learn], minlength=len(c.words)).astype("<u4")
        pair_count = np.bincount(c.pair[learn], minlength=len(c.pairs)).astype("<u4")
        degree = np.bincount((c.pairs >> U(32)).astype(np.int64), minlength=len(c.words)).astype("<u4")
        after = c.pairs.astype("<u4")
        some, a, b = _cuts(c, bits)
        blob = lambda x, e, put=np.ndarray.tobytes: pa.array([put(x[i:j]) for i, j in zip(e[:-1].tolist(), e[1:].tolist(), strict=True)], pa.binary())
        return pa.Table.from_batches([batch(
            chunk=np.full(len(some), key[0].as_py()), shard=some.astype(np.int32), words=blob(c.words, a), count=blob(count, a, _small),
            degree=blob(degree, a, _small), after=blob(after, b), pair_count=blob(pair_count, b, _small),
        )])

    def answer(key: tuple, t: pa.Table) -> pa.Table:
        col = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in t.column(name).combine_chunks()]
        words, after = col("words", "<u8"), col("after", "<u4")
        count, degree, pair_count = ([_counts(x.as_buffer()) for x in t.column(n).combine_chunks()] for n in ("count", "degree", "pair_count"))
        every, inv = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(inv, np.concatenate(count), len(every)).astype(np.int64)
        pair = (np.repeat(inv, np.concatenate(degree)).astype(U) << U(32)) | np.concatenate(after).astype(U)
        pairs, back = np.unique(pair, return_inverse=True)
        seen = np.bincount(back, np.concatenate(pair_count), len(pairs)).astype(np.int64)
        live = pairs[seen > 0]
        row = (live >> U(32)).astype(np.int64)
        known = np.flatnonzero((total > 0) | (np.bincount(row, minlength=len(every)) > 0))
        trie = Trie(every[known], total[known], np.bincount(row, minlength=len(every))[known], live.astype(np.uint32), seen[seen > 0], d, k)
        out: dict[str, list] = {"count": [], "back": [], "value": []}
        for w, g, a in zip(words, degree, after, strict=True):
            i = trie.word(w.astype(U))
            out["count"].append(_small(np.where(i >= 0, trie.count[i] if trie.first.n else 0, 0)))
            out["back"].append(np.where(i >= 0, trie.back[i] if trie.first.n else 1, 1).astype(np.uint8).tobytes())
            out["value"].append(trie.pair(np.repeat(i, g), a).tobytes())
        n = len(words)
        stat = np.zeros((2, n), np.int64)
        real = every != _START
        stat[:, 0] = total[real].sum(), (total[real] > 0).sum()
        return pa.Table.from_batches([batch(chunk=t.column("chunk").combine_chunks(), shard=t.column("shard").combine_chunks(), **{c: pa.array(v, pa.binary()) for c, v in out.items()}, tokens=stat[0], distinct=stat[1])])

    replies = freeze(rows.groupBy("chunk").applyInArrow(ask, _ASK).groupBy("shard").applyInArrow(answer, _REPLY))
    n_train, vocabulary = (int(x or 0) for x in replies.agg(F.sum("tokens"), F.sum("distinct")).first())
    whole = n_train + ADD * (vocabulary + 1)

    def finish(key: tuple, t: pa.Table, r: pa.Table) -> pa.Table:
        c = read_chunk(t)
        r = r.sort_by("shard")
        col = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in r.column(name).combine_chunks())])
        count = np.concatenate([np.zeros(0, np.int64), *(_counts(x.as_buffer()) for x in r.column("count").combine_chunks())])
        back, value = restore(col("back", np.uint8)), restore(col("value", np.uint8))
        single = (count + ADD) / whole
        p1 = single[c.word]
        p = value[c.pair] + back[c.context] * p1
        n = t.num_rows
        add = lambda x: np.bincount(c.doc, x, n)
        return pa.Table.from_batches([batch(
            doc_id=t.column("doc_id").combine_chunks(), held_out=t.column("held_out").combine_chunks(), n_tokens=c.size, n_known=add(count[c.word] > 0).astype(np.int64),
            train_tokens=np.full(n, n_train), base_score=add(np.log10(p1)), score=add(np.log10(np.minimum(p, 1.0))),
        )])

    reply = replies.select("chunk", "shard", "count", "back", "value")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("chunk").cogroup(reply.groupBy("chunk")).applyInArrow(finish, schema)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), held_out("doc_id", 10))
