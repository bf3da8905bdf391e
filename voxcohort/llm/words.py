"""Words of whole texts as arrays: bounds and 64-bit hashes of every word of an Arrow batch, without a Python loop per word.

A batch is cut between documents into slices of 256 kB, so memory does not depend on the batch; one document is
never cut. Hashes are polynomial over a byte table and then mixed; they depend on the bytes of the word alone, so every
executor computes the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_UNDO = pow(_BASE, -1, 2**64)
_GRAM = U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (splitmix finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(_BASE))
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        for k, b in enumerate((_BASE, _UNDO)):
            t = np.full(size, b, U)
            t[0] = 1
            _powers[k] = np.cumprod(t, dtype=U)
    return _powers[0], _powers[1]


class Alphabet:
    """Which bytes belong to words, and what they are folded to."""

    def __init__(self, outside: bytes, lower: bool):
        self.inside = np.ones(256, bool)
        self.inside[list(outside)] = False
        self.fold = np.arange(256, dtype=np.uint8)
        if lower:
            self.fold[65:91] += 32
        self.lower = lower


_SPACES = bytes([32, *range(9, 14)])
SPACED = Alphabet(_SPACES, False)
SPACED_LOWER = Alphabet(_SPACES, True)
ALNUM_LOWER = Alphabet(bytes([*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]), True)


@dataclass
class Slice:
    """Documents row..row+n of a batch: their bytes, and where each begins."""

    row: int
    n: int
    data: np.ndarray
    offs: np.ndarray


def slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a text column (null counts as empty) between documents; a longer document is a slice of its own."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = pc.fill_null(text, b"" if pa.types.is_binary(text.type) else "")
    n = len(text)
    if not n:
        return
    kind = np.int64 if text.type in (pa.large_string(), pa.large_binary()) else np.int32
    _, where, bytes_ = text.buffers()
    offs = np.frombuffer(where, kind)[text.offset : text.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bytes_, np.uint8) if bytes_ is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(int(np.searchsorted(offs, offs[i] + limit, "right")) - 1, i + 1)
        yield Slice(i, j - i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


@dataclass
class Words:
    """Words of a slice in order; first[d]:first[d+1] are those of document d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    doc: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash, one entry more than bytes; see range_hash."""
    pw, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * pw[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range of what prefix was made of."""
    _, undo = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * undo[start] + (end - start).astype(U))


def bounds(s: Slice, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes of a slice, where its words begin and end, and the first word of each document; a word never crosses a document's end."""
    n = len(s.data)
    data = alphabet.fold[s.data] if alphabet.lower else s.data
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = alphabet.inside[data]
    edge = np.zeros(n + 1, bool)
    edge[s.offs] = True
    here = inside[1:-1]
    start = np.flatnonzero(here & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(here & (~inside[2:] | edge[1:])) + 1
    return data, start, end, np.searchsorted(start, s.offs)


def words_of(s: Slice, alphabet: Alphabet) -> Words:
    """All words of a slice."""
    data, start, end, first = bounds(s, alphabet)
    doc = np.repeat(np.arange(s.n), np.diff(first))
    return Words(data, start, end, range_hash(prefix_hash(data), start, end), first, doc)


def rolling(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, by first word; which of them lie within one document."""
    m = len(w) - k + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, bool)
    acc = w.hash[:m].copy()
    for j in range(1, k):
        acc = acc * _GRAM + w.hash[j : j + m]
    return mix(acc + U(k)), w.doc[:m] == w.doc[k - 1 :]


def phrase_hash(words: list[str]) -> int:
    """What rolling() gives for these words (already folded), as a signed 64-bit integer."""
    text = pa.array([" ".join(words)])
    w = words_of(next(slices(text)), SPACED)
    return int(rolling(w, len(words))[0].view(np.int64)[0])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def joined(w: Words, s: Slice, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of each document joined by one space: bytes of all documents, and where each begins."""
    n = len(s.data)
    out = np.empty(n + 1, np.uint8)
    out[:n] = w.data
    change = np.zeros(n + 2, np.int8)
    kept = np.flatnonzero(keep)
    if len(kept):
        last = np.ones(len(kept), bool)
        last[:-1] = w.doc[kept[1:]] != w.doc[kept[:-1]]
        stop = w.end[kept] + ~last
        np.add.at(change, w.start[kept], 1)
        np.add.at(change, stop, -1)
        out[w.end[kept[~last]]] = 32
    take = np.cumsum(change[: n + 1]).astype(bool)
    count = np.zeros(n + 2, np.int64)
    np.cumsum(take, out=count[1:])
    return out[take], count[s.offs]
