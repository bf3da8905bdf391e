"""Token ids of whole texts by the tokenizers library, each distinct word encoded once per worker while it is remembered.

Some tokenizers drop white space and never join across it (word_bpe_49k is one): the ids of a text are those of its words in
order. For them a worker keeps the ids of words it has met in a table of fixed size (about HELD bytes, at most `limit` words), a
word at the place its 64-bit hash gives; a word met more often than the newcomers stays. A run of punctuation behind a letter is
a word of its own and capitals are folded where neither can change an id, so fewer words are distinct. All this changes the
time, never the ids. Other tokenizers encode whole texts.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

from .words import SPACED, Slice, U, Words, bounds, prefix_hash, range_hash

END_ID = 1
HELD = 16 << 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PLACE = 14  # bytes of a place of the table: hash, where its ids begin, their number, how often met
_GROUP = 500
_SPARE = 1 << 16  # ids of new words stand here until those that stay are stored
_open: dict[tuple, "WordIds"] = {}


def _pairs() -> np.ndarray:
    """By first and second byte: Latin, Greek and Cyrillic letters of two bytes that stay letters when normalised and lower-cased."""
    out = np.zeros((256, 256), bool)
    for c in map(chr, range(0x80, 0x530)):
        if c.isalpha() and unicodedata.normalize("NFC", c).lower().isalpha():
            out[tuple(c.encode())] = True
    return out


_PAIR = _pairs()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def drops_space(rules: dict) -> bool:
    """Whether white space only separates: the rules split words off, each piece of a word ends in a marked token, and letters alone spell no added token."""
    steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = any(s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"] for s in steps)
    added = [t["content"] for t in rules.get("added_tokens", [])]
    return bool(rules["model"].get("end_of_word_suffix")) and split and not any(re.search(r"\s", t) or re.fullmatch("[A-Za-z]*", t) for t in added)


def folds(rules: dict) -> bool:
    """Whether capitals and small letters are the same to the rules."""
    rule = rules.get("normalizer") or {}
    return any(s["type"] == "Lowercase" for s in rule.get("normalizers", [rule]) if s)


def trailing(rules: dict) -> np.ndarray:
    """By byte: ASCII punctuation that no added token holds."""
    out = np.zeros(256, bool)
    out[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
    out[[c for t in rules.get("added_tokens", []) for c in t["content"].encode()]] = False
    return out


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Ranges of an array one after the other."""
    stop = np.cumsum(size, dtype=np.int64)
    return data[np.repeat(start - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]


def parts_of(s: Slice, trail: np.ndarray, fold: bool) -> tuple[Words, np.ndarray]:
    """Words of a slice, a run of `trail` behind a letter as one of its own, and which of them are of known letters only (one piece).

    Capitals are folded in words of letters where no mark can follow: it could make another letter of the capital than of the
    small one.
    """
    data, first, last, begin = bounds(s, SPACED)
    n = len(data)
    good = _LETTER[data]
    pair = np.flatnonzero(data[:-1] >= 0xC3)
    pair = pair[_PAIR[data[pair], data[pair + 1]]]
    good[pair] = good[pair + 1] = True
    core = last.copy()
    some = np.flatnonzero(trail[data[last - 1]])
    for _ in range(4):
        core[some] -= 1
        some = some[(core[some] > first[some]) & trail[data[core[some] - 1]]]
    if len(some):
        solid = np.append(-1, np.flatnonzero(~trail[data]))
        core[some] = solid[np.searchsorted(solid, core[some]) - 1] + 1
    core = np.where((core > first) & good[core - 1], core, last)
    bad = np.zeros(n + 1, np.int32)
    np.cumsum(~good, out=bad[1:])
    plain = bad[core] == bad[first]
    if fold:
        up = np.flatnonzero(data - np.uint8(65) < 26)
        up = up[(data[np.minimum(up + 1, n - 1)] < 128) & plain[np.searchsorted(first, up, "right") - 1]]
        data = data.copy()
        data[up] += 32
    tail = core < last
    start, end, one = first, core, plain
    if tail.any():
        at = np.arange(len(first)) + np.cumsum(tail) - tail
        m = len(first) + int(tail.sum())
        start, end, one = np.empty(m, np.int64), np.empty(m, np.int64), np.zeros(m, bool)
        start[at], end[at], one[at] = first, core, plain
        start[at[tail] + 1], end[at[tail] + 1] = core[tail], last[tail]
        begin = np.append(at, m)[begin]
    return Words(data, start, end, range_hash(prefix_hash(data), start, end), begin, np.repeat(np.arange(s.n), np.diff(begin))), one


class WordIds:
    """Encoder of one worker; see the module."""

    def __init__(self, path: str, limit: int):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path) as f:
            rules = json.load(f)
        self.by_word = drops_space(rules)
        if self.by_word:
            suffix = rules["model"]["end_of_word_suffix"]
            self.ends = np.zeros(self.tok.get_vocab_size() + 1, bool)
            self.ends[[i for w, i in self.tok.get_vocab().items() if w.endswith(suffix)]] = True
            self.fold, self.trail = folds(rules), trailing(rules)
            places = 1 << (max(1, min(limit, HELD // 2 // _PLACE)).bit_length() - 1)
            self.hash, self.at = np.zeros(places, U), np.zeros(places, np.int32)
            self.len, self.met = np.zeros(places, np.uint8), np.zeros(places, np.uint8)
            self.room = (HELD - places * _PLACE) // 4
            self.pool, self.used = np.zeros(self.room + _SPARE, np.uint32), 0

    def _tidy(self) -> None:
        """Close the gaps that replaced words left among the ids. If that leaves less than a quarter free, the words met least are forgotten."""
        held = np.flatnonzero(self.met)
        held = held[np.argsort(self.met[held], kind="stable")[::-1]]
        fit = int(np.searchsorted(np.cumsum(self.len[held], dtype=np.int64), self.room * 3 // 4, "right"))
        self.met[held[fit:]] = 0
        held = held[:fit]
        flat = gather(self.pool, self.at[held], self.len[held])
        self.at[held] = np.cumsum(self.len[held], dtype=np.int64) - self.len[held]
        self.pool[: len(flat)], self.used = flat, len(flat)

    def _store(self, hashes: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        """Remember distinct words as far as there is room. A word that holds a place is met once less; a newcomer gets the place when that was the last time."""
        place = (hashes & U(len(self.hash) - 1)).astype(np.int64)
        free = self.met[place] <= 1
        self.met[place[~free]] -= 1
        one = np.flatnonzero(free & (size < 256))
        _, k = np.unique(place[one], return_index=True)
        one = one[k]
        if self.used + int(size[one].sum()) > self.room:
            self._tidy()
        one = one[: int(np.searchsorted(np.cumsum(size[one]), self.room - self.used, "right"))]
        ids = gather(flat, (np.cumsum(size) - size)[one], size[one])
        at = self.used + np.cumsum(size[one]) - size[one]
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        p = place[one]
        self.hash[p], self.at[p], self.len[p], self.met[p] = hashes[one], at, size[one], 1

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order in which words were encoded, their ids one after the other, and how many each has.

        Words of letters only are one piece each, so many are encoded as one text and cut behind marked tokens.
        """
        order, flat, sizes = [], [], []

        def alone(which: np.ndarray) -> None:
            ids = self._ids([data[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(start[which].tolist(), end[which].tolist(), strict=True)])
            order.append(which)
            flat.extend(np.array(x, np.uint32) for x in ids)
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))

        one = np.flatnonzero(plain)
        if len(one):
            size = end[one] - start[one] + 1
            stop = np.cumsum(size)
            text = gather(np.append(data, np.uint8(32)), start[one], size)
            text[stop - 1] = 32
            raw, cuts = text.tobytes(), [0, *stop[_GROUP - 1 : -1 : _GROUP].tolist(), int(stop[-1])]
            for k, got in enumerate(self._ids([raw[i:j].decode() for i, j in zip(cuts[:-1], cuts[1:], strict=True)])):
                which, ids = one[k * _GROUP : (k + 1) * _GROUP], np.array(got, np.uint32)
                last = np.flatnonzero(self.ends[ids])
                if len(last) == len(which) and last[-1] == len(ids) - 1:
                    order.append(which)
                    flat.append(ids)
                    sizes.append(np.diff(last, prepend=-1))
                else:
                    alone(which)
        if not plain.all():
            alone(np.flatnonzero(~plain))
        return np.concatenate(order), np.concatenate(flat), np.concatenate(sizes)

    def encode(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a slice, each followed by END_ID, and where each document begins."""
        if not self.by_word:
            raw, o = s.data.tobytes(), s.offs
            texts = [raw[o[i] : o[i + 1]].decode("utf-8", "replace") for i in range(s.n)]
            ids = [[*x, END_ID] for x in self._ids(texts)]
            return np.array([x for y in ids for x in y], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        w, plain = parts_of(s, self.trail, self.fold)
        place = (w.hash & U(len(self.hash) - 1)).astype(np.int64)
        known = (self.hash[place] == w.hash) & (self.met[place] > 0)
        size, at = self.len[place].astype(np.int64), self.at[place].astype(np.int64)
        pool, learned = self.pool, None
        new = np.flatnonzero(~known)
        if len(new):
            uniq, one, inv = np.unique(w.hash[new], return_index=True, return_inverse=True)
            one = new[one]
            order, flat, sizes = self._learn(w.data, w.start[one], w.end[one], plain[one])
            learned = uniq[order], flat, sizes
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            size[new] = sizes[back][inv]
            at[new] = self.used + (np.cumsum(sizes) - sizes)[back][inv]
            if self.used + len(flat) > len(pool):
                pool = np.concatenate([pool[: self.used], flat])
            pool[self.used : self.used + len(flat)] = flat
        stop = np.cumsum(size)
        ids = np.full((int(stop[-1]) if len(stop) else 0) + s.n, END_ID, np.uint32)
        ids[np.arange(len(ids) - s.n) + np.repeat(w.doc, size)] = gather(pool, at, size)
        hit = place[known]
        self.met[hit] += self.met[hit] < 255  # once a slice, however often the word stands in it
        if learned:
            self._store(*learned)
        return ids, np.append(0, stop)[w.first] + np.arange(s.n + 1)


def encoder(path: str, limit: int = 2_000_000) -> WordIds:
    """The worker's encoder for a vocabulary file, kept between tasks."""
    key = (path, limit)
    if key not in _open:
        _open[key] = WordIds(path, limit)
    return _open[key]
