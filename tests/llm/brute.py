"""Plain statements of what the operators return, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def crc(ids):
    import numpy as np

    return zlib.crc32(np.array(ids, "<u4").tobytes())


def near_components(docs):
    """doc_id -> (set size, component) by all pairs."""
    sets = {}
    for i, t in docs:
        w = words(t, True)
        sets[i] = frozenset([tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in ids}


def window_dedup(docs, size=13):
    """doc_id -> (words, removed, sha256)."""
    first = {}
    for i, t in sorted(docs):
        w = words(t)
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    out = {}
    for i, t in docs:
        w = words(t)
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


def byte_dedup(docs, size=100):
    """doc_id -> (bytes, removed, spans, sha256)."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        off = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if b[k : k + size] in seen:
                off[k : k + size] = b"\1" * size
            seen.add(b[k : k + size])
        kept = bytes(c for c, o in zip(b, off) if not o)
        out[i] = (len(b), sum(off), sum(1 for k in range(len(off)) if off[k] and (k == 0 or not off[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def bigram_scores(docs, d, k):
    """doc_id -> (tokens, known, N, base, score) of the interpolated model without quantisation."""
    uni, bi, ctx, after, toks = Counter(), Counter(), Counter(), Counter(), {}
    for i, t in docs:
        w = toks[i] = [*words(t, True), None]
        if zlib.crc32(str(i).encode()) % 10:
            uni.update(w)
            for a, b in zip([0, *w], w):
                after[a] += not bi[a, b]
                bi[a, b] += 1
                ctx[a] += 1
    n = sum(uni.values())
    z = n + 0.1 * (len(uni) + 1)
    out = {}
    for i, w in toks.items():
        base = sum(math.log10((uni[x] + 0.1) / z) for x in w)
        score = 0.0
        for a, b in zip([0, *w], w):
            score += math.log10((max(bi[a, b] - d, 0) + (k + d * after[a]) * (uni[b] + 0.1) / z) / (ctx[a] + k))
        out[i] = (len(w), sum(uni[x] > 0 for x in w), n, base, score)
    return out


def quality_base(text):
    """(words, characters in words, symbols, repeated lines, words in repeated 5-word windows)."""
    w = [x.decode() for x in words(text)]
    many = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    inside = set()
    for k in range(len(w) - 4):
        if many[tuple(w[k : k + 5])] > 1:
            inside.update(range(k, k + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


_ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def phrase_places(text, phrases):
    """(words, places, smallest, largest start, labels)."""
    w = [x.decode() for x in _ALNUM.findall((text or "").encode().lower())]
    at, labels = [], set()
    for label, p in phrases:
        p = p.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                at.append(k)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def license_labels(text, templates, phrases, k=3, slack=3, cover=0.7, stretch=1.5):
    """(labels, score) by plain diagonal voting: merged diagonals, distinct template positions."""
    w = [x.decode() for x in _ALNUM.findall((text or "").encode().lower())]
    *_, base = phrase_places(text, phrases)
    labels, score = set(base.split(",")) - {""}, 1.0 if base else 0.0
    for label, t in templates:
        t = t.split()
        grams = len(t) - k + 1
        at = {}
        for j in range(grams):
            at.setdefault(tuple(t[j : j + k]), []).append(j)
        diagonals = {}
        for p in range(len(w) - k + 1):
            for j in at.get(tuple(w[p : p + k]), ()):
                diagonals.setdefault(p - j, []).append((p, j))
        spans, last = [], None
        for d in sorted(diagonals):
            if last is None or d - last > slack:
                spans.append([])
            spans[-1] += diagonals[d]
            last = d
        for s in spans:
            share = len({j for _, j in s}) / grams
            score = max(score, share)
            if share >= cover and max(p for p, _ in s) - min(p for p, _ in s) + 1 <= math.ceil(grams * stretch):
                labels.add(label)
    return ",".join(sorted(labels)), score
