"""N-gram Jaccard join by signature trees.

A document is its set of word shingles. Equal sets are one. Two sets at or above the threshold share one of the first few shingles of
each in any fixed order. The order here begins with shingles that only one set holds, so a set that has enough of them shares nothing
it must and is done; shingles of many sets come last. Sketches tell which shingles may be held twice: they overestimate, so none is
missed, and from there on a set is shipped without the shingles that no other set holds.

Large groups of near copies are first hung on leaders (verified as well), so the rest only looks for links between documents that are
not connected yet. In a block of documents that share a key and are not all connected the documents form trees by size: a node holds the
OR of its members' bitmaps and their size range. Pairs of nodes are walked from the roots, and a pair is left when no two sets
below it can overlap enough or all are connected. Pairs that reach the leaves connect their groups to a cluster, so a block returns
fewer pairs than it holds groups, and every pair that could link lies within a cluster. A cluster of several groups is walked once
more, on the sets themselves. What is returned is connectivity: every pair of unconnected sets that could reach the threshold is walked.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketch
from .common import arrow_map, batch, cut, documents, partitions, passing
from .components import components
from .words import SPACED_LOWER, U, Slice, mix, rolling, signed, slices, words_of

WORDS = 5
PERCENT = 80
HOT_KEYS = 1 << 16
HOT_LEAST = 8
SLICE_ROWS = 4096
BLOCK_ROWS = 2048
BLOCK_SHINGLES = 1 << 20
TEXT_SLICE = 1 << 18
LEADERS = 64
LEAF = 8


def shingles(s: Slice, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a slice; a text of fewer words is one shingle, one without words none."""
    w = words_of(s, SPACED_LOWER)
    size = np.diff(w.first)
    full, _ = rolling(w, k)
    short = {n: rolling(w, n)[0] for n in range(1, k) if (size == n).any()}
    for a, n in zip(w.first[:-1].tolist(), size.tolist(), strict=True):
        yield np.unique(full[a : a + n - k + 1]) if n >= k else short[n][a : a + 1] if n else full[:0]


def prefix_length(n: int, percent: int) -> int:
    """How many first shingles must include a shared one: n less what an overlap needs at least, plus one."""
    return n - (percent * n + 99) // 100 + 1


def bitmap(h: np.ndarray, n: int | None = None) -> bytes:
    """One bit per shingle of h in four to eight times as many bits as the set's size n (64 at least, a power of two)."""
    width = max(64, 4 << int(len(h) if n is None else n).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(mix(h) & U(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def linked(x: np.ndarray, y: np.ndarray, percent: int, nx: int | None = None, ny: int | None = None) -> bool:
    """Whether two sets link; nx, ny: their sizes, where x and y leave out shingles that no other set holds."""
    nx, ny = len(x) if nx is None else nx, len(y) if ny is None else ny
    if 100 * min(nx, ny) < percent * max(nx, ny) or not len(x) or not len(y):
        return False
    if len(x) > len(y):
        x, y = y, x
    i = np.searchsorted(y, x)
    i[i == len(y)] = 0
    both = int((y[i] == x).sum())
    return 100 * both >= percent * (nx + ny - both)


class Node:
    """Members below a node: OR of bitmaps, size range, and the most shingles that share bits with others of their set."""

    __slots__ = ("bits", "lo", "hi", "excess", "children", "members", "groups")

    def __init__(self, members: list[tuple], children: list["Node"]):
        self.children, self.members = children, members
        parts = children or [Node._leaf(m) for m in members]
        bits = 0
        for p in parts:
            bits |= p[0] if isinstance(p, tuple) else p.bits
        self.bits = bits
        get = lambda i, name: [p[i] if isinstance(p, tuple) else getattr(p, name) for p in parts]
        self.lo, self.hi, self.excess = min(get(1, "lo")), max(get(2, "hi")), max(get(3, "excess"))
        groups: set = set()
        for g in get(4, "groups"):
            groups |= g
            if len(groups) > 1:
                break
        self.groups = groups

    @staticmethod
    def _leaf(m: tuple) -> tuple:
        return m[2], m[1], m[1], m[3], {m[4]}


def tree(members: list[tuple]) -> Node:
    """A tree over members (id, size, bits, excess, group) in order of size and group."""
    members = sorted(members, key=lambda m: (m[1], m[4], m[0]))
    level = [Node(members[i : i + LEAF], []) for i in range(0, len(members), LEAF)]
    while len(level) > 1:
        level = [Node([], level[i : i + LEAF]) for i in range(0, len(level), LEAF)]
    return level[0]


def fold(bits: int, width: int) -> int:
    """A bitmap of twice the width brought to width."""
    return (bits & ((1 << width) - 1)) | (bits >> width)


def narrowed(a: tuple, width: int) -> tuple:
    """A summary (bits, smallest, largest size, excess) of twice the width brought to width.

    More shingles share bits then than were counted at the full width, so no excess below the size is safe; the other side's bounds the overlap.
    """
    return fold(a[0], width), a[1], a[2], a[2]


def possible(a: tuple, b: tuple, percent: int) -> bool:
    """Whether the largest overlap of (bits, smallest, largest size, excess) allows a link; bits and excess of one width."""
    if 100 * a[2] < percent * b[1] or 100 * b[2] < percent * a[1]:
        return False
    most = min((a[0] & b[0]).bit_count() + min(a[3], b[3]), a[2], b[2])
    return (100 + percent) * most >= percent * (a[1] + b[1])


def summary(h: np.ndarray, n: int | None = None) -> tuple[tuple, int]:
    """What possible() asks of one set of size n, and the width of its bitmap."""
    n = len(h) if n is None else n
    raw = bitmap(h, n)
    bits = int.from_bytes(raw, "little")
    return (bits, n, n, len(h) - bits.bit_count()), 8 * len(raw)


def aligned(a: tuple, wa: int, b: tuple, wb: int) -> tuple[tuple, tuple]:
    """Two summaries with bitmaps of one width; widths further apart than twice belong to sizes too far apart."""
    if wa == 2 * wb:
        a = narrowed(a, wb)
    elif wb == 2 * wa:
        b = narrowed(b, wa)
    return a, b


def walk(x: Node, y: Node, wx: int, wy: int, percent: int, top: Callable[[int], int] = int) -> Iterator[tuple[int, int]]:
    """Pairs of ids of different groups below two roots that may link; wx, wy: bitmap widths; top: what a group is part of by now."""
    low = min(wx, wy)
    sx = (lambda *a: a) if wx == low else lambda *a: narrowed(a, low)
    sy = (lambda *a: a) if wy == low else lambda *a: narrowed(a, low)
    todo = [(x, y)]
    while todo:
        a, b = todo.pop()
        if len(a.groups) == 1 and len(b.groups) == 1 and len({top(g) for g in a.groups | b.groups}) == 1:
            continue
        if not possible(sx(a.bits, a.lo, a.hi, a.excess), sy(b.bits, b.lo, b.hi, b.excess), percent):
            continue
        if a is b and a.children:
            todo += [(c, d) for i, c in enumerate(a.children) for d in a.children[i:]]
        elif a.children and (not b.children or a.hi >= b.hi):
            todo += [(c, b) for c in a.children]
        elif b.children:
            todo += [(a, c) for c in b.children]
        else:
            for i, m in enumerate(a.members):
                for n in b.members[i + 1 :] if a is b else b.members:
                    if m[4] != n[4] and top(m[4]) != top(n[4]) and possible(sx(m[2], m[1], m[1], m[3]), sy(n[2], n[1], n[1], n[3]), percent):
                        yield (m[0], n[0]) if m[0] < n[0] else (n[0], m[0])


def block_pairs(rows: list[tuple], percent: int, top: Callable[[int], int] = int) -> Iterator[tuple[int, int]]:
    """Pairs of a block's rows (id, size, bitmap bytes, group, shingles in the bitmap if not all): trees by bitmap width, the largest group's
    apart from the others', each walked with itself and those of the same or the next width."""
    large = Counter(r[3] for r in rows).most_common(1)[0][0]
    by: dict[tuple[int, bool], list[tuple]] = {}
    for i, n, raw, g, *held in rows:
        bits = int.from_bytes(raw, "little")
        by.setdefault((8 * len(raw), g == large), []).append((i, n, bits, (held[0] if held else n) - bits.bit_count(), g))
    trees = [(w, tree(m)) for (w, _), m in sorted(by.items())]
    for i, (w, t) in enumerate(trees):
        for v, u in trees[i:]:
            if v in (w, 2 * w):
                yield from walk(t, u, w, v, percent, top)


def connect(rows: list[tuple], percent: int, sure: Callable[[int, int], bool]) -> Iterator[tuple[int, int]]:
    """Pairs of ids that connect the groups of a block's rows (as of block_pairs), fewer than groups: `sure` decides on two rows as they come."""
    up: dict[int, int] = {}

    def top(g: int) -> int:
        while (u := up.get(g, g)) != g:
            up[g] = up.get(u, u)
            g = u
        return g

    # rows by number: an id with several sets has several rows
    for i, j in block_pairs([(i, *r[1:]) for i, r in enumerate(rows)], percent, top):
        if sure(i, j):
            up[top(rows[i][3])] = top(rows[j][3])
            yield rows[i][0], rows[j][0]


def dealt(rows: DataFrame, percent: int) -> DataFrame:
    """Where rows (key, doc_id, v, root, n, w) of keys with several groups (root) meet: key, p, q, doc_id, v, root, a row for each place.

    Keys of many rows or shingles (w) are cut into slices. Slices of the largest group meet all slices of the others, and those meet
    each other; the largest group need not meet itself, so its rows are copied only as often as the others have slices.
    """
    per = rows.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("w").alias("w"), F.min("n").alias("least"), F.max("n").alias("most"))
    mixed = per.groupBy("key").agg(
        *(F.sum("c").alias("c"), F.sum("w").alias("w"), F.max(F.struct("c", "w", "root")).alias("large")),
        *(F.count("*").alias("groups"), F.min("least").alias("least"), F.max("most").alias("most")),
    )
    # two sets whose sizes alone rule a link out need no walk
    mixed = mixed.where((F.col("groups") > 1) & ((F.col("c") > 2) | (100 * F.col("least") >= percent * F.col("most"))))

    def parts(c, w):
        return F.greatest(F.lit(1), F.ceil(c / BLOCK_ROWS), F.ceil(w / BLOCK_SHINGLES)).cast("int")

    c, w, large = F.col("c"), F.col("w"), F.col("large")
    mixed = mixed.select("key", large["root"].alias("large"), parts(large["c"], large["w"]).alias("wide"), parts(c - large["c"], w - large["w"]).alias("rest"))
    at = F.xxhash64("doc_id", "v")
    in_large = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda q: F.struct(F.pmod(at, F.col("wide")).cast("int").alias("p"), q.alias("q")))
    own = F.pmod(at, F.col("rest")).cast("int")
    with_large = F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda p: F.struct(p.alias("p"), own.alias("q")))
    others = F.filter(F.sequence(F.lit(0), F.col("rest") - 1), lambda q: q != own)
    with_others = F.transform(others, lambda q: F.struct((F.col("wide") + F.least(q, own)).alias("p"), F.greatest(q, own).alias("q")))
    places = rows.join(mixed, "key").withColumn("at", F.explode(F.when(F.col("root") == F.col("large"), in_large).otherwise(F.concat(with_large, with_others))))
    return places.select("key", "at.p", "at.q", "doc_id", "v", "root")


def walked(places: DataFrame, sets: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Pairs (a, b) that connect the groups of each block of places (as of dealt): links, or, if not exact, pairs whose bitmaps allow one.

    sets: doc_id, v, n, w and bits, or set if exact.
    """
    spark, body = places.sparkSession, "set" if exact else "bits"

    def pairs(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        if not exact:
            return connect(rows, percent, lambda i, j: True)
        sets = [np.frombuffer(r[2], U) for r in rows]
        told = [(i, n, bitmap(h, n), g, w) for (i, n, _, g, w), h in zip(rows, sets, strict=True)]
        return connect(told, percent, lambda i, j: linked(sets[i], sets[j], percent, rows[i][1], rows[j][1]))

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rows = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            found = list(pairs(rows)) if len(rows) > 1 else []
            if found:
                yield batch(a=pa.array([x for x, _ in found], pa.int64()), b=pa.array([y for _, y in found], pa.int64()))

        for b in it:
            for key, p, q, i, n, g, w, raw in zip(*(b.column(c).to_pylist() for c in ("key", "p", "q", "doc_id", "n", "root", "w")), b.column(body), strict=True):
                if (key, p, q) != name:
                    yield from flush()
                    name, rows = (key, p, q), []
                rows.append((i, n, raw.as_py(), g, w))
        yield from flush()

    rows = places.join(sets, ["doc_id", "v"]).select("key", "p", "q", "doc_id", "n", "root", "w", body)
    return arrow_map(rows.repartition(partitions(spark), "key", "p", "q").sortWithinPartitions("key", "p", "q"), blocks, "a long, b long")


def hot_keys(sets: DataFrame) -> np.ndarray:
    """Shingles that many of the sets hold, most frequent first, at most HOT_KEYS. They only set the order of keys, never the result."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            yield batch(h=signed(h[n > 1]), n=n[n > 1])

        for b in it:
            held.append(_numbers(b.column("set")))
            size += len(held[-1])
            if size >= sketch.FLUSH:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    top = arrow_map(sets.select("set"), count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_LEAST).orderBy(F.desc("n"), "h").limit(HOT_KEYS)
    return np.sort(np.array([r["h"] for r in top.collect()], np.int64).view(U))


def _numbers(raw: pa.Array) -> np.ndarray:
    """All shingles of a column of sets."""
    return np.concatenate([np.zeros(0, U), *(np.frombuffer(x.as_buffer(), U) for x in raw)])


def _ordered(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Sorted shingles with the hot ones moved to the end."""
    if not len(hot) or not len(h):
        return h
    i = np.searchsorted(hot, h)
    i[i == len(hot)] = 0
    late = hot[i] == h
    return np.concatenate([h[~late], h[late]])


def join(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (least id reachable by links).

    Null and empty texts have no shingle and are linked with nothing. Rows with one id count as one document with all their links. A null
    id is never linked; its component is null. Other columns are ignored.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with passing(docs.sparkSession) as keep:
        return cut(_join(d, k, percent, keep))


def _join(d: DataFrame, k: int, percent: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """join() of doc_id and text; keep evaluates a table once for the steps that follow."""
    spark = d.sparkSession

    def all_shingles(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        for s in slices(b.column("text"), TEXT_SLICE):
            yield np.concatenate([np.zeros(0, U), *shingles(s, k)])

    # about one cell per shingle and row
    bits = sketch.width_bits(sketch.text_bytes(d) // 9)
    twice = spark.sparkContext.broadcast(sketch.merged(d.select("text"), all_shingles, bits))

    def describe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for s in slices(b.column("text"), TEXT_SLICE):
                sets = list(shingles(s, k))
                n = [len(h) for h in sets]
                some = twice.value(np.concatenate([np.zeros(0, U), *sets]))
                kept = [h[some[i:j]] for h, (i, j) in zip(sets, pairwise(np.cumsum([0, *n]).tolist()), strict=True)]
                left = [keys_left(m, len(x), percent) > 0 for m, x in zip(n, kept, strict=True)]
                yield batch(
                    doc_id=b.column("doc_id").slice(s.row, s.n),
                    n=np.array(n, np.int64),
                    f1=np.array([int(mix(h).sum()) if len(h) else 0 for h in sets], U).view(np.int64),
                    f2=np.array([int(mix(h ^ U(0x5851F42D4C957F2D)).sum()) if len(h) else 0 for h in sets], U).view(np.int64),
                    open=pa.array(left, pa.bool_()),
                    set=pa.array([x.tobytes() if o else b"" for x, o in zip(kept, left, strict=True)], pa.binary()),
                )

    made = keep(arrow_map(d, describe, "doc_id long, n long, f1 long, f2 long, open boolean, set binary"))
    twice.destroy()
    # equal sets are one: the least id stands for them
    whole = made.where("n > 0 and doc_id is not null")
    # frozen, so that the join below is between two plain shuffles and a large group of copies can be split
    lead = keep(whole.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep")))
    member = keep(whole.select("doc_id", "f1", "f2", "n", "open").join(lead, ["f1", "f2", "n"]).select("doc_id", "n", "open", "rep"))
    # ids with several sets: v tells their sets apart; 0 for all others
    several = whole.groupBy("doc_id").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi")).where("lo <> hi").select("doc_id", F.lit(True).alias("several"))
    firsts_ = cut(member.where("open and doc_id = rep").select("doc_id").distinct())
    look = sketch.may_hold(firsts_)
    some = whole.where("open").where(look(F.col("doc_id"))).join(firsts_, "doc_id", "left_semi").dropDuplicates(["doc_id", "f1", "f2", "n"]).join(several, "doc_id", "left")
    some = keep(some.select("doc_id", F.when(F.col("several"), F.col("f1")).otherwise(F.lit(0)).alias("v"), "n", "set"))

    # copies counted once, fewer shingles are left that two sets hold
    held = int(some.agg(F.sum(F.length("set"))).first()[0] or 0) // 8
    again = spark.sparkContext.broadcast(sketch.merged(some.select("set"), lambda b: iter([_numbers(b.column("set"))]), sketch.width_bits(held)))
    hot = spark.sparkContext.broadcast(hot_keys(some))

    def head(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for i, v, n, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "v", "n")), b.column("set"), strict=True):
                h = np.frombuffer(raw.as_buffer(), U)
                h = h[again.value(h)]
                if (m := keys_left(n, len(h), percent)) > 0:
                    keys = signed(_ordered(h, hot.value)[:m])
                    out.append((i, v, n, len(h), *firsts(keys), keys, bitmap(h, n), h.tobytes()))
            kinds = {"doc_id": pa.int64(), "v": pa.int64(), "n": pa.int64(), "w": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "keys": pa.list_(pa.int64()), "bits": pa.binary(), "set": pa.binary()}
            yield batch(**{c: pa.array([x[j] for x in out], t) for j, (c, t) in enumerate(kinds.items())})

    near = keep(arrow_map(some, head, "doc_id long, v long, n long, w long, k1 long, k2 long, keys array<long>, bits binary, set binary"))
    again.destroy()
    hot.destroy()

    # near copies mostly agree in two keys at once
    links = [_stars(near.select("doc_id", "n", "set", c), c, percent) for c in ("k1", "k2")]
    group = components(links[0].unionByName(links[1]))

    # blocks that still hold different groups are walked by bitmaps: what these do not rule out connects groups to clusters
    rooted = near.select("doc_id", "v", "n", "w", "keys").join(group.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    rooted = keep(rooted)
    keyed = rooted.select(F.explode("keys").alias("key"), "doc_id", "v", "root", "n", "w")
    maybe = walked(dealt(keyed, percent), near.select("doc_id", "v", "n", "w", "bits"), percent, False)
    known = group.select(F.col("node").alias("a"), F.col("root").alias("b"))
    cluster = components(known.unionByName(maybe))
    # every link not known yet lies within a cluster of several groups: each set goes there once and is verified
    inside = rooted.join(cluster.select(F.col("node").alias("doc_id"), F.col("root").alias("key")), "doc_id", "left").withColumn("key", F.coalesce("key", "doc_id"))
    more = walked(dealt(inside.select("key", "doc_id", "v", "root", "n", "w"), percent), near.select("doc_id", "v", "n", "w", "set"), percent, True)
    # the sets of one id link what stands for them
    ends_of = member.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("hi")).where("b <> hi").select("doc_id", "b")
    same_id = member.join(ends_of, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b")
    all_ = known.unionByName(more).unionByName(same_id)
    return _answer(made, member, components(all_))


def keys_left(n: int, held: int, percent: int) -> int:
    """How many of a set's first shingles are among the `held` of its n that another set may hold, when the others come first."""
    return prefix_length(n, percent) - (n - held) if n else 0


def _pair_of(keys: np.ndarray) -> int:
    """One number for the first two keys; 0 if there is none."""
    return int(mix(keys[:2].view(U) * np.array([1, 3], U)[: len(keys)]).sum().view(np.int64)) if len(keys) else 0


def firsts(keys: np.ndarray) -> tuple[int, int]:
    """Numbers for the first two keys in their order and in a second, unrelated order."""
    return _pair_of(keys), _pair_of(keys[np.argsort(mix(keys.view(U)))])


def _stars(sets: DataFrame, column: str, percent: int) -> DataFrame:
    """Verified links to leaders of the documents that share `column`, keys with many documents in slices of about SLICE_ROWS.

    sets: doc_id, set and the column; n, the size, where set leaves out shingles that no other set holds.
    A document that no leader of its slice matches, or that connects some, becomes one, up to LEADERS; first documents of slices meet once more.
    """
    spark = sets.sparkSession
    if "n" not in sets.columns:
        sets = sets.withColumn("n", F.expr("length(set) div 8"))
    n = sets.count()
    # at most 50,000 keys are that frequent, which bounds both broadcasts
    many = sets.groupBy(column).agg(F.count("*").alias("c")).where(F.col("c") > max(SLICE_ROWS, n // 50_000))
    sliced = sets.select("doc_id", "n", "set", column).join(F.broadcast(many), column, "left")
    sliced = sliced.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce(F.ceil(F.col("c") / SLICE_ROWS), F.lit(1))))

    def star(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, leaders, same = None, [], []
        for b in it:
            a, c = [], []
            for i, key, salt, m, raw in zip(*(b.column(x).to_pylist() for x in ("doc_id", column, "salt", "n")), b.column("set"), strict=True):
                h = np.frombuffer(raw.as_buffer(), U)
                if (key, salt) != name:
                    name, leaders, same = (key, salt), [], []
                own, width = summary(h, m)
                met: set[int] = set()
                for j, (leader, x, other, w) in enumerate(leaders):
                    if same[j] not in met and possible(*aligned(own, width, other, w), percent) and linked(h, x, percent, m, other[1]):
                        met.add(same[j])
                        a.append(i), c.append(leader)
                if met:  # leaders that this document connects count as one from now on
                    least = min(met)
                    same = [least if g in met else g for g in same]
                if len(leaders) < LEADERS and len(met) != 1:
                    same.append(min(met) if met else len(leaders))
                    leaders.append((i, h.copy(), own, width))
            yield batch(a=pa.array(a, pa.int64()), b=pa.array(c, pa.int64()))

    def run(t: DataFrame) -> DataFrame:
        return arrow_map(t.repartition(partitions(spark), column, "salt").sortWithinPartitions(column, "salt", "doc_id").select("doc_id", "n", column, "salt", "set"), star, "a long, b long")

    tops = sliced.where("c is not null").groupBy(column, "salt").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    again = sets.select("doc_id", "n", "set", column).join(F.broadcast(tops), "doc_id", "left_semi").withColumn("salt", F.lit(0).cast("long"))
    return run(sliced).unionByName(run(again))


def _answer(made: DataFrame, member: DataFrame, group: DataFrame) -> DataFrame:
    m = member.select("doc_id", "rep")
    m = m.join(group.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("root"))
    m = m.groupBy("doc_id").agg(F.min("root").alias("root"))
    return made.select("doc_id", "n").join(m, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def first_of_each(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group of near duplicates, that of the least id; repeated rows count once, rows without an id stay.

    Only rows that a filter of the ids to be looked at lets through are shuffled with their texts.
    """
    found = join(docs.select("doc_id", "text"), k, percent).where("doc_id is not null").select("doc_id", "component_id")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    again = found.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    look = sketch.may_hold(cut(gone.unionByName(again).distinct()))
    marked = docs.withColumn("__look", F.coalesce(look(F.col("doc_id").cast("long")), F.lit(False)))
    rest = marked.where("__look").join(gone.withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id"), "left_anti").dropDuplicates(["doc_id", "text"])
    return marked.where("not __look").unionByName(rest).drop("__look")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))
