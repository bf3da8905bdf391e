"""A prefix trie over conversations as a distributed burst trie.

A conversation is a sequence of turn entries: 16 bytes of the turn's digest (role and text) and its number of words. Entries of one turn
are equal, so a prefix of the sequence's bytes names a trie node exactly, and byte order is an order of the trie.

Equal sequences become one record first. All records then start in the container of the root. A container with more than `limit` records
bursts: its head becomes a trie node, and its records move to the containers of their next turn. Bursting goes on, one table per round,
until no container is oversized; only those that still are take part in a round. The containers that are left are shared out
by head, sorted, and swept: one pass over the sorted suffixes keeps the current path alone and lets go of a node when the path leaves
it. At last the burst heads, few and deepest first, take the sums of what hangs below them.

A conversation's entries (24 bytes a turn) are one row, as a document's text is; neither the conversations of a node nor those of a hot
sequence are ever gathered: hot sequences are spread by conversation id and arrive as chunks of their list of ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, batch, freeze, partitions
from .quality_rules import words

ENTRY = 24
LIMIT = 4096
GROUP = 20
CHUNK = 1 << 20
FLUSH = 20_000
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_EMPTY = hashlib.sha256(b"").hexdigest()


def entry(role: Column, text: Column) -> Column:
    """Digest of a turn and its number of words, as hexadecimal digits; null role or text counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return F.concat(digest, F.lpad(F.lower(F.hex(F.size(words(text)).cast("long"))), 16, "0"))


def rebuilt(conversations: DataFrame, group: int = GROUP) -> DataFrame:
    """conv_id and seq (entries, binary) of every conversation after its rebuilding.

    Turns are in the order of `turn`, null first; equal ones in the order of their entries. Conversation c gets the first h turns of
    c - c % group and then its own turns without its first h, where h is crc32 of the id's digits modulo 4. Rows without a conv_id belong to
    no conversation.
    """
    c = conversations.where("conv_id is not null").select(
        F.col("conv_id").alias("_c"), (F.col("conv_id") - F.col("conv_id") % group).alias("_base"), "turn", entry(F.col("role"), F.col("text")).alias("e")
    )
    # whole groups of ids meet in a task, so the base's turns need no second shuffle
    own = c.repartition("_base").groupBy("_base", "_c").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("some"), "turn", "e"))), lambda x: x["e"]).alias("own"))
    base = own.where("_c = _base").select("_base", F.slice("own", 1, 3).alias("lead"))
    h = (F.crc32(F.col("_c").cast("string").cast("binary")) % 4).cast("int")
    lead = F.coalesce(F.slice("lead", F.lit(1), h), F.array().cast("array<string>"))
    rest = F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))
    return own.join(base, "_base", "left").select(F.col("_c").alias("conv_id"), F.unhex(F.array_join(F.concat(lead, rest), "")).alias("seq"))


def _id_lists(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (seq, conv_id) rows: per sequence, chunks of the list of ids."""
    seq, ids, size = None, [], 0
    out: list[tuple] = []

    def chunk():
        out.append((seq, ids[0], len(ids), ",".join(map(str, ids))))

    for b in it:
        for s, c in zip(b.column("seq").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
            if s != seq or size >= CHUNK:
                if ids:
                    chunk()
                seq, ids, size = s, [], 0
            ids.append(c)
            size += 20
            if len(out) >= FLUSH or size == 20 and out and len(out[-1][3]) >= CHUNK // 4:
                yield _rows(out, ("seq", "conv_id", "n", "ids"), (pa.binary(), pa.int64(), pa.int64(), pa.string()))
                out = []
    if ids:
        chunk()
    yield _rows(out, ("seq", "conv_id", "n", "ids"), (pa.binary(), pa.int64(), pa.int64(), pa.string()))


def _rows(rows: list[tuple], names: tuple, kinds: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return batch(**{n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})


def _records(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted chunks: one record per sequence, with the digest of its whole list of ids."""
    now, out = None, []
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
    for b in it:
        for i in range(b.num_rows):
            seq, c, n, ids = (b.column(k)[i].as_py() for k in range(4))
            if now and now[0] == seq:
                now[2] += n
                now[3].update(b"," + ids.encode())
                continue
            if now:
                out.append((*now[:3], now[3].hexdigest()))
            now = [seq, c, n, hashlib.sha256(ids.encode())]
            if len(out) >= FLUSH:
                yield _rows(out, ("seq", "least", "n", "ends"), kinds)
                out = []
    if now:
        out.append((*now[:3], now[3].hexdigest()))
    yield _rows(out, ("seq", "least", "n", "ends"), kinds)


def records(sequences: DataFrame) -> DataFrame:
    """seq, least (conv_id), n and ends (digest of all ids, ascending) of each distinct sequence of (conv_id, seq)."""
    n = partitions(sequences.sparkSession)
    spread = freeze(sequences).repartitionByRange(n, "seq", "conv_id").sortWithinPartitions("seq", "conv_id").select("seq", "conv_id")
    lists = arrow_map(spread, _id_lists, "seq binary, conv_id long, n long, ids string")
    return freeze(arrow_map(lists.repartition(n, "seq").sortWithinPartitions("seq", "conv_id"), _records, "seq binary, least long, n long, ends string"))


class _Node:
    __slots__ = ("least", "n", "children", "n_children", "leaves", "saved", "words", "ends")

    def __init__(self, words: int):
        self.least, self.n, self.children, self.n_children, self.leaves, self.saved, self.words, self.ends = None, 0, [], 0, 0, 0, words, _EMPTY


def _sweep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of sorted containers (d, up, seq, least, n, ends); those of a container's head also name their parent's bytes.

    Holds the path of the record at hand, and of its nodes the children that were already left: at most the records of one container.
    """
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "above")
    kinds = (*[pa.int64()] * 7, pa.string(), pa.binary())
    out: list[tuple] = []
    path: list[_Node] = []
    d, up, last = 0, None, None

    def leave(to: int) -> None:
        """Let go of the path's nodes beyond the first `to`."""
        while len(path) > to:
            x, depth = path.pop(), d + len(path)
            x.leaves = x.leaves or 1
            x.saved += (x.n - 1) * x.words
            out.extend((c[0], depth + 1, x.least, *c[1:], None) for c in x.children)
            row = (x.least, x.n, x.n_children, x.leaves, x.saved, x.ends)
            if path:
                p = path[-1]
                p.children.append(row)
                p.n_children += 1
                p.leaves += x.leaves
                p.saved += x.saved
            else:
                out.append((row[0], d, up, *row[1:], last[: ENTRY * (d - 1)] if d else None))

    for b in it:
        for d_, up_, seq, least, n, ends in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
            if last is None or d_ != d or seq[: ENTRY * d] != last[: ENTRY * d]:
                leave(0)
                d, up, last = d_, up_, seq
                path.append(_Node(int.from_bytes(seq[ENTRY * d - 8 : ENTRY * d], "big") if d else 0))
            else:
                k = d
                while ENTRY * (k + 1) <= min(len(seq), len(last)) and seq[ENTRY * k : ENTRY * (k + 1)] == last[ENTRY * k : ENTRY * (k + 1)]:
                    k += 1
                leave(k - d + 1)
                last = seq
            for k in range(d + len(path), len(seq) // ENTRY + 1):
                path.append(_Node(int.from_bytes(seq[ENTRY * k - 8 : ENTRY * k], "big")))
            for x in path:
                x.least = least if x.least is None else min(x.least, least)
                x.n += n
            path[-1].ends = ends
            if len(out) >= FLUSH:
                yield _rows(out, names, kinds)
                out = []
    leave(0)
    yield _rows(out, names, kinds)


def trie(sequences: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Nodes of the trie of (conv_id, seq): smallest member, depth, parent's smallest member (root: null), members, children, leaves of the
    subtree, words saved in the subtree by storing shared turns once, and SHA-256 of the ids that end at the node.

    A conv_id is given once. Without conversations there is no node; conversations without turns are members of the root, and end there.
    """
    spark = sequences.sparkSession
    n = partitions(spark)
    head = lambda d: F.substring("seq", F.lit(1), F.lit(ENTRY) * d)
    open_ = records(sequences).select(F.lit(0).alias("d"), F.lit(None).cast("long").alias("up"), "seq", "least", "n", "ends")
    closed, burst = [], []
    while True:
        keyed = open_.withColumn("head", head(F.col("d")))
        ends_here = F.when(F.length("seq") == ENTRY * F.col("d"), F.col("ends"))
        sums = keyed.groupBy("head").agg(F.count("*").alias("size"), F.min("least").alias("conv_id"), F.sum("n").alias("n_convs"), F.min("up").alias("up"), F.max(ends_here).alias("ends"))
        over = freeze(sums.where(F.col("size") > limit).drop("size"))
        if over.isEmpty():
            closed.append(open_)
            break
        burst.append(over)
        moved = keyed.join(over.select("head", F.col("conv_id").alias("_up")), "head", "left")
        closed.append(moved.where("_up is null").select(*open_.columns))
        # what ends at a head that bursts is counted there and moves no further
        open_ = freeze(moved.where((F.col("_up").isNotNull()) & (F.length("seq") > ENTRY * F.col("d"))).select((F.col("d") + 1).alias("d"), F.col("_up").alias("up"), "seq", "least", "n", "ends"))
    held = closed[0]
    for c in closed[1:]:
        held = held.unionAll(c)
    dealt = held.repartition(n, "d", head(F.col("d"))).sortWithinPartitions("d", "seq")
    swept = arrow_map(dealt, _sweep, f"{NODES}, above binary")
    if not burst:
        return swept.drop("above")
    swept = freeze(swept)
    out, below = swept, swept.where("above is not null")
    for d in range(len(burst) - 1, -1, -1):
        under = below.where(F.col("depth") == d + 1).groupBy(F.col("above").alias("head")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
        own = (F.col("n_convs") - 1) * (F.conv(F.hex(F.substring("head", ENTRY * d - 7, 8)), 16, 10).cast("long") if d else F.lit(0))
        heads = freeze(
            burst[d].join(under, "head").select(
                "conv_id", F.lit(d).cast("long").alias("depth"), F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                (F.col("saved") + own).alias("saved_tokens"), F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256"), (F.substring("head", 1, ENTRY * (d - 1)) if d else F.lit(None).cast("binary")).alias("above"),
            )
        )
        out = out.unionAll(heads)
        below = below.unionAll(heads)
    return out.drop("above")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
