"""Repeated byte windows by a radix sort of suffixes that stops at the threshold.

Every start of a `size`-byte window is a suffix of which only the first `size` bytes matter. The first digit is the window's anchor: its
least `anchor`-byte gram, with its place in the window. Equal windows have equal anchors, and neighbouring windows share one, so a bucket
is shipped as one row per anchor with the bytes around it instead of one row per byte. Buckets of anchors that occur once are
dropped by a count-min sketch. Inside a bucket, most-significant-digit passes of eight bytes split the suffixes and drop what stands
alone; what is still together after the last digit are exactly the repeated windows.

Rows of one anchor with the same bytes around it need no sort: all but the first are repeated throughout. A task settles those it sees
before anything is shuffled, so a passage that most documents share arrives as one row per part. A bucket with more than
`bucket_rows` different surroundings is not sorted in its task but sent on window by window, by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from . import sketch
from .common import arrow_map, batch, cut, documents, partitions
from .substring_dedup import _own, covered, runs
from .words import U, mix, prefix_hash, range_hash, signed, slices

SIZE = 100
ANCHOR = 32
BUCKET_ROWS = 20_000
LATE_ROWS = 10_000
_PLACE = U(31)


def anchors(prefix: np.ndarray, offs: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, anchor place, first and last window start it serves, for all windows that lie within a document."""
    n = len(prefix) - 1
    w = size - gram + 1
    if n < size:
        return (np.zeros(0, U), *[np.zeros(0, np.int64)] * 3)
    at = np.arange(n - gram + 1)
    h = range_hash(prefix, at, at + gram)
    m = (h >> _PLACE << _PLACE) | at.astype(U)
    span = 1
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < w:
        m = np.minimum(m[: len(m) - (w - span)], m[w - span :])
    # starts in the last size - 1 bytes of a document have no window of their own
    short = np.zeros(len(m) + 1, np.int32)
    lo = np.maximum(offs[1:] - size + 1, offs[:-1])
    np.add.at(short, np.minimum(lo, len(m)), 1)
    np.add.at(short, np.minimum(offs[1:], len(m)), -1)
    s = np.flatnonzero(np.cumsum(short[:-1]) == 0)
    if not len(s):
        return (np.zeros(0, U), *[np.zeros(0, np.int64)] * 3)
    p = (m[s] & U((1 << 31) - 1)).astype(np.int64)
    head = np.flatnonzero((np.diff(p, prepend=-1) != 0) | (np.diff(s, prepend=-9) != 1))
    return h[p[head]], p[head], s[head], s[np.append(head[1:], len(s)) - 1]


def repeated(data: np.ndarray, start: np.ndarray, group: np.ndarray, size: int) -> np.ndarray:
    """Group number of each suffix after all digits, -1 where it stands alone. Suffixes of different groups never meet."""
    words = np.ndarray(max(0, len(data) - 7), ">u8", data.tobytes(), strides=(1,)) if len(data) > 7 else np.zeros(0, ">u8")
    live, grp = np.arange(len(start)), group
    for digit in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
        key = words[start[live] + digit].astype(U)
        order = np.lexsort((key, grp))
        g, k = grp[order], key[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
        number = np.cumsum(new) - 1
        many = np.bincount(number)[number] > 1 if len(number) else np.zeros(0, bool)
        live, grp = live[order[many]], number[many]
        if not len(live):
            break
    out = np.full(len(start), -1, np.int64)
    out[live] = grp
    return out


def _emit(doc: np.ndarray, sig: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of covered starts."""
    if not len(doc):
        return
    order = np.lexsort((pos, sig, doc))
    doc, sig, pos = doc[order], sig[order], pos[order]
    row = np.cumsum((np.diff(doc, prepend=0) != 0) | (np.diff(sig, prepend=0) != 0))
    r, p, n = runs(row, pos)
    at = np.searchsorted(row, r)
    yield _row(doc_id=doc[at], sig=sig[at], pos=p, len=n)


_SCHEMA = "bucket long, around long, doc_id long, sig long, pos long, len long, place int, bytes binary"


def _row(**c) -> pa.RecordBatch:
    n = len(c["doc_id"])
    kinds = {"place": pa.int32(), "bytes": pa.binary()}
    return batch(**{k: pa.array(c[k], kinds.get(k, pa.int64())) if k in c else pa.nulls(n, kinds.get(k, pa.int64())) for k in ("bucket", "around", "doc_id", "sig", "pos", "len", "place", "bytes")})


def _spread(pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and window start of each window of rows with n windows from pos."""
    row = np.repeat(np.arange(len(n)), n)
    return row, pos[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def marks(docs: DataFrame, size: int = SIZE, gram: int = ANCHOR, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Runs of window starts that also start earlier: doc_id, sig (hash of the text), pos, len."""
    if not 8 <= gram <= size:
        raise ValueError("8 <= gram <= size")
    d = _own(docs).where("doc_id is not null")
    spark = docs.sparkSession

    def all_anchors(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        for s in slices(b.column("text")):
            yield anchors(prefix_hash(s.data), s.offs, size, gram)[0]

    bits = sketch.width_bits(2 * sketch.text_bytes(d) // (size - gram + 2))
    twice = spark.sparkContext.broadcast(sketch.merged(d.select("text"), all_anchors, bits))

    def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, around, doc, sig, pos, n, place = (np.concatenate(x) for x in list(zip(*held, strict=True))[:7])
            data = [x[7] for x in held]
            order = np.lexsort((pos, doc, around, h))
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (around[order][1:] != around[order][:-1])
            head = order[np.flatnonzero(new)]
            lead = head[np.cumsum(new) - 1]
            late = order[(doc[order] != doc[lead]) | (pos[order] != pos[lead])]
            # window by window they take far more memory than as rows; by document, so that few runs are cut
            late = late[np.lexsort((pos[late], sig[late], doc[late]))]
            for k in range(0, len(late), LATE_ROWS):
                at = late[k : k + LATE_ROWS]
                row, start = _spread(pos[at], n[at])
                yield from _emit(doc[at][row], sig[at][row], start)
            flat = [y for x in data for y in x]
            # in small batches: a large one is held here and, outside the heap, by its reader
            for k in range(0, len(head), sketch.ROWS // 10):
                at = head[k : k + sketch.ROWS // 10]
                yield _row(bucket=signed(h[at]), around=signed(around[at]), doc_id=doc[at], sig=sig[at], pos=pos[at], len=n[at], place=place[at], bytes=[flat[i] for i in at.tolist()])

        for b in it:
            did, sig = b.column("doc_id").to_numpy(), b.column("sig").to_numpy()
            for s in slices(b.column("text")):
                prefix = prefix_hash(s.data)
                h, p, lo, hi = anchors(prefix, s.offs, size, gram)
                at = np.flatnonzero(twice.value(h))
                h, p, lo, hi = h[at], p[at], lo[at], hi[at]
                row = np.searchsorted(s.offs, lo, "right") - 1
                around = range_hash(prefix, lo, hi + size) + mix((p - lo).astype(U))
                raw = s.data.tobytes()
                held.append((h, around, did[row + s.row], sig[row + s.row], lo - s.offs[row], hi - lo + 1, (p - lo).astype(np.int32), [raw[i:j] for i, j in zip(lo.tolist(), (hi + size).tolist(), strict=True)]))
                count += len(h)
                if count >= sketch.FLUSH // 20:
                    yield from flush()
                    held, count = [], 0
        if count:
            yield from flush()

    def sort(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        wide: tuple | None = None  # bucket, surroundings, first document and start, while a bucket is sent on window by window

        def pieces(t: pa.Table, lead: tuple | None) -> Iterator[pa.RecordBatch]:
            """Complete buckets, or (with lead) a part of one that is too wide to sort here."""
            c = {name: t.column(name).to_numpy() for name in ("bucket", "around", "doc_id", "sig", "pos", "len")}
            new = np.ones(t.num_rows, bool)
            new[1:] = (c["bucket"][1:] != c["bucket"][:-1]) | (c["around"][1:] != c["around"][:-1])
            # rows that repeat the surroundings of the first row with them are covered throughout
            first_at = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            ld, lp = c["doc_id"][first_at], c["pos"][first_at]
            if lead is not None and lead[1] == c["around"][0]:
                same = first_at == 0
                ld, lp = np.where(same, lead[2], ld), np.where(same, lead[3], lp)
                new[0] = False
            late = np.flatnonzero((c["doc_id"] != ld) | (c["pos"] != lp))
            row, start = _spread(c["pos"][late], c["len"][late])
            yield from _emit(c["doc_id"][late][row], c["sig"][late][row], start)
            lone = np.flatnonzero(new)
            if lead is None:
                # a bucket with one kind of surroundings is settled
                heads = c["bucket"][lone]
                _, back, kinds = np.unique(heads, return_inverse=True, return_counts=True)
                lone = lone[kinds[back] > 1]
            if not len(lone):
                return
            col = t.column("bytes").combine_chunks().take(pa.array(lone))
            col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
            s = next(slices(col, 1 << 40))
            row, start = _spread(np.zeros(len(lone), np.int64), c["len"][lone])
            where = s.offs[row] + start
            doc, sig, pos = c["doc_id"][lone][row], c["sig"][lone][row], c["pos"][lone][row] + start
            if lead is not None:
                key = range_hash(prefix_hash(s.data), where, where + size)
                yield _row(bucket=signed(key), doc_id=doc, sig=sig, pos=pos, len=np.ones(len(pos), np.int64))
                return
            place = t.column("place").to_numpy()[lone][row] - start
            _, bucket = np.unique(c["bucket"][lone], return_inverse=True)
            grp = repeated(s.data, where, bucket[row] * (size + 1) + place, size)
            at = np.flatnonzero(grp >= 0)
            at = at[np.lexsort((pos[at], doc[at], grp[at]))]
            head = np.ones(len(at), bool)
            head[1:] = grp[at][1:] != grp[at][:-1]
            lead_at = at[np.flatnonzero(head)][np.cumsum(head) - 1] if len(at) else at
            at = at[(doc[at] != doc[lead_at]) | (pos[at] != pos[lead_at])]
            yield from _emit(doc[at], sig[at], pos[at])

        for b in it:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([carry, t]) if carry is not None else t
            carry = None
            if not t.num_rows:
                continue
            key = t.column("bucket").to_numpy()
            if wide is not None:
                end = int(np.searchsorted(key != wide[0], True)) if key[0] == wide[0] else 0
                if end:
                    yield from pieces(t.slice(0, end), wide)
                    wide = _last(t.slice(0, end), wide)
                if end == t.num_rows:
                    continue
                wide, t, key = None, t.slice(end), key[end:]
            cut_at = int(np.flatnonzero(key == key[-1])[0])
            if cut_at:
                yield from pieces(t.slice(0, cut_at), None)
            carry = t.slice(cut_at)
            if carry.num_rows > bucket_rows:
                yield from pieces(carry, (key[-1], None, 0, 0))
                wide, carry = _last(carry, None), None
        if carry is not None:
            yield from pieces(carry, None)

    rows = arrow_map(d, first, _SCHEMA)
    near = rows.where("bucket is null").select("doc_id", "sig", "pos", "len")
    far = rows.where("bucket is not null").repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "around", "doc_id", "pos")
    done = cut(arrow_map(far, sort, _SCHEMA).select("bucket", "doc_id", "sig", "pos", "len").unionByName(near.withColumn("bucket", F.lit(None).cast("long"))))
    twice.destroy()
    wide = done.where("bucket is not null")
    least = wide.groupBy("bucket").agg(F.min(F.struct("doc_id", "pos")).alias("least"))
    late = wide.join(least, "bucket").where(F.struct("doc_id", "pos") > F.col("least")).select("doc_id", "sig", "pos", "len")
    return done.where("bucket is null").drop("bucket").unionByName(late)


def _last(t: pa.Table, lead: tuple | None) -> tuple:
    """State after a part of a wide bucket: its key, the surroundings of its last row, and the first row with those."""
    around = t.column("around").to_numpy()
    i = int(np.flatnonzero(around == around[-1])[0])
    if i == 0 and lead is not None and lead[1] == around[0]:
        return lead
    return t.column("bucket")[i].as_py(), int(around[-1]), t.column("doc_id")[i].as_py(), t.column("pos")[i].as_py()


def remove(docs: DataFrame, size: int = SIZE, gram: int = ANCHOR, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay) and kept_text (without characters cut in two) appended.

    A byte goes if a window of `size` bytes over it also starts earlier: in a smaller id, or earlier in the same id. Null texts are
    empty. Rows with one id are ordered by start alone. Rows with a null id are neither earlier nor cut.
    """
    m = marks(docs, size, gram, bucket_rows).groupBy(F.col("doc_id").alias("__id"), F.col("sig").alias("__sig")).agg(F.collect_list(F.struct("pos", "len")).alias("__runs"))
    base = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text")
    d = base.join(m, (base["doc_id"].cast("long") == m["__id"]) & (F.xxhash64(base["text"]) == m["__sig"]), "left").drop("__id", "__sig")
    out = base.schema.fields

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            marked = b.column("__runs")
            for s in slices(b.column("text")):
                cols: dict[str, list] = {"n_bytes": np.diff(s.offs), "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": [], "kept_text": []}
                for i in range(s.n):
                    data = s.data[s.offs[i] : s.offs[i + 1]]
                    x = marked[s.row + i]
                    gone = spans = 0
                    if x.is_valid:
                        off = covered(len(data), x.values.field("pos").to_numpy(), x.values.field("len").to_numpy() + size - 1)
                        gone, spans = int(off.sum()), int((np.diff(off.astype(np.int8), prepend=0) == 1).sum())
                        data = data[~off]
                    raw = data.tobytes()
                    for c, v in zip(("n_removed", "n_spans", "kept_sha256", "kept", "kept_text"), (gone, spans, hashlib.sha256(raw).hexdigest(), raw, raw.decode("utf-8", "ignore")), strict=True):
                        cols[c].append(v)
                kinds = {"n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary(), "kept_text": pa.string()}
                yield batch(**{f.name: b.column(f.name).slice(s.row, s.n) for f in out}, n_bytes=cols["n_bytes"], **{c: pa.array(cols[c], k) for c, k in kinds.items()})

    kinds = [("n_bytes", LongType()), ("n_removed", LongType()), ("n_spans", LongType()), ("kept_sha256", StringType()), ("kept", BinaryType()), ("kept_text", StringType())]
    return arrow_map(d, run, StructType([*out, *(StructField(n, k) for n, k in kinds)]))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(documents(spark, sf_dir).select("doc_id", "text")).drop("text", "kept", "kept_text")
