"""Hierarchical language identification.

A first linear support vector machine per language family decides the family; inside it, one machine per pair of its languages
votes for the language. Features are frequencies of hashed byte trigrams of the folded text, so a text of any length is scored whole
in one pass: per trigram one weight is looked up and summed. Only the fit sees labels; it runs on a bounded sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import arrow_map, batch, documents, give_back, held_out
from .words import Alphabet, Slice, slices

UNKNOWN = "und"
DIMS = 1 << 12
PER_LANGUAGE = 1000
SAMPLE_ROWS = 64_000

# Families of ISO 639-1 codes. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "uralic": ("et", "fi", "hu"),
}
FAMILY_OF = {code: f for f, codes in FAMILIES.items() for code in codes}

_FOLD = Alphabet(bytes([*range(0, 65), *range(91, 97), *range(123, 128)]), True)
_LETTER = re.compile(r"[^\W\d_]")
_MULT = np.uint32(0x9E3779B1)


def trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature of each byte's trigram (non-letters as one blank, runs of blanks skipped), where each document's begin, and whether it has an ASCII letter."""
    inside = _FOLD.inside[data]
    low = np.where(inside, _FOLD.fold[data], 32).astype(np.uint32)
    ascii_ = inside & (data < 128)
    n = len(low)
    pad = np.concatenate([low, np.full(2, 32, np.uint32)])
    code = (pad[:n] << np.uint32(16)) | (pad[1 : n + 1] << np.uint32(8)) | pad[2 : n + 2]
    ok = pad[:n] + pad[1 : n + 1] != 64
    # trigrams that reach into the next document are left out
    for back in (1, 2):
        at = offs[1:] - back
        ok[at[at >= 0]] = False
    code = ((code * _MULT) >> np.uint32(32 - DIMS.bit_length() + 1)).astype(np.int64)
    count = np.concatenate([[0], np.cumsum(ok)])
    letters = np.concatenate([[0], np.cumsum(ascii_)])[offs]
    return code[ok], count[offs], np.diff(letters) > 0


@dataclass
class Machine:
    """One weight per feature and a bias; the margin of a text is the mean weight of its trigrams plus the bias."""

    weight: np.ndarray
    bias: float


def fit_machine(x: np.ndarray, y: np.ndarray, c: float = 1000.0, steps: int = 300) -> Machine:
    """Linear machine with squared hinge loss by accelerated gradient descent; classes weigh the same, y is +1 or -1."""
    scale = np.float32(np.sqrt(x.shape[1]))
    share = (0.5 / np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum()))).astype(np.float32)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):  # largest curvature by power iteration
        v = x.T @ (share * (x @ v))
        size = float(np.linalg.norm(v))
        v /= max(size, 1e-30)
    rate = np.float32(1.0 / (1.0 + 2.5 * c * (size * float(scale) ** 2 + 1)))
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    pw, pb = w, b
    for t in range(1, steps + 1):
        k = np.float32((t - 1) / (t + 2))
        vw, vb = w + k * (w - pw), b + k * (b - pb)
        slack = np.maximum(0, 1 - y * (scale * (x @ vw) + vb)) * y * share
        pw, pb = w, b
        w = vw - rate * (vw - np.float32(2 * c) * scale * (slack @ x))
        b = vb + rate * np.float32(2 * c) * slack.sum()
    return Machine((w * scale).astype(np.float64), float(b))


@dataclass
class Model:
    languages: list[str]
    families: list[str]
    by_family: dict[str, Machine]
    by_pair: dict[tuple[str, str], Machine]

    def predict(self, margin: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language, and the probability taken as family times weakest pair, for margins of n texts."""
        squash = lambda m: 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))
        if len(self.families) > 1:
            f = np.stack([squash(margin[x]) for x in self.families])
            sure = f / f.sum(0)
        else:
            sure = np.ones((len(self.families), n))
        best = sure.argmax(0)
        lang, score = np.zeros(n, np.int64), sure.max(0)
        for k, fam in enumerate(self.families):
            own = [i for i, x in enumerate(self.languages) if FAMILY_OF.get(x, x) == fam]
            rows = best == k
            if len(own) == 1:
                lang[rows] = own[0]
                continue
            wins, weak = np.zeros((len(own), n)), np.ones((len(own), n))
            for i, j in combinations(range(len(own)), 2):
                p = squash(margin[self.languages[own[i]], self.languages[own[j]]])
                wins[i] += (p >= 0.5) + 1e-3 * p
                wins[j] += (p < 0.5) + 1e-3 * (1 - p)
                weak[i], weak[j] = np.minimum(weak[i], p), np.minimum(weak[j], 1 - p)
            pick = wins.argmax(0)
            lang[rows] = np.array(own)[pick[rows]]
            score[rows] *= weak[pick[rows], np.flatnonzero(rows)]
        return lang, score

    @property
    def machines(self) -> list[tuple]:
        return [*self.by_family.items(), *self.by_pair.items()]


def fit(rows: DataFrame, per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on at most per_language texts of each language, fewer if more than sample_rows came together: those with the least hash of the id.

    Every value of lang is learned, from one text at least.
    rows: doc_id, text, lang. Rows without label or text do not take part. None if no row is left. The sample's feature
    vectors (trigram ids and counts) are all the driver receives, so its size is bounded by the two parameters.
    """
    some = rows.where("text is not null and lang is not null")
    kinds = [(r[0], r[1]) for r in some.groupBy("lang").count().collect()]
    if not kinds:
        return None
    per_language = max(1, min(per_language, sample_rows // len(kinds)))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id")
    # hashes are even, so twice the share that is wanted and some more holds the least ones, and no language's rows meet in one task
    share = rows.sparkSession.createDataFrame([(v, (2.0 * per_language + 64) / n) for v, n in kinds], "lang string, share double")
    keyed = some.select("doc_id", "lang", F.xxhash64("doc_id").alias("draw")).join(F.broadcast(share), "lang")
    keyed = keyed.where(F.col("draw") / F.lit(2.0**64) + 0.5 <= F.col("share"))
    picked = keyed.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).select("doc_id", "lang").distinct()
    sample = some.join(F.broadcast(picked), ["doc_id", "lang"], "left_semi").select("lang", "text")

    def features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for s in slices(b.column("text")):
                code, first, _ = trigrams(s.data, s.offs)
                out = []
                for d in range(s.n):
                    count = np.bincount(code[first[d] : first[d + 1]], minlength=DIMS)
                    at = np.flatnonzero(count)
                    out.append((at.astype(np.uint16).tobytes(), (count[at] / max(1, count.sum())).astype(np.float32).tobytes()))
                yield batch(lang=b.column("lang").slice(s.row, s.n), at=pa.array([x[0] for x in out], pa.binary()), share=pa.array([x[1] for x in out], pa.binary()))

    got = sorted((r["lang"], bytes(r["at"]), bytes(r["share"])) for r in arrow_map(sample, features, "lang string, at binary, share binary").toLocalIterator())
    got = [g for g in got if g[1]]
    if not got:
        return None
    x = np.zeros((len(got), DIMS), np.float32)
    for i, (_, at, share) in enumerate(got):
        x[i, np.frombuffer(at, np.uint16)] = np.frombuffer(share, np.float32)
    lang = np.array([g[0] for g in got])
    languages = sorted(set(lang.tolist()))
    family = np.array([FAMILY_OF.get(v, v) for v in lang.tolist()])
    families = sorted(set(family.tolist()))
    sign = lambda t: np.where(t, 1.0, -1.0).astype(np.float32)
    by_family = {f: fit_machine(x, sign(family == f)) for f in families} if len(families) > 1 else {}
    by_pair = {}
    for a, b in combinations(languages, 2):
        if FAMILY_OF.get(a, a) == FAMILY_OF.get(b, b):
            rows_ = (lang == a) | (lang == b)
            by_pair[a, b] = fit_machine(x[rows_], sign(lang[rows_] == a))
    # the driver would hold what the sample took for all that follows
    del got, x
    give_back()
    return Model(languages, families, by_family, by_pair)


def _lettered(s: Slice, some: np.ndarray) -> np.ndarray:
    """Whether each text of a slice has a letter; some: those known to have an ASCII letter."""
    for d in np.flatnonzero(~some):
        raw = s.data[s.offs[d] : s.offs[d + 1]].tobytes().decode("utf-8", "replace")
        some[d] = _LETTER.search(raw) is not None
    return some


def with_letters(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs whose text has a letter; text as in predict."""
    column, _, field = text.partition(".")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keep = np.zeros(b.num_rows, bool)
            for s in slices(b.column(column).field(field) if field else b.column(column)):
                keep[s.row : s.row + s.n] = _lettered(s, trigrams(s.data, s.offs)[2])
            yield b.filter(pa.array(keep))

    return arrow_map(docs, run, docs.schema)


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score appended; only the text is looked at.

    `und` with score 0 where the text is null or has no letter (or nothing was learned). Columns of these names in docs are replaced.
    text may be a field of a struct column, as column.field.
    """
    column, _, field = text.partition(".")
    docs = docs.drop("lang_pred", "score")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            label: list[str] = []
            prob: list[np.ndarray] = []
            texts = b.column(column).field(field) if field else b.column(column)
            for s in slices(texts):
                code, first, lettered = trigrams(s.data, s.offs)
                lettered = _lettered(s, lettered)
                if model is None:
                    label += [UNKNOWN] * s.n
                    prob.append(np.zeros(s.n))
                    continue
                many = np.maximum(1, np.diff(first))
                margin = {}
                for name, m in model.machines:
                    run_ = np.concatenate([[0.0], np.cumsum(m.weight[code])])
                    margin[name] = (run_[first[1:]] - run_[first[:-1]]) / many + m.bias
                lang, score = model.predict(margin, s.n)
                names = np.array([*model.languages, UNKNOWN], object)
                label += names[np.where(lettered, lang, len(model.languages))].tolist()
                prob.append(np.where(lettered, score, 0.0))
            cols = {c: b.column(c) for c in b.schema.names}
            yield batch(**cols, lang_pred=pa.array(label, pa.string()), score=np.concatenate(prob) if prob else np.zeros(0))

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return arrow_map(docs, run, schema)


def learn_and_predict(docs: DataFrame, learn: Column) -> DataFrame:
    """Fit on the rows where `learn` holds, then predict all rows of docs (doc_id, text, lang, any others)."""
    model = fit(docs.where(learn).select("doc_id", "text", "lang"))
    return predict(docs, model)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = held_out("doc_id", 5)
    model = fit(docs.where(~out).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", out.alias("held_out"), "text"), model).drop("text")
