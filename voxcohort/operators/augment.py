"""Augmentation as pure functions of (scan, epoch, op): the same draw on any number of partitions."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import BACKGROUND_LEVEL, INTENSITY_CAP
from ..functions.draws import uniform
from ..functions.scalars import col, let
from .boxes import degrade_box, each, warp_box
from .stencil import convolved, kernel, smooth_box

BATCH = 24


def batch_of(uid: str = "uid") -> Column:
    return F.floor(F.col(uid) / BATCH)


def draw(op: str, k: int = 0, epoch: int = 0, scope: str = "scan") -> Column:
    """Uniform for one op; scope 'batch' shares it over a batch of 24 scans."""
    key = batch_of() if scope == "batch" else F.col("uid")
    return uniform(F.lit(scope), key, F.lit(epoch), F.lit(op), F.lit(k))


def gate(op: str, prob: float, epoch: int = 0, scope: str = "batch") -> Column:
    return draw(op + ".gate", 0, epoch, scope) < prob


def flip(df: DataFrame, width: int, when: Column, side: str | None = None) -> DataFrame:
    """Mirror left-right where `when` holds; mask sides swap with it."""
    out = df.withColumn("_f", when).withColumn("x", F.when(F.col("_f"), F.lit(width - 1) - F.col("x")).otherwise(F.col("x")))
    if side:
        out = out.withColumn(side, F.when(F.col("_f"), F.when(F.col(side) == "L", "R").otherwise("L")).otherwise(F.col(side)))
    return out.drop("_f")


THETA = [f"t{i}{j}" for i in range(3) for j in range(4)]


def affine_draws(
    df: DataFrame, rot_deg: float = 15.0, zoom: float = 0.15, shift: float = 0.06, epoch: int = 0,
    rot_axes: tuple[float, float, float] = (1.0, 1.0, 1.0), zoom_range: tuple[float, float] | None = None, shift_ap: float = 0.0,
) -> DataFrame:
    """Adds t00 .. t23: rotation times zoom and a translation, in normalised coordinates.

    `rot_axes` multiplies the three angles. The zoom is drawn per column around one, or once for all axes within `zoom_range`. With
    `shift_ap` only the A-P axis is shifted, by at most so much. Options change no draw's key.
    """
    u = lambda k: draw("affine", k, epoch)
    sym = lambda k: u(k) * 2 - 1
    scale = (lambda k: F.lit(zoom_range[0]) + u(3) * (zoom_range[1] - zoom_range[0])) if zoom_range else (lambda k: 1 + sym(3 + k) * zoom)
    move = (lambda k: sym(7) * shift_ap if k == 1 else F.lit(0.0)) if shift_ap > 0 else (lambda k: sym(6 + k) * shift)
    t = df.select(
        "*", *[(sym(k) * F.lit(rot_deg * math.pi / 180) * rot_axes[k]).alias(f"_a{k}") for k in range(3)],
        *[scale(k).alias(f"_z{k}") for k in range(3)], *[move(k).alias(f"t{k}3") for k in range(3)],
    )
    c, s = [F.cos(f"_a{k}") for k in range(3)], [F.sin(f"_a{k}") for k in range(3)]
    rot = (
        (c[1] * c[2], s[0] * s[1] * c[2] - c[0] * s[2], c[0] * s[1] * c[2] + s[0] * s[2]),
        (c[1] * s[2], s[0] * s[1] * s[2] + c[0] * c[2], c[0] * s[1] * s[2] - s[0] * c[2]),
        (-s[1], s[0] * c[1], c[0] * c[1]),
    )
    out = t.select(*df.columns, *[(rot[i][j] * F.col(f"_z{j}")).alias(f"t{i}{j}") for i in range(3) for j in range(3)], *[f"t{k}3" for k in range(3)])
    return out


_STIRLING = 16
_LOG_FACTORIAL = np.array([math.lgamma(k + 1.0) for k in range(_STIRLING)])


def _series(n: np.ndarray) -> np.ndarray:
    """What Stirling's formula leaves out of log(n!), for n from 16 on to within rounding."""
    q = 1 / n
    return q * (1 / 12 - q * q * (1 / 360 - q * q * (1 / 1260 - q * q / 1680)))


def _log_factorial(n: np.ndarray) -> np.ndarray:
    far = np.maximum(n, _STIRLING)
    return np.where(n < _STIRLING, _LOG_FACTORIAL[np.clip(n, 0, _STIRLING - 1).astype(int)], (far + 0.5) * np.log(far) - far + 0.5 * math.log(2 * math.pi) + _series(far))


def _log_ratio(lam: np.ndarray, m: np.ndarray, x: np.ndarray) -> np.ndarray:
    """log of p(m + x) / p(m); where both factorials go by Stirling, their difference is taken before it loses digits."""
    b = m + x
    m_, b_ = np.maximum(m, _STIRLING), np.maximum(b, _STIRLING)
    far = x * np.log(lam / b_) - (m_ + 0.5) * np.log(b_ / m_) + x - _series(b_) + _series(m_)
    return np.where((m >= _STIRLING) & (b >= _STIRLING), far, x * np.log(lam) - _log_factorial(b) + _log_factorial(m))


def poisson_counts(lam: np.ndarray, key: str) -> np.ndarray:
    """A Poisson count per mean, exact for every mean, in a bounded expected number of attempts (at most five); 0 where the mean is not positive.

    Rejection under the envelope that holds for every log-concave distribution: flat around the mode, exponential beyond. With p the
    probability of the mode m and w = 1 + p / 2, the candidate is m plus or minus round(y); y comes from one uniform, its sign from a bit,
    acceptance from another uniform. All three are cut from md5 of key, place and number of the attempt, so a count is a function of its key.
    """
    out = np.zeros(len(lam))
    open_ = np.flatnonzero(lam > 0)
    m = np.floor(lam)
    m_ = np.maximum(m, _STIRLING)
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.exp(m_ - lam + m_ * np.log(lam / m_) - _series(m_)) / np.sqrt(2 * math.pi * m_)
        p = np.where(m >= _STIRLING, far, np.exp(m * np.log(lam) - lam - _log_factorial(m)))
    head, attempt = hashlib.md5(f"{key}|".encode()), 1
    while len(open_):
        raw = np.frombuffer(b"".join([_digest(head, i, attempt) for i in open_.tolist()]), ">u8").reshape(-1, 2)
        u, a = _uniforms(raw)
        sign = np.where((raw[:, 1] >> np.uint64(20)) & np.uint64(15) < 8, -1.0, 1.0)
        q, mode = p[open_], m[open_]
        w = 1 + q / 2
        y = np.where(u * (1 + w) <= w, u * (1 + w), w - np.log((1 - u) * (1 + w))) / q
        x = sign * np.floor(y + 0.5)
        ok = (mode + x >= 0) & (np.log(a) + np.minimum(0, w - q * y) <= _log_ratio(lam[open_], mode, np.maximum(x, -mode)))
        out[open_[ok]] = (mode + x)[ok]
        open_, attempt = open_[~ok], attempt + 1
    return out


def _uniforms(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two uniforms of each digest: its first 13 hexadecimal digits and the 13 that follow."""
    hi, lo = raw[:, 0], raw[:, 1]
    second = ((hi & np.uint64(0xFFF)) << np.uint64(40)) | (lo >> np.uint64(24))
    return tuple((x.astype(float) + 0.5) / 2.0**52 for x in (hi >> np.uint64(12), second))


def _digest(head, place: int, attempt: int) -> bytes:
    h = head.copy()
    h.update(b"%d|%d" % (place, attempt))
    return h.digest()


def count_noise(data, gain, uid="uid", scope: str = "voxel") -> Column:
    """Poisson(v * gain) / gain for every voxel of a volume's array; negative voxels count as 0. A null array or gain gives null.

    The draws of voxel i of a scan are keyed by scope, uid and i. A digest a voxel and attempt is what it costs, some five microseconds.
    """

    @F.arrow_udf("array<double>")
    def run(boxes: pa.Array, gains: pa.Array, uids: pa.Array) -> pa.Array:
        out = []
        for v, g, u in zip(boxes, gains.to_pylist(), uids.to_pylist(), strict=True):
            lam = v.values.to_numpy(zero_copy_only=False).astype(float) * g if v.is_valid and g is not None else None
            out.append(None if lam is None else poisson_counts(lam, f"{scope}|{u}") / g)
        return pa.array(out, pa.list_(pa.float64()))

    return run(col(data), col(gain), col(uid))


def gamma_gain(v: Column, g: Column) -> Column:
    return F.pow(F.greatest(v, F.lit(0.0)) / INTENSITY_CAP, g) * INTENSITY_CAP


def truncated(data: Column, depth: int, k: Column, top: Column) -> Column:
    """Zero the last k of `depth` S-I slices, or the first k; S-I is the fastest axis."""
    lost = lambda z: F.when(top, z >= F.lit(depth) - k).otherwise(z < k)
    return F.transform(data, lambda v, i: F.when(lost(i % depth), F.lit(0.0)).otherwise(v))


def coarse_sizes(dims: tuple[int, int, int], least: int, epoch: int = 0) -> Column:
    """Samples left on each axis by a coarser grid: 1 to 2.2 times fewer, `least` at least."""
    return F.array(*[F.greatest(F.lit(least), F.round(F.lit(float(n)) / (1 + draw("psf", k, epoch, "batch") * 1.2)).cast("int")) for k, n in enumerate(dims)])


def diffuse(data, dims: tuple[int, int, int], level: float) -> Column:
    """Blurred mask of what is above `level`."""
    head = F.transform(data, lambda v: (v > level).cast("double"))
    return smooth_box(head, dims, 2.0, "replicate", taps=5)


def halo(data, dims: tuple[int, int, int]) -> Column:
    return smooth_box(smooth_box(data, dims, 1.2, "replicate", taps=5), dims, 1.2, "replicate", taps=5)


def chain(
    boxes: DataFrame, dims: tuple[int, int, int], epoch: int = 0, flip_p: float = 0.5, affine: dict | None = None, si_slices: int = 0, count_p: float = 0.3, psf: bool = False,
    least: int = 8, background: float = 0.0, scatter: float = 0.0, gamma_p: float = 0.3, level: float = 0.15, cap: float = INTENSITY_CAP,
) -> DataFrame:
    """The whole training chain on (uid, data, mask) in the scan's row: no row leaves its place.

    Mirror and affine map are one map, so image and mask are interpolated once; the mask is cut at one half. S-I truncation follows,
    in both. Then intensity, image only: counts, coarser grid, blur, background, scatter, gamma and the final clamp. Gates are drawn once
    per batch, amounts per scan (or per batch where they describe the scanner); a step that is off draws nothing and shifts no other draw.
    """
    on = lambda op, p: gate(op, p, epoch)
    t = affine_draws(boxes, epoch=epoch, **(affine or {})).withColumn("_f", on("flip", flip_p))
    cut_ = F.transform(warp_box("mask", dims, THETA, F.col("_f")), lambda v: (F.round(v, 9) > 0.5).cast("double"))
    t = t.select("uid", warp_box("data", dims, THETA, F.col("_f")).alias("data"), cut_.alias("mask"))

    def step(df: DataFrame, when: Column, new, *columns: str) -> DataFrame:
        return df.withColumns({c: F.when(when, new(F.col(c))).otherwise(F.col(c)) for c in columns or ("data",)})

    if si_slices:
        k = 1 + F.floor(draw("cutsi", 0, epoch, "batch") * si_slices)
        t = step(t, on("cutsi", 0.5), lambda c: truncated(c, dims[2], k, draw("cutsi", 1, epoch, "batch") < 0.5), "data", "mask")
    t = step(t, on("count", count_p), lambda c: count_noise(c, F.lit(25.0) + F.lit(150.0) * draw("count", 0, epoch), scope="voxel" if epoch == 0 else f"voxel{epoch}"))
    if psf:
        t = step(t, on("psf", 0.5), lambda c: degrade_box(c, dims, coarse_sizes(dims, least, epoch)))
        t = step(t, on("blur", 0.5), lambda c: smooth_box(c, dims, F.lit(0.4) + F.lit(0.8) * draw("psf", 3, epoch, "batch"), "replicate", taps=5))
    add = lambda c, amount, extra: F.zip_with(c, extra, lambda v, e: v + amount * e)
    if background:
        t = step(t, on("bg", 0.5), lambda c: add(c, F.lit(background) * draw("bg", 0, epoch), diffuse(c, dims, level)))
    if scatter:
        t = step(t, on("scatter", 0.5), lambda c: add(c, F.lit(scatter) * draw("scatter", 0, epoch), halo(c, dims)))
    g = F.lit(0.7) + F.lit(0.6) * draw("gamma", 0, epoch)
    t = step(t, on("gamma", gamma_p), lambda c: let(g, lambda e: F.transform(c, lambda v: gamma_gain(v, e))))
    return t.withColumn("data", F.transform("data", lambda v: F.least(F.lit(cap), F.greatest(F.lit(0.0), v))))


def lesion_draws(scans: DataFrame, p: float, lo: float, hi: float, asym: float, epoch: int = 0) -> DataFrame:
    """Severity per side for the normal scans that are drawn, zero elsewhere, and the new label."""
    pick = (F.col("y") == 0) & (draw("lesion", 0, epoch) < p)
    sv = lo + (hi - lo) * draw("lesion", 1, epoch)
    weak = sv * (asym + (1 - asym) * draw("lesion", 2, epoch))
    heavy_left = draw("lesion", 3, epoch) < 0.5
    zero = F.lit(0.0)
    return scans.select(
        "*", pick.alias("lesioned"), F.when(pick, F.when(heavy_left, sv).otherwise(weak)).otherwise(zero).alias("sev_l"),
        F.when(pick, F.when(heavy_left, weak).otherwise(sv)).otherwise(zero).alias("sev_r"), F.when(pick, F.lit(1)).otherwise(F.col("y")).alias("y_new"),
    )


def own_extent(mask: np.ndarray) -> tuple[np.ndarray, float]:
    """Of a mask volume: each A-P slice's place in the mask's own extent (2nd to 98th percentile of its profile), and the mean L-R place."""
    profile = mask.sum((0, 2))
    c = np.cumsum(profile) / max(profile.sum(), 1)
    lo, hi = (c < 0.02).sum(), (c < 0.98).sum()
    return (np.arange(mask.shape[1]) - lo) / max(hi - lo, 2), (mask.sum((1, 2)) * np.arange(mask.shape[0])).sum() / max(mask.sum(), 1)


def _by_side(mask: np.ndarray, sev_l: float, sev_r: float) -> tuple[np.ndarray, np.ndarray]:
    """A-P places and the severity of each L-R plane, shaped to the volume."""
    u, middle = own_extent(mask)
    return u[None, :, None], np.where(np.arange(mask.shape[0]) < middle, sev_l, sev_r)[:, None, None]


def lesion_field(mask, dims: tuple[int, int, int], sigma: float, shape=(0.55, 0.35, 0.25), edge: float = 0.0, margins=None) -> Column:
    """The blurred multiplicative field of columns sev_l and sev_r, strongest at the posterior end of the mask.

    shape is (edge, ramp, base) of the A-P profile, as numbers or columns. With `edge` the loss grows towards the margins, an array that is
    0 at the hottest core and 1 where the structure fades (see margins_of).
    """
    shape = [c if isinstance(c, Column) else F.lit(float(c)) for c in shape]

    def field(m: np.ndarray, sev_l, sev_r, u_edge, u_ramp, base, *rim) -> np.ndarray:
        m = m.reshape(dims)
        u, sev = _by_side(m, sev_l, sev_r)
        loss = sev * (base + (1 - base) * np.clip((u_edge - u) / max(u_ramp, 1e-3), 0, 1))
        if rim:
            loss = np.minimum(1.0, loss * (1 + edge * rim[0].reshape(dims)))
        w = np.array(kernel(sigma))
        return np.clip(convolved(1 - loss * m, w, "replicate", (0, 1, 2)), 0, 1)

    return each(field, mask, "sev_l", "sev_r", *shape, *([margins] if edge else []))


def margins_of(data, mask, dims: tuple[int, int, int], sigma: float = 1.5) -> Column:
    """1 minus the blurred specific part relative to its largest value in the mask; 0 outside the mask."""

    def rim(v: np.ndarray, m: np.ndarray) -> np.ndarray:
        soft = convolved(np.maximum(v.reshape(dims) - BACKGROUND_LEVEL, 0), np.array(kernel(sigma)), "replicate", (0, 1, 2))
        m = m.reshape(dims)
        return np.clip(1 - soft / max((soft * m).max(), 1e-6), 0, 1) * m

    return each(rim, data, mask)


def jittered_shape(epoch: int = 0) -> tuple[Column, Column, Column]:
    """Drawn (edge, ramp, base) of a scan's A-P profile."""
    return tuple(F.lit(lo) + F.lit(span) * draw("jitter", k, epoch) for k, (lo, span) in enumerate(((0.4, 0.3), (0.2, 0.3), (0.1, 0.3))))


def textured(f, dims: tuple[int, int, int], uid="uid", sigma: float = 4.0, depth: float = 0.3, scope: str = "texture") -> Column:
    """A field whose loss is modulated by a smooth random texture: keyed normals per voxel, blurred, standardised over the scan."""

    def vary(v: np.ndarray, u) -> np.ndarray:
        head = hashlib.md5(f"{scope}|{u}|".encode())
        raw = np.frombuffer(b"".join([_digest(head, i, 0) for i in range(v.size)]), ">u8").reshape(-1, 2)
        a, b = _uniforms(raw)
        t = convolved((np.sqrt(-2 * np.log(a)) * np.cos(2 * math.pi * b)).reshape(dims), np.array(kernel(sigma)), "replicate", (0, 1, 2))
        return np.clip(1 - (1 - v.reshape(dims)) * (1 + depth * t / max(t.std(ddof=1), 1e-6)), 0, 1)

    return each(vary, f, uid)


def peak_clipped(data, mask, dims: tuple[int, int, int], share: float, u_max: float, least: int, sigma: float = 0.0) -> Column:
    """Compress the brightest `share` of each side's posterior part by the side's severity (columns sev_l, sev_r); parts of fewer than `least`
    voxels stay. With sigma the change alone is blurred, so no sharp plateau is left."""

    def clip(v: np.ndarray, m: np.ndarray, sev_l, sev_r) -> np.ndarray:
        v, m = v.reshape(dims), m.reshape(dims)
        u, sev = _by_side(m, sev_l, sev_r)
        _, middle = own_extent(m)
        out = v.copy()
        left = np.broadcast_to((np.arange(dims[0]) < middle)[:, None, None], dims)
        for side in (left, ~left):
            part = (m > 0) & side & np.broadcast_to((u < u_max) & (u >= -0.1), dims)
            if part.sum() >= least:
                q = np.quantile(v[part], 1 - share)
                out = np.where(part & (v > q), q + (v - q) * (1 - sev), out)
        return v - convolved(v - out, np.array(kernel(sigma)), "replicate", (0, 1, 2)) if sigma else out

    return each(clip, data, mask, "sev_l", "sev_r")


def lesion_apply(v: Column, f: Column) -> Column:
    """Only the part above the background level is reduced."""
    return v - F.greatest(v - BACKGROUND_LEVEL, F.lit(0.0)) * (1 - f)
