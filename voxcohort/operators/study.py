"""Resampling, covariance and audit operators used by the study queries."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import poisson1_thresholds, uniform
from ..functions.scalars import log_loss_term, sigmoid
from ..session import cut, stored
from .ranking import row_numbers


def poisson1_weights(uids: list, seed: str, replicates: int) -> np.ndarray:
    """(rows, replicates) Poisson(1) weights: the same draws as poisson1(uniform(uid, seed, replicate))."""
    out = np.empty((len(uids), replicates))
    tails = [b"%d" % r for r in range(replicates)]
    for i, u in enumerate(uids):
        head = hashlib.md5(f"{u}|{seed}|".encode())
        for r, t in enumerate(tails):
            h = head.copy()
            h.update(t)
            out[i, r] = int.from_bytes(h.digest()[:7], "big") >> 4
    return np.searchsorted(poisson1_thresholds(), (out + 0.5) / 2.0**52).astype(np.int64)


def _slice_sums(it: Iterator[pa.RecordBatch], seed: str, replicates: int, chunk: int = 512) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (arm, s): per arm, weight sums of the first and the last score, and of all between with their own rank sums.

    A score may go on in the neighbouring slices, so the outer two are left open; what lies between is settled here. Every row holds
    vectors over the replicates, and a task holds three of them per arm.
    """
    parts: list[tuple] = []
    arm, held = None, None  # held: [s, p, n] of the score at hand
    inner = None  # [s, p, n, u] of the settled scores behind the first
    loss = np.zeros((2, replicates))

    def close() -> None:
        """The score at hand is complete within this slice: first of its arm, or one more between."""
        nonlocal inner
        s, p, n = held
        if not any(x[0] == arm for x in parts):
            parts.append((arm, s, p, n, None))
        elif inner is None:
            inner = [s, p, n, p * n / 2.0]
        else:
            inner[3] = inner[3] + p * (inner[2] + n / 2.0)
            inner[1], inner[2] = inner[1] + p, inner[2] + n

    def finish() -> None:
        nonlocal inner, held
        if inner is not None:
            parts.append((arm, *inner))
        if held is not None:
            parts.append((arm, *held, None))
        inner, held = None, None

    for b in it:
        for at in range(0, b.num_rows, chunk):
            c = b.slice(at, chunk)
            w = poisson1_weights(c.column("uid").to_pylist(), seed, replicates)
            y, d = c.column("y").to_numpy(), c.column("dl").to_numpy()
            first = np.array(c.column("arm").to_pylist()) == "a"
            loss += np.stack([(w * np.where(first, d, 0.0)[:, None]).sum(0), w[first].sum(0)])
            arms, s = c.column("arm").to_pylist(), c.column("s").to_numpy()
            heads = [0, *(k for k in range(1, len(s)) if s[k] != s[k - 1] or arms[k] != arms[k - 1])]
            ps, ns = (np.add.reduceat(w * (y == v)[:, None], heads, axis=0) for v in (1, 0))
            for k, p, n in zip(heads, ps, ns, strict=True):
                if held is not None and arm == arms[k] and held[0] == s[k]:
                    held[1], held[2] = held[1] + p, held[2] + n
                    continue
                if held is not None and arm == arms[k]:
                    close()
                elif held is not None:
                    finish()
                arm, held = arms[k], [s[k], p, n]
    finish()
    rows = [(x[0], float(x[1]), x[2], x[3], x[4]) for x in parts] + [("loss", 0.0, *loss, None)]
    double = pa.list_(pa.float64())
    yield pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.float64()), *(pa.array([None if x[k] is None else x[k].astype(float) for x in rows], double) for k in (2, 3, 4))],
        names=["arm", "s", "p", "n", "u"],
    )


def bootstrap_deltas(df: DataFrame, a: str, b: str, y: str, replicates: int, seed: str) -> DataFrame:
    """(rep, d_ll, d_auc) of arm b minus arm a under shared Poisson(1) row weights.

    The plan does not depend on the number of replicates. Each arm is sorted once over all its slices (by score and uid, so that equal
    scores may spread); a row's weights are drawn where it lands and never shuffled. A slice returns at most three rows of vectors per
    arm, and the rank sums are put together from those.
    """
    dl = log_loss_term(y, sigmoid(b)) - log_loss_term(y, sigmoid(a))
    arms = F.array(F.struct(F.lit("a").alias("arm"), F.col(a).alias("s")), F.struct(F.lit("b").alias("arm"), F.col(b).alias("s")))
    both = df.select("uid", F.col(y).cast("int").alias("y"), dl.alias("dl"), F.explode(arms).alias("_arm")).select("_arm.arm", F.col("_arm.s").cast("double").alias("s"), "uid", "y", "dl")
    dealt = both.repartitionByRange("arm", "s", "uid").sortWithinPartitions("arm", "s")
    sums = cut(dealt.mapInArrow(lambda it: _slice_sums(it, seed, replicates), "arm string, s double, p array<double>, n array<double>, u array<double>"))
    u = F.coalesce("u", F.array_repeat(F.lit(None).cast("double"), replicates)).alias("u")
    long = sums.select("arm", "s", "p", "n", u).select("arm", "s", F.posexplode(F.arrays_zip("p", "n", "u")).alias("rep", "_v")).select("arm", "s", "rep", "_v.*")
    loss = long.where("arm = 'loss'").groupBy("rep").agg((F.sum("p") / F.sum("n")).alias("d_ll"))
    # open scores of neighbouring slices become one; a settled stretch starts at a score of its own
    tied = long.where("arm <> 'loss'").groupBy("arm", "rep", "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.coalesce(F.max("u"), F.sum("p") * F.sum("n") / 2).alias("u"))
    w = Window.partitionBy("arm", "rep")
    before = F.coalesce(F.sum("n").over(w.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranked = tied.withColumn("w", F.col("u") + F.col("p") * before)
    area = ranked.groupBy("arm", "rep").agg((F.sum("w") / (F.sum("p") * F.sum("n"))).alias("auc"))
    sign = F.when(F.col("arm") == "b", F.lit(1.0)).otherwise(F.lit(-1.0))
    return loss.join(area.groupBy("rep").agg(F.sum(sign * F.col("auc")).alias("d_auc")), "rep").select("rep", "d_ll", "d_auc")


def _moments(it: Iterator[pa.RecordBatch], held: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Of (group, vector) rows: per group the number of vectors, their sum and the upper triangle of their second moments, packed."""
    sums: dict = {}
    size = 0

    def flush() -> pa.RecordBatch:
        double = pa.list_(pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([k for k in sums], kind), pa.array([int(v[0][0]) for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], double), pa.array([v[2] for v in sums.values()], double)], names=["k", "n", "s", "ss"])

    kind = pa.int64()
    for b in it:
        kind = b.schema.field(0).type
        b = b.filter(pc.is_valid(b.column(1)))
        groups = b.column(0).to_pylist()
        if not groups:
            continue
        x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(groups), -1)
        i, j = np.triu_indices(x.shape[1])
        order = {}
        for r, g in enumerate(groups):
            order.setdefault(g, []).append(r)
        for g, rows in order.items():
            part = x[rows]
            new = (np.array([len(rows)]), part.sum(0), (part.T @ part)[i, j])
            old = sums.get(g)
            sums[g] = new if old is None else tuple(a + c for a, c in zip(old, new, strict=True))
            size += len(i) if old is None else 0
        if size > held:
            yield flush()
            sums, size = {}, 0
    if sums:
        yield flush()


def covariances(df: DataFrame, group: str, vector: str, least: int = 3) -> DataFrame:
    """(group, i, j, cov) for i <= j. Vectors (not null, of one length) are folded where they lie: what moves is one packed row of moments per group
    and task, never a vector and never d x d rows for one."""
    kind = dict(df.dtypes)[group]
    parts = df.select(F.col(group).alias("k"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(_moments, f"k {kind}, n long, s array<double>, ss array<double>")
    n = parts.groupBy("k").agg(F.sum("n").alias("n"))
    s = parts.select("k", F.posexplode("s").alias("i", "a")).groupBy("k", "i").agg(F.sum("a").alias("a"))
    # place of (i, j) in the packed triangle of d columns: i*d - i*(i-1)/2 + (j - i)
    d = F.size("s")
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), d - 1), lambda i: F.transform(F.sequence(i, d - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    ss = parts.select("k", F.inline(F.zip_with(pairs, "ss", lambda p, v: F.struct(p["i"].alias("i"), p["j"].alias("j"), v.alias("v"))))).groupBy("k", "i", "j").agg(F.sum("v").alias("v"))
    means = n.join(s, "k").groupBy("k", "n").agg(F.map_from_entries(F.collect_list(F.struct("i", "a"))).alias("m")).where(F.col("n") >= least)
    t = ss.join(means, "k")
    return t.select(F.col("k").alias(group), "i", "j", ((F.col("v") - F.col("m")[F.col("i")] * F.col("m")[F.col("j")] / F.col("n")) / (F.col("n") - 1)).alias("cov"))


def covariance_gap(cov: DataFrame, group: str, dims: int) -> DataFrame:
    """Mean squared covariance difference averaged over group pairs.

    Per entry, sum over pairs of (ci - cj)^2 equals g*sum(c^2) - sum(c)^2, so no pair is formed.
    """
    e = cov.groupBy("i", "j").agg(
        F.count(F.lit(1)).alias("g"), F.sum(F.col("cov") * F.col("cov")).alias("s2"), F.sum("cov").alias("s")
    )
    twice = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.lit(2.0))
    total = F.sum(twice * (F.col("g") * F.col("s2") - F.col("s") * F.col("s")))
    pairs = F.max(F.col("g") * (F.col("g") - 1) / F.lit(2.0))
    return e.agg(F.max("g").alias("groups"), (total / F.lit(float(dims * dims)) / pairs).alias("gap"))


def epps_pulley(df: DataFrame, value: str, key: str, nodes: int = 64) -> DataFrame:
    """Distance of each group of values to N(0, 1).

    The pairwise mean of exp(-(a-b)^2/2) is the integral of |mean exp(ita)|^2 against a normal density,
    so a Gauss-Hermite rule turns the quadratic pair sum into 2 * nodes linear sums.
    """
    t, w = np.polynomial.hermite_e.hermegauss(nodes)
    w = w / math.sqrt(2.0 * math.pi)
    keep = [(float(a), float(b)) for a, b in zip(t, w) if a > 0 and b > 1e-18]
    v = F.col(value)
    s = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.exp(-v * v / 4.0)).alias("g"),
        *[F.avg(F.cos(v * a)).alias(f"c{i}") for i, (a, _) in enumerate(keep)],
        *[F.avg(F.sin(v * a)).alias(f"s{i}") for i, (a, _) in enumerate(keep)],
    )
    pair = F.lit(0.0)
    for i, (_, b) in enumerate(keep):
        pair = pair + F.lit(2.0 * b) * (F.col(f"c{i}") * F.col(f"c{i}") + F.col(f"s{i}") * F.col(f"s{i}"))
    if nodes % 2:
        pair = pair + F.lit(float(w[nodes // 2]))
    return s.select(key, "n", (pair - F.lit(math.sqrt(2.0)) * F.col("g") + F.lit(1.0 / math.sqrt(3.0))).alias("distance"))


def permuted(df: DataFrame, within: list[str], column: str, seed) -> DataFrame:
    """Replace `column` by a seeded permutation of it inside each `within` group; uids are distinct within one, and the seed may be a column of `within`."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    rest = [c for c in df.columns if c not in (*within, "uid", column)]
    held = {f"_c{i}": F.col(c) for i, c in enumerate(rest)}
    base = df.withColumn("_h1", uniform(F.col("uid"), seed, F.lit("to"))).withColumn("_h2", uniform(F.col("uid"), seed, F.lit("from")))
    # what a row has besides rides along: joined back by uid, rows unfolded just before would be taken for as few as they were, and be broadcast
    to = row_numbers(base.withColumns(held), within, ["_h1", "uid"], carry=tuple(held)).select(*within, "rn", "uid", *held)
    src = row_numbers(base, within, ["_h2", "uid"], carry=(column,)).select(*within, "rn", F.col(column).alias("_v"))
    return to.join(src, within + ["rn"]).select(*within, "uid", *[F.col(k).alias(c) for k, c in zip(held, rest, strict=True)], F.col("_v").alias(column))


def solved(df: DataFrame, h: str, g: str, x: str, d: int) -> DataFrame:
    """Adds x0 .. of the symmetric positive definite system with columns h{i}_{j} (i <= j) and g{i}: elimination, one projection per unknown."""
    a = {(i, j): F.col(f"{h}{i}_{j}") for i in range(d) for j in range(i, d)}
    b = [F.col(f"{g}{i}") for i in range(d)]
    keep = df.columns
    for k in range(d):
        names = {f"_a{i}_{j}": c for (i, j), c in a.items()} | {f"_r{i}": c for i, c in enumerate(b)}
        df = df.select(*keep, *[c.alias(n) for n, c in names.items()])
        at = lambda i, j: F.col(f"_a{min(i, j)}_{max(i, j)}")
        a = {(i, j): at(i, j) - at(k, i) * at(k, j) / at(k, k) if i > k else F.col(f"_a{i}_{j}") for (i, j) in a}
        b = [F.col(f"_r{i}") - at(k, i) * F.col(f"_r{k}") / at(k, k) if i > k else F.col(f"_r{i}") for i in range(d)]
    df = df.select(*keep, *[c.alias(f"_a{i}_{j}") for (i, j), c in a.items()], *[c.alias(f"_r{i}") for i, c in enumerate(b)])
    for i in range(d - 1, -1, -1):
        rest = sum((F.col(f"_a{i}_{j}") * F.col(f"{x}{j}") for j in range(i + 1, d)), F.lit(0.0))
        df = df.withColumn(f"{x}{i}", (F.col(f"_r{i}") - rest) / F.col(f"_a{i}_{i}"))
    return df.select(*keep, *[f"{x}{i}" for i in range(d)])


def logistic_fits(
    df: DataFrame, fit_key: str, fold: str, features: list[str], y: str, ridge: float = 1e-6, steps: int = 8
) -> DataFrame:
    """Out-of-fold logistic scores: one ridge model per (fit, fold), trained on the fit's other folds.

    The models are a table. A step joins it to the rows by fit, sums the normal equations (mergeable, d(d+3)/2 numbers per model) and solves
    all of them as columns; neither rows nor models reach the driver, however many models there are.
    """
    d = len(features) + 1
    frozen = cut(df)
    xs = [F.lit(1.0)] + [F.col(f) for f in features]
    beta = [F.col(f"_b{i}") for i in range(d)]
    models = stored(frozen.select(fit_key, F.col(fold).alias("_model")).distinct().select("*", *[F.lit(0.0).alias(f"_b{i}") for i in range(d)], F.lit(math.inf).alias("_moved")))
    z = sum((b * x for b, x in zip(beta[1:], xs[1:], strict=True)), beta[0])
    for _ in range(steps):
        t = frozen.join(models, fit_key).where(F.col("_model") != F.col(fold)).withColumn("_p", sigmoid(z))
        g, h = F.col(y) - F.col("_p"), F.col("_p") * (1 - F.col("_p"))
        aggs = [F.sum(g * xs[i]).alias(f"_g{i}") for i in range(d)]
        aggs += [F.sum(h * xs[i] * xs[j]).alias(f"_h{i}_{j}") for i in range(d) for j in range(i, d)]
        s = models.join(t.groupBy(fit_key, "_model").agg(*aggs), [fit_key, "_model"], "left")
        # a model whose fold is the only one has nothing to learn from: the ridge alone keeps it at zero
        s = s.fillna(0.0, [f"_g{i}" for i in range(d)] + [f"_h{i}_{j}" for i in range(d) for j in range(i, d)])
        s = s.withColumns({f"_g{i}": F.col(f"_g{i}") - ridge * beta[i] for i in range(d)} | {f"_h{i}_{i}": F.col(f"_h{i}_{i}") + ridge for i in range(d)})
        s = solved(s, "_h", "_g", "_x", d)
        models = stored(s.select(fit_key, "_model", *[(F.col(f"_b{i}") + F.col(f"_x{i}")).alias(f"_b{i}") for i in range(d)], F.greatest(*[F.abs(f"_x{i}") for i in range(d)]).alias("_moved")))
        if models.where("_moved >= 1e-8").isEmpty():
            break
    out = frozen.join(models, (frozen[fit_key] == models[fit_key]) & (frozen[fold] == models["_model"])).drop(models[fit_key])
    return out.withColumn("score", z).drop("_model", "_moved", *[f"_b{i}" for i in range(d)])
