"""Operators against brute force on small inputs, with perturbed controls that must differ."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxcohort.functions.scalars import sorted_nearest, sorted_quantile
from voxcohort.sources.files import parse_log
from voxcohort.functions.scalars import calibrate, clip_prob, logit, sanitise
from voxcohort.functions.draws import poisson1, uniform
from voxcohort.operators import augment, boxes, calibration, cohort, components, geometry, maps, ranking, stencil, study, volumes
from voxcohort.streaming import scoring


def brute_auc(y, s):
    pos, neg = [a for a, b in zip(s, y) if b == 1], [a for a, b in zip(s, y) if b == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_ties_single_class_and_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot", rng.randint(0, 1), float(rng.randint(0, 20))) for _ in range(2000)]
    rows += [("tied", i % 2, 0.5) for i in range(10)] + [("one", 1, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, y int, s double").repartition(7)
    got = {r.g: r.auc for r in ranking.auc(df, ["g"], "s", "y").collect()}
    for g in ("hot", "tied", "one"):
        want = brute_auc([r[1] for r in rows if r[0] == g], [r[2] for r in rows if r[0] == g])
        assert got[g] == pytest.approx(want) if want is not None else got[g] is None
    flipped = df.withColumn("s", -F.col("s"))
    assert {r.g: r.auc for r in ranking.auc(flipped, ["g"], "s", "y").collect()}["hot"] != pytest.approx(got["hot"], abs=1e-6)


def test_quantiles_and_tiles(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": ["a"] * 501 + ["b"] * 8, "v": np.r_[rng.normal(size=501).round(1), rng.normal(size=8)]})
    pdf["uid"] = range(len(pdf))
    df = spark.createDataFrame(pdf)
    q = {r.g: r for r in ranking.quantiles(df, ["g"], "v", {"lo": 0.13, "hi": 0.9}).collect()}
    for g in "ab":
        v = pdf[pdf.g == g].v
        assert q[g].lo == pytest.approx(np.quantile(v, 0.13)) and q[g].hi == pytest.approx(np.quantile(v, 0.9))
    t = ranking.row_numbers(df, ["g"], ["v", "uid"]).withColumn("t", ranking.tile("rn", "n", 3)).toPandas()
    assert t[t.g == "a"].t.value_counts().sort_index().tolist() == [167, 167, 167]
    assert t[t.g == "b"].t.value_counts().sort_index().tolist() == [3, 3, 2]


def test_stacks_of_volumes_are_bounded(spark):
    """Temporaries of whole-volume steps follow 65,536 voxels, not the rows of a batch."""
    d = spark.range(3000).coalesce(1).select(F.array(*[F.lit(1.0)] * 64).alias("data"))
    got = d.select(boxes.batched(lambda v: v * len(v), (4, 4, 4), "data").alias("v")).agg(F.count("v"), F.max(F.array_max("v"))).first()
    assert got[0] == 3000 and got[1] <= 1024


def test_running_is_exact_over_many_slices(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"), (F.col("id") % 7).alias("w"))
    got = ranking.running(df, ["g"], ["o"], {"t": F.col("w")}, {"m": F.struct("w", "o")}).toPandas().sort_values(["g", "o"])
    want = df.toPandas().sort_values(["g", "o"])
    assert (got.t_before.to_numpy() == (want.groupby("g").w.cumsum() - want.w).to_numpy()).all()
    assert (got.m_upto.map(lambda s: s["w"]).to_numpy() == want.groupby("g").w.cummin().to_numpy()).all()


def test_calibration_minimises_the_loss(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=400) * 2
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.6 * z + 0.3)))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"z": z, "y": y}))
    loss = lambda a, b: np.mean(np.logaddexp(0, a * z + b) - y * (a * z + b))
    f = calibration.fit(df).first()
    assert all(loss(f.a, f.b) <= loss(f.a + da, f.b + db) for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))
    g = calibration.fit(df, slopes=[0.78, 1.0]).collect()
    for r in g:
        grid = min((loss(r.a, b), b) for b in np.arange(-1, 1.5, 0.001))
        assert r.b == pytest.approx(grid[1], abs=1e-3)
    c = calibration.fit(df, slope_bounds=(0.2, 0.4)).first()
    assert c.a == 0.4 and c.b == pytest.approx(min((loss(0.4, b), b) for b in np.arange(-1, 1.5, 0.001))[1], abs=1e-3)


def test_missing_and_duplicate_folds_are_named(spark):
    scans = spark.createDataFrame([(1,), (2,), (3,)], "uid long")
    with pytest.raises(KeyError, match="3"):
        cohort.folds_of(scans, spark.createDataFrame([(1, 0), (2, 1)], "uid long, fold int"), strict=True)
    with pytest.raises(ValueError, match="more than one"):
        cohort.folds_of(scans, spark.createDataFrame([(1, 0), (2, 1), (3, 1), (3, 2)], "uid long, fold int"), strict=True)


def test_coverage_names_holes_and_duplicates(spark):
    preds = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0)], "uid long, member int")
    scans = spark.createDataFrame([(1,), (2,), (3,)], "uid long")
    got = {(r.uid, r.member, r.n) for r in cohort.coverage(preds, scans, [0, 1]).collect()}
    assert got == {(2, 0, 2), (2, 1, 0), (3, 0, 0), (3, 1, 0)}


def test_probability_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (float("nan"),), (float("inf"),), (float("-inf"),)], "p double")
    got = [r.q for r in df.select(clip_prob(sanitise("p")).alias("q")).collect()]
    assert got == [1e-6, 1 - 1e-6, 0.5, 1 - 1e-6, 1e-6]
    assert df.limit(1).select(logit("p").alias("z")).first().z == pytest.approx(math.log(1e-6 / (1 - 1e-6)))


def flood(cells):
    left, parts = set(cells), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            c = todo.pop()
            part.add(c)
            for i, d in itertools.product(range(len(c)), (-1, 1)):
                n = tuple(v + d * (k == i) for k, v in enumerate(c))
                if n in left:
                    left.remove(n)
                    todo.append(n)
        parts.append(part)
    return parts


def spiral(n):
    g, x, y, dx, dy, out = set(), 0, 0, 1, 0, []
    for _ in range(n * n):
        out.append((x, y))
        g.add((x, y))
        ahead = (x + 2 * dx, y + 2 * dy)
        nx, ny = x + dx, y + dy
        if not (0 <= nx < n and 0 <= ny < n) or ahead in g:
            dx, dy = -dy, dx
            nx, ny = x + dx, y + dy
            if not (0 <= nx < n and 0 <= ny < n) or (nx, ny) in g or (x + 2 * dx, y + 2 * dy) in g:
                break
        x, y = nx, ny
    return out


def test_components_match_flood_fill(spark):
    rng = random.Random(4)
    scans = {0: spiral(17), 1: [c for c in itertools.product(range(17), range(17)) if rng.random() < 0.55], 2: [(3, 3)]}
    df = spark.createDataFrame([(u, *c) for u, cs in scans.items() for c in cs], "uid long, x int, y int")
    lab = components.components(df, {"x": 17, "y": 17})
    got = {}
    for r in lab.collect():
        got.setdefault((r.uid, r.label), set()).add((r.x, r.y))
    want = [(u, p) for u, cs in scans.items() for p in flood(cs)]
    assert len(got) == len(want)
    for u, p in want:
        assert got[(u, min(x * 17 + y for x, y in p))] == p
    big = components.largest(lab).groupBy("uid").count().collect()
    assert {r.uid: r["count"] for r in big} == {u: max(len(p) for p in flood(cs)) for u, cs in scans.items()}


def test_holes_are_filled(spark):
    ring = [(0, x, y) for x in range(1, 6) for y in range(1, 6) if (x, y) not in ((3, 3), (1, 1))]
    df = spark.createDataFrame(ring, "uid long, x int, y int")
    got = {(r.x, r.y) for r in components.fill_holes(df, {"x": 7, "y": 7}, df).collect()}
    assert (3, 3) in got and (1, 1) not in got and (0, 0) not in got


def image(spark, n, seed):
    v = np.random.default_rng(seed).random((n, n))
    rows = [(0, x, y, float(v[x, y])) for x in range(n) for y in range(n)]
    return v, stencil.by_scan(spark.createDataFrame(rows, "uid long, x int, y int, v double"))


def grid(df, col, n):
    out = np.zeros((n, n))
    for r in df.select("x", "y", col).collect():
        out[r.x, r.y] = r[col]
    return out


def test_smoothing_erosion_and_moments_against_numpy(spark):
    n = 11
    v, df = image(spark, n, 5)
    w = np.array(stencil.kernel(1.0))
    h = len(w) // 2
    for border, mode in (("zero", "constant"), ("replicate", "edge")):
        p = np.pad(v, h, mode=mode)
        want = sum(w[i] * w[j] * p[i : i + n, j : j + n] for i in range(len(w)) for j in range(len(w)))
        assert np.allclose(grid(stencil.smooth(df, ["x", "y"], "v", 1.0, border), "v", n), want)
    cur, total = v.copy(), 0
    for _ in range(3):
        p = np.pad(cur, 1, constant_values=np.inf)
        cur = np.min([p[i : i + n, j : j + n] for i in range(3) for j in range(3)], axis=0)
        total = total + cur
    assert np.allclose(grid(stencil.erosion_depth(df, ["x", "y"], "v", 3), "depth", n), total)
    t = maps.local_moments(df, "v", 5)
    p, k = np.pad(v, 2), 5
    off = (np.arange(k) - 2) / k
    for x, y in ((0, 0), (5, 5), (10, 3)):
        win = p[x : x + k, y : y + k]
        m0 = max(win.sum() / k**2, 1e-4)
        cx, cy = (win.sum(1) @ off) / k**2 / m0, (win.sum(0) @ off) / k**2 / m0
        u20 = max((win.sum(1) @ off**2) / k**2 / m0 - cx**2, 0)
        u11 = (off @ win @ off) / k**2 / m0 - cx * cy
        r = t.where((F.col("x") == x) & (F.col("y") == y)).first()
        assert r.u20 == pytest.approx(u20) and r.u11 == pytest.approx(u11)


def test_dense_grid_is_asserted(spark):
    _, df = image(spark, 4, 6)
    assert stencil.assert_dense(df, {"x": 4, "y": 4}).count() == 16
    with pytest.raises(Exception, match="not dense"):
        stencil.assert_dense(df.where("x + y > 0"), {"x": 4, "y": 4}).count()
    assert stencil.densify(df.where("x + y > 0"), {"x": 4, "y": 4}).count() == 16


def test_resample_identity_and_shift(spark):
    v = np.random.default_rng(7).random((3, 4, 5))
    df = spark.createDataFrame([(0, v.ravel().tolist())], "uid long, data array<double>")
    same = geometry.resample(df, v.shape, (F.col("x"), F.col("y"), F.col("z"))).orderBy("x", "y", "z").toPandas().v
    assert np.allclose(same, v.ravel())
    half = geometry.resample(df, v.shape, (F.col("x") + 0.5, F.col("y"), F.col("z"))).orderBy("x", "y", "z").toPandas().v
    want = (v + np.concatenate([v[1:], np.zeros((1, 4, 5))])) / 2
    assert np.allclose(half, want.ravel()) and not np.allclose(half, v.ravel())


def test_pose_matrix_maps_the_axis(spark):
    lx, rx, s = (40.0, 70.0, 44.0), (86.0, 78.0, 50.0), (110.0, 140.0, 60.0)
    cols = {f"l{a}": v for a, v in zip("xyz", lx)} | {f"r{a}": v for a, v in zip("xyz", rx)} | {f"s{a}": v for a, v in zip("xyz", s)}
    m = geometry.pose_matrix(spark.createDataFrame(pd.DataFrame([{"uid": 1, **cols}]))).first()
    a = np.array([[m[f"a{i}{j}"] for j in range(4)] for i in range(3)])
    mid = (np.array(lx) + rx) / 2
    assert np.allclose(a @ [64, 74, 46, 1], mid)
    d = np.array(rx) - lx
    gap = np.linalg.norm(d) * np.clip(122 / 110, 0.8, 1.25)
    assert np.allclose(a @ [64 + gap / 2, 74, 46, 1], rx)


def test_epps_pulley_equals_the_pair_sum(spark):
    x = np.random.default_rng(8).normal(size=60) * 1.5
    df = spark.createDataFrame([(0, float(v)) for v in x], "k int, v double")
    want = np.exp(-((x[:, None] - x[None]) ** 2) / 2).mean() - math.sqrt(2) * np.exp(-(x**2) / 4).mean() + 1 / math.sqrt(3)
    assert study.epps_pulley(df, "v", "k").first().distance == pytest.approx(want, abs=1e-9)


def test_permutation_keeps_values_and_moves_them(spark):
    df = spark.createDataFrame([(i, i % 2, float(i)) for i in range(200)], "uid long, y int, v double")
    got = study.permuted(df, ["y"], "v", "s").toPandas()
    assert sorted(got.v) == [float(i) for i in range(200)] and (got.v % 2 == got.y).all()
    assert (got.v != got.uid).mean() > 0.9


def test_bootstrap_equals_weighted_statistics(spark):
    """Ties across slices, one slice or many, and a plan that does not grow with the replicates."""
    r = np.random.default_rng(2)
    n, reps = 400, 30
    pdf = pd.DataFrame({"uid": range(n), "y": r.integers(0, 2, n), "a": np.round(r.normal(size=n), 1), "b": np.where(r.random(n) < 0.4, 0.5, r.normal(size=n))})
    df = spark.createDataFrame(pdf)
    w = study.poisson1_weights(list(range(n)), "s", reps)
    same = spark.range(n).select(F.transform(F.sequence(F.lit(0), F.lit(reps - 1)), lambda k: poisson1(uniform(F.col("id"), F.lit("s"), k))).alias("w")).collect()
    assert (w == np.array([x.w for x in same])).all()
    want = []
    clip = lambda z: np.clip(1 / (1 + np.exp(-z)), 1e-6, 1 - 1e-6)
    ll = lambda p: -np.where(pdf.y == 1, np.log(p), np.log(1 - p))
    dl = ll(clip(pdf.b)) - ll(clip(pdf.a))
    for k in range(reps):
        auc = {}
        for c in "ab":
            x, v = pdf[c].to_numpy(), w[:, k]
            pos, neg = pdf.y == 1, pdf.y == 0
            wins = (x[pos][:, None] > x[neg][None]) + 0.5 * (x[pos][:, None] == x[neg][None])
            auc[c] = (wins * np.outer(v[pos], v[neg])).sum() / (v[pos].sum() * v[neg].sum())
        want.append(((w[:, k] * dl).sum() / w[:, k].sum(), auc["b"] - auc["a"]))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "8", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = study.bootstrap_deltas(df, "a", "b", "y", reps, "s").orderBy("rep").collect()
            assert np.allclose([(x.d_ll, x.d_auc) for x in got], want), parts
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    size = lambda k: len(study.bootstrap_deltas(df, "a", "b", "y", k, "s")._jdf.queryExecution().analyzed().toString())
    assert abs(size(200) - size(12)) < 100


def test_permutations_of_many_replicates(spark):
    df = spark.createDataFrame([(i, i % 2, float(i)) for i in range(100)], "uid long, y int, v double")
    many = df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(5))))
    got = study.permuted(many, ["rep", "y"], "v", F.concat(F.lit("p"), F.col("rep").cast("string"))).toPandas()
    one = study.permuted(df, ["y"], "v", "p3").toPandas().set_index("uid").v
    third = got[got.rep == 3].set_index("uid").v
    assert len(got) == 500 and (third.sort_index() == one.sort_index()).all() and got.groupby("uid").v.nunique().mean() > 3


def test_fits_by_group_equal_fits_alone(spark):
    """The table of fits takes the same steps as a fit on its own: free, bounded, pinned, separable and null groups."""
    r = np.random.default_rng(6)
    rows = []
    for g in range(12):
        a, b = r.uniform(0.1, 4.5), r.uniform(-1, 1)
        for z in r.normal(size=80) * 2:
            rows.append((g if g else None, float(z), float(r.random() < 1 / (1 + math.exp(-(a * z + b))))))
    rows += [(99, -1.0, 0.0), (99, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, z double, y double")
    for options in ({"slope_bounds": (0.3, 2.0)}, {"slopes": [0.5, 1.5], "intercept_bounds": (-0.5, 0.5)}, {"intercept": 0.1}):
        many = calibration.fit(df, group="g", steps=14, **options).collect()
        assert len(many) == 13 * len(options.get("slopes", [0]))
        for g in (None, 5, 99):
            alone = calibration.fit(df.where(F.col("g").eqNullSafe(g)), steps=14, **options).collect()
            mine = [x for x in many if x.g == g]
            for x, y in zip(sorted(mine, key=str), sorted(alone, key=str), strict=True):
                assert (x.slope, x.converged) == (y.slope, y.converged), (g, options)
                if y.converged:
                    assert (x.a, x.b) == pytest.approx((y.a, y.b), abs=1e-8), (g, options)


def test_a_hundred_thousand_groups(spark):
    n = 100_000
    df = spark.range(n * 8, numPartitions=8).select(F.floor(F.col("id") / 8).alias("g"), (F.col("id") % 8 - 3.5).alias("z"), (((F.col("id") % 8) >= 4) != ((F.col("id") % 8).isin(2, 5) & (F.floor(F.col("id") / 8) % 2 == 0) | (F.col("id") % 8).isin(3, 4))).cast("int").alias("y"))
    got = calibration.fit(df, group="g").agg(F.count("*").alias("n"), F.count_if("converged").alias("ok"), F.countDistinct(F.round("a", 6)).alias("kinds"), F.max(F.abs("b")).alias("b")).first()
    assert (got.n, got.ok, got.kinds) == (n, n, 2) and got.b < 1e-6


def test_elimination_solves(spark):
    r = np.random.default_rng(3)
    m = r.normal(size=(5, 9))
    h, g = m @ m.T, r.normal(size=5)
    row = {f"h{i}_{j}": float(h[i, j]) for i in range(5) for j in range(i, 5)} | {f"g{i}": float(v) for i, v in enumerate(g)}
    got = study.solved(spark.createDataFrame(pd.DataFrame([row])), "h", "g", "x", 5).first()
    assert np.allclose([got[f"x{i}"] for i in range(5)], np.linalg.solve(h, g))


def test_logistic_fits_are_out_of_fold(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-1.2 * x))).astype(int)
    pdf = pd.DataFrame({"uid": range(300), "x": x, "y": y, "fold": np.arange(300) % 3, "fit": "a"})
    got = study.logistic_fits(spark.createDataFrame(pdf), "fit", "fold", ["x"], "y").toPandas().set_index("uid").score
    for f in range(3):
        tr = pdf[pdf.fold != f]
        b = np.zeros(2)
        X = np.c_[np.ones(len(tr)), tr.x]
        for _ in range(12):
            p = 1 / (1 + np.exp(-X @ b))
            b += np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X + 1e-6 * np.eye(2), X.T @ (tr.y - p) - 1e-6 * b)
        te = pdf[pdf.fold == f]
        assert np.allclose(got.loc[te.uid], b[0] + b[1] * te.x, atol=1e-6)


def test_poisson_counts_fit_at_every_mean():
    """Chi-square against the probabilities, with cells of at least ten expected counts."""
    n = 40000
    for m in (1e-3, 0.5, 3.0, 15.9, 29.0, 31.0, 2000.0):
        counts = augment.poisson_counts(np.full(n, m), f"m{m}")
        top = int(m + 12 * math.sqrt(m) + 12)
        p = np.exp([i * math.log(m) - m - math.lgamma(i + 1) for i in range(top)]) * n
        seen = np.bincount(counts.astype(int), minlength=top)
        cells, e, o = [], 0.0, 0
        for x, y in zip(p, seen):
            e, o = e + x, o + y
            if e >= 10:
                cells.append((e, o))
                e, o = 0.0, 0
        e, o = np.array(cells).T
        free = max(1, len(cells) - 1)
        assert len(seen) == top and ((o - e) ** 2 / e).sum() < free + 5 * math.sqrt(2 * free), m
    assert (augment.poisson_counts(np.array([0.0, -1.0]), "z") == 0).all()


def test_count_noise_is_keyed_by_scan_and_voxel(spark):
    df = spark.range(6).select(F.col("id").alias("uid"), F.array_repeat(F.lit(4.0), 5000).alias("data")).unionByName(spark.createDataFrame([(9, None)], "uid long, data array<double>"))
    noisy = lambda d: {r.uid: r.v for r in d.select("uid", augment.count_noise("data", F.lit(100.0)).alias("v")).collect()}
    one = noisy(df)
    assert one == noisy(df.repartition(5)) and one[9] is None and one[0] != one[1]
    v = np.array([one[k] for k in range(6)])
    assert v.mean() == pytest.approx(4.0, rel=0.01) and v.var() == pytest.approx(0.04, rel=0.06)


def test_array_smoothing_equals_padded_convolution(spark):
    r = np.random.default_rng(0)
    for dims in ((5, 6, 7), (8, 8)):
        v = r.random(dims)
        b = spark.createDataFrame([(0, v.ravel().tolist(), 0.8), (1, None, 0.8), (2, v.ravel().tolist(), None)], "uid long, data array<double>, s double")
        for border, only in itertools.product(("zero", "replicate"), (None, (0,), (1,))):
            got = {x.uid: x for x in b.select("uid", stencil.smooth_box("data", dims, 1.0, border, only=only).alias("a"), stencil.smooth_box("data", dims, F.col("s"), border, taps=5, only=only).alias("c")).collect()}
            assert got[1].a is None and got[1].c is None and got[2].c is None
            for w, found in ((stencil.kernel(1.0), got[0].a), (stencil.kernel(0.8, 5), got[0].c)):
                want, half = v, len(w) // 2
                for a in range(len(dims)) if only is None else only:
                    pad = [(half, half) if k == a else (0, 0) for k in range(len(dims))]
                    y = np.pad(want, pad, mode="edge" if border == "replicate" else "constant")
                    want = sum(c * np.take(y, range(k, k + dims[a]), axis=a) for k, c in enumerate(w))
                assert np.allclose(found, want.ravel())


@pytest.mark.parametrize("dims", [(7,), (5, 6), (4, 5, 6), (17, 17)])
def test_face_labels_match_a_plain_search(dims):
    r = np.random.default_rng(1)
    for share in (0.0, 0.3, 0.5, 0.7, 1.0):
        cell = r.permutation(np.flatnonzero((r.random(dims) < share).ravel()))
        label = {}
        for c0 in sorted(cell.tolist()):
            todo = [c0] if c0 not in label else []
            while todo:
                c = todo.pop()
                label[c] = c0
                for a, d in itertools.product(range(len(dims)), (-1, 1)):
                    y = list(np.unravel_index(c, dims))
                    y[a] += d
                    if 0 <= y[a] < dims[a] and (k := int(np.ravel_multi_index(y, dims))) in cell and k not in label:
                        todo.append(k)
        assert [label[c] for c in cell.tolist()] == components.face_labels(cell, dims).tolist()


def test_draws_repeat_and_differ(spark):
    df = spark.range(48).withColumnRenamed("id", "uid")
    one = df.select(augment.draw("a").alias("u"), augment.draw("a", scope="batch").alias("b")).toPandas()
    two = df.repartition(5).orderBy("uid").select(augment.draw("a").alias("u")).toPandas()
    other = df.select(augment.draw("a", epoch=1).alias("u")).toPandas()
    assert (one.u == two.u).all() and (one.u != other.u).all() and one.b.nunique() == 2


def test_normalise_fallbacks(spark):
    df = spark.createDataFrame([(0, [0.0] * 64), (1, [float(i) for i in range(64)])], "uid long, data array<double>")
    out = {r.uid: np.array(r.d) for r in df.select("uid", volumes.brain_mean_normalise("data").alias("d")).collect()}
    v = np.arange(64.0)
    big = v > 0.15 * np.quantile(v, 0.999)
    assert (out[0] == 0).all() and np.allclose(out[1], np.clip(v / (v[big].mean() + 1e-6), 0, 12))


def test_scoring_plans_may_not_mix_scans(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2]), (2, [1.0, float("nan")])], "uid long, logits array<double>")
    ok = scoring.assert_per_scan(scoring.score_logits(df, 1.0, 0.0, 6.0))
    assert {r.uid: (round(r.p, 6), r.ok) for r in ok.collect()} == {1: (round(1 / (1 + math.exp(-0.15)), 6), True), 2: (0.5, False)}
    mixed = (
        df.groupBy("uid").count(), df.groupBy("uid").applyInArrow(lambda t: t, df.schema), df.intersect(df), df.offset(1), df.limit(1),
        df.sample(0.5), df.distinct(), df.orderBy("uid"), df.join(df, "uid"), df.mapInArrow(lambda it: it, df.schema),
    )
    for plan in mixed:
        with pytest.raises(ValueError, match="alone"):
            scoring.assert_per_scan(plan)


def test_failing_scans_are_isolated(spark):
    df = spark.createDataFrame([(i, [float(i)] * 4) for i in range(6)], "uid long, data array<double>")

    def fn(member, batch, mirrored):
        if (batch["uid"] == 3).any():
            raise RuntimeError("unreadable")
        return batch["data"].map(sum)

    got = scoring.score_with(df, [0], fn).toPandas()
    assert set(got[~got.ok].uid) == {3} and len(got) == 12
    assert set(got[~got.ok].error) == {"RuntimeError: unreadable"}
    hedged = {r.uid: (r.p, r.ok) for r in scoring.hedge_views(scoring.score_with(df, [0, 1], fn, rows=2), 1.0, 0.0, 6.0).collect()}
    assert len(hedged) == 6 and hedged[3] == (0.5, False) and all(ok for i, (_, ok) in hedged.items() if i != 3)


def test_scorer_of_wrong_length_is_refused(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "uid long, data array<double>")
    got = scoring.score_with(df, [0], lambda m, b, v: b["data"].map(sum).iloc[:1]).toPandas()
    assert got.ok.all() and sorted(got[got.view == 0].z) == [0, 1, 2, 3, 4]


def test_separable_subsets_say_so(spark):
    rows = [("apart", float(i), int(i > 0)) for i in range(-5, 6)] + [("mixed", float(i), int((i * 7) % 3 == 0)) for i in range(-20, 21)]
    out = {r.g: r for r in calibration.fit(spark.createDataFrame(rows, "g string, z double, y int"), group="g").collect()}
    assert out["mixed"].converged and not out["apart"].converged and math.isfinite(out["apart"].a)


def test_late_epochs_are_read(spark):
    text = spark.createDataFrame([("[run7 f2] ep123 val ll 0.1000 auc 0.9000 (best 0.0900@101)",), ("[run7 f2] ep07 val ll 0.2000 auc 0.9000 (best 0.2000@7)",)], "value string")
    assert sorted(r.epoch for r in parse_log(text).where("kind = 'epoch'").collect()) == [7, 123]


def test_arrays_are_rebuilt_on_any_grid(spark):
    dims = (6, 5, 4)
    r = np.random.default_rng(0)
    full = r.random(dims)
    keep = r.random(dims) < 0.3
    rows = [(1, int(x), int(y), int(z), float(full[x, y, z])) for x, y, z in np.argwhere(keep)] + [(2, 5, 4, 3, 2.0)]
    out = {b.uid: np.array(b["data"]).reshape(dims) for b in volumes.to_boxes(spark.createDataFrame(rows, "uid long, x int, y int, z int, v double"), dims).collect()}
    assert np.allclose(out[1], np.where(keep, full, 0)) and out[2].sum() == 2 and out[2][5, 4, 3] == 2


def test_order_statistics_of_nothing(spark):
    df = spark.createDataFrame([([],), ([3.0],)], "a array<double>")
    got = [tuple(r) for r in df.select(sorted_quantile("a", 0.9), sorted_nearest("a", 0.9)).collect()]
    assert got == [(None, None), (3.0, 3.0)]


def test_calibrate_is_monotone(spark):
    p = [r.p for r in spark.range(-5, 6).select(calibrate(F.col("id").cast("double"), 0.78, -0.1).alias("p")).collect()]
    assert p == sorted(p) and 0 < p[0] < p[-1] < 1


def test_content_roots_do_not_depend_on_writers(spark):
    from voxcohort.sources import files

    rows = [("a", f"line {i}") for i in range(700)] + [("a", "twice")] * 300 + [("b", "x")]
    df = spark.createDataFrame(rows, "name string, value string")
    roots = lambda d, leaf: {r.name: (r.md5, r.length) for r in files.content_roots(d, leaf=leaf).collect()}
    for leaf in (1, 10, 5000):
        one = roots(df, leaf)
        assert one == roots(df.repartition(7), leaf) and one["a"][1] == 1000
        assert roots(df.where("value <> 'line 3'"), leaf)["a"] != one["a"]
        assert roots(df.unionByName(df.where("value = 'line 3'")), leaf)["a"] != one["a"]
        assert roots(df.where("value <> 'line 3'"), leaf)["b"] == one["b"]


def test_covariances_merge_over_tasks(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(90, 4))
    g = [f"g{i % 4}" if i % 9 else None for i in range(88)] + ["few", "few"]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(g, x)] + [("g1", None)], "k string, v array<float>")
    want = {k: np.cov(x.astype(np.float32)[[i for i, q in enumerate(g) if q == k]].T) for k in set(g) - {"few", None}}
    for parts in (1, 6):
        got = study.covariances(df.repartition(parts), "k", "v").collect()
        assert {q.k for q in got} >= set(want) and "few" not in {q.k for q in got}
        assert all(q["cov"] == pytest.approx(want[q.k][q.i, q.j], abs=1e-6) for q in got if q.k is not None) and len([q for q in got if q.k == "g1"]) == 10
