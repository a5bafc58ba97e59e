"""Kernels against planted truth."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lattiq.functions import kernels as K
from lattiq.model import CubeMeta
from lattiq.operators import crystal, detect, flowlines, orientation, phase, strain
from lattiq.operators import classify as L
from lattiq.operators import peaks as P


def cube_of(spark, frames: dict):
    return spark.createDataFrame([(x, y, a.ravel().tolist()) for (x, y), a in frames.items()], "rx long, ry long, data array<double>")


def disk(n, x0, y0, r=2.5):
    x, y = np.indices((n, n))
    return 1 / (1 + np.exp(np.clip(4 * (np.hypot(x - x0, y - y0) - r), -60, 60)))


def test_disks_are_found_to_a_fraction_of_a_pixel(spark):
    places = {(0, 0): [(10.3, 12.6), (22.0, 20.4)], (0, 1): [(15.5, 9.25)]}
    cube = cube_of(spark, {k: sum(disk(32, *p) for p in v) for k, v in places.items()})
    template = np.fft.ifftshift(disk(32, 16, 16))
    for how, bound in (("pixel", 0.71), ("poly", 0.15), ("multicorr", 0.1)):
        out = detect.find_disks(cube, template, CubeMeta(32, 32), subpixel=how, least_relative=0.5, spacing=4, edge=2).toPandas()
        for (rx, ry), want in places.items():
            got = out[(out.rx == rx) & (out.ry == ry)][["qx", "qy"]].to_numpy()
            assert len(got) == len(want)
            assert all(np.hypot(*(got - w).T).min() < bound for w in want)


def test_origins_of_shifted_disks(spark):
    cube = cube_of(spark, {(0, k): disk(32, 15 + k, 14.5 - k) for k in range(3)})
    for out, bound in ((detect.origins(cube, 2.0, 2.0, CubeMeta(32, 32)), 0.05), (detect.origins_friedel(cube, CubeMeta(32, 32)), 0.15)):
        for r in out.collect():
            assert abs(r["qx0"] - 15 - r["ry"]) < bound and abs(r["qy0"] - 14.5 + r["ry"]) < bound


def test_lattice_and_strain_are_recovered(spark):
    g1, g2, rows = (8.0, 0.5), (-0.6, 7.0), []
    for k in range(4):
        e = np.array([[1 + 0.01 * k, 0.004 * k], [0.002 * k, 1 - 0.005 * k]])
        for h in range(-2, 3):
            for l in range(-2, 3):
                q = e @ (h * np.array(g1) + l * np.array(g2)) + [32.3, 31.2]
                rows.append((0, k, float(q[0]), float(q[1]), 1.0 + 0.1 * (h + l) ** 2))
    peaks = spark.createDataFrame(rows, "rx long, ry long, qx double, qy double, intensity double")
    fit = strain.fit_lattice(strain.index_peaks(peaks, (32.3, 31.2), g1, g2, 2.5))
    s = {r["ry"]: r for r in strain.strain(fit, spark.createDataFrame([(*g1, *g2)], "r_g1x double, r_g1y double, r_g2x double, r_g2y double")).collect()}
    for k in range(4):
        assert abs(s[k]["e_xx"] + 0.01 * k) < 1e-9 and abs(s[k]["e_yy"] - 0.005 * k) < 1e-9 and abs(s[k]["e_xy"] + 0.003 * k) < 1e-9
    assert all(r["error"] < 1e-9 for r in fit.collect())
    back = strain.rotate_strain(strain.rotate_strain(strain.strain(fit, strain.reference(fit)), (1.0, 2.0)).withColumn("x", F.lit(0)), (1.0, -2.0))
    for a, b in zip(back.orderBy("ry").collect(), strain.strain(fit, strain.reference(fit)).orderBy("ry").collect()):
        assert abs(a["e_xx"] - b["e_xx"]) < 1e-12 and abs(a["e_xy"] - b["e_xy"]) < 1e-12


def test_histogram_keeps_the_sum_and_thinning_is_greedy(spark):
    rng = np.random.default_rng(0)
    rows = [(0, 0, float(x), float(y), float(i)) for x, y, i in rng.random((200, 3)) * [14, 14, 5]]
    peaks = spark.createDataFrame(rows, "rx long, ry long, qx double, qy double, intensity double")
    assert abs(P.histogram(peaks, 16, 16).agg(F.sum("value")).first()[0] - sum(r[4] for r in rows)) < 1e-9
    kept, want = {(r["qx"], r["qy"]) for r in P.min_spacing(peaks, 2.0).collect()}, []
    for _, _, x, y, _ in sorted(rows, key=lambda r: -r[4]):
        if all(math.hypot(x - a, y - b) >= 2.0 for a, b in want):
            want.append((x, y))
    assert kept == set(want)


def test_surfaces_are_fitted(spark):
    df = spark.createDataFrame([(i, j, 1 + 0.2 * i - 0.1 * j + 0.03 * i * j + (5.0 if (i, j) == (3, 3) else 0.0)) for i in range(6) for j in range(6)], "rx long, ry long, v double")
    _, robust = P.fit_surface(df, ["v"], "parabola", robust_steps=3)
    assert all(abs(r["v"] - r["v_fit"]) < 1e-6 for r in robust.collect() if (r["rx"], r["ry"]) != (3, 3))
    _, bezier = P.fit_surface(df.where("rx != 3 or ry != 3"), ["v"], "bezier_two", scale=(5.0, 5.0))
    assert all(abs(r["v"] - r["v_fit"]) < 1e-8 for r in bezier.collect())


def test_friedel_midpoints(spark):
    rows = [(0, 0, 30.5 + s * a, 29.25 + s * b, 1.0) for a, b in ((5.0, 1.0), (-2.0, 6.0), (4.0, 5.0)) for s in (1, -1)] + [(0, 0, 40.0, 22.0, 9.0)]
    r = P.friedel_origin(spark.createDataFrame(rows, "rx long, ry long, qx double, qy double, intensity double"), (30.0, 30.0), 2.0, 9.0, 3.0).first()
    assert r["pairs"] == 3 and abs(r["qx0"] - 30.5) < 1e-9 and abs(r["qy0"] - 29.25) < 1e-9


def test_whole_patterns_are_fitted(spark):
    x, y = np.indices((16, 16))
    part = detect.disk_lattice(1, 1.5, 1.0)
    true = {"level": 0.2, "x0": 7.6, "y0": 8.2, "ux": 5.1, "uy": 0.2, "vx": -0.3, "vy": 4.8, "height": 2.0}
    a = true["level"] + part(x, y, *(true[k] for k in ("x0", "y0", "ux", "uy", "vx", "vy", "height")))
    spec = {k: (v, v - 3, v + 3) for k, v in (("x0", 7.5), ("y0", 8.0), ("ux", 5.0), ("uy", 0.0), ("vx", 0.0), ("vy", 5.0), ("height", 1.0))}
    model = detect.Model((detect.constant, {"level": (0.0, -1, 1)}), (part, spec))
    r = detect.fit_all(cube_of(spark, {(0, 0): a}), model, CubeMeta(16, 16)).first()
    assert all(abs(r[k] - v) < 1e-3 for k, v in true.items()) and r["status"] == 1


def test_crystal_and_orientation(spark):
    real = crystal.lattice((3.0, 4.0, 5.0, 80.0, 95.0, 110.0))
    assert np.allclose(real @ crystal.reciprocal(real).T, np.eye(3)) and np.allclose(np.linalg.norm(real, axis=1), [3, 4, 5])
    assert abs(crystal.wavelength(200e3) - 0.0250793) < 1e-6 and crystal.rational(np.array([0.5, 1.0, 0])) == (1, 2, 0)
    fcc = spark.createDataFrame([(x, y, z, 13, 1.0) for x, y, z in ((0.0, 0.0, 0.0), (0.5, 0.5, 0.0), (0.5, 0.0, 0.5), (0.0, 0.5, 0.5))], "x double, y double, z double, number int, occ double")
    table = spark.createDataFrame([(13, *[1.0] * 5, *[1.0] * 5)], "number int, " + ", ".join(f"{c}{i} double" for c in "ab" for i in range(1, 6)))
    real = crystal.lattice(4.05)
    hkl = crystal.structure_factors(crystal.reflections(spark, real, 1.0), fcc, table, real).toPandas()
    assert all(len({h % 2, k % 2, l % 2}) == 1 for h, k, l in hkl[["h", "k", "l"]].itertuples(index=False))
    plan = orientation.plan(hkl, orientation.zone_axes([(0, 0, 1), (0, 1, 1), (1, 1, 1)], 8.0), n_gamma=120)
    rows, want = [], {}
    for k, (zone, turn) in enumerate(((0, 0.3), (5, 1.1), (len(plan.matrices) - 1, 2.0))):
        c, s = math.cos(turn), math.sin(turn)
        m = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]) @ plan.matrices[zone]
        want[k] = m
        rows += [(0, k, *map(float, r)) for r in orientation.simulate(hkl, m, 200e3, 0.02)[["qx", "qy", "intensity"]].itertuples(index=False)]
    peaks = spark.createDataFrame(rows, "rx long, ry long, qx double, qy double, intensity double")
    found = orientation.match_orientations(peaks, plan)
    sym = orientation.cubic_symmetry()
    assert len(sym) == 24
    for r in found.collect():
        assert r["corr"] > 0.9
        g = orientation.simulate(hkl, np.array(r["matrix"]).reshape(3, 3), 200e3, 0.02)
        w = orientation.simulate(hkl, want[r["ry"]], 200e3, 0.02)
        d = np.hypot(g.qx.to_numpy()[:, None] - w.qx.to_numpy()[None], g.qy.to_numpy()[:, None] - w.qy.to_numpy()[None])
        assert d.min(axis=0).max() < 0.06
    e = orientation.orientation_strain(peaks, found, hkl, 200e3, 0.02, 0.1).toPandas()
    assert e[["e_xx", "e_yy", "e_xy"]].abs().max().max() < 0.03
    library = {n: orientation.simulate(hkl, crystal.orientation(z), 200e3, 0.02) for n, z in (("a", (0, 0, 1)), ("b", (0, 1, 1)))}
    mixed = spark.createDataFrame([(0, 0, float(r.qx), float(r.qy), float(r.intensity)) for r in library["b"].itertuples()], "rx long, ry long, qx double, qy double, intensity double")
    w = {r["phase"]: r for r in orientation.phase_weights(mixed, library, 0.02).collect()}
    assert w["b"]["weight"] > 10 * w["a"]["weight"] and w["b"]["residual"] < 0.2
    b = orientation.bloch(hkl, crystal.orientation((0, 0, 1)), 200e3, [0.0, 80.0])
    assert np.allclose(b.groupby("thickness").intensity.sum(), 1, atol=1e-6)


def test_grains_follow_the_seed(spark):
    rows = []
    for x in range(4):
        for y in range(4):
            t = 0.0 if y < 2 else 0.5
            c, s = math.cos(t), math.sin(t)
            rows.append((x, y, 0, 1.0 - 0.01 * (x + y), [c, -s, 0.0, s, c, 0.0, 0.0, 0.0, 1.0]))
    g = orientation.cluster_grains(spark.createDataFrame(rows, "rx long, ry long, match long, corr double, matrix array<double>"), 5.0)
    assert g.grain.nunique() == 2 and (g[g.ry < 2].grain == 0).all() and (g[g.ry >= 2].grain == 1).all()


def test_phase_reconstructions(spark):
    x, y = np.meshgrid(np.arange(32) / 32, np.arange(32) / 32, indexing="ij")
    true = np.sin(2 * np.pi * x) * np.cos(4 * np.pi * y)
    gx, gy = (np.roll(true, -1, 0) - np.roll(true, 1, 0)) / 2, (np.roll(true, -1, 1) - np.roll(true, 1, 1)) / 2
    got, errors = phase.dpc(gx, gy)
    assert np.allclose(got, true - true.mean(), atol=1e-3) and all(b <= a for a, b in zip(errors, errors[1:]))
    rng = np.random.default_rng(3)
    base = np.pad(rng.random((12, 12)), 2)
    images = pd.DataFrame({"qx": [0, 0, 1], "qy": [0, 1, 0], "image": [np.roll(base, s, (0, 1)).ravel().tolist() for s in ((0, 0), (1, 0), (0, -1))]})
    _, shifts, errors = phase.parallax(spark.createDataFrame(images, "qx long, qy long, image array<double>"), 16, 16, 3)
    d = shifts[["dx", "dy"]].to_numpy() - shifts[["dx", "dy"]].to_numpy()[0]
    assert np.allclose(d, [[0, 0], [-1, 0], [0, 1]], atol=0.1)
    assert errors[-1] < errors[0]
    probe = np.fft.fft2(np.where(np.hypot(np.fft.fftfreq(16)[:, None], np.fft.fftfreq(16)[None]) < 0.2, 1.0, 0.0)) / 16
    probe = np.fft.fftshift(probe)
    phases = K.gaussian_filter(rng.random((32, 32)), 1.5, "wrap")  # what the probe's aperture lets through
    obj = np.exp(0.6j * (phases - phases.min()) / np.ptp(phases))
    rows = []
    for px in range(0, 32, 4):
        for py in range(0, 32, 4):
            patch, _, _ = phase._overlap(obj, probe, np.array([[px, py]], float))
            rows.append((float(px), float(py), np.abs(np.fft.fft2(patch[0] * probe)).ravel().tolist()))
    got, _, errors = phase.ptychography(spark.createDataFrame(rows, "x double, y double, amplitude array<double>"), (32, 32), probe, iterations=40, fix_probe=True)
    assert errors[-1] < 0.05 * errors[0]
    likeness = lambda o: abs(np.vdot(o - o.mean(), obj - obj.mean())) / np.linalg.norm(o - o.mean()) / np.linalg.norm(obj - obj.mean())
    assert likeness(np.asarray(got)) > 0.9


def test_decompositions(spark):
    rng = np.random.default_rng(4)
    h = np.array([[3.0, 0, 1, 0], [0, 2, 0, 1]])
    x = rng.random((60, 2)) @ h
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    _, errors = L.nmf(df, "v", 2, 15)
    assert errors[-1] < 0.05 * float((x**2).sum()) and errors[-1] <= errors[0]
    mean, components, values = L.pca(df, "v", 2)
    c = np.cov(x.T)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(values, np.sort(np.linalg.eigvalsh(c))[::-1][:2]) and np.allclose(components @ c @ components.T, np.diag(values), atol=1e-9)


def test_flow_lines_follow_the_angle():
    hist = np.zeros((20, 20, 12))
    hist[:, 10, 0] = 5.0
    lines = flowlines.flowlines(hist, 1.0)
    assert len(lines) == 1 and np.ptp(lines[0][:, 0]) > 15 and np.ptp(lines[0][:, 1]) < 1
    c = flowlines.orientation_correlation(hist[None], 4)
    assert c.shape == (1, 7, 4) and c[0, 0, 0] > c[0, 3, 0]
