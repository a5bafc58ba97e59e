"""Composed operators against brute force and planted truth."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.functions import kernels as K
from lattiq.model import CubeMeta
from lattiq.operators import classify as L
from lattiq.operators import detect, polar, probes, rings
from lattiq.operators import peaks as P
from lattiq.operators.quantiles import grouped_quantiles


def test_quantiles_of_ties_nulls_and_single_values(spark):
    rng = np.random.default_rng(3)
    groups = {0: rng.integers(0, 4, 101).astype(float), 1: rng.normal(size=40), 2: np.array([7.0]), 3: np.repeat(-1.5, 9)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [(0, None), (4, None)]
    shares = {"low": 0.25, "mid": 0.5, "high": 0.9, "first": 0.0, "last": 1.0}
    got = {r["g"]: r for r in grouped_quantiles(spark.createDataFrame(rows, "g int, v double"), ["g"], F.col("v"), shares).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for g, values in groups.items():
        for name, share in shares.items():
            assert got[g][name] == pytest.approx(np.quantile(values, share), abs=1e-12)


def test_stacks_of_patterns_with_and_without_peaks(spark):
    """More patterns than one stack holds; every third has nothing."""
    n, meta = 700, CubeMeta(64, 64)
    frames = np.zeros((n, 64, 64))
    for k in range(n):
        if k % 3:
            frames[k, 5 + k % 50, 7 + k % 40] = 1.0 + k
    assert n > detect.STACK_VALUES // meta.q_n
    cube = spark.createDataFrame([(0, k, f.ravel().tolist()) for k, f in enumerate(frames)], "rx long, ry long, data array<double>").coalesce(1)
    got = {r["ry"]: (r["qx"], r["qy"], r["intensity"]) for r in detect.find_disks(cube, None, meta, least=0.5).collect()}
    assert got == {k: (5.0 + k % 50, 7.0 + k % 40, 1.0 + k) for k in range(n) if k % 3}


def test_maxima_of_a_stack_are_those_of_its_patterns():
    a = np.random.default_rng(1).integers(0, 5, (6, 9, 11)).astype(float)  # plateaus
    for edge in (1, 2):
        tops = K.local_maxima(a, edge)
        for k, x in enumerate(a):
            want = {(i, j) for i in range(edge, 9 - edge) for j in range(edge, 11 - edge) if all(x[i, j] >= x[i + p, j + q] for p, q in ((1, 0), (0, 1), (1, 1), (-1, 1))) and all(x[i, j] > x[i + p, j + q] for p, q in ((-1, 0), (0, -1), (1, -1), (-1, -1)))}
            assert set(zip(*np.nonzero(tops[k]))) == want
            assert {(p[0], p[1]) for p in K.maxima_2d(x, edge=edge, top=tops[k])} == {(p[0], p[1]) for p in K.maxima_2d(x, edge=edge)}
    assert not K.local_maxima(np.ones((2, 9)), 1).any()


def test_disk_means_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    frame = rng.random((8, 8))
    points = [(0.2, 0.1), (3.5, 4.5), (7.4, 7.4), (20.0, 3.0)]
    cube = spark.createDataFrame([(0, 0, frame.ravel().tolist())], "rx long, ry long, data array<double>")
    peaks = spark.createDataFrame([(0, 0, *p) for p in points + points[:1]], "rx long, ry long, qx double, qy double")
    x, y = np.indices((8, 8))
    means = {p: frame[(x - p[0]) ** 2 + (y - p[1]) ** 2 <= 1.6**2].mean() for p in points[:3]}
    got = {(r["qx"], r["qy"]): r["intensity"] for r in rings.integrate_disks(cube, peaks, 1.6).collect()}
    assert got.keys() == means.keys()
    for p, m in means.items():
        assert got[p] == pytest.approx(m / max(means.values()))


def test_symmetry_of_a_masked_ring(spark):
    """Four-fold intensity behind a stop, against the autocorrelations written out."""
    n, t = 24, np.arange(24)
    value, seen = 2 + np.cos(2 * np.pi * 4 * t / n), (t < 9) | (t > 13)
    rows = [(0, 0, int(k), 3, float(value[k]) if seen[k] else None) for k in t]
    out = polar.annular_symmetry(spark.createDataFrame(rows, "rx long, ry long, t int, r int, value double"), 6, n).orderBy("order").collect()
    auto = lambda v: np.fft.ifft(np.abs(np.fft.fft(v)) ** 2).real / v.sum() ** 2 - 1
    want = np.abs(np.fft.fft(auto(value * seen) - auto(seen.astype(float))))[1:7]
    assert np.allclose([r["power"] for r in out], want, atol=1e-12)


def test_beam_stop_is_a_grown_wedge_and_a_disk(spark):
    got = np.zeros((30, 24), bool)
    for r in probes.beam_stop(spark, 30, 24, (14.0, 11.0), -5.0, 8.0, 2, 4.0).collect():
        got[r["qx"], r["qy"]] = r["mask"]
    x, y = np.indices((30, 24))
    angle = np.angle(np.exp(1j * (np.arctan2(y - 11, x - 14) + math.radians(5))))
    want = K.dilate(np.abs(angle) < math.radians(8), 2) | (np.hypot(x - 14, y - 11) < 4)
    assert (got == want).all() and want.any() and not want.all()


def test_classes_merge_and_go(spark):
    rng = np.random.default_rng(2)
    w, h = rng.random((5, 4)), rng.random((4, 6))
    spots = spark.createDataFrame([(f, c, float(w[f, c])) for f in range(5) for c in range(4)], "feature long, class long, w double")
    places = spark.createDataFrame([(0, p, c, float(h[c, p])) for c in range(4) for p in range(6)], "rx long, ry long, class long, h double")
    s, p = L.merge_classes(spots, places, 1, 3)
    total = h.sum(axis=1)
    want = np.delete(w, 3, 1)
    want[:, 1] = (w[:, 1] * total[1] + w[:, 3] * total[3]) / (total[1] + total[3])
    got = np.zeros((5, 3))
    for r in s.collect():
        got[r["feature"], r["class"]] = r["w"]
    assert np.allclose(got, want)
    assert {(r["class"], r["ry"]): r["h"] for r in p.collect()}[(1, 2)] == pytest.approx(h[1, 2] + h[3, 2])
    s, p = L.remove_class(spots, places, 0)
    assert {(r["feature"], r["class"]): r["w"] for r in s.collect()} == {(f, c - 1): w[f, c] for f in range(5) for c in range(1, 4)}
    found = {(r["a"], r["b"]): (r["cc_w"], r["cc_h"]) for r in L.merge_candidates(spots, places, 5, 6, 0.0, 0.0).collect()}
    cw, ch = np.corrcoef(w.T), np.corrcoef(h)
    pairs = {(a, b) for a in range(4) for b in range(a + 1, 4) if cw[a, b] > 0 and ch[a, b] > 0}
    assert found.keys() == pairs and all(np.allclose(found[p], (cw[p], ch[p])) for p in pairs)


def test_affine_map_is_recovered_and_a_line_gives_none(spark):
    rng = np.random.default_rng(4)
    m, shift = np.array([[1.1, -0.2], [0.15, 0.9]]), np.array([3.0, -4.0])
    rows = [(0, *map(float, q), *map(float, m @ q + shift)) for q in rng.normal(size=(30, 2))] + [(1, float(k), 2.0 * k, float(k), 0.0) for k in range(5)]
    out = P.fit_affine(spark.createDataFrame(rows, "g int, x double, y double, u double, v double"), ["g"]).collect()
    assert [r["g"] for r in out] == [0]
    assert np.allclose([out[0][c] for c in "abcdef"], [1.1, -0.2, 3.0, 0.15, 0.9, -4.0])


@pytest.mark.parametrize("how", ["flat", "gaussian", "sigmoid", "sigmoid_log"])
def test_kernels_of_a_probe(how):
    x, y = np.indices((32, 32))
    probe = 1 / (1 + np.exp(np.clip(4 * (np.hypot(x - 12.0, y - 17.0) - 4), -60, 60)))
    kernel = detect.probe_kernel(probe, (12.0, 17.0), how, (5.0, 9.0))
    assert kernel.sum() == pytest.approx(1.0 if how == "flat" else 0.0, abs=1e-9)
    assert kernel[0, 0] > 0 and np.allclose(kernel, np.roll(kernel[::-1, ::-1], (1, 1), (0, 1)), atol=1e-6)  # even about the corner
    if how in ("sigmoid", "sigmoid_log"):
        assert kernel[7, 0] < 0 and abs(kernel[14, 14]) < 1e-6
