import math

import numpy as np
import pandas as pd

from lattiq.model import CubeMeta
from lattiq.operators import cube, polar, rings
from lattiq.operators import phase
from lattiq.operators import ptychography as pt


def frames(spark, images):
    return spark.createDataFrame([(0, k, a.ravel().tolist()) for k, a in enumerate(images)], "rx long, ry long, data array<double>")


def test_ellipse_through_a_ring(spark):
    x, y = np.indices((64, 64), dtype=float)
    t = 0.4
    u, v = (x - 31) * math.cos(t) + (y - 33) * math.sin(t), (y - 33) * math.cos(t) - (x - 31) * math.sin(t)
    a = np.exp(-((np.hypot(u / 20, v / 17) - 1) ** 2) / (2 * 0.02**2))
    image = cube.virtual_diffraction(frames(spark, [a]), meta=CubeMeta(64, 64))
    e = rings.fit_ellipse(image, (32.0, 32.0), 12.0, 26.0)
    assert abs(e["x0"] - 31) < 0.05 and abs(e["y0"] - 33) < 0.05 and abs(e["a"] - 20) < 0.1 and abs(e["b"] - 17) < 0.1 and abs(e["theta"] - t) < 0.02


def test_ring_fits_and_strain(spark):
    x, y = np.indices((32, 32), dtype=float)
    true = dict(zip(rings.RING, (0.1, 1.0, 3.0, 2.0, 1.0, 1.5, 15.5, 16.2, 10.0, 0.06, 1.08)))
    a = rings.ring_model(np.array(list(true.values())), x, y)
    out = rings.fit_rings(frames(spark, [a]), dict(true, x0=16.0, y0=16.0, radius=9.5, b=0.0, c=1.0, height=1.5), CubeMeta(32, 32))
    r = out.first()
    assert all(abs(r[k] - true[k]) < 1e-3 for k in ("x0", "y0", "radius", "b", "c"))
    s = rings.ring_strain(out).first()
    m = np.eye(2) + [[s["e_xx"], s["e_xy"]], [s["e_xy"], s["e_yy"]]]
    assert np.allclose(m @ m, [[1, 0.03], [0.03, 1.08]], atol=1e-3)


def test_polar_peaks_are_where_they_were_put(spark):
    spec = polar.PolarSpec(0.0, 12.0, 1.0, 36)
    x, y = np.indices((32, 32), dtype=float)
    a = sum(np.exp(-((x - 15.5 - 8 * math.cos(t)) ** 2 + (y - 15.5 - 8 * math.sin(t)) ** 2) / 4) for t in (0.5, 3.0))
    from lattiq.model import pixels

    p = polar.polar_data(pixels(frames(spark, [a]), CubeMeta(32, 32)), (15.5, 15.5), spec)
    got = rings.polar_peaks(p, 36, least=0.2).toPandas().sort_values("qt")
    assert len(got) == 2 and np.allclose(got.qr, 8, atol=0.5) and np.allclose(got.qt * spec.annular_step, [0.5, 3.0], atol=0.1)


def test_pixel_size_and_background(spark):
    r = pd.DataFrame({"radius": [0.4, 0.57, 0.8], "intensity": [1.0, 0.6, 0.4]})
    q = np.linspace(0, 1, 400)
    y = sum(i * np.exp(-((q - 1.07 * k) ** 2) / (2 * 0.015**2)) for k, i in zip(r.radius, r.intensity))
    size, width = rings.calibrate_pixel_size(q, y, r, 0.02)
    assert abs(size - 0.02 / 1.07) < 1e-5 and abs(width - 0.015) < 1e-3
    k = np.linspace(0.05, 2, 200)
    base = 0.2 + 3 * np.exp(-(k**2) / (2 * 0.5**2)) + 1 * np.exp(-(k**4) / (2 * 0.9**4))
    _, fit = rings.fit_background(k, base)
    assert np.abs(fit - base).max() < 1e-3
    k = np.linspace(0.3, 2.5, 300)
    base = 0.2 + 3 * np.exp(-(k**2) / (2 * 0.5**2)) + 1 * np.exp(-(k**4) / (2 * 0.9**4))
    radii = np.linspace(1.5, 5, 141)
    _, g = rings.pair_distribution(k, base * (1 + 0.05 * np.sin(2 * np.pi * k * 2.5) / k), radii)
    assert abs(radii[g.argmax()] - 2.5) < 0.15


def test_aligned_mean_and_disk_means(spark):
    a = np.zeros((16, 16))
    a[6:9, 5:8] = 1.0
    a[7, 6] = 2.0
    mean = rings.aligned_mean(frames(spark, [a, np.roll(a, 1, 0), np.roll(a, -1, 1), a]), CubeMeta(16, 16))
    assert np.allclose(np.sort(mean.ravel())[-9:], np.sort(a.ravel())[-9:])
    peaks = spark.createDataFrame([(0, 0, 7.0, 6.0), (0, 0, 2.0, 2.0)], "rx long, ry long, qx double, qy double")
    got = {r["qx"]: r["intensity"] for r in rings.integrate_disks(frames(spark, [a]), peaks, 1.0, CubeMeta(16, 16)).collect()}
    assert got == {7.0: 1.0, 2.0: 0.0}


def scan(spark, far):
    rows = [(float(x), float(y), far(np.array([[x, y]], float)).ravel().tolist()) for x in range(0, 24, 4) for y in range(0, 24, 4)]
    return spark.createDataFrame(rows, "x double, y double, amplitude array<double>")


def make_probe():
    q = np.hypot(np.fft.fftfreq(12)[:, None], np.fft.fftfreq(12)[None])
    return np.fft.fftshift(np.fft.ifft2(np.where(q < 0.25, 1.0, 0.0) * np.exp(4j * q**2))) * 5


def test_variants_of_ptychography_lower_their_error(spark, tmp_path):
    rng = np.random.default_rng(5)
    obj, probe = np.exp(1j * 0.4 * rng.random((24, 24))), make_probe()
    plain = scan(spark, lambda at: np.abs(np.fft.fft2(phase._overlap(obj, probe, at)[0] * probe)))

    def space(df, name):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    for method in ("RAAR", "DM_AP"):
        _, _, e = pt.projection_sets(plain, space, (24, 24), probe, method, 0.8, 5)
        assert min(e) < 0.7 * e[0]
    modes = np.stack([probe, 0.4 * np.roll(probe, 1, 0)])
    both = scan(spark, lambda at: np.sqrt(sum(np.abs(np.fft.fft2(phase._overlap(obj, probe, at)[0] * m)) ** 2 for m in modes)))
    _, p, e = pt.mixed_state(both, (24, 24), modes, 4)
    assert e[-1] < 0.7 * e[0] and abs(np.vdot(p[0], p[1])) < 1e-6 * np.vdot(p[0], p[0]).real
    prop = phase.fresnel((12, 12), 1.0, 0.02, 10.0)
    two = np.exp(1j * 0.3 * rng.random((2, 24, 24)))

    def through(at):
        w = phase._overlap(two[0], probe, at)[0] * probe
        return np.abs(np.fft.fft2(np.fft.ifft2(np.fft.fft2(w) * prop) * phase._overlap(two[1], probe, at)[0]))

    _, _, e = pt.multislice(scan(spark, through), 2, (24, 24), probe, prop, 5)
    assert e[-1] < 0.7 * e[0]


def test_constraints():
    rng = np.random.default_rng(6)
    a = rng.random((16, 16))
    assert np.abs(pt.threshold(2 * np.exp(1j * a))).max() <= 1 + 1e-12
    step = np.where(np.arange(32) < 16, 0.0, 1.0)[:, None] + np.zeros((32, 32))
    noisy = step + 0.1 * rng.standard_normal((32, 32))
    smooth = pt.total_variation(noisy, 0.2)
    assert ((smooth - step) ** 2).mean() < 0.5 * ((noisy - step) ** 2).mean() and abs(smooth.sum() - noisy.sum()) < 1e-6
    assert np.allclose(pt.identical_slices(np.stack([a, 3 * a])), np.stack([2 * a, 2 * a]))
    frc, half, n = pt.ring_correlation(a, a)
    assert np.allclose(frc[1:], 1) and n[3] > 0 and half[1] > half[4]
    p = np.zeros((8, 8), complex)
    p[1, 0] = 1
    assert abs(pt.center_probe(p)[0, 0]) > 0.99
    assert np.allclose(np.abs(np.fft.fft2(pt.impose_aperture(a.astype(complex), np.ones((16, 16))))), 1)
    w = rng.random((8, 8)) + 0j
    assert np.allclose(pt.propagate(pt.propagate(w, 1.0, 0.02, 5.0), 1.0, 0.02, -5.0), w)
    assert pt.kz_regularize(rng.random((4, 8, 8)) + 0j, 1.0, (1, 1, 1)).shape == (4, 8, 8)
    assert np.angle(pt.shrink_phase(np.exp(1j * a), 0.5)).min() >= -1e-12 and pt.smooth(np.exp(1j * a), 1.0, True).shape == (16, 16)
