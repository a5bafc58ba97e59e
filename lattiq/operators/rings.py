"""Ellipses, amorphous rings, polar peaks and fits of pixel size and pair distributions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattiq.functions import kernels as K
from lattiq.model import CubeMeta
from lattiq.operators.detect import per_frame


def fit_ellipse(image: DataFrame, center: tuple[float, float], r0: float, r1: float, value: str = "value", rounds: int = 8) -> dict[str, float]:
    """Ellipse (x0, y0, a, b, theta) through the intensity of one pattern in an annulus.

    The weighted conic A x^2 + B xy + C y^2 + D x + E y = 1 is linear in its
    coefficients: each round is one aggregate of moments about the current
    centre, which then moves.
    """
    x0, y0 = center
    out = (r1, r1, 0.0)
    for _ in range(rounds):
        x, y = F.col("qx") - x0, F.col("qy") - y0
        used = image.where((x * x + y * y >= r0 * r0) & (x * x + y * y < r1 * r1))
        scale = r1  # keeps the moments near 1
        terms = [t for t in (x * x / scale**2, x * y / scale**2, y * y / scale**2, x / scale, y / scale)]
        w = F.col(value) ** 2
        sums = [F.sum(w * a * b) for i, a in enumerate(terms) for b in terms[i:]] + [F.sum(w * a) for a in terms]
        row = [v or 0.0 for v in used.agg(*[s.alias(f"m{k}") for k, s in enumerate(sums)]).first()]
        m = np.zeros((5, 5))
        m[np.triu_indices(5)] = row[:15]
        m = m + np.triu(m, 1).T
        a, b, c, d, e = np.linalg.lstsq(m, np.array(row[15:]), rcond=None)[0]
        form = np.array([[a, b / 2], [b / 2, c]])
        shift = -np.linalg.solve(2 * form, [d, e])
        k = 1 + shift @ form @ shift
        values, vectors = np.linalg.eigh(form / k)
        if values[0] <= 0:
            break
        x0, y0 = x0 + shift[0] * scale, y0 + shift[1] * scale
        out = (scale / math.sqrt(values[0]), scale / math.sqrt(values[1]), math.atan2(vectors[1, 0], vectors[0, 0]) % math.pi)
        if np.abs(shift).max() * scale < 1e-6:
            break
    return {"x0": float(x0), "y0": float(y0), "a": float(out[0]), "b": float(out[1]), "theta": float(out[2])}


def ring_model(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Constant, central Gaussian and an elliptical ring with its own inner and outer width.

    p: level, central height and width, ring height, inner and outer width, x0, y0, radius, B, C of x^2 + B xy + C y^2.
    """
    level, i0, s0, i1, inner, outer, x0, y0, radius, b, c = p
    u, v = x - x0, y - y0
    r2 = np.maximum(u * u + b * u * v + c * v * v, 0)
    d = np.sqrt(r2) - radius
    return level + i0 * np.exp(-r2 / (2 * s0 * s0)) + i1 * np.exp(-(d**2) / (2 * np.where(d < 0, inner, outer) ** 2))


RING = ("level", "central", "central_width", "height", "inner", "outer", "x0", "y0", "radius", "b", "c")


def fit_rings(cube: DataFrame, start: dict[str, float], meta: CubeMeta = CubeMeta(), steps: int = 60) -> DataFrame:
    """Ring parameters of each pattern."""
    x, y = np.indices((meta.q_nx, meta.q_ny), dtype=float)
    lower = [-np.inf, 0, 0.1, 0, 0.1, 0.1, -np.inf, -np.inf, 0.1, -1.5, 0.1]
    first = [start[n] for n in RING]

    def fit(a: np.ndarray) -> np.ndarray:
        p, cost, _, status = K.least_squares(lambda q: (ring_model(q, x, y) - a).ravel(), first, lower, None, steps)
        return np.array([*p, cost, status], float)

    return per_frame(cube, fit, ", ".join(f"{n} double" for n in RING) + ", cost double, status long", meta)


def ring_strain(rings: DataFrame) -> DataFrame:
    """e_xx, e_yy, e_xy of each pattern from its ring: the symmetric root of the form [[1, B/2], [B/2, C]], less the identity.

    The root of a 2 x 2 form M is (M + sqrt(det) I) / sqrt(trace + 2 sqrt(det)).
    """
    root = F.sqrt(F.col("c") - F.col("b") * F.col("b") / 4)
    scale = F.sqrt(1 + F.col("c") + 2 * root)
    return rings.select("rx", "ry", ((1 + root) / scale - 1).alias("e_xx"), ((F.col("c") + root) / scale - 1).alias("e_yy"), (F.col("b") / 2 / scale).alias("e_xy"))


def polar_peaks(polar: DataFrame, n_annular: int, sigma: float = 1.0, quantile: float = 0.5, least: float = 0.0, most: int = 10) -> DataFrame:
    """Peaks of normalised polar images (rx, ry, t, r, value): qt, qr, intensity and prominence across angle.

    A quantile over the angle is each radius' background; the rest is blurred
    (the angle wraps) and searched for maxima, brightest first.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        im = np.full((n_annular, int(pdf.r.max()) + 1), np.nan)
        im[pdf.t.astype(int), pdf.r.astype(int)] = pdf.value
        bg = np.nanquantile(im, quantile, axis=0)
        a = np.nan_to_num(np.maximum(im - bg, 0))
        wide = np.concatenate([a] * 3)
        wide = K.gaussian_filter(wide, sigma, "nearest")
        m = K.maxima_2d(np.pad(wide, ((0, 0), (1, 1))), subpixel="poly", least=least, edge=1)
        m = m[(m[:, 0] >= n_annular) & (m[:, 0] < 2 * n_annular)][:most]
        rows = []
        for t, r, v in m:
            column = wide[:, min(max(int(round(r)) - 1, 0), a.shape[1] - 1)][n_annular : 2 * n_annular]
            rows.append((pdf.rx.iloc[0], pdf.ry.iloc[0], t - n_annular, r - 1, v, v - column.min()))
        return pd.DataFrame(rows, columns=["rx", "ry", "qt", "qr", "intensity", "prominence"])

    return polar.where("value is not null").groupBy("rx", "ry").applyInPandas(run, "rx long, ry long, qt double, qr double, intensity double, prominence double")


def fit_background(k: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scattering background c + I0 exp(-k^2 / 2 s0^2) + I1 exp(-k^4 / 2 s1^4) of a mean radial profile, and its values."""
    top = float(y.max() - y.min()) + 1e-12
    f = lambda p: p[0] + p[1] * np.exp(-(k**2) / (2 * p[2] ** 2)) + p[3] * np.exp(-(k**4) / (2 * p[4] ** 4))
    p, *_ = K.least_squares(lambda p: (f(p) - y) / top, [float(y.min()), top / 2, k.max() / 3, top / 2, k.max() / 2], [0, 0, 1e-3, 0, 1e-3], None, 200)
    return p, f(p)


def pair_distribution(k: np.ndarray, y: np.ndarray, radii: np.ndarray, k_width: float = 0.25, damping: float = 0.0, density: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Structure factor and reduced pair distribution of a mean radial profile.

    The edges of the window fade over k_width; with a density the distribution
    is 1 + G / (4 pi rho r).
    """
    _, bg = fit_background(k, y)
    window = np.sin(np.clip((k - k[0]) / k_width, 0, 1) * np.pi / 2) ** 2 * np.sin(np.clip((k[-1] - k) / k_width, 0, 1) * np.pi / 2) ** 2
    s = (y - bg) * k / np.maximum(bg, 1e-12) * window
    g = 4 * np.pi * np.gradient(k) * s @ np.sin(2 * np.pi * np.outer(k, radii)) if k.size else np.zeros(0)
    g = g * np.exp(-damping * radii**2) if damping else g
    return s, (g if density is None else 1 + g / (4 * np.pi * density * np.maximum(radii, 1e-9)))


def calibrate_pixel_size(q: np.ndarray, measured: np.ndarray, rings: pd.DataFrame, pixel_size: float, width: float = 0.02, bound: float = 0.2) -> tuple[float, float]:
    """Pixel size that puts simulated rings (radius, intensity) on a measured profile; and the broadening.

    The measured axis is stretched by a scale; the new size is the old over it.
    """
    top = float(measured.max()) + 1e-12

    def profile(p):
        r = rings.radius.to_numpy()[:, None] * p[0]
        return p[2] * (rings.intensity.to_numpy()[:, None] * np.exp(-((q[None] - r) ** 2) / (2 * p[1] ** 2))).sum(axis=0)

    best = None
    for s in np.linspace(1 - bound, 1 + bound, 41):
        base = profile([s, width, 1.0])
        h = float(base @ measured) / max(float(base @ base), 1e-12)
        e = float(((h * base - measured) ** 2).sum())
        if best is None or e < best[0]:
            best = (e, s, h)
    p, *_ = K.least_squares(lambda p: (profile(p) - measured) / top, [best[1], width, best[2]], [1 - 2 * bound, width / 10, 0], [1 + 2 * bound, width * 10, np.inf], 100)
    return pixel_size / float(p[0]), float(p[1])


def aligned_mean(cube: DataFrame, meta: CubeMeta = CubeMeta()) -> np.ndarray:
    """Mean of patterns aligned to the plain mean by whole-pixel correlation: two passes, each a sum of frames.

    All patterns count, and none depends on the order of the others.
    """

    def total(f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches):
            s, n = np.zeros(meta.q_n), 0
            for pdf in batches:
                for d in pdf.data:
                    s += f(np.asarray(d, float).reshape(meta.q_nx, meta.q_ny)).ravel()
                    n += 1
            yield pd.DataFrame({"k": np.arange(meta.q_n), "s": s, "n": n})

        rows = cube.select("data").mapInPandas(run, "k long, s double, n long").groupBy("k").agg((F.sum("s") / F.sum("n")).alias("v")).orderBy("k").collect()
        return np.array([r["v"] for r in rows]).reshape(meta.q_nx, meta.q_ny)

    mean = total(lambda a: a)
    ft = np.fft.fft2(mean)

    def align(a: np.ndarray) -> np.ndarray:
        c = np.fft.ifft2(ft * np.conj(np.fft.fft2(a))).real
        return np.roll(a, np.unravel_index(c.argmax(), c.shape), (0, 1))

    return total(align)


def integrate_disks(cube: DataFrame, peaks: DataFrame, radius: float, meta: CubeMeta = CubeMeta()) -> DataFrame:
    """Peaks with their intensity replaced by the pattern's mean inside a disk, relative to the brightest of the position.

    A peak meets its frame as one row and sums the few pixels of its disk there.
    Equal peaks of a position are one; a disk without a pixel on the detector goes.
    """

    def near(c: str, n: int):
        low, high = F.greatest(F.ceil(F.col(c) - radius), F.lit(0)), F.least(F.floor(F.col(c) + radius), F.lit(n - 1))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    met = peaks.select("rx", "ry", "qx", "qy").join(cube.select("rx", "ry", "data"), ["rx", "ry"]).dropDuplicates(["rx", "ry", "qx", "qy"])
    inside = lambda x: F.filter(F.col("__y"), lambda y: (x - F.col("qx")) ** 2 + (y - F.col("qy")) ** 2 <= radius * radius)
    values = F.flatten(F.transform("__x", lambda x: F.transform(inside(x), lambda y: F.get("data", (x * meta.q_ny + y).cast("int")))))
    found = met.withColumn("__x", near("qx", meta.q_nx)).withColumn("__y", near("qy", meta.q_ny)).withColumn("__v", values).where(F.size("__v") > 0)
    m = found.select("rx", "ry", "qx", "qy", (F.aggregate("__v", F.lit(0.0), lambda a, v: a + v) / F.size("__v")).alias("mean"))
    top = F.max("mean").over(W.partitionBy("rx", "ry"))
    return m.withColumn("top", top).select("rx", "ry", "qx", "qy", F.when(F.col("top") > 0, F.col("mean") / F.col("top")).otherwise(0.0).alias("intensity"))
