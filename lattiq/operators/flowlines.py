"""Orientation histograms, their correlations, and flow lines."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orientation_histogram(peaks: DataFrame, center: tuple[float, float], ranges: list[tuple[float, float]], theta_step: float = 10.0, upsample: float = 1.0, offset: float = 0.0) -> DataFrame:
    """Intensity by (range, x, y, theta bin), shared linearly in x, y and angle (modulo 180 degrees).

    Radial ranges are half-open and a literal list; a peak counts in each range that holds it.
    Peaks are summed by position and angle first; only those sums are shared in x and y.
    """
    n = int(round(180 / theta_step))
    dx, dy = F.col("qx") - center[0], F.col("qy") - center[1]
    r, t = F.sqrt(dx * dx + dy * dy), (F.degrees(F.atan2(dy, dx)) + offset) / theta_step
    table = F.array(*[F.struct(F.lit(k).cast("long").alias("range"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for k, (a, b) in enumerate(ranges)])
    s = peaks.select("rx", "ry", "intensity", r.alias("r"), t.alias("t"), F.explode(F.filter(table, lambda g: (r >= g["a"]) & (r < g["b"]))).alias("g"))
    low = F.floor("t")
    corners = F.array(*[F.struct(F.pmod(low + c, F.lit(n)).alias("theta"), (F.col("intensity") * (F.col("t") - low if c else 1 - F.col("t") + low)).alias("w")) for c in (0, 1)])
    s = s.select("rx", "ry", F.col("g.range").alias("range"), F.explode(corners).alias("c")).where("c.w != 0")
    s = s.groupBy("range", "rx", "ry", F.col("c.theta").alias("theta")).agg(F.sum("c.w").alias("w"))
    x, y = (F.col("rx") + 0.5) * upsample - 0.5, (F.col("ry") + 0.5) * upsample - 0.5
    (i, u), (j, v) = ((F.floor(c), c - F.floor(c)) for c in (x, y))
    parts = F.array(*[F.struct((i + a).alias("x"), (j + b).alias("y"), (F.col("w") * (u if a else 1 - u) * (v if b else 1 - v)).alias("w")) for a in (0, 1) for b in (0, 1)])
    out = s.select("range", "theta", F.explode(F.filter(parts, lambda p: p["w"] != 0)).alias("p"))
    return out.groupBy("range", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "theta").agg(F.sum("p.w").alias("value"))


def orientation_correlation(hist: np.ndarray, radius: int) -> np.ndarray:
    """Correlation of angles (range pair, angle difference, distance) relative to independence.

    hist: (ranges, x, y, theta).  Transforms over x, y and theta; rings of unit width.
    """
    k, nx, ny, nt = hist.shape
    pad = ((0, 0), (0, nx), (0, ny), (0, 0))
    f = np.fft.fftn(np.pad(hist, pad), axes=(1, 2, 3))
    flat = np.fft.fftn(np.pad(np.broadcast_to(hist.mean(axis=3, keepdims=True), hist.shape), pad), axes=(1, 2, 3))
    x, y = np.minimum(np.arange(2 * nx), 2 * nx - np.arange(2 * nx)), np.minimum(np.arange(2 * ny), 2 * ny - np.arange(2 * ny))
    ring = np.rint(np.hypot(x[:, None], y[None])).astype(int)
    out = []
    for a in range(k):
        for b in range(a, k):
            c = np.fft.ifftn(f[a] * np.conj(f[b])).real
            base = np.fft.ifftn(flat[a] * np.conj(flat[b])).real
            top = np.array([[c[ring == r][:, t].sum() for r in range(radius)] for t in range(nt // 2 + 1)])
            low = np.array([[base[ring == r][:, t].sum() for r in range(radius)] for t in range(nt // 2 + 1)])
            out.append(np.divide(top, low, out=np.zeros_like(top), where=low > 0))
    return np.array(out)


def flowlines(hist: np.ndarray, least: float, spacing: float = 2.0, step: float = 0.5, longest: int = 200) -> list[np.ndarray]:
    """Streamlines (x, y, theta) of one (x, y, theta) histogram, brightest seed first.

    A line follows the local angle both ways until the intensity falls under
    ``least``, it leaves the map, or it comes within ``spacing`` of an earlier
    line of like angle.  Each line depends on those before, so this runs on one
    map at a time; points of earlier lines are kept by cell, so that a step
    looks only at those near it.
    """
    nx, ny, nt = hist.shape
    size = math.pi / nt
    up, down = np.roll(hist, 1, axis=2), np.roll(hist, -1, axis=2)
    seeds = np.argwhere((hist >= up) & (hist > down) & (hist >= least))
    seeds = seeds[np.argsort(-hist[tuple(seeds.T)], kind="stable")]
    cell = spacing * (1 + 1e-9) if spacing > 0 else 1.0  # what is nearer than spacing lies in the same cell or beside it
    taken: dict[tuple[int, int], list[tuple[float, float, float]]] = {}
    out: list[np.ndarray] = []

    def at(x: float, y: float, t: float) -> float:
        i, j, k = int(round(x)), int(round(y)), int(round(t / size)) % nt
        return float(hist[i, j, k]) if 0 <= i < nx and 0 <= j < ny else -1.0

    def close(x: float, y: float, t: float) -> bool:
        i, j = math.floor(x / cell), math.floor(y / cell)
        for k in (i, i - 1, i + 1):
            for m in (j, j - 1, j + 1):
                for a, b, c in taken.get((k, m), ()):
                    if (x - a) ** 2 + (y - b) ** 2 < spacing**2 and abs((t - c + math.pi / 2) % math.pi - math.pi / 2) < 2 * size:
                        return True
        return False

    for sx, sy, st in seeds.tolist():
        x0, y0, t0 = float(sx), float(sy), st * size
        if close(x0, y0, t0):
            continue
        halves = []
        for way in (1, -1):
            x, y, t, line = x0, y0, t0, []
            for _ in range(longest):
                x, y = x + way * step * math.cos(t), y + way * step * math.sin(t)
                near = max((t, t - size, t + size), key=lambda a: at(x, y, a))
                if at(x, y, near) < least or close(x, y, near):
                    break
                t = near
                line.append((x, y, t))
            halves.append(line)
        line = halves[1][::-1] + [(x0, y0, t0)] + halves[0]
        if len(line) > 1:
            out.append(np.array(line))
            for p in line:
                taken.setdefault((math.floor(p[0] / cell), math.floor(p[1] / cell)), []).append(p)
    return out


def misfit(a: Column, b: Column) -> Column:
    """Angle between two axes, in degrees, 0 to 90."""
    return F.abs(F.pmod(a - b + 90, F.lit(180)) - 90)
