"""Orientation matching, grains, phases and dynamical diffraction.

Libraries are built once on the driver and broadcast; their size depends on the
crystal and the angular step, not on the data.  Each pattern's peaks are matched
inside their group.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattiq.functions import kernels as K
from lattiq.operators.crystal import orientation, wavelength


def zone_axes(corners: list[tuple[float, float, float]], step: float) -> np.ndarray:
    """Unit vectors over a spherical triangle, about ``step`` degrees apart, by interpolation along great arcs."""
    a, b, c = (np.asarray(v, float) / np.linalg.norm(v) for v in corners)

    def arc(u, v, t):
        w = math.acos(float(np.clip(u @ v, -1, 1)))
        return u if w < 1e-9 else (math.sin((1 - t) * w) * u + math.sin(t * w) * v) / math.sin(w)

    n = max(1, math.ceil(math.degrees(max(math.acos(np.clip(a @ b, -1, 1)), math.acos(np.clip(a @ c, -1, 1)))) / step))
    out = [a]
    for i in range(1, n + 1):
        u, v = arc(a, b, i / n), arc(a, c, i / n)
        out += [arc(u, v, j / i) for j in range(i + 1)]
    return np.array(out)


@dataclass
class OrientationPlan:
    """Reference polar images of each zone axis, transformed along the in-plane angle."""

    matrices: np.ndarray  # (zones, 3, 3)
    shells: np.ndarray
    n_gamma: int
    library: np.ndarray  # (zones, shells, n_gamma), conjugate transforms
    width: float
    kernel: float
    power: float


def polar_image(qx, qy, intensity, shells: np.ndarray, n_gamma: int, width: float, kernel: float, power: float) -> np.ndarray:
    """Peaks as blurred spots on (shell, angle): linear in radius, Gaussian along the arc."""
    r, t = np.hypot(qx, qy), np.arctan2(qy, qx)
    gamma = np.arange(n_gamma) * (2 * math.pi / n_gamma)
    near = np.maximum(0, 1 - np.abs(r[None] - shells[:, None]) / width)  # (shells, peaks)
    d = np.angle(np.exp(1j * (gamma[:, None] - t[None])))
    arc = np.exp(-((d * r[None]) ** 2) / (2 * kernel**2))  # (gamma, peaks)
    return np.einsum("sp,gp,p->sg", near, arc, np.asarray(intensity, float) ** power)


def simulate(hkl: pd.DataFrame, matrix: np.ndarray, volts: float, sigma: float) -> pd.DataFrame:
    g = hkl[["gx", "gy", "gz"]].to_numpy() @ matrix.T
    lam, g2 = wavelength(volts), (hkl[["gx", "gy", "gz"]].to_numpy() ** 2).sum(axis=1)
    s = (2 * g[:, 2] - lam * g2) / (2 - 2 * lam * g[:, 2])
    keep = (np.abs(s) <= 3 * sigma) & (g2 > 1e-12)
    return pd.DataFrame({"qx": g[keep, 0], "qy": g[keep, 1], "intensity": hkl.intensity.to_numpy()[keep] * np.exp(-s[keep] ** 2 / (2 * sigma**2))})


def plan(hkl: pd.DataFrame, zones: np.ndarray, volts: float = 200e3, sigma: float = 0.02, n_gamma: int = 90, width: float = 0.06, kernel: float = 0.06, power: float = 0.25) -> OrientationPlan:
    """Reference library of reflections (gx, gy, gz, intensity) for the zone axes."""
    matrices = np.array([orientation(z) for z in zones])
    radii = np.sqrt((hkl[["gx", "gy", "gz"]].to_numpy() ** 2).sum(axis=1))
    shells = np.unique(np.round(radii[radii > 1e-6], 3))
    images = []
    for m in matrices:
        s = simulate(hkl, m, volts, sigma)
        im = polar_image(s.qx.to_numpy(), s.qy.to_numpy(), s.intensity, shells, n_gamma, width, kernel, power)
        n = np.sqrt((im**2).sum())
        images.append(im / n if n else im)
    return OrientationPlan(matrices, shells, n_gamma, np.conj(np.fft.fft(np.array(images), axis=2)), width, kernel, power)


def match(qx: np.ndarray, qy: np.ndarray, intensity: np.ndarray, p: OrientationPlan, matches: int = 1, delete: float = 0.05) -> list[tuple[int, float, float, bool]]:
    """Best (zone, angle, correlation, mirrored) of a pattern; further ones after removing the explained peaks."""
    out, weight = [], np.asarray(intensity, float).copy()
    for _ in range(matches):
        best = None
        for mirror in (False, True):
            im = polar_image(qx, -qy if mirror else qy, weight, p.shells, p.n_gamma, p.width, p.kernel, p.power)
            norm = np.sqrt((im**2).sum())
            if norm == 0:
                continue
            c = np.fft.ifft((np.fft.fft(im, axis=1)[None] * p.library).sum(axis=1), axis=1).real / norm
            z, g = np.unravel_index(c.argmax(), c.shape)
            lo, mid, hi = c[z, g - 1], c[z, g], c[z, (g + 1) % p.n_gamma]
            d = lo - 2 * mid + hi
            angle = (g + (0.5 * (lo - hi) / d if d else 0.0)) * 2 * math.pi / p.n_gamma
            if best is None or mid > best[2]:
                best = (int(z), float(angle % (2 * math.pi)), float(mid), mirror)
        if best is None:
            break
        out.append(best)
        if matches > 1:
            ref = np.fft.ifft(np.conj(p.library[best[0]]), axis=1).real
            g = int(round(best[1] / (2 * math.pi) * p.n_gamma)) % p.n_gamma
            ref = np.roll(ref, g, axis=1)
            r, t = np.hypot(qx, qy), np.arctan2(-qy if best[3] else qy, qx) % (2 * math.pi)
            s = np.abs(r[:, None] - p.shells[None]).argmin(axis=1)
            hit = ref[s, np.rint(t / (2 * math.pi) * p.n_gamma).astype(int) % p.n_gamma] > 0.5 * ref.max()
            weight = np.where(hit, 0.0, weight)
    return out


def match_orientations(peaks: DataFrame, p: OrientationPlan, matches: int = 1) -> DataFrame:
    """Orientation of each position's centred, calibrated peaks: match, zone, angle, corr, mirror, matrix."""
    shared = peaks.sparkSession.sparkContext.broadcast(p)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, rows = shared.value, []
        for k, (z, angle, corr, mirror) in enumerate(match(pdf.qx.to_numpy(), pdf.qy.to_numpy(), pdf.intensity.to_numpy(), q, matches)):
            c, s = math.cos(angle), math.sin(angle)
            m = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]) @ q.matrices[z]
            if mirror:
                m = np.diag([1, -1, 1]) @ m
            rows.append((pdf.rx.iloc[0], pdf.ry.iloc[0], k, z, angle, corr, mirror, m.ravel().tolist()))
        return pd.DataFrame(rows, columns=["rx", "ry", "match", "zone", "angle", "corr", "mirror", "matrix"])

    return peaks.groupBy("rx", "ry").applyInPandas(run, "rx long, ry long, match long, zone long, angle double, corr double, mirror boolean, matrix array<double>")


def sort_matches(orientations: DataFrame) -> DataFrame:
    """Matches of each position renumbered by falling correlation."""
    order = W.partitionBy("rx", "ry").orderBy(F.col("corr").desc(), "match")
    return orientations.withColumn("match", (F.row_number().over(order) - 1).cast("long"))


def cubic_symmetry() -> np.ndarray:
    """The 24 rotations of the cube: signed permutation matrices of determinant 1."""
    out = []
    for perm in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)):
        for signs in np.ndindex(2, 2, 2):
            m = np.zeros((3, 3))
            m[range(3), perm] = 1 - 2 * np.array(signs)
            if np.linalg.det(m) > 0:
                out.append(m)
    return np.array(out)


def misorientation(a: np.ndarray, b: np.ndarray, symmetry: np.ndarray) -> float:
    """Smallest rotation angle between two orientations, in degrees."""
    trace = np.einsum("ij,sjk,ik->s", a, symmetry, b)
    return math.degrees(math.acos(float(np.clip((trace.max() - 1) / 2, -1, 1))))


def reduce_direction(v: np.ndarray, symmetry: np.ndarray) -> np.ndarray:
    """The equivalent of a direction in the triangle 0 <= y <= x <= z of cubic symmetry."""
    w = np.concatenate([symmetry @ v, -(symmetry @ v)])
    ok = (w[:, 0] >= w[:, 1] - 1e-9) & (w[:, 1] >= -1e-9) & (w[:, 2] >= w[:, 0] - 1e-9)
    return w[ok][0] if ok.any() else np.sort(np.abs(v))[[1, 0, 2]]


def cluster_grains(orientations: DataFrame, tolerance: float = 5.0, least: float = 0.0, symmetry: np.ndarray | None = None) -> pd.DataFrame:
    """Grains by region growing from the best correlated seed; growth compares with the seed.

    Sequential by definition, so the map of one scan (a few numbers a position) is grown on the driver.
    """
    symmetry = cubic_symmetry() if symmetry is None else symmetry
    rows = orientations.where("match = 0").select("rx", "ry", "corr", "matrix").toPandas()
    at = {(r.rx, r.ry): np.array(r.matrix).reshape(3, 3) for r in rows.itertuples()}
    grain: dict[tuple[int, int], int] = {}
    n = 0
    for r in rows.sort_values(["corr", "rx", "ry"], ascending=[False, True, True]).itertuples():
        if (r.rx, r.ry) in grain or r.corr < least:
            continue
        seed, todo = at[r.rx, r.ry], [(r.rx, r.ry)]
        grain[r.rx, r.ry] = n
        while todo:
            x, y = todo.pop()
            for p in ((x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if p in at and p not in grain and misorientation(seed, at[p], symmetry) <= tolerance:
                    grain[p] = n
                    todo.append(p)
        n += 1
    return pd.DataFrame([(x, y, g) for (x, y), g in sorted(grain.items())], columns=["rx", "ry", "grain"])


def pattern_strain(qx, qy, intensity, sx, sy, reach: float, rounds: int = 5) -> tuple[np.ndarray, int]:
    """2 x 2 map from simulated to measured peaks, matched to the nearest within ``reach``, reweighted by residuals."""
    d = np.hypot(qx[:, None] - sx[None], qy[:, None] - sy[None])
    j = d.argmin(axis=1)
    ok = d[np.arange(len(qx)), j] <= reach
    if ok.sum() < 2:
        return np.eye(2), int(ok.sum())
    s, q, w = np.column_stack([sx[j[ok]], sy[j[ok]]]), np.column_stack([qx[ok], qy[ok]]), np.ones(int(ok.sum()))
    m = np.eye(2)
    for _ in range(rounds):
        m = np.linalg.lstsq(s * w[:, None], q * w[:, None], rcond=None)[0].T
        r = np.hypot(*(q - s @ m.T).T)
        w = 1 / (1 + (r / max(np.median(r), 1e-12)) ** 2)
    return m, int(ok.sum())


def orientation_strain(peaks: DataFrame, orientations: DataFrame, hkl: pd.DataFrame, volts: float, sigma: float, reach: float) -> DataFrame:
    """e_xx, e_yy, e_xy, theta of each position against the pattern simulated for its orientation."""
    shared = peaks.sparkSession.sparkContext.broadcast(hkl)
    o = orientations.where("match = 0").select("rx", "ry", "matrix")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = simulate(shared.value, np.array(pdf.matrix.iloc[0]).reshape(3, 3), volts, sigma)
        m, n = pattern_strain(pdf.qx.to_numpy(), pdf.qy.to_numpy(), pdf.intensity.to_numpy(), s.qx.to_numpy(), s.qy.to_numpy(), reach)
        return pd.DataFrame({"rx": [pdf.rx.iloc[0]], "ry": [pdf.ry.iloc[0]], "e_xx": [1 - m[0, 0]], "e_yy": [1 - m[1, 1]], "e_xy": [-(m[0, 1] + m[1, 0]) / 2], "theta": [(m[1, 0] - m[0, 1]) / 2], "n": [n]})

    return peaks.join(o, ["rx", "ry"]).groupBy("rx", "ry").applyInPandas(run, "rx long, ry long, e_xx double, e_yy double, e_xy double, theta double, n long")


def phase_weights(peaks: DataFrame, library: dict[str, pd.DataFrame], reach: float, most: int = 4, power: float = 0.5) -> DataFrame:
    """Non-negative weights of simulated patterns (name -> qx, qy, intensity) in each measured one.

    Simulated peaks match the nearest measured peak within ``reach``; those
    without one become rows of their own, which punish false positives.
    Patterns are dropped one by one, the least useful first, down to ``most``.
    The reliability is the rise of the residual without the best pattern.
    """
    names = sorted(library)
    shared = peaks.sparkSession.sparkContext.broadcast([library[n] for n in names])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        qx, qy, b = pdf.qx.to_numpy(), pdf.qy.to_numpy(), pdf.intensity.to_numpy() ** power
        cols, extra = [], []
        for s in shared.value:
            v, d = np.zeros(len(b)), np.hypot(s.qx.to_numpy()[:, None] - qx[None], s.qy.to_numpy()[:, None] - qy[None])
            j, i = d.argmin(axis=1), s.intensity.to_numpy() ** power
            hit = d[np.arange(len(j)), j] <= reach
            np.add.at(v, j[hit], i[hit])
            cols.append(v)
            extra.append(float(np.sqrt((i[~hit] ** 2).sum())))
        a = np.vstack([np.array(cols).T, np.diag(extra)])
        a, y = a / np.maximum(np.linalg.norm(a, axis=0), 1e-12), np.concatenate([b, np.zeros(len(names))])
        used = list(range(len(names)))
        x, res = K.nnls(a[:, used], y)
        while len(used) > most:
            drop = min(range(len(used)), key=lambda k: (x[k], -k))
            used.pop(drop)
            x, res = K.nnls(a[:, used], y)
        w = np.zeros(len(names))
        w[used] = x
        top = int(w.argmax())
        rest = [k for k in used if k != top]
        gap = (K.nnls(a[:, rest], y)[1] if rest else float(np.linalg.norm(y))) - res
        scale = max(float(np.linalg.norm(y)), 1e-12)
        return pd.DataFrame({"rx": pdf.rx.iloc[0], "ry": pdf.ry.iloc[0], "phase": names, "weight": w, "residual": res / scale, "reliability": gap / scale})

    return peaks.groupBy("rx", "ry").applyInPandas(run, "rx long, ry long, phase string, weight double, residual double, reliability double")


def dominant_phase(weights: DataFrame) -> DataFrame:
    return weights.groupBy("rx", "ry").agg(F.max(F.struct("weight", "phase")).alias("b")).select("rx", "ry", "b.phase", "b.weight")


def bloch(hkl: pd.DataFrame, matrix: np.ndarray, volts: float, thickness: list[float], sigma: float = 0.02, relativistic: float | None = None) -> pd.DataFrame:
    """Dynamical intensities at several thicknesses by Bloch waves.

    The structure matrix couples beams g and h by U(g - h), on its diagonal
    2 k s; intensities are |C exp(2 pi i z gamma) C^-1 psi0|^2.
    """
    lam = wavelength(volts)
    k0 = 1 / lam
    gamma_rel = relativistic if relativistic is not None else 1 + volts / 510998.95
    f = {(int(r.h), int(r.k), int(r.l)): complex(r.f_re, r.f_im) for r in hkl.itertuples()}
    g = hkl[["gx", "gy", "gz"]].to_numpy() @ matrix.T
    g2 = (g**2).sum(axis=1)
    s = (2 * g[:, 2] - lam * g2) / (2 - 2 * lam * g[:, 2])
    beams = [(0, 0, 0)] + [t for t, e, q in zip(f, s, g2) if abs(e) <= 3 * sigma and q > 1e-12]
    s_of = {t: float(e) for t, e in zip(f, s)} | {(0, 0, 0): 0.0}
    n = len(beams)
    u = np.zeros((n, n), complex)
    for i, a in enumerate(beams):
        for j, b in enumerate(beams):
            u[i, j] = 2 * k0 * s_of[a] if i == j else gamma_rel / math.pi * f.get(tuple(p - q for p, q in zip(a, b)), 0)
    values, vectors = np.linalg.eig(u)
    start = np.linalg.solve(vectors, np.eye(n)[:, 0])
    rows = []
    for z in thickness:
        psi = vectors @ (np.exp(2j * math.pi * z * values / (2 * k0)) * start)
        rows += [(float(z), *b, float(abs(v) ** 2)) for b, v in zip(beams, psi)]
    return pd.DataFrame(rows, columns=["thickness", "h", "k", "l", "intensity"])


def convergent_beam(spark, hkl: pd.DataFrame, matrix: np.ndarray, volts: float, thickness: float, semiangle: float, n: int) -> DataFrame:
    """Bloch intensities over a disk of incident tilts: the tilts are distributed, structure factors broadcast."""
    shared = spark.sparkContext.broadcast(hkl)
    t = spark.range(n * n).select(((F.expr(f"id div {n}") - (n - 1) / 2) * (2 * semiangle / max(n - 1, 1))).alias("tx"), ((F.col("id") % n - (n - 1) / 2) * (2 * semiangle / max(n - 1, 1))).alias("ty"))
    t = t.where(F.col("tx") ** 2 + F.col("ty") ** 2 <= semiangle**2).repartition(spark.sparkContext.defaultParallelism)

    def run(batches):
        for pdf in batches:
            for tx, ty in zip(pdf.tx, pdf.ty):
                z = matrix[2] + tx * matrix[0] + ty * matrix[1]
                out = bloch(shared.value, orientation(z, matrix[0]), volts, [thickness])
                yield out.drop(columns="thickness").assign(tx=tx, ty=ty)[["tx", "ty", "h", "k", "l", "intensity"]]

    return t.mapInPandas(run, "tx double, ty double, h long, k long, l long, intensity double")
