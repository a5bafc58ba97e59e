"""Crystals: lattices, structure factors, kinematic patterns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.functions.columns import CHARGE, LIGHT, MASS, PLANCK


def wavelength(volts: float) -> float:
    return PLANCK * 1e10 / math.sqrt(2 * MASS * CHARGE * volts * (1 + CHARGE * volts / (2 * MASS * LIGHT * LIGHT)))


def lattice(cell) -> np.ndarray:
    """Rows are the real lattice vectors; the cell is a, or (a, b, c), or those with three angles in degrees, or 3 x 3."""
    c = np.asarray(cell, float)
    if c.shape == (3, 3):
        return c
    if c.size == 1:
        c = np.array([c.item()] * 3)
    if c.size == 3:
        c = np.concatenate([c, [90.0] * 3])
    a, b, g = np.radians(c[3:])
    f = (math.cos(a) - math.cos(b) * math.cos(g)) / math.sin(g)
    rows = np.array([[c[0], 0, 0], [c[1] * math.cos(g), c[1] * math.sin(g), 0], [c[2] * math.cos(b), c[2] * f, c[2] * math.sqrt(max(0.0, math.sin(b) ** 2 - f * f))]])
    return np.where(np.abs(rows) < 1e-12, 0.0, rows)


def reciprocal(real: np.ndarray) -> np.ndarray:
    return np.linalg.inv(real).T


def strained(real: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Lattice under a deformation; atoms and occupancies stay with it."""
    return real @ np.asarray(matrix, float).T


def scattering_factor(g: Column, terms: int = 5) -> Column:
    """Electron scattering factor sum a (2 + b g^2) / (1 + b g^2)^2 from columns a1..an, b1..bn."""
    g2 = g * g
    return sum(((F.col(f"a{i}") * (2 + F.col(f"b{i}") * g2)) / ((1 + F.col(f"b{i}") * g2) * (1 + F.col(f"b{i}") * g2)) for i in range(1, terms + 1)), F.lit(0.0))


def reflections(spark: SparkSession, real: np.ndarray, k_max: float) -> DataFrame:
    """h, k, l and g of all reciprocal points within k_max."""
    r = reciprocal(real)
    n = [int(math.floor(k_max * np.linalg.norm(v))) for v in real]  # |h_i| <= k_max |a_i|
    axis = lambda name, m: spark.range(-m, m + 1).select(F.col("id").alias(name))
    hkl = axis("h", n[0]).crossJoin(axis("k", n[1])).crossJoin(axis("l", n[2]))
    g = [F.col("h") * float(r[0, i]) + F.col("k") * float(r[1, i]) + F.col("l") * float(r[2, i]) for i in range(3)]
    out = hkl.select("h", "k", "l", *[c.alias(x) for c, x in zip(g, ("gx", "gy", "gz"))])
    return out.withColumn("g", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2 + F.col("gz") ** 2)).where(F.col("g") <= k_max)


def structure_factors(hkl: DataFrame, atoms: DataFrame, scattering: DataFrame, real: np.ndarray, tolerance: float = 1e-4, terms: int = 5) -> DataFrame:
    """f_re, f_im and intensity of each reflection; weaker ones than the tolerance go.

    ``atoms`` (x, y, z, number, occ) and ``scattering`` (number, a1..., b1...; number is the atomic number) describe one
    unit cell and are broadcast; the sum over atoms is a partial aggregate.
    """
    volume = abs(float(np.linalg.det(real)))
    cell = atoms.join(scattering, "number")
    phase = 2 * math.pi * (F.col("h") * F.col("x") + F.col("k") * F.col("y") + F.col("l") * F.col("z"))
    f = scattering_factor(F.col("g"), terms=terms) * F.col("occ") / volume
    keys = ["h", "k", "l", "gx", "gy", "gz", "g"]
    out = hkl.crossJoin(F.broadcast(cell)).groupBy(*keys).agg(F.sum(f * F.cos(phase)).alias("f_re"), F.sum(f * F.sin(phase)).alias("f_im"))
    return out.withColumn("intensity", F.col("f_re") ** 2 + F.col("f_im") ** 2).where(F.sqrt("intensity") > tolerance)


def orientation(zone: tuple[float, float, float], x_axis: tuple[float, float, float] | None = None) -> np.ndarray:
    """Rows: the x, y and beam directions of the detector in crystal coordinates."""
    z = np.asarray(zone, float) / np.linalg.norm(zone)
    guess = np.asarray(x_axis, float) if x_axis is not None else np.eye(3)[int(np.argmin(np.abs(z)))]
    x = guess - z * (guess @ z)
    if np.linalg.norm(x) < 1e-12:
        raise ValueError("the x axis lies along the zone axis")
    x /= np.linalg.norm(x)
    return np.array([x, np.cross(z, x), z])


def to_detector(hkl: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Append qx, qy and qz: g in detector coordinates."""
    rows = [sum((float(matrix[i, j]) * F.col(c) for j, c in enumerate(("gx", "gy", "gz"))), F.lit(0.0)) for i in range(3)]
    return hkl.select("*", *[r.alias(n) for r, n in zip(rows, ("qx", "qy", "qz"))])


def excitation_error(qz: Column, g: Column, lam: float) -> Column:
    """Distance to the Ewald sphere along the beam."""
    return (2 * qz - lam * g * g) / (2 - 2 * lam * qz)


def kinematic_pattern(hkl: DataFrame, matrix: np.ndarray, volts: float, sigma: float, cutoff: float = 3.0, least: float = 0.0) -> DataFrame:
    """h, k, l, qx, qy, s and intensity of the reflections near the Ewald sphere."""
    p = to_detector(hkl, matrix).withColumn("s", excitation_error(F.col("qz"), F.col("g"), wavelength(volts)))
    p = p.where(F.abs(F.col("s")) <= cutoff * sigma).withColumn("intensity", F.col("intensity") * F.exp(-F.col("s") ** 2 / (2 * sigma * sigma)))
    return p.where(F.col("intensity") > least).select("h", "k", "l", "qx", "qy", "s", "intensity")


def precession_errors(hkl: DataFrame, matrix: np.ndarray, volts: float, angle: float, steps: int = 72) -> DataFrame:
    """Excitation errors for beam tilts on a cone: h, k, l, step, s."""
    lam = wavelength(volts)
    p = to_detector(hkl, matrix).select("h", "k", "l", "qx", "qy", "qz", "g", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    t = 2 * math.pi * F.col("step") / steps
    tilted = F.col("qx") * F.cos(t) * math.sin(angle) + F.col("qy") * F.sin(t) * math.sin(angle) + F.col("qz") * math.cos(angle)
    return p.select("h", "k", "l", F.col("step").cast("long").alias("step"), excitation_error(tilted, F.col("g"), lam).alias("s"))


def ring_pattern(patterns: DataFrame, digits: int = 4) -> DataFrame:
    """Unique radii (rounded) and summed intensity of many patterns."""
    r = F.round(F.sqrt(F.col("qx") ** 2 + F.col("qy") ** 2), digits)
    return patterns.groupBy(r.alias("radius")).agg(F.sum("intensity").alias("intensity"))


def k_histogram(peaks: DataFrame, k_min: float, k_max: float, k_step: float, k_power: float = 1.0, i_power: float = 1.0, radius: Column | None = None) -> DataFrame:
    """Linear shares of intensity in bins of k, times k^power, relative to the maximum."""
    n = int(round((k_max - k_min) / k_step)) + 1
    q = ((F.sqrt(F.col("qx") ** 2 + F.col("qy") ** 2) if radius is None else radius) - k_min) / k_step
    low = F.floor(q)
    i = F.col("intensity") ** i_power
    parts = F.array(F.struct(low.alias("bin"), (i * (1 - (q - low))).alias("w")), F.struct((low + 1).alias("bin"), (i * (q - low)).alias("w")))
    s = peaks.select(F.explode(parts).alias("c")).select("c.*").where((F.col("bin") >= 0) & (F.col("bin") < n)).groupBy("bin").agg(F.sum("w").alias("w"))
    k = k_min + F.col("bin") * k_step
    full = peaks.sparkSession.range(n).select(F.col("id").alias("bin")).join(s, "bin", "left").select("bin", (F.coalesce("w", F.lit(0.0)) * k**k_power).alias("v"))
    return full.crossJoin(F.broadcast(full.agg(F.max("v").alias("top")))).select("bin", (F.col("v") / F.col("top")).alias("value"))


def moire(a: DataFrame, b: DataFrame, rotation: float, strain: np.ndarray | None = None, least: float = 0.0) -> DataFrame:
    """Sums of all pairs of two bounded, thresholded patterns, the second rotated and deformed."""
    c, s = math.cos(rotation), math.sin(rotation)
    m = np.array([[c, -s], [s, c]]) @ np.linalg.inv(np.eye(2) if strain is None else np.eye(2) + np.asarray(strain, float))
    q = b.where(F.col("intensity") > least).select(F.col("h").alias("h1"), F.col("k").alias("k1"), F.col("l").alias("l1"), F.col("qx").alias("bx"), F.col("qy").alias("by"), F.col("intensity").alias("ib"))
    x = F.col("qx") + float(m[0, 0]) * F.col("bx") + float(m[0, 1]) * F.col("by")
    y = F.col("qy") + float(m[1, 0]) * F.col("bx") + float(m[1, 1]) * F.col("by")
    return a.where(F.col("intensity") > least).crossJoin(F.broadcast(q)).select("h", "k", "l", "h1", "k1", "l1", x.alias("qx"), y.alias("qy"), F.sqrt(F.col("intensity") * F.col("ib")).alias("intensity"))


def rational(v: np.ndarray, limit: int = 20) -> tuple[int, ...]:
    """Smallest whole numbers along a direction, up to a limit."""
    v = np.asarray(v, float)
    v = v / np.abs(v).max()
    for n in range(1, limit + 1):
        w = np.rint(v * n)
        if np.abs(w / n - v).max() < 1e-3:
            return tuple(int(x) // math.gcd(*(int(y) for y in w)) for x in w)
    return tuple(int(x) for x in np.rint(v * limit))
