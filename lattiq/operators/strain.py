"""Lattice indexing, lattice fits and strain."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Vector = tuple[float, float]


def choose_basis(maxima: DataFrame, center: Vector) -> DataFrame:
    """Origin (nearest the centre), g1 (next nearest) and g2 (near, but at an angle to g1), as one row.

    ``maxima`` has the peaks (qx, qy) of one averaged map.
    """
    d = F.sqrt((F.col("qx") - center[0]) ** 2 + (F.col("qy") - center[1]) ** 2)
    m = maxima.select("qx", "qy", d.alias("d"), F.atan2(F.col("qy") - center[1], F.col("qx") - center[0]).alias("angle"))
    near = m.withColumn("n", F.row_number().over(W.orderBy("d", "qx", "qy")))  # the maxima of one map
    first = near.where("n = 1").select(F.col("qx").alias("x0"), F.col("qy").alias("y0"))
    g1 = near.where("n = 2").select(F.col("qx").alias("x1"), F.col("qy").alias("y1"), F.col("angle").alias("angle1"))
    rest = near.where("n > 2").crossJoin(F.broadcast(g1))
    score = F.col("d") * (F.cos(F.col("angle") - F.col("angle1")) ** 2 + 0.1)
    g2 = rest.select("qx", "qy", score.alias("s")).agg(F.min(F.struct("s", "qx", "qy")).alias("b"))
    out = first.crossJoin(F.broadcast(g1)).crossJoin(F.broadcast(g2))
    return out.select("x0", "y0", (F.col("x1") - F.col("x0")).alias("g1x"), (F.col("y1") - F.col("y0")).alias("g1y"), (F.col("b.qx") - F.col("x0")).alias("g2x"), (F.col("b.qy") - F.col("y0")).alias("g2y"))


def fractional(x: Column, y: Column, g1: Vector, g2: Vector) -> tuple[Column, Column]:
    """Coordinates along g1 and g2."""
    det = g1[0] * g2[1] - g1[1] * g2[0]
    return (x * g2[1] - y * g2[0]) / det, (y * g1[0] - x * g1[1]) / det


def index_directions(points: DataFrame, origin: Vector, g1: Vector, g2: Vector) -> DataFrame:
    """Whole indices (h, k), rounded half to even."""
    h, k = fractional(F.col("qx") - origin[0], F.col("qy") - origin[1], g1, g2)
    return points.withColumn("h", F.rint(h).cast("long")).withColumn("k", F.rint(k).cast("long"))


def index_peaks(peaks: DataFrame, origin: Vector, g1: Vector, g2: Vector, max_spacing: float) -> DataFrame:
    """Peaks within max_spacing of a lattice point, with its indices; no join with the lattice is needed.

    Where max_spacing is under half a cell along both axes, the rounded
    coordinates name the only point in reach; else the nearest of the nine points
    around them does (for a reduced cell).
    """
    x, y = F.col("qx") - origin[0], F.col("qy") - origin[1]
    fh, fk = fractional(x, y, g1, g2)
    det = abs(g1[0] * g2[1] - g1[1] * g2[0])
    alone = max_spacing * max(math.hypot(*g1), math.hypot(*g2)) / det < 0.5

    def distance(h, k):
        return (x - h * g1[0] - k * g2[0]) ** 2 + (y - h * g1[1] - k * g2[1]) ** 2

    if alone:
        out = peaks.withColumn("h", F.rint(fh)).withColumn("k", F.rint(fk)).where(distance(F.col("h"), F.col("k")) <= max_spacing**2)
        return out.withColumn("h", F.col("h").cast("long")).withColumn("k", F.col("k").cast("long"))
    around = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])

    def candidate(o):
        h, k = F.rint(fh) + o["a"], F.rint(fk) + o["b"]
        return F.struct(distance(h, k).alias("d2"), h.cast("long").alias("h"), k.cast("long").alias("k"))

    best = peaks.withColumn("__b", F.array_min(F.transform(around, candidate)))
    return best.where(F.col("__b.d2") <= max_spacing**2).withColumn("h", F.col("__b.h")).withColumn("k", F.col("__b.k")).drop("__b")


def fit_lattice(indexed: DataFrame, min_peaks: int = 5, error: bool = True) -> DataFrame:
    """Weighted least squares of q = (x0, y0) + h g1 + k g2 at each position, weights I^2.

    One aggregate of 12 moments by position and Cramer's rule; the error, the
    mean distance weighted by I, takes a join back on the same key.
    """
    w, h, k, x, y = F.col("intensity") ** 2, F.col("h"), F.col("k"), F.col("qx"), F.col("qy")
    terms = {"s": w, "sh": w * h, "sk": w * k, "shh": w * h * h, "shk": w * h * k, "skk": w * k * k, "sx": w * x, "shx": w * h * x, "skx": w * k * x, "sy": w * y, "shy": w * h * y, "sky": w * k * y}
    m = indexed.groupBy("rx", "ry").agg(F.count("*").alias("n"), *[F.sum(t).alias(c) for c, t in terms.items()]).where(F.col("n") >= min_peaks)
    s, sh, sk, shh, shk, skk = (F.col(c) for c in ("s", "sh", "sk", "shh", "shk", "skk"))
    c00, c01, c02 = shh * skk - shk * shk, sk * shk - sh * skk, sh * shk - sk * shh
    c11, c12, c22 = s * skk - sk * sk, sh * sk - s * shk, s * shh - sh * sh
    det = F.nullif(s * c00 + sh * c01 + sk * c02, F.lit(0.0))

    def solve(a, b, c):
        return (c00 * a + c01 * b + c02 * c) / det, (c01 * a + c11 * b + c12 * c) / det, (c02 * a + c12 * b + c22 * c) / det

    xs, ys = solve(*(F.col(c) for c in ("sx", "shx", "skx"))), solve(*(F.col(c) for c in ("sy", "shy", "sky")))
    fit = m.select("rx", "ry", xs[0].alias("x0"), ys[0].alias("y0"), xs[1].alias("g1x"), ys[1].alias("g1y"), xs[2].alias("g2x"), ys[2].alias("g2y"))
    if not error:
        return fit
    res = F.hypot(x - F.col("x0") - h * F.col("g1x") - k * F.col("g2x"), y - F.col("y0") - h * F.col("g1y") - k * F.col("g2y"))
    err = indexed.join(fit, ["rx", "ry"]).groupBy("rx", "ry").agg((F.sum(F.col("intensity") * res) / F.sum("intensity")).alias("error"))
    return fit.join(err, ["rx", "ry"])


def on_grid(fit: DataFrame, scan: DataFrame) -> DataFrame:
    """Fits on every scan position, with mask 0 and zeros where there is none."""
    return scan.join(fit.withColumn("mask", F.lit(1.0)), ["rx", "ry"], "left").na.fill(0.0)


def reference(fit: DataFrame) -> DataFrame:
    """Component-wise median of the lattice vectors, as one row."""
    return fit.agg(*[F.median(c).alias(f"r_{c}") for c in ("g1x", "g1y", "g2x", "g2y")])


def strain(fit: DataFrame, ref: DataFrame) -> DataFrame:
    """e_xx, e_yy, e_xy and theta against a reference row."""
    f = fit.crossJoin(F.broadcast(ref))
    g1x, g1y, g2x, g2y = (F.col(c) for c in ("g1x", "g1y", "g2x", "g2y"))
    a, b, c, d = (F.col(f"r_{n}") for n in ("g1x", "g1y", "g2x", "g2y"))
    det = a * d - b * c
    xx, xy = (d * g1x - b * g2x) / det, (d * g1y - b * g2y) / det
    yx, yy = (a * g2x - c * g1x) / det, (a * g2y - c * g1y) / det
    return f.select("rx", "ry", (1 - xx).alias("e_xx"), (1 - yy).alias("e_yy"), (-(xy + yx) / 2).alias("e_xy"), ((yx - xy) / 2).alias("theta"))


def rotate_strain(s: DataFrame, x_axis: Vector, flip_theta: bool = False) -> DataFrame:
    """The strain tensor in axes whose x lies along x_axis."""
    t = math.atan2(x_axis[1], x_axis[0])
    c, n = math.cos(t), math.sin(t)
    xx, yy, xy = F.col("e_xx"), F.col("e_yy"), F.col("e_xy")
    return s.select(
        "rx", "ry",
        (c * c * xx + 2 * c * n * xy + n * n * yy).alias("e_xx"),
        (n * n * xx - 2 * c * n * xy + c * c * yy).alias("e_yy"),
        (c * n * (yy - xx) + (c * c - n * n) * xy).alias("e_xy"),
        (-F.col("theta") if flip_theta else F.col("theta")).alias("theta"),
    )


def set_hkl(indexed: DataFrame, g1_hkl: tuple[int, int, int], g2_hkl: tuple[int, int, int]) -> DataFrame:
    """Miller indices from lattice indices and those of the basis."""
    names = ("miller_h", "miller_k", "miller_l")
    return indexed.select("*", *[(F.col("h") * a + F.col("k") * b).alias(n) for n, a, b in zip(names, g1_hkl, g2_hkl)])


def strain_map(peaks: DataFrame, origin: Vector, g1: Vector, g2: Vector, max_spacing: float, x_axis: Vector = (1.0, 0.0), flip_theta: bool = False, ref: DataFrame | None = None) -> DataFrame:
    """From calibrated peaks to strain in given axes: indices, lattice fits, reference (their median, or a row given), strain, rotation."""
    fit = fit_lattice(index_peaks(peaks, origin, g1, g2, max_spacing), error=False)
    return rotate_strain(strain(fit, reference(fit) if ref is None else ref), x_axis, flip_theta)
