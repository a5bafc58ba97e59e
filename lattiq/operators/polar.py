"""Polar views, radial statistics, backgrounds and pair distributions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.model import CubeMeta


@dataclass(frozen=True)
class PolarSpec:
    """Radial bins qmin, qmin + qstep, ... below qmax, and annular bins over a full (or half) turn."""

    qmin: float = 0.0
    qmax: float = 5.0
    qstep: float = 1.0
    n_annular: int = 12
    two_fold: bool = False
    ellipse: tuple[float, float, float] | None = None

    @property
    def n_radial(self) -> int:
        return math.ceil((self.qmax - self.qmin) / self.qstep - 1e-9)

    @property
    def turn(self) -> float:
        return math.pi if self.two_fold else 2 * math.pi

    @property
    def annular_step(self) -> float:
        return self.turn / self.n_annular


def polar_bins(x: Column, y: Column, spec: PolarSpec) -> tuple[Column, Column]:
    """Fractional radial and annular bin of a point about the origin."""
    if spec.ellipse is None:
        r, t = F.sqrt(x * x + y * y), F.atan2(y, x)
    else:
        a, b, theta = spec.ellipse
        c, s = math.cos(theta), math.sin(theta)
        u, v = x * c + y * s, (y * c - x * s) * (a / b)
        r, t = (b / a) * F.sqrt(u * u + v * v), F.atan2(v, u) + theta
    return (r - spec.qmin) / spec.qstep, F.pmod(t, F.lit(spec.turn)) / spec.annular_step


def polar_scatter(p: DataFrame, origin: tuple[Column | float, Column | float], spec: PolarSpec, value: str = "i", keep: tuple[str, ...] = ("rx", "ry")) -> DataFrame:
    """Pixels shared bilinearly among polar bins: keep..., t, r, value, norm.

    ``norm`` is the share of pixels themselves in the bin.  The angle wraps, the
    radius is cut off.
    """
    r, t = polar_bins(F.col("qx") - origin[0], F.col("qy") - origin[1], spec)
    q = p.withColumn("__r", r).withColumn("__t", t)
    fr, ft = F.floor("__r"), F.floor("__t")
    dr, dt = F.col("__r") - fr, F.col("__t") - ft
    parts = [F.struct((fr + a).alias("r"), F.pmod(ft + b, F.lit(spec.n_annular)).alias("t"), (wr * wt).alias("w")) for a, wr in ((0, 1 - dr), (1, dr)) for b, wt in ((0, 1 - dt), (1, dt))]
    s = q.select(*keep, F.col(value).alias("v"), F.explode(F.array(*parts)).alias("c")).select(*keep, "v", "c.*")
    s = s.where((F.col("r") >= 0) & (F.col("r") < spec.n_radial))
    return s.groupBy(*keep, "t", "r").agg(F.sum(F.col("v") * F.col("w")).alias("value"), F.sum("w").alias("norm"))


def polar_data(p: DataFrame, origin, spec: PolarSpec, threshold: float = 0.1, **options) -> DataFrame:
    """Normalised polar image; bins that hold less than a share of a pixel are null."""
    s = polar_scatter(p, origin, spec, **options)
    return s.withColumn("value", F.when(F.col("norm") >= threshold, F.col("value") / F.col("norm"))).drop("norm")


def polar_view(p: DataFrame, origin, spec: PolarSpec, give: str = "masked", threshold: float = 0.1, power: float | None = None, **options) -> DataFrame:
    """Polar image in the form asked for, over every bin that a pixel shares.

    A bin is masked where its share of pixels, times its annular step in radians,
    is under the threshold.  ``masked`` and ``nan`` leave its value null, ``zeros``
    makes it 0; ``all`` and ``all_zeros`` add norm, density and mask.  ``power``
    scales by the radius relative to the last bin's.
    """
    s = polar_scatter(p, origin, spec, **options).withColumn("density", F.col("norm") * spec.annular_step)
    last = spec.qmin + (spec.n_radial - 1) * spec.qstep
    scale = F.lit(1.0) if power is None else F.pow((spec.qmin + F.col("r") * spec.qstep) / last, F.lit(float(power)))
    s = s.withColumn("mask", F.col("density") < threshold)
    value = F.when(~F.col("mask"), F.col("value") / F.col("norm") * scale)
    if give in ("zeros", "all_zeros"):
        value = value.otherwise(0.0)
    elif give not in ("masked", "nan", "all"):
        raise ValueError(give)
    s = s.withColumn("value", value)
    return s if give.startswith("all") else s.drop("norm", "density", "mask")


def polar_gather(p: DataFrame, origin: tuple[float, float], spec: PolarSpec, meta: CubeMeta = CubeMeta()) -> DataFrame:
    """Polar image sampled bilinearly at bin centres: one join with the table of weights."""
    weights = gather_weights(p.sparkSession, origin, spec, meta)
    return p.join(F.broadcast(weights), ["qx", "qy"]).groupBy("rx", "ry", "t", "r").agg(F.sum(F.col("i") * F.col("w")).alias("value"))


def radial_integral(p: DataFrame, origin: tuple[float, float], spec: PolarSpec, meta: CubeMeta = CubeMeta()) -> DataFrame:
    """rx, ry, r, value: the sum over the angle of polar_gather; a pixel's weights are summed before they meet the patterns."""
    weights = gather_weights(p.sparkSession, origin, spec, meta).groupBy("qx", "qy", "r").agg(F.sum("w").alias("w"))
    return p.join(F.broadcast(weights), ["qx", "qy"]).groupBy("rx", "ry", "r").agg(F.sum(F.col("i") * F.col("w")).alias("value"))


def gather_weights(spark, origin: tuple[float, float], spec: PolarSpec, meta: CubeMeta = CubeMeta()) -> DataFrame:
    """r, t, qx, qy, w: the four pixels about each bin's centre, four rows for each bin of the literal grid."""
    g = spark.range(spec.n_radial * spec.n_annular).select(F.expr(f"id div {spec.n_annular}").alias("r"), (F.col("id") % spec.n_annular).alias("t"))
    rr, tt = spec.qmin + (F.col("r") + 0.5) * spec.qstep, (F.col("t") + 0.5) * spec.annular_step
    a, b, theta = spec.ellipse or (1.0, 1.0, 0.0)
    c, s = math.cos(theta), math.sin(theta)
    u, v = rr * F.cos(tt), rr * (b / a) * F.sin(tt)
    x, y = origin[0] + u * c - v * s, origin[1] + u * s + v * c
    g = g.select("r", "t", x.alias("x"), y.alias("y")).where((x >= 0) & (y >= 0) & (x <= meta.q_nx - 1) & (y <= meta.q_ny - 1))
    fx, fy = F.least(F.floor("x"), F.lit(meta.q_nx - 2)), F.least(F.floor("y"), F.lit(meta.q_ny - 2))
    dx, dy = F.col("x") - fx, F.col("y") - fy
    parts = [F.struct((fx + i).alias("qx"), (fy + j).alias("qy"), (wx * wy).alias("w")) for i, wx in ((0, 1 - dx), (1, dx)) for j, wy in ((0, 1 - dy), (1, dy))]
    return g.select("r", "t", F.explode(F.array(*parts)).alias("c")).select("r", "t", "c.*")


def radial_profile(polar: DataFrame, how: str = "mean") -> DataFrame:
    """radial(rx, ry, r): mean (with population variance) or median over the angle; null bins do not count."""
    if how == "median":
        return polar.groupBy("rx", "ry", "r").agg(F.median("value").alias("radial"), F.var_pop("value").alias("variance"))
    return polar.groupBy("rx", "ry", "r").agg(F.avg("value").alias("radial"), F.var_pop("value").alias("variance"))


def radial_statistics(polar: DataFrame) -> DataFrame:
    """Mean, variance and normalised variance over the scan of the radial means."""
    out = radial_profile(polar).groupBy("r").agg(F.avg("radial").alias("mean"), F.var_pop("radial").alias("variance"))
    return out.withColumn("variance_norm", F.when(F.col("mean") > 0, F.col("variance") / F.col("mean") ** 2).otherwise(F.col("variance")))


def local_fluctuation(polar: DataFrame, use_median: bool = False) -> DataFrame:
    """Per position and radius: mean (or median) and variance normalised by its square."""
    out = radial_profile(polar, "median" if use_median else "mean")
    return out.withColumn("variance_norm", F.when(F.col("radial") > 0, F.col("variance") / F.col("radial") ** 2))


def annular_symmetry(polar: DataFrame, orders: int, n_annular: int) -> DataFrame:
    """Power of each order in the normalised angular autocorrelation, less that of the bins that count.

    The transform of a normalised autocorrelation is |sum v e|^2 / (sum v)^2 over
    the bins that are not null; that of the bins themselves, |sum e|^2 / n^2, is what
    a mask or a beam stop adds.  A shell of nulls gives no row.
    """
    n = F.explode(F.sequence(F.lit(1), F.lit(orders))).alias("order")
    angle = 2 * math.pi * F.col("order") * F.col("t") / n_annular
    seen = polar.where("value is not null").select("rx", "ry", "r", "t", "value", n)
    moments = [F.sum(F.col("value") * f(angle)).alias(a) for a, f in (("c", F.cos), ("s", F.sin))] + [F.sum(f(angle)).alias(a) for a, f in (("c0", F.cos), ("s0", F.sin))]
    sums = seen.groupBy("rx", "ry", "r", "order").agg(*moments, F.sum("value").alias("v"), F.count("*").alias("n"))
    c, s, c0, s0, total = (F.col(x) for x in ("c", "s", "c0", "s0", "v"))
    image = (c * c + s * s) / F.when(total != 0, total * total).otherwise(1.0)
    return sums.select("rx", "ry", "r", F.col("order").cast("long").alias("order"), F.abs(image - (c0 * c0 + s0 * s0) / (F.col("n") * F.col("n"))).alias("power"))


def radial_background(p: DataFrame, origin: tuple[float, float], qstep: float = 1.0, floor: float = 0.0) -> DataFrame:
    """Median over each integer shell of every pattern, at least ``floor``."""
    r = F.floor(F.sqrt((F.col("qx") - origin[0]) ** 2 + (F.col("qy") - origin[1]) ** 2) / qstep)
    return p.groupBy("rx", "ry", r.alias("r")).agg(F.greatest(F.median("i"), F.lit(floor)).alias("background"))


def subtract_radial(p: DataFrame, background: DataFrame, origin: tuple[float, float], qstep: float = 1.0) -> DataFrame:
    """Patterns less their radial background, interpolated linearly at each pixel; never under 0.

    Beyond the outermost shell the background holds its last value.
    """
    shells = F.map_from_entries(F.collect_list(F.struct("r", "background")))
    b = background.groupBy("rx", "ry").agg(shells.alias("b"), F.max("r").alias("top"))
    d = F.sqrt((F.col("qx") - origin[0]) ** 2 + (F.col("qy") - origin[1]) ** 2) / qstep
    q = p.join(b, ["rx", "ry"]).withColumn("d", d)
    low = F.least(F.floor("d"), F.col("top"))
    high = F.least(low + 1, F.col("top"))
    f = F.least(F.col("d") - low, F.lit(1.0))
    bg = F.coalesce(F.try_element_at("b", low), F.lit(0.0)) * (1 - f) + F.coalesce(F.try_element_at("b", high), F.lit(0.0)) * f
    return q.withColumn("background", bg).withColumn("i", F.greatest(F.col("i") - F.col("background"), F.lit(0.0))).select("rx", "ry", "qx", "qy", "i", "background")


def scattering_model(k2: Column, c: float, i0: float, s0: float, i1: float, s1: float) -> Column:
    """Constant, Gaussian and fourth-power Gaussian in k."""
    return c + i0 * F.exp(-k2 / (2 * s0 * s0)) + i1 * F.exp(-(k2 * k2) / (2 * s1**4))


def sine_transform(profile: DataFrame, k: str, f: str, radii: DataFrame, dk: float) -> DataFrame:
    """r, 4 pi sum f(k) sin(2 pi k r) dk: the pair distribution from a reduced structure factor.

    The radii are a literal grid, so the pairs are bounded by the two grids.
    """
    term = F.col(f) * F.sin(2 * math.pi * F.col(k) * F.col("radius"))
    return profile.crossJoin(F.broadcast(radii)).groupBy("radius").agg((4 * math.pi * dk * F.sum(term)).alias("pdf"))
