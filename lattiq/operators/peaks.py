"""Peak tables: calibrated views, histograms, masks, origins, thresholds, maxima, calibration fits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattiq.functions.columns import corners, rotate
from lattiq.model import Calibration
from lattiq.operators.cube import grid


def brightest_first() -> list[Column]:
    """Order of peaks in a pattern: brightest first, ties by x then y, also falling."""
    return [F.col("intensity").desc(), F.col("qx").desc(), F.col("qy").desc()]


def calibrated(peaks: DataFrame, cal: Calibration, origin: tuple[Column, Column] | DataFrame | None = None, **steps) -> DataFrame:
    """Peaks centred, made circular, scaled and rotated, in that order: a view, without a shuffle.

    ``origin`` gives it for each position, as expressions of rx and ry or as a
    table (rx, ry, qx0, qy0) to join; else the calibration's mean origin serves.
    """
    if isinstance(origin, DataFrame):
        peaks = peaks.join(origin, ["rx", "ry"])
        origin = (F.col("qx0"), F.col("qy0"))
    if origin is not None and cal.qx0 is None:
        cal = cal.with_(qx0=0.0, qy0=0.0)
    on = cal.active(**steps)
    x, y = F.col("qx"), F.col("qy")
    if on["center"]:
        ox, oy = origin if origin is not None else (F.lit(cal.qx0), F.lit(cal.qy0))
        x, y = x - ox, y - oy
    if on["ellipse"]:
        xx, xy, yy = cal.ellipse_matrix()
        x, y = xx * x + xy * y, xy * x + yy * y
    if on["pixel"]:
        x, y = x * cal.q_pixel_size, y * cal.q_pixel_size
    if on["rotate"]:
        x, y = rotate(x, y, cal.qr_rotation, cal.qr_flip)
    return peaks.withColumn("__x", x).withColumn("__y", y).withColumn("qx", F.col("__x")).withColumn("qy", F.col("__y")).drop("__x", "__y", "qx0", "qy0")


def histogram(peaks: DataFrame, nx: int, ny: int, sampling: float = 1.0, origin: tuple[float, float] = (0.0, 0.0), pixel: float = 1.0, dense: bool = True) -> DataFrame:
    """Two-dimensional histogram of intensity with bilinear shares (the Bragg vector map).

    Calibrated peaks are taken back to pixels by ``pixel`` and ``origin``.  Peaks
    with a neighbour outside the grid are dropped.
    """
    x, y = (F.col("qx") / pixel + origin[0]) * sampling, (F.col("qy") / pixel + origin[1]) * sampling
    inside = (F.floor(x) >= 0) & (F.floor(y) >= 0) & (F.ceil(x) < nx) & (F.ceil(y) < ny)
    c = peaks.where(inside).select(F.explode(corners(x, y, F.col("intensity"))).alias("c")).select("c.*").where("w != 0")
    sums = c.groupBy("qx", "qy").agg(F.sum("w").alias("value"))
    if not dense:
        return sums
    return grid(peaks.sparkSession, nx, ny).join(sums, ["qx", "qy"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def weighted(peaks: DataFrame, weights: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Peaks of positions whose weight (rx, ry, w) exceeds the threshold, their intensity scaled by it."""
    return peaks.join(weights, ["rx", "ry"]).where(F.col("w") > threshold).withColumn("intensity", F.col("intensity") * F.col("w")).drop("w")


def peak_image(peaks: DataFrame, center: tuple[float, float], r0: float, r1: float) -> DataFrame:
    """Summed intensity with r0 <= r < r1 at each position that has peaks."""
    d = (F.col("qx") - center[0]) ** 2 + (F.col("qy") - center[1]) ** 2
    return peaks.groupBy("rx", "ry").agg(F.sum(F.when((d >= r0 * r0) & (d < r1 * r1), F.col("intensity")).otherwise(0.0)).alias("value"))


def mask_in_q(peaks: DataFrame, masked: DataFrame) -> DataFrame:
    """Peaks whose pixel, rounded half to even, is not among the masked (qx, qy)."""
    m = masked.select(F.col("qx").cast("long").alias("mx"), F.col("qy").cast("long").alias("my"))
    return peaks.join(m, (F.rint("qx").cast("long") == F.col("mx")) & (F.rint("qy").cast("long") == F.col("my")), "left_anti")


def mask_in_r(peaks: DataFrame, masked: DataFrame) -> DataFrame:
    return peaks.join(masked, ["rx", "ry"], "left_anti")


def measure_origin(peaks: DataFrame, guess: tuple[float, float], how: str = "intensity weighted distance") -> DataFrame:
    """The peak of each position that is nearest, brightest, or brightest for 1 / (1 + d^2).

    An ordered minimum aggregate: partial results, no window sort.  Ties go to
    the smallest (qx, qy, intensity).
    """
    d2 = (F.col("qx") - guess[0]) ** 2 + (F.col("qy") - guess[1]) ** 2
    score = {"distance": d2, "intensity": -F.col("intensity"), "intensity weighted distance": -F.col("intensity") / (1 + d2)}[how]
    best = F.min(F.struct(score.alias("s"), "qx", "qy", "intensity"))
    return peaks.groupBy("rx", "ry").agg(best.alias("b")).select("rx", "ry", F.col("b.qx").alias("qx0"), F.col("b.qy").alias("qy0"))


# ----- fits that are linear in their parameters: one aggregate of moments, a small solve

TERMS = {
    "constant": lambda x, y: [F.lit(1.0)],
    "plane": lambda x, y: [F.lit(1.0), x, y],
    "parabola": lambda x, y: [F.lit(1.0), x, y, x * x, y * y, x * y],
    "bezier_two": lambda x, y: [a * b for a in ((1 - x) ** 2, 2 * (1 - x) * x, x * x) for b in ((1 - y) ** 2, 2 * (1 - y) * y, y * y)],
}


def fit_surface(table: DataFrame, values: list[str], model: str = "plane", robust_steps: int = 0, robust_threshold: float = 2.0, scale: tuple[float, float] = (1.0, 1.0)) -> tuple[dict[str, np.ndarray], DataFrame]:
    """Least-squares surfaces of values over (rx, ry); coefficients, and the table with <value>_fit columns.

    The normal equations are aggregated in one pass and solved on the driver (at
    most 9 unknowns).  Each robust step drops rows whose squared residual exceeds
    robust_threshold^2 times the mean.  The caller's table is never changed.
    """
    x, y = F.col("rx").cast("double") / scale[0], F.col("ry").cast("double") / scale[1]
    terms = TERMS[model](x, y)
    out: dict[str, np.ndarray] = {}
    for v in values:
        used = table.where(F.col(v).isNotNull())
        for step in range(robust_steps + 1):
            sums = [F.sum(a * b) for i, a in enumerate(terms) for b in terms[i:]] + [F.sum(a * F.col(v)) for a in terms]
            row = [z or 0.0 for z in used.agg(*[s.alias(f"m{k}") for k, s in enumerate(sums)]).first()]
            n = len(terms)
            m = np.zeros((n, n))
            m[np.triu_indices(n)] = row[: n * (n + 1) // 2]
            m = m + np.triu(m, 1).T
            out[v] = np.linalg.lstsq(m, np.array(row[n * (n + 1) // 2 :]), rcond=None)[0]
            if step < robust_steps:
                fit = sum((F.lit(float(c)) * t for c, t in zip(out[v], terms)), F.lit(0.0))
                res = (F.col(v) - fit) ** 2
                mean = used.agg(F.avg(res)).first()[0]
                used = used.where(res <= robust_threshold**2 * mean)
    for v in values:
        table = table.withColumn(f"{v}_fit", sum((F.lit(float(c)) * t for c, t in zip(out[v], terms)), F.lit(0.0)))
    return out, table


# ----- thresholds


def universal_threshold(peaks: DataFrame, share: float, metric: str = "maximum") -> DataFrame:
    """Peaks brighter than a share of the maximum, mean or median of the patterns' maxima, or than a given value."""
    if metric == "manual":
        return peaks.where(F.col("intensity") >= share)
    top = peaks.groupBy("rx", "ry").agg(F.max("intensity").alias("top"))
    cut = top.agg({"maximum": F.max, "average": F.avg, "median": F.median}[metric]("top").alias("cut"))  # one row
    return peaks.crossJoin(F.broadcast(cut)).where(F.col("intensity") > F.col("cut") * share).drop("cut")


def relative_threshold(peaks: DataFrame, share: float, to: int = 0) -> DataFrame:
    """Peaks brighter than a share of the pattern's ``to``-th brightest peak."""
    order = W.partitionBy("rx", "ry").orderBy(*brightest_first())
    ref = F.nth_value("intensity", to + 1).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return peaks.withColumn("ref", ref).where(F.col("intensity") > F.col("ref") * share).drop("ref")


def brightest(peaks: DataFrame, n: int) -> DataFrame:
    """The n brightest peaks of each pattern."""
    return peaks.withColumn("rank", F.row_number().over(W.partitionBy("rx", "ry").orderBy(*brightest_first())).cast("long")).where(F.col("rank") <= n)


def thin(x: np.ndarray, y: np.ndarray, spacing: float) -> np.ndarray:
    """Which of the points, in order, are at least ``spacing`` from every kept point before."""
    kept = np.ones(len(x), bool)
    cells: dict[tuple[int, int], list[int]] = {}
    for k in range(len(x)):
        c = (math.floor(x[k] / spacing), math.floor(y[k] / spacing))
        near = [j for a in (-1, 0, 1) for b in (-1, 0, 1) for j in cells.get((c[0] + a, c[1] + b), ())]
        if any((x[k] - x[j]) ** 2 + (y[k] - y[j]) ** 2 < spacing**2 for j in near):
            kept[k] = False
        else:
            cells.setdefault(c, []).append(k)
    return kept


def min_spacing(peaks: DataFrame, spacing: float) -> DataFrame:
    """Greedy thinning of each pattern, brightest first: a group of one pattern's peaks at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["intensity", "qx", "qy"], ascending=False)
        return pdf[thin(pdf.qx.to_numpy(), pdf.qy.to_numpy(), spacing)]

    return peaks.groupBy("rx", "ry").applyInPandas(run, peaks.schema)


def reflected_pairs(x: np.ndarray, y: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs a < b of centred points with b at most ``reach`` from a's reflection, and that distance.

    Reflections are looked up in cells of ``reach``, so no matrix of all pairs is made.
    """
    cx, cy = np.floor(x / reach).astype(np.int64), np.floor(y / reach).astype(np.int64)
    mx, my = np.floor(-x / reach).astype(np.int64), np.floor(-y / reach).astype(np.int64)
    cell = lambda i, j: (i << 32) + j
    order = np.argsort(cell(cx, cy), kind="stable")
    cells, out = cell(cx, cy)[order], []
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            near = cell(mx + i, my + j)
            first = np.searchsorted(cells, near)
            many = np.searchsorted(cells, near, side="right") - first
            a = np.repeat(np.arange(len(x)), many)
            b = order[np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)]
            d = np.hypot(x[a] + x[b], y[a] + y[b])
            ok = (a < b) & (d <= reach)
            out.append((a[ok], b[ok], d[ok]))
    a, b, d = (np.concatenate(c) for c in zip(*out))
    return a, b, d


def friedel_origin(peaks: DataFrame, center: tuple[float, float], r0: float, r1: float, max_distance: float, iterations: int = 3) -> DataFrame:
    """Origin of each pattern as the mean midpoint of Friedel pairs in an annulus.

    Pairs are matched greedily, nearest to the reflection first; each pattern's
    centre moves to its result and the search repeats.  Null where no pair is found.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf.qx.to_numpy(), pdf.qy.to_numpy()
        c, found = np.array(center, float), 0
        for _ in range(iterations):
            r = np.hypot(x - c[0], y - c[1])
            i = np.flatnonzero((r >= r0) & (r < r1))
            a, b, d = reflected_pairs(x[i] - c[0], y[i] - c[1], max_distance)
            used, mids = set(), []
            for k in np.lexsort((b, a, d)):
                if a[k] not in used and b[k] not in used:
                    used |= {a[k], b[k]}
                    mids.append(((x[i[a[k]]] + x[i[b[k]]]) / 2, (y[i[a[k]]] + y[i[b[k]]]) / 2))
            found = len(mids)
            if not found:
                break
            new = np.mean(mids, axis=0)
            if np.allclose(new, c):
                break
            c = new
        ok = found > 0
        return pd.DataFrame({"rx": [pdf.rx.iloc[0]], "ry": [pdf.ry.iloc[0]], "qx0": [c[0] if ok else None], "qy0": [c[1] if ok else None], "pairs": [found]}).astype({"qx0": float, "qy0": float})

    return peaks.groupBy("rx", "ry").applyInPandas(run, "rx long, ry long, qx0 double, qy0 double, pairs long")


# ----- maxima of images


def maxima(p: DataFrame, by: list[str], value: str = "i", x: str = "qx", y: str = "qy", edge: int = 1, subpixel: bool = False, least: float | None = None) -> DataFrame:
    """Local maxima of images in long form, by an equi-join with their eight shifted copies.

    A maximum is at least its neighbours at larger x, or equal x and larger y,
    and above all the others, so one pixel of a plateau stands.  ``edge`` pixels at
    the border are left out.  With ``subpixel`` a parabola through each axis moves
    the position.
    """
    offsets = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
    o = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets])
    sent = p.select(*by, (F.col(x)).alias("sx"), F.col(y).alias("sy"), F.col(value).alias("nv"), F.explode(o).alias("o"))
    sent = sent.select(*by, (F.col("sx") - F.col("o.a")).alias(x), (F.col("sy") - F.col("o.b")).alias(y), "nv", F.col("o.a").alias("a"), F.col("o.b").alias("b"))
    after = ((F.col("a") == 1) & (F.col("b") >= 0)) | ((F.col("a") == 0) & (F.col("b") == 1)) | ((F.col("a") == -1) & (F.col("b") == 1))
    at = lambda a, b: F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col("nv")))
    around = sent.groupBy(*by, x, y).agg(F.max(F.when(after, F.col("nv"))).alias("hi"), F.max(F.when(~after, F.col("nv"))).alias("lo"), F.count("*").alias("n"), at(1, 0).alias("xp"), at(-1, 0).alias("xm"), at(0, 1).alias("yp"), at(0, -1).alias("ym"))
    size = p.groupBy(*by).agg(F.max(x).alias("mx"), F.max(y).alias("my"))
    top = p.join(around.where("n = 8"), [*by, x, y]).join(size, by) if by else p.join(around.where("n = 8"), [x, y]).crossJoin(F.broadcast(size))
    v = F.col(value)
    keep = (v >= F.col("hi")) & (v > F.col("lo")) & (F.col(x) >= edge) & (F.col(y) >= edge) & (F.col(x) <= F.col("mx") - edge) & (F.col(y) <= F.col("my") - edge)
    if least is not None:
        keep = keep & (v >= least)
    top = top.where(keep)
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    if subpixel:
        px = px + (F.col("xp") - F.col("xm")) / (4 * v - 2 * F.col("xp") - 2 * F.col("xm"))
        py = py + (F.col("yp") - F.col("ym")) / (4 * v - 2 * F.col("yp") - 2 * F.col("ym"))
    return top.select(*by, px.alias(x), py.alias(y), v.alias("intensity"))


def electron_count(p: DataFrame, background: float, xray: float, dark: DataFrame | None = None) -> DataFrame:
    """Counted electrons: pixels between two thresholds that exceed all eight neighbours."""
    if dark is not None:
        p = p.join(F.broadcast(dark), ["qx", "qy"]).withColumn("i", F.col("i") - F.col("dark")).drop("dark")
    p = p.withColumn("i", F.when((F.col("i") > background) & (F.col("i") < xray), F.col("i")).otherwise(0.0))
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)])
    sent = p.where("i > 0").select("rx", "ry", "qx", "qy", "i", F.explode(offsets).alias("o")).select("rx", "ry", (F.col("qx") + F.col("o.a")).alias("qx"), (F.col("qy") + F.col("o.b")).alias("qy"), F.col("i").alias("n"))
    high = sent.groupBy("rx", "ry", "qx", "qy").agg(F.max("n").alias("n"))
    return p.where("i > 0").join(high, ["rx", "ry", "qx", "qy"], "left").where("n is null or i > n").drop("n")


def counting_thresholds(p: DataFrame, sigma_background: float, sigma_xray: float) -> tuple[float, float]:
    """Thresholds from the mean and the population deviation of the intensities."""
    mean, std = p.agg(F.avg("i"), F.stddev_pop("i")).first()
    return mean + sigma_background * std, mean + sigma_xray * std


def pixel_size_from_indexed(peaks: DataFrame, a: float, by: list[str]) -> DataFrame:
    """Calibrated pixel size from radii and indices of a cubic cell: least-squares slope of q over sqrt(h^2 + k^2 + l^2)."""
    d2 = F.col("h") ** 2 + F.col("k") ** 2 + F.col("l") ** 2
    slope = F.sum(F.col("q") * F.sqrt(d2)) / F.sum(d2)
    return peaks.groupBy(*by).agg((1 / (slope * a)).alias("dq"))


def maxima_1d(profile: DataFrame, by: list[str], index: str, value: str = "value", least_relative: float = 0.0, to: int = 0) -> DataFrame:
    """Local maxima of profiles that wrap at their ends, with their rank from 0, brightest first.

    A maximum is above its next value and at least its previous one.  Maxima not
    brighter than a share of the ``to``-th brightest go.  A profile is one row for
    each index of a literal axis.
    """
    order = W.partitionBy(*by).orderBy(index)
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = F.coalesce(F.lead(value).over(order), F.first(value).over(whole))
    before = F.coalesce(F.lag(value).over(order), F.last(value).over(whole))
    found = profile.withColumn("__after", after).withColumn("__before", before).where((F.col(value) > F.col("__after")) & (F.col(value) >= F.col("__before"))).drop("__after", "__before")
    ranks = W.partitionBy(*by).orderBy(F.desc(value), F.desc(index))
    ranked = found.withColumn("rank", (F.row_number().over(ranks) - 1).cast("long"))
    if least_relative:
        ref = F.max(F.when(F.col("rank") == to, F.col(value))).over(W.partitionBy(*by))
        ranked = ranked.withColumn("__ref", ref).where(F.col(value) > F.col("__ref") * least_relative).drop("__ref")
    return ranked


def fit_affine(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The least-squares map (x, y) -> (u, v) of each group: u = a x + b y + c, v = d x + e y + f.

    One aggregate of centred moments; groups whose points lie on a line give none.
    """
    fits = pairs.groupBy(*by).agg(
        *[F.avg(c).alias(f"m{c}") for c in "xyuv"],
        F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"),
        *[F.covar_pop(p, q).alias(f"{p}{q}") for p in "xy" for q in "uv"],
    )
    fits = fits.withColumn("det", F.col("xx") * F.col("yy") - F.col("xy") ** 2).where(F.col("det") > 1e-12 * F.col("xx") * F.col("yy"))
    out = fits
    for first, second, shift, q in (("a", "b", "c", "u"), ("d", "e", "f", "v")):
        out = out.withColumn(first, (F.col(f"x{q}") * F.col("yy") - F.col(f"y{q}") * F.col("xy")) / F.col("det"))
        out = out.withColumn(second, (F.col(f"y{q}") * F.col("xx") - F.col(f"x{q}") * F.col("xy")) / F.col("det"))
        out = out.withColumn(shift, F.col(f"m{q}") - F.col(first) * F.col("mx") - F.col(second) * F.col("my"))
    return out.select(*by, *"abcdef")


def composed_threshold(peaks: DataFrame, share: float = 0.0, to: int = 0, spacing: float = 0.0, most: int | None = None) -> DataFrame:
    """A relative threshold, then greedy thinning, then the brightest of each pattern; what is 0 or None is left out."""
    out = relative_threshold(peaks, share, to) if share else peaks
    out = min_spacing(out, spacing) if spacing else out
    return out if most is None else brightest(out, most)
