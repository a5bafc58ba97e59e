"""Cube geometry, virtual images, virtual diffraction and cleaning."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattiq.model import CubeMeta, pixels
from lattiq.operators.quantiles import grouped_quantiles

Mask = Callable[[Column, Column], Column]  # (qx, qy) -> boolean or weight

# ----- detectors


def point(x: float, y: float) -> Mask:
    return lambda qx, qy: (qx == int(x)) & (qy == int(y))


def circle(x: float, y: float, r: float) -> Mask:
    return lambda qx, qy: (qx - x) * (qx - x) + (qy - y) * (qy - y) < r * r


def annulus(x: float, y: float, inner: float, outer: float) -> Mask:
    if outer <= inner:
        raise ValueError("the outer radius must be above the inner")

    def inside(qx, qy):
        d = (qx - x) * (qx - x) + (qy - y) * (qy - y)
        return (d > inner * inner) & (d < outer * outer)

    return inside


def rectangle(x0: float, x1: float, y0: float, y1: float) -> Mask:
    """Edges round half to even; half-open."""
    a, b, c, d = (round(v) for v in (x0, x1, y0, y1))
    return lambda qx, qy: (qx >= a) & (qx < b) & (qy >= c) & (qy < d)


def weights(values: list[list[float]]) -> Mask:
    """Arbitrary weights of a small detector, a row for each qx."""
    n = len(values[0])

    def weight(qx, qy):
        flat = F.array(*[F.lit(float(v)) for row in values for v in row])
        return F.element_at(flat, (qx * n + qy + 1).cast("int"))

    return weight


def sector(x: float, y: float, r: float, start: float, stop: float) -> Mask:
    """Disk sector between two clockwise angles from the y axis, in radians."""

    def inside(qx, qy):
        angle = F.pmod(F.atan2(qx - x, qy - y) - start, F.lit(2 * math.pi))
        return ((qx - x) * (qx - x) + (qy - y) * (qy - y) <= r * r) & (angle <= (stop - start) % (2 * math.pi))

    return inside


def detector_to_pixels(geometry: tuple[float, ...], q_pixel_size: float, origin: tuple[float, float], centered: bool, calibrated: bool) -> tuple[float, ...]:
    """Detector geometry (x, y, radii...) in pixels.

    Calibrated lengths are divided by the pixel size; a centred geometry is then
    moved to the mean origin.  Adding the origin before the division, as is
    sometimes done, would scale a pixel length and is not repeated here.
    """
    g = [v / q_pixel_size for v in geometry] if calibrated else list(geometry)
    if centered:
        g[0], g[1] = g[0] + origin[0], g[1] + origin[1]
    return tuple(g)


def _weight(mask: Mask, qx: Column, qy: Column) -> Column:
    return mask(qx, qy).cast("double")


# ----- virtual images: inside a row, no shuffle


def virtual_image(cube: DataFrame, mask: Mask, meta: CubeMeta = CubeMeta(), name: str = "value", data: str = "data") -> DataFrame:
    """rx, ry and the weighted sum over the detector."""

    def term(i, k):
        qx, qy = F.floor(k / meta.q_ny), k % meta.q_ny
        return i * _weight(mask, qx, qy)

    return cube.select("rx", "ry", F.aggregate(F.transform(data, term), F.lit(0.0), lambda a, v: a + v).alias(name))


def virtual_image_shifted(cube: DataFrame, mask: Mask, dx: Column, dy: Column, meta: CubeMeta = CubeMeta(), name: str = "value", bilinear: bool = False) -> DataFrame:
    """As virtual_image with the mask rolled by a shift for each position, wrapping around the detector.

    Whole shifts round half to even; a bilinear shift mixes four rolled masks.
    """
    low = (F.floor(dx), F.floor(dy)) if bilinear else (F.rint(dx).cast("long"), F.rint(dy).cast("long"))

    def rolled(qx, qy, sx, sy):
        return _weight(mask, F.pmod(qx - sx, F.lit(meta.q_nx)), F.pmod(qy - sy, F.lit(meta.q_ny)))

    def term(i, k):
        qx, qy = F.floor(k / meta.q_ny), (k % meta.q_ny).cast("long")
        if not bilinear:
            return i * rolled(qx, qy, *low)
        fx, fy = dx - low[0], dy - low[1]
        return i * (
            rolled(qx, qy, low[0], low[1]) * (1 - fx) * (1 - fy) + rolled(qx, qy, low[0] + 1, low[1]) * fx * (1 - fy)
            + rolled(qx, qy, low[0], low[1] + 1) * (1 - fx) * fy + rolled(qx, qy, low[0] + 1, low[1] + 1) * fx * fy
        )

    return cube.select("rx", "ry", F.aggregate(F.transform("data", term), F.lit(0.0), lambda a, v: a + v).alias(name))


# ----- virtual diffraction: partial aggregates by detector pixel

METHODS = {"mean": F.avg, "max": F.max, "sum": F.sum}


def _reduced(p: DataFrame, method: str, value: Column) -> DataFrame:
    """One value for each detector pixel; a median sorts distinct values, since a group is a whole scan."""
    if method == "median":
        return grouped_quantiles(p, ["qx", "qy"], value, {"value": 0.5})
    return p.groupBy("qx", "qy").agg(METHODS[method](value).alias("value"))


def virtual_diffraction(cube: DataFrame, method: str = "mean", where: Column | None = None, weight: Column | None = None, meta: CubeMeta = CubeMeta()) -> DataFrame:
    """qx, qy, value over the scan; ``where`` selects positions, ``weight`` weighs them.

    A weighted mean divides by the sum of weights; a weighted maximum or median is
    that of the weighted patterns.
    """
    used = cube if where is None else cube.where(where)
    if weight is None:
        return _reduced(pixels(used, meta), method, F.col("i"))
    p = pixels(used.withColumn("__w", weight.cast("double")), meta, ("__w",))
    wi = F.col("i") * F.col("__w")
    if method == "mean":
        return p.groupBy("qx", "qy").agg((F.sum(wi) / F.sum("__w")).alias("value"))
    return _reduced(p, method, wi)


def virtual_diffraction_shifted(cube: DataFrame, dx: Column, dy: Column, method: str = "mean", meta: CubeMeta = CubeMeta()) -> DataFrame:
    """Patterns rolled by a whole shift for each position; a maximum is at least 0."""
    p = pixels(cube.withColumn("__x", F.rint(dx).cast("long")).withColumn("__y", F.rint(dy).cast("long")), meta, ("__x", "__y"))
    p = p.select(F.pmod(F.col("qx") + F.col("__x"), F.lit(meta.q_nx)).alias("qx"), F.pmod(F.col("qy") + F.col("__y"), F.lit(meta.q_ny)).alias("qy"), "i")
    out = _reduced(p, method, F.col("i"))
    return out.withColumn("value", F.greatest("value", F.lit(0.0))) if method == "max" else out


def local_average(cube: DataFrame, meta: CubeMeta = CubeMeta()) -> DataFrame:
    """Each pattern averaged with its scan neighbours by the kernel 1 2 1 / 2 4 2 / 1 2 1, renormalised at borders.

    Each frame is sent to its nine neighbours and summed there: one shuffle by
    position with partial sums.
    """
    offsets = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(float((2 - abs(a)) * (2 - abs(b)))).alias("w")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    sent = cube.select("rx", "ry", "data", F.explode(offsets).alias("o")).select((F.col("rx") + F.col("o.dx")).alias("rx"), (F.col("ry") + F.col("o.dy")).alias("ry"), "data", F.col("o.w").alias("w"))
    p = sent.select("rx", "ry", "w", F.posexplode("data").alias("k", "i"))
    sums = p.groupBy("rx", "ry", "k").agg((F.sum(F.col("w") * F.col("i")) / F.sum("w")).alias("value"))
    here = cube.select("rx", "ry").distinct()
    return sums.join(here, ["rx", "ry"], "left_semi").select("rx", "ry", F.expr(f"k div {meta.q_ny}").cast("long").alias("qx"), (F.col("k") % meta.q_ny).cast("long").alias("qy"), "value")


# ----- geometry


def set_scan_shape(linear: DataFrame, r_ny: int, position: str = "pos") -> DataFrame:
    return linear.withColumn("rx", F.expr(f"{position} div {r_ny}")).withColumn("ry", F.col(position) % r_ny)


def swap_rq(p: DataFrame) -> DataFrame:
    return p.select(F.col("qx").alias("rx"), F.col("qy").alias("ry"), F.col("rx").alias("qx"), F.col("ry").alias("qy"), "i")


def swap_rxy(p: DataFrame) -> DataFrame:
    return p.select("qx", "qy", "i", F.col("ry").alias("rx"), F.col("rx").alias("ry"))


def swap_qxy(p: DataFrame) -> DataFrame:
    return p.select("rx", "ry", "i", F.col("qy").alias("qx"), F.col("qx").alias("qy"))


def crop(p: DataFrame, x: str, y: str, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    """Half-open crop of two axes, numbered from 0 again."""
    inside = (F.col(x) >= x0) & (F.col(x) < x1) & (F.col(y) >= y0) & (F.col(y) < y1)
    return p.where(inside).withColumn(x, F.col(x) - x0).withColumn(y, F.col(y) - y0)


def bin_axes(p: DataFrame, x: str, y: str, n: int, size_x: int, size_y: int) -> DataFrame:
    """Sum n x n blocks of two axes; a remainder is dropped."""
    others = [c for c in ("rx", "ry", "qx", "qy") if c not in (x, y)]
    used = p.where((F.col(x) < size_x // n * n) & (F.col(y) < size_y // n * n))
    return used.groupBy(F.expr(f"{x} div {n}").alias(x), F.expr(f"{y} div {n}").alias(y), *others).agg(F.sum("i").alias("i"))


def wrapped(total: Column, bits: int = 16) -> Column:
    """A whole sum in an unsigned type of so many bits, which wraps."""
    return F.pmod(total, F.lit(1 << bits))


def thin_r(p: DataFrame, n: int, r_nx: int, r_ny: int) -> DataFrame:
    """Every n-th scan position."""
    keep = (F.col("rx") % n == 0) & (F.col("ry") % n == 0) & (F.col("rx") < r_nx // n * n) & (F.col("ry") < r_ny // n * n)
    return p.where(keep).withColumn("rx", F.expr(f"rx div {n}")).withColumn("ry", F.expr(f"ry div {n}"))


def pad_q(cube: DataFrame, output: tuple[int, int] | None = None, factor: float | None = None, meta: CubeMeta = CubeMeta()) -> DataFrame:
    """Zero-pad the detector, inside the row.

    A factor pads round(N * (f - 1) / 2) on both sides; a size pads half, rounded
    down, on the low side and the rest on the high side.
    """
    if factor is not None:
        px, py = round(meta.q_nx * (factor - 1) / 2), round(meta.q_ny * (factor - 1) / 2)
        nx, ny = meta.q_nx + 2 * px, meta.q_ny + 2 * py
    else:
        nx, ny = output
        px, py = (nx - meta.q_nx) // 2, (ny - meta.q_ny) // 2

    def value(k):
        x, y = F.floor(k / ny) - px, k % ny - py
        inside = (x >= 0) & (x < meta.q_nx) & (y >= 0) & (y < meta.q_ny)
        return F.when(inside, F.get("data", (x * meta.q_ny + y).cast("int"))).otherwise(0.0)

    padded = cube.select("rx", "ry", F.transform(F.sequence(F.lit(0), F.lit(nx * ny - 1)), value).alias("data"))
    return pixels(padded, CubeMeta(nx, ny))


# ----- masks over the detector grid


def grid(spark, nx: int, ny: int, x: str = "qx", y: str = "qy") -> DataFrame:
    """Dense detector grid: nx * ny rows."""
    return spark.range(nx * ny).select(F.expr(f"id div {ny}").alias(x), (F.col("id") % ny).alias(y))


def bragg_mask(spark, nx: int, ny: int, g1: tuple[float, float], g2: tuple[float, float], radius: float, origin: tuple[float, float], max_q: float, reach: int) -> DataFrame:
    """Number of disks, centred on lattice points within max_q of the origin, that cover each pixel."""
    k = spark.range(-reach, reach + 1)
    lattice = k.select(F.col("id").alias("h")).crossJoin(k.select(F.col("id").alias("k")))  # (2 reach + 1)^2 rows
    vx, vy = F.col("h") * g1[0] + F.col("k") * g2[0], F.col("h") * g1[1] + F.col("k") * g2[1]
    lattice = lattice.select(vx.alias("vx"), vy.alias("vy")).where("sqrt(vx * vx + vy * vy) < %r" % float(max_q))
    near = (F.col("qx") - F.col("vx") - origin[0]) ** 2 + (F.col("qy") - F.col("vy") - origin[1]) ** 2 < radius * radius
    return grid(spark, nx, ny).join(F.broadcast(lattice), near, "left").groupBy("qx", "qy").agg(F.count("vx").alias("n"))


def pixels_off_peaks(p: DataFrame, peaks: DataFrame, radius: float) -> DataFrame:
    """Pixels farther than the radius from every peak of their position: a distance anti join per position."""
    k = peaks.select("rx", "ry", F.col("qx").alias("px"), F.col("qy").alias("py"))
    near = (p["rx"] == k["rx"]) & (p["ry"] == k["ry"]) & ((p["qx"] - k["px"]) ** 2 + (p["qy"] - k["py"]) ** 2 <= radius * radius)
    return p.join(k, near, "left_anti")


def threshold_mask(dp: DataFrame, share: float, value: str = "value") -> DataFrame:
    """Pixels of one pattern at or above the order statistic at index round(n * share)."""
    ranked = dp.withColumn("rank", F.row_number().over(W.orderBy(value)) - 1)
    n = dp.count()
    at = min(int(round(n * share)), n - 1)
    limit = ranked.where(F.col("rank") == at).select(F.col(value).alias("limit"))
    return dp.crossJoin(F.broadcast(limit)).withColumn("mask", F.col(value) >= F.col("limit")).drop("limit")


# ----- centre of mass, radial reductions, probe


def center_of_mass(cube: DataFrame, meta: CubeMeta = CubeMeta(), mask: Mask | None = None) -> DataFrame:
    """Intensity-weighted mean pixel of each pattern, inside the row; null where there is no intensity."""

    def moment(f):
        def term(i, k):
            qx, qy = F.floor(k / meta.q_ny).cast("double"), (k % meta.q_ny).cast("double")
            return i * f(qx, qy) * (_weight(mask, qx, qy) if mask else F.lit(1.0))

        return F.aggregate(F.transform("data", term), F.lit(0.0), lambda a, v: a + v)

    total = F.nullif(moment(lambda x, y: F.lit(1.0)), F.lit(0.0))
    return cube.select("rx", "ry", (moment(lambda x, y: x) / total).alias("com_x"), (moment(lambda x, y: y) / total).alias("com_y"))


def radial_reduction(p: DataFrame, x0: float, y0: float, bin_size: float = 1.0, how: Callable[[str], Column] = F.avg, by: tuple[str, ...] = ("rx", "ry")) -> DataFrame:
    """Any aggregate over integer shells of radius; ``how`` maps the column name to an aggregate."""
    r = F.floor(F.sqrt((F.col("qx") - x0) ** 2 + (F.col("qy") - y0) ** 2) / bin_size)
    return p.groupBy(*by, r.alias("r")).agg(how("i").alias("value"))


def synthetic_probe(spark, radius: float, width: float, nx: int, ny: int) -> DataFrame:
    """Logistic disk about the middle of the detector."""
    r = F.sqrt((F.col("qx") - nx / 2) ** 2 + (F.col("qy") - ny / 2) ** 2)
    return grid(spark, nx, ny).withColumn("value", 1 / (1 + F.exp(4 * (r - radius) / width)))


def probe_size(dp: DataFrame, low: float, high: float, steps: int, value: str = "value") -> DataFrame:
    """Radius and centre of a disk from its area above rising thresholds.

    r(t) = sqrt(area above t * max / pi) on ``steps`` thresholds; its mean where
    the gradient lies between twice its median and 0 is the radius, and the centre
    of mass above the mean threshold kept is the centre.
    """
    spark = dp.sparkSession
    t = spark.range(steps).select("id", (F.lit(float(low)) + F.col("id") * ((high - low) / (steps - 1))).alias("t"))
    top = dp.agg(F.max(value).alias("top"))
    full = dp.crossJoin(F.broadcast(top))
    area = full.crossJoin(F.broadcast(t)).groupBy("id", "t").agg(F.sqrt(F.sum((F.col(value) > F.col("t") * F.col("top")).cast("double")) / math.pi).alias("r"))
    order = W.orderBy("id")  # a few hundred thresholds
    prev, nxt = F.lag("r").over(order), F.lead("r").over(order)
    grad = F.when(prev.isNull(), nxt - F.col("r")).when(nxt.isNull(), F.col("r") - prev).otherwise((nxt - prev) / 2)
    g = area.withColumn("dr", grad)
    kept = g.crossJoin(F.broadcast(g.agg(F.median("dr").alias("mid")))).where("dr <= 0 and dr >= 2 * mid").agg(F.avg("r").alias("radius"), F.avg("t").alias("t_mean"))
    above = full.crossJoin(F.broadcast(kept)).where(F.col(value) > F.col("t_mean") * F.col("top"))
    v = F.col(value)
    return above.groupBy("radius").agg((F.sum(v * F.col("qx")) / F.sum(v)).alias("x0"), (F.sum(v * F.col("qy")) / F.sum(v)).alias("y0"))


# ----- cleaning

#: Neighbours that vote on hot pixels: the 3 x 3 block and the ring around it without its corners.
HOT_OFFSETS = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if abs(a) + abs(b) < 4]


def neighbours(dp: DataFrame, offsets: list[tuple[int, int]], nx: int, ny: int, wrap: bool) -> DataFrame:
    """qx, qy, o, value: the values of each pixel's neighbours, wrapped or clipped at the edges."""
    o = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets])
    s = dp.select("qx", "qy", "value", F.posexplode(o).alias("o", "d"))
    x, y = F.col("qx") - F.col("d.a"), F.col("qy") - F.col("d.b")
    if wrap:
        return s.select(F.pmod(x, F.lit(nx)).alias("qx"), F.pmod(y, F.lit(ny)).alias("qy"), "o", "value")
    return s.select(x.alias("qx"), y.alias("qy"), "o", "value").where((F.col("qx") >= 0) & (F.col("qx") < nx) & (F.col("qy") >= 0) & (F.col("qy") < ny))


def hot_pixels(mean_dp: DataFrame, threshold: float, k: int = 1, meta: CubeMeta = CubeMeta()) -> DataFrame:
    """Pixels whose mean exceeds the k-th highest (from 0) of their 21 neighbours, self included, by the threshold."""
    n = neighbours(mean_dp, HOT_OFFSETS, meta.q_nx, meta.q_ny, wrap=True)
    top = n.groupBy("qx", "qy").agg(F.sort_array(F.collect_list("value"), asc=False)[k].alias("limit"))
    return mean_dp.join(top, ["qx", "qy"]).withColumn("hot", (F.col("value") - F.col("limit")) > threshold)


def _replaced(data: Column, at: int, value: Column) -> Column:
    return F.transform(data, lambda i, k: F.when(k == at, value).otherwise(i))


def median_replace(cube: DataFrame, bad: list[tuple[int, int]], meta: CubeMeta = CubeMeta(), width: int = 3) -> DataFrame:
    """Frames with each bad pixel replaced by the median of its clipped width x width block, of the original values.

    Inside the row.  Replacing one after the other, so that a later pixel sees
    earlier replacements, would depend on an order and is not repeated.
    """
    half, data = width // 2, F.col("data")
    for x, y in bad:
        block = [F.get("data", F.lit(a * meta.q_ny + b)) for a in range(max(0, x - half), min(meta.q_nx, x - half + width)) for b in range(max(0, y - half), min(meta.q_ny, y - half + width))]
        v = F.array_sort(F.array(*block))
        n = len(block)
        mid = (F.get(v, F.lit((n - 1) // 2)) + F.get(v, F.lit(n // 2))) / 2
        at = x * meta.q_ny + y
        data = _replaced(data, at, mid)
    return cube.withColumn("data", data)


def filter_hot_pixels(cube: DataFrame, threshold: float, k: int = 1, meta: CubeMeta = CubeMeta()) -> DataFrame:
    """Frames with the hot pixels of their mean pattern (at most the detector's number) replaced by local medians."""
    hot = hot_pixels(virtual_diffraction(cube, meta=meta), threshold, k, meta).where("hot").select("qx", "qy").collect()
    return median_replace(cube, sorted((int(r["qx"]), int(r["qy"])) for r in hot), meta)


def shift_bilinear(cube: DataFrame, dx: float, dy: float, meta: CubeMeta = CubeMeta()) -> DataFrame:
    """Every pattern shifted by a fraction of pixels, periodic, by four weighted rolls inside the row."""
    lx, ly = math.floor(dx), math.floor(dy)
    fx, fy = dx - lx, dy - ly

    def at(k, sx, sy):
        x, y = F.pmod(F.floor(k / meta.q_ny) - sx, F.lit(meta.q_nx)), F.pmod(k % meta.q_ny - sy, F.lit(meta.q_ny))
        return F.get("data", (x * meta.q_ny + y).cast("int"))

    def value(k):
        return at(k, lx, ly) * ((1 - fx) * (1 - fy)) + at(k, lx + 1, ly) * (fx * (1 - fy)) + at(k, lx, ly + 1) * ((1 - fx) * fy) + at(k, lx + 1, ly + 1) * (fx * fy)

    return cube.withColumn("data", F.transform(F.sequence(F.lit(0), F.lit(meta.q_n - 1)), value))


def dark_reference(cube: DataFrame, width: int, axis: str = "x", meta: CubeMeta = CubeMeta()) -> DataFrame:
    """Mean over all frames of the detector's edge strips, a value for each line of the axis (background streaks)."""
    across, n = ("qy", meta.q_ny) if axis == "x" else ("qx", meta.q_nx)
    along = "qx" if axis == "x" else "qy"
    strip = pixels(cube, meta).where((F.col(across) < width) | (F.col(across) >= n - width))
    return strip.groupBy(along).agg(F.avg("i").alias("dark"))


def subtract_dark(p: DataFrame, dark: DataFrame, on: list[str]) -> DataFrame:
    """Pixels less a dark reference of at most one row for each detector pixel."""
    return p.join(F.broadcast(dark), on).withColumn("i", F.col("i") - F.col("dark")).drop("dark")
