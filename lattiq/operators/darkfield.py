"""Digital dark field: apertures and images from peak lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def point_list(peaks: DataFrame, center: tuple[float, float]) -> DataFrame:
    """Peaks about a centre with radius and angle in degrees, atan2(-qx, qy)."""
    x, y = F.col("qx") - center[0], F.col("qy") - center[1]
    return peaks.select("rx", "ry", x.alias("qx"), y.alias("qy"), "intensity", F.hypot(x, y).alias("r"), F.degrees(F.atan2(-x, y)).alias("phi"))


def apertures(spark, mode: str, g1: tuple[float, float], g2: tuple[float, float] = (0.0, 0.0), center: tuple[float, float] = (0.0, 0.0), n1: tuple[int, int] = (0, 0), n2: tuple[int, int] = (0, 0), shift: tuple[float, float] = (0.0, 0.0), r: tuple[float, float] = (0.0, float("inf")), pad: float = 0.0, shape: tuple[int, int] | None = None) -> DataFrame:
    """Aperture positions (i, j, x, y): one, a row along g1, or a lattice.

    Those outside r[0] <= r <= r[1], or within ``pad`` of the detector's edge, are left out.
    """
    i = spark.range(n1[0], n1[1] + 1).select(F.col("id").alias("i")) if mode != "single" else spark.range(1).select(F.lit(0).cast("long").alias("i"))
    j = spark.range(n2[0], n2[1] + 1).select(F.col("id").alias("j")) if mode == "array" else spark.range(1).select(F.lit(0).cast("long").alias("j"))
    s1, s2 = (0.0, 0.0) if mode == "2-beam" else shift
    a, b = F.col("i") + s1, F.col("j") + s2
    x, y = a * g1[0] + b * g2[0], a * g1[1] + b * g2[1]
    out = i.crossJoin(j).select("i", "j", (x + center[0]).alias("x"), (y + center[1]).alias("y"), F.sqrt(x * x + y * y).alias("r"))
    if mode != "single":
        out = out.where((F.col("r") >= r[0]) & (F.col("r") <= r[1]))
        if shape is not None:
            out = out.where((F.col("x") > pad) & (F.col("x") < shape[0] - pad) & (F.col("y") > pad) & (F.col("y") < shape[1] - pad))
    return out.drop("r")


def subtract(keep: DataFrame, drop: DataFrame, tolerance: float) -> DataFrame:
    """Apertures farther than the tolerance from every one of another set (both small lattices)."""
    d = drop.select(F.col("x").alias("dx"), F.col("y").alias("dy"))
    near = (F.col("x") - F.col("dx")) ** 2 + (F.col("y") - F.col("dy")) ** 2 <= tolerance**2
    return keep.join(F.broadcast(d), near, "left_anti")


def image(points: DataFrame, spots: DataFrame, tolerance: float) -> DataFrame:
    """Summed intensity of peaks within the tolerance of an aperture; a peak counts for each aperture.

    Peaks and apertures meet in cells of the tolerance: an equi-join on the nine
    cells around an aperture, not a nested loop.
    """
    cell = lambda v: F.floor(v / tolerance)
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    s = spots.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(around).alias("o"))
    s = s.select("ax", "ay", (cell(F.col("ax")) + F.col("o.a")).alias("cx"), (cell(F.col("ay")) + F.col("o.b")).alias("cy"))
    p = points.withColumn("cx", cell(F.col("qx"))).withColumn("cy", cell(F.col("qy")))
    hit = p.join(F.broadcast(s), ["cx", "cy"]).where((F.col("qx") - F.col("ax")) ** 2 + (F.col("qy") - F.col("ay")) ** 2 <= tolerance**2)
    return hit.groupBy("rx", "ry").agg(F.sum("intensity").alias("value"))


def radial_image(points: DataFrame, radius: float, tolerance: float) -> DataFrame:
    return points.where(F.abs(F.col("r") - radius) <= tolerance).groupBy("rx", "ry").agg(F.sum("intensity").alias("value"))
