"""Display numerics: intensity scalings and histograms of images in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def order_statistic(image: DataFrame, share: float, value: str = "value") -> DataFrame:
    """One row: the value at index round((n - 1) * share) of the sorted image, not interpolated.

    Found from the counts of distinct values, which are pre-aggregated, so the
    image itself is not sorted in one place.
    """
    counts = image.groupBy(value).agg(F.count("*").alias("__n"))
    at = counts.withColumn("__to", F.sum("__n").over(W.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)))
    n = image.agg(F.count("*").alias("__total"))
    hit = at.crossJoin(F.broadcast(n)).where(F.col("__to") > F.rint((F.col("__total") - 1) * share))
    return hit.agg(F.min(value).alias("v"))


def scaled(image: DataFrame, how: str = "ordered", low: float = 0.01, high: float = 0.99, power: float = 0.5, value: str = "value") -> DataFrame:
    """The image scaled to 0..1 between two limits (or by ``log``, ``power`` or ``full`` ranks first).

    Limits: 'ordered' order statistics, 'minmax', 'absolute' values, 'std' deviations
    about the median, 'centered' symmetric about the median.
    """
    v = F.col(value)
    kind, _, scale = how.partition(":")
    if scale == "log":
        image = image.withColumn(value, F.log(F.greatest(v, F.lit(1e-12))))
    elif scale == "power":
        image = image.withColumn(value, F.signum(v) * F.abs(v) ** power)
    elif scale == "full":  # rank / (n - 1), through the counts of distinct values
        n = image.count()
        keys = [c for c in image.columns if c != value]
        counts = image.groupBy(value).agg(F.count("*").alias("__n"))
        before = F.coalesce(F.sum("__n").over(W.orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        base = counts.withColumn("__before", before).drop("__n").withColumnRenamed(value, "__v")
        inner = F.row_number().over(W.partitionBy(value).orderBy(*keys)) - 1
        return image.withColumn("__k", inner).join(base, v == F.col("__v")).withColumn(value, (F.col("__before") + F.col("__k")) / max(n - 1, 1)).drop("__k", "__before", "__v")
    if kind == "ordered":
        lim = order_statistic(image, low, value).select(F.col("v").alias("__lo")).crossJoin(order_statistic(image, high, value).select(F.col("v").alias("__hi")))
    elif kind == "minmax":
        lim = image.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    elif kind == "std":
        lim = image.agg((F.median(value) + low * F.stddev_pop(value)).alias("__lo"), (F.median(value) + high * F.stddev_pop(value)).alias("__hi"))
    elif kind == "centered":
        lim = image.agg(F.median(value).alias("__m"), F.greatest(F.max(value) - F.median(value), F.median(value) - F.min(value)).alias("__d"))
        lim = lim.select((F.col("__m") - F.col("__d")).alias("__lo"), (F.col("__m") + F.col("__d")).alias("__hi"))
    elif kind == "absolute":
        lim = image.sparkSession.range(1).select(F.lit(float(low)).alias("__lo"), F.lit(float(high)).alias("__hi"))
    else:
        raise ValueError(how)
    out = F.when(F.col("__hi") > F.col("__lo"), F.least(F.greatest((v - F.col("__lo")) / (F.col("__hi") - F.col("__lo")), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return image.crossJoin(F.broadcast(lim)).withColumn(value, out).drop("__lo", "__hi")


def histogram(image: DataFrame, bins: int, value: str = "value") -> DataFrame:
    """Counts in equal bins from minimum to maximum; the last bin is closed."""
    lim = image.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    counts = image.crossJoin(F.broadcast(lim)).groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return image.sparkSession.range(bins).select(F.col("id").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def complex_to_hsv(re, im, top: float):
    """Hue from phase, value from amplitude up to ``top``: a struct (h, s, v)."""
    amp, phase = F.sqrt(re * re + im * im), F.atan2(im, re)
    turn = 6.283185307179586
    return F.struct((F.pmod(phase, F.lit(turn)) / turn).alias("h"), F.lit(1.0).alias("s"), F.least(amp / top, F.lit(1.0)).alias("v"))
