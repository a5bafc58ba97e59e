"""Data model: frames, pixels and peaks as DataFrames, and calibration as an immutable value.

``frames(rx, ry, data array<double>, ...)`` holds one diffraction pattern a row, in
row-major order of the detector; reductions over the detector stay inside a row
and need no shuffle.  ``pixels(rx, ry, qx, qy, i, ...)`` is its long form, for
reductions over the scan.  ``peaks(rx, ry, qx, qy, intensity, ...)`` holds
detected peaks, raw; calibrated peaks are a view of Column expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CubeMeta:
    """Shape of the detector and, where known, of the scan."""

    q_nx: int = 8
    q_ny: int = 8
    r_nx: int | None = None
    r_ny: int | None = None

    @property
    def q_n(self) -> int:
        return self.q_nx * self.q_ny


@dataclass(frozen=True)
class Calibration:
    """Scalar calibrations; setters give a new value, so views never go stale.

    The origin may also be a column of a per-position table joined to the peaks.
    """

    q_pixel_size: float = 1.0
    q_pixel_units: str = "pixels"
    r_pixel_size: float = 1.0
    r_pixel_units: str = "pixels"
    qx0: float | None = None
    qy0: float | None = None
    a: float | None = None
    b: float | None = None
    theta: float | None = None
    qr_rotation: float | None = None
    qr_flip: bool = False
    probe_semiangle: float | None = None
    extra: dict = field(default_factory=dict, hash=False)

    def with_(self, **changes) -> Calibration:
        return replace(self, **changes)

    def active(self, center: bool | None = None, ellipse: bool | None = None, pixel: bool | None = None, rotate: bool | None = None) -> dict[str, bool]:
        """Which steps a calibrated view applies; None asks for whatever is available."""
        have = {"center": self.qx0 is not None and self.qy0 is not None, "ellipse": None not in (self.a, self.b, self.theta), "pixel": self.q_pixel_size != 1, "rotate": self.qr_rotation is not None}
        asked = {"center": center, "ellipse": ellipse, "pixel": pixel, "rotate": rotate}
        for name, want in asked.items():
            if want and not have[name] and name != "pixel":
                raise ValueError(f"no calibration for {name}")
        return {k: have[k] if asked[k] is None else asked[k] for k in have}

    def ellipse_matrix(self) -> tuple[float, float, float]:
        """(xx, xy, yy) of the symmetric map that makes the ellipse a circle of radius a."""
        e, phi = self.b / self.a, self.theta - math.pi / 2
        s, c = math.sin(phi), math.cos(phi)
        return e * s * s + c * c, s * c * (1 - e), s * s + e * c * c


SCAN_NY = 25
PEAK_QSHAPE = (64, 64)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as an 8 x 8 cube: data is the magnitude, raw keeps the sign."""
    e = read(spark, sf_dir, "embeddings")
    raw = F.transform("embedding", lambda v: v.cast("double"))
    return e.select(F.expr(f"vec_id div {SCAN_NY}").alias("rx"), (F.col("vec_id") % SCAN_NY).alias("ry"), F.transform(raw, F.abs).alias("data"), raw.alias("raw"), F.col("label").cast("long").alias("label"))


def pixels(cube: DataFrame, meta: CubeMeta = CubeMeta(), keep: tuple[str, ...] = (), data: str = "data") -> DataFrame:
    """Long form of frames."""
    long = cube.select("rx", "ry", *keep, F.posexplode(data).alias("k", "i"))
    return long.select("rx", "ry", *keep, F.expr(f"k div {meta.q_ny}").cast("long").alias("qx"), (F.col("k") % meta.q_ny).cast("long").alias("qy"), "i")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as peaks on a 64 x 64 detector."""
    t = read(spark, sf_dir, "lineitem")
    d = lambda c: F.col(c).cast("double")
    return t.select(
        (F.col("l_suppkey") % 10).cast("long").alias("rx"),
        F.expr("l_suppkey div 10").cast("long").alias("ry"),
        (d("l_quantity") + 10 * d("l_discount")).alias("qx"),
        ((F.col("l_partkey") % 50).cast("double") + 5 * d("l_tax")).alias("qy"),
        (d("l_extendedprice") / 1000).alias("intensity"),
    )


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as sparse peaks with five classes."""
    t = read(spark, sf_dir, "events")
    return t.select(
        (F.col("user_id") % 10).cast("long").alias("rx"),
        F.expr("user_id div 10").cast("long").alias("ry"),
        (F.col("event_id") % 64).cast("double").alias("qx"),
        F.expr("(event_id div 64) % 64").cast("double").alias("qy"),
        F.col("value").cast("double").alias("intensity"),
        F.col("event_type").alias("kind"),
    )


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; never minus zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


#: The same views for DuckDB.
PIXELS_SQL = """p as (
  select vec_id // 25 as rx, vec_id % 25 as ry, k // 8 as qx, k % 8 as qy, abs(v::double) as i, v::double as v, label::bigint as label
  from (select vec_id, label, unnest(embedding) as v, unnest(range(64)) as k from embeddings))"""
PEAKS_SQL = """b as (
  select (l_suppkey % 10)::bigint as rx, (l_suppkey // 10)::bigint as ry, l_quantity::double + 10 * l_discount::double as qx,
         (l_partkey % 50)::double + 5 * l_tax::double as qy, l_extendedprice::double / 1000 as intensity from lineitem)"""
COUNTED_SQL = """c as (
  select (user_id % 10)::bigint as rx, (user_id // 10)::bigint as ry, (event_id % 64)::double as qx, ((event_id // 64) % 64)::double as qy,
         value::double as intensity, event_type as kind from events)"""
