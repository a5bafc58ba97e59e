"""Probe-forming optics as Column expressions, and masks of a probe or a beam stop on a detector grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.operators.cube import grid

#: Aberration coefficients by (order n, symmetry m): magnitude in Angstrom and angle in radians.
Aberrations = dict[tuple[int, int], tuple[float, float]]


def phase_error(alpha: Column, phi: Column, coefficients: Aberrations, wavelength: float) -> Column:
    """chi(alpha, phi) = 2 pi / lambda sum C_nm alpha^(n+1) / (n+1) cos(m (phi - phi_nm)), alpha in radians."""
    terms = [F.pow(alpha, F.lit(n + 1)) * (size / (n + 1)) * F.cos(m * (phi - angle)) for (n, m), (size, angle) in coefficients.items()]
    return sum(terms, F.lit(0.0)) * (2 * math.pi / wavelength)


def soft_aperture(alpha: Column, semiangle: float, rolloff: float = 0.0) -> Column:
    """1 inside the semi-angle, 0 outside; a cosine falls from 1 to 0 over the last ``rolloff`` radians inside."""
    if not rolloff:
        return F.when(alpha < semiangle, 1.0).otherwise(0.0)
    edge = (1 + F.cos(math.pi * (alpha - semiangle + rolloff) / rolloff)) / 2
    return F.when(alpha > semiangle, 0.0).when(alpha > semiangle - rolloff, edge).otherwise(1.0)


def temporal_envelope(alpha: Column, focal_spread: float, wavelength: float) -> Column:
    damp = alpha * alpha * (math.pi / 2 / wavelength * focal_spread)
    return F.exp(-damp * damp)


def gaussian_envelope(alpha: Column, spread: float, wavelength: float) -> Column:
    return F.exp(-(alpha * alpha) * (spread * spread / (2 * wavelength * wavelength)))


def spatial_envelope(alpha: Column, phi: Column, coefficients: Aberrations, angular_spread: float, wavelength: float) -> Column:
    """exp(-sign(s) (s / 2)^2 |grad chi|^2) of the gradient of chi by angle and, divided by alpha, by azimuth."""
    k = 2 * math.pi / wavelength
    along = sum([F.pow(alpha, F.lit(n)) * size * F.cos(m * (phi - angle)) for (n, m), (size, angle) in coefficients.items()], F.lit(0.0)) * k
    across = sum([F.pow(alpha, F.lit(n)) * (-m * size / (n + 1)) * F.sin(m * (phi - angle)) for (n, m), (size, angle) in coefficients.items()], F.lit(0.0)) * k
    return F.exp((along * along + across * across) * (-math.copysign(1.0, angular_spread) * (angular_spread / 2) ** 2))


def contrast_transfer(alpha: Column, phi: Column, coefficients: Aberrations, wavelength: float) -> Column:
    return F.sin(phase_error(alpha, phi, coefficients, wavelength))


def zero_vacuum(probe: DataFrame, origin: tuple[float, float], semiangle: float, reach: float, value: str = "value") -> DataFrame:
    """A probe with 0 wherever a pixel is not nearer to the origin than ``reach`` times the semi-angle in pixels."""
    near = F.hypot(F.col("qx") - origin[0], F.col("qy") - origin[1]) < semiangle * reach
    return probe.withColumn(value, F.when(near, F.col(value)).otherwise(0.0))


def beam_stop(spark, nx: int, ny: int, origin: tuple[float, float], angle: float, half_span: float = 1.0, grow: int = 10, radius: float = 10.0) -> DataFrame:
    """qx, qy, mask of a wedge about the direction ``angle`` (degrees), grown by steps to edge neighbours, and a disk.

    Growing by n steps reaches the pixels at most n away by sum of both
    coordinates, so the wedge's rows are sent there: as many as the detector has
    pixels, times 2 n^2.
    """
    x, y = F.col("qx") - origin[0], F.col("qy") - origin[1]
    apart = F.pmod(F.atan2(y, x) - math.radians(angle) + math.pi, F.lit(2 * math.pi)) - math.pi
    whole = grid(spark, nx, ny)
    reach = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-grow, grow + 1) for b in range(abs(a) - grow, grow - abs(a) + 1)])
    wedge = whole.where(F.abs(apart) < math.radians(abs(half_span))).select("qx", "qy", F.explode(reach).alias("o"))
    grown = wedge.select((F.col("qx") + F.col("o.a")).alias("qx"), (F.col("qy") + F.col("o.b")).alias("qy")).distinct().withColumn("__arm", F.lit(True))
    return whole.join(grown, ["qx", "qy"], "left").select("qx", "qy", (F.col("__arm").isNotNull() | (F.hypot(x, y) < radius)).alias("mask"))
