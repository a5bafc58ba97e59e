"""Column functions: calibration transforms, ellipses, complex numbers, electron optics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# SI constants (exact or CODATA).
PLANCK, MASS, CHARGE, LIGHT = 6.62607015e-34, 9.1093837015e-31, 1.602176634e-19, 299792458.0


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def rotate(x: Column, y: Column, angle: float, flip: bool = False) -> tuple[Column, Column]:
    """Counter-clockwise rotation; a flip swaps the axes first."""
    if flip:
        x, y = y, x
    c, s = math.cos(angle), math.sin(angle)
    return c * x - s * y, s * x + c * y


def ellipse_to_axes(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """Semi-axes and angle (a, b, theta) of A x^2 + B x y + C y^2 = 1, a along theta.

    The larger eigenvalue of the form belongs to the smaller semi-axis.
    """
    half, root = (a + c) / 2, F.sqrt((a - c) * (a - c) / 4 + b * b / 4)
    return 1 / F.sqrt(half - root), 1 / F.sqrt(half + root), F.atan2(-b, c - a) / 2


def axes_to_ellipse(a: Column, b: Column, theta: Column) -> tuple[Column, Column, Column]:
    s, c = F.sin(theta), F.cos(theta)
    return c * c / (a * a) + s * s / (b * b), 2 * s * c * (1 / (a * a) - 1 / (b * b)), s * s / (a * a) + c * c / (b * b)


def complex_of(re, im=0.0) -> Column:
    return F.struct(col(re).cast("double").alias("re"), col(im).cast("double").alias("im"))


def complex_multiply(a: Column, b: Column) -> Column:
    return complex_of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def complex_abs2(a: Column) -> Column:
    return a["re"] * a["re"] + a["im"] * a["im"]


def complex_exp(phase) -> Column:
    return complex_of(F.cos(col(phase)), F.sin(col(phase)))


def wavelength(volts: Column | float) -> Column:
    """Relativistic electron wavelength in Angstrom."""
    v = col(volts).cast("double")
    return F.lit(PLANCK * 1e10) / F.sqrt(2 * MASS * CHARGE * v * (1 + CHARGE * v / (2 * MASS * LIGHT * LIGHT)))


def interaction(volts: Column | float) -> Column:
    """Electron interaction parameter in radians per volt-Angstrom."""
    v = col(volts).cast("double")
    mc2 = MASS * LIGHT * LIGHT
    return 2 * math.pi / (wavelength(v) * v) * (mc2 + CHARGE * v) / (2 * mc2 + CHARGE * v)


def corners(x: Column, y: Column, value: Column) -> Column:
    """The four whole neighbours of a point with bilinear shares of a value: array of (qx, qy, w)."""
    fx, fy = F.floor(x), F.floor(y)
    dx, dy = x - fx, y - fy
    return F.array(*[F.struct((fx + a).cast("long").alias("qx"), (fy + b).cast("long").alias("qy"), (value * wx * wy).alias("w")) for a, wx in ((0, 1 - dx), (1, dx)) for b, wy in ((0, 1 - dy), (1, dy))])
