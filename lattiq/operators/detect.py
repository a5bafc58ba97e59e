"""Per-pattern kernels as DataFrame operators: disk detection, origins, shifts, probes, whole-pattern fits.

Each operator is one ``mapInPandas`` over frames: a frame is independent of all
others, so nothing is shuffled, and templates travel as broadcasts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lattiq.functions import kernels as K
from lattiq.model import CubeMeta


#: Values of a stack of patterns that are transformed together: 16 MiB, whatever the pattern's size.
STACK_VALUES = 1 << 21


def per_stack(cube: DataFrame, f: Callable[[np.ndarray], list[np.ndarray]], schema: str, meta: CubeMeta = CubeMeta()) -> DataFrame:
    """Apply a function of a stack of patterns that gives an array of rows for each; rx and ry are put before them."""
    fields = [c.split() for c in schema.split(", ")]
    step = max(1, STACK_VALUES // meta.q_n)

    def run(batches):
        for pdf in batches:
            for k in range(0, len(pdf), step):
                part = pdf.iloc[k : k + step]
                found = f(np.stack(part.data.to_numpy()).astype(float).reshape(-1, meta.q_nx, meta.q_ny))
                rows = np.concatenate([np.reshape(r, (-1, len(fields))) for r in found])
                many = [len(r) if np.ndim(r) > 1 else 1 for r in found]
                out = {"rx": np.repeat(part.rx.to_numpy(), many), "ry": np.repeat(part.ry.to_numpy(), many)}
                yield pd.DataFrame({**out, **{name: rows[:, j].astype("int64" if kind == "long" else float) for j, (name, kind) in enumerate(fields)}})

    return cube.select("rx", "ry", "data").mapInPandas(run, f"rx long, ry long, {schema}")


def per_frame(cube: DataFrame, f: Callable[[np.ndarray], np.ndarray], schema: str, meta: CubeMeta = CubeMeta()) -> DataFrame:
    """Apply a function of one pattern that gives a row, or an array of rows."""
    return per_stack(cube, lambda stack: [f(a) for a in stack], schema, meta)


def find_disks(cube: DataFrame, template: np.ndarray | None, meta: CubeMeta = CubeMeta(), power: float = 1.0, sigma_dp: float = 0.0, filter_function: Callable[[np.ndarray], np.ndarray] | None = None, **maxima) -> DataFrame:
    """Peaks (qx, qy, intensity) of each pattern's correlation with a template (or of the pattern itself).

    ``filter_function`` is applied to each pattern first; ``maxima`` goes to the
    search for maxima (subpixel, least, least_relative, spacing, edge, most, ...).
    Patterns are filtered, transformed and searched a stack at a time.
    """
    shared = cube.sparkSession.sparkContext.broadcast(None if template is None else np.fft.fft2(template))

    def find(a: np.ndarray) -> list[np.ndarray]:
        a = np.stack([filter_function(x) for x in a]) if filter_function else a
        a = K.gaussian_filter(a, sigma_dp, axes=(1, 2)) if sigma_dp else a
        m = None
        if shared.value is not None:
            m = np.fft.fft2(a) * np.conj(shared.value)
            m = m if power == 1 else np.abs(m) ** power * np.exp(1j * np.angle(m))
            a = np.maximum(np.fft.ifft2(m).real, 0)
        elif maxima.get("subpixel") == "multicorr":
            m = np.fft.fft2(a)
        options = dict(maxima)
        a = K.gaussian_filter(a, options.pop("sigma", 0), axes=(1, 2))
        tops = K.local_maxima(a, options.get("edge", 1))
        return [K.maxima_2d(x, transform=None if m is None else m[k], top=tops[k], **options) for k, x in enumerate(a)]

    return per_stack(cube, find, "qx double, qy double, intensity double", meta)


def origins(cube: DataFrame, radius: float, scale: float = 1.2, meta: CubeMeta = CubeMeta()) -> DataFrame:
    """Brightest blurred pixel, then the centre of mass within scale * radius of it; a stack of patterns at a time."""

    def find(a: np.ndarray) -> np.ndarray:
        blurred = K.gaussian_filter(a, radius, "nearest", axes=(1, 2)).reshape(len(a), -1)
        i, j = (v[:, None, None] for v in np.unravel_index(blurred.argmax(axis=1), a.shape[1:]))
        x, y = np.indices(a.shape[1:])
        w = a * ((x - i) ** 2 + (y - j) ** 2 < (radius * scale) ** 2)
        s = w.sum(axis=(1, 2))
        safe = np.where(s == 0, 1.0, s)
        return np.column_stack([np.where(s != 0, (w * q).sum(axis=(1, 2)) / safe, start.ravel()) for q, start in ((x, i), (y, j))])

    return per_stack(cube, find, "qx0 double, qy0 double", meta)


def origins_friedel(cube: DataFrame, meta: CubeMeta = CubeMeta(), factor: int = 4) -> DataFrame:
    """Half the position of the padded autoconvolution's maximum: the centre of inversion."""

    def find(a: np.ndarray) -> np.ndarray:
        n, k = a.shape
        f = np.fft.fft2(np.pad(a, ((0, n), (0, k))))
        m = f * f
        c = np.fft.ifft2(m).real
        x, y = K.refine_peak(m, factor, tuple(float(v) for v in np.unravel_index(c.argmax(), c.shape)))
        return np.array([x / 2 % n, y / 2 % k])

    return per_frame(cube, find, "qx0 double, qy0 double", meta)


def map_frames(cube: DataFrame, f: Callable[[np.ndarray], np.ndarray], meta: CubeMeta = CubeMeta()) -> DataFrame:
    """Frames with their data replaced by f of each pattern."""

    def run(batches):
        for pdf in batches:
            pdf["data"] = [f(np.asarray(d, float).reshape(meta.q_nx, meta.q_ny)).ravel() for d in pdf.data]
            yield pdf

    return cube.select("rx", "ry", "data").mapInPandas(run, "rx long, ry long, data array<double>")


def resample(cube: DataFrame, shape: tuple[int, int], how: str = "fourier", conserve: bool = False, meta: CubeMeta = CubeMeta()) -> DataFrame:
    if how == "fourier":
        return map_frames(cube, lambda a: K.fourier_resample(a, shape, conserve), meta)

    def bilinear(a: np.ndarray) -> np.ndarray:
        out = K.zoom_bilinear(a, shape)
        return out * (a.sum() / out.sum()) if conserve and out.sum() else out

    return map_frames(cube, bilinear, meta)


def shift_fourier(cube: DataFrame, dx: float, dy: float, meta: CubeMeta = CubeMeta()) -> DataFrame:
    return map_frames(cube, lambda a: K.fourier_shift(a, dx, dy), meta)


def vacuum_probe(mean: np.ndarray, threshold: float = 0.2, expansion: int = 4, opening: int = 1) -> np.ndarray:
    """Probe from an averaged vacuum pattern: what lies outside its opened, expanded disk fades out."""
    mask = K.dilate(K.opened(mean > threshold * mean.max(), opening), expansion)
    return mean * K.edge_window(mask, max(expansion, 1))


def probe_kernel(probe: np.ndarray, origin: tuple[float, float], how: str = "flat", radii: tuple[float, float] = (1.0, 2.0), sigma_scale: float = 2.0) -> np.ndarray:
    """Correlation kernel with its centre at the corner; all but 'flat' sum to zero."""
    k = K.fourier_shift(probe / probe.sum(), -origin[0], -origin[1])
    if how == "flat":
        return k
    n, m = probe.shape
    r = np.hypot(np.minimum(np.arange(n), n - np.arange(n))[:, None], np.minimum(np.arange(m), m - np.arange(m))[None])
    if how == "gaussian":
        rms = np.sqrt((k * r**2).sum() / k.sum())
        trench = np.exp(-(r**2) / (2 * (sigma_scale * rms) ** 2))
    elif how == "sigmoid":
        t = np.clip((r - radii[0]) / (radii[1] - radii[0]), 0, 1)
        trench = np.where((r > radii[0]) & (r < radii[1]), np.sin(np.pi * t) ** 2, 0.0)
    elif how == "sigmoid_log":
        mid = sum(radii) / 2
        w = (radii[1] - radii[0]) / 10 + 1e-9
        trench = 1 / (1 + np.exp(-(r - radii[0]) / w)) * (1 / (1 + np.exp((r - radii[1]) / w))) * (r > mid - 10 * (radii[1] - radii[0]))
    else:
        raise ValueError(how)
    return k - trench / trench.sum()


# ----- whole-pattern fitting


class Model:
    """A sum of parts over a detector; parts name their parameters, and equal names are shared."""

    def __init__(self, *parts: tuple[Callable, dict[str, tuple[float, float, float]]]):
        self.parts = parts
        self.start: dict[str, tuple[float, float, float]] = {}
        for _, params in parts:
            for name, spec in params.items():
                self.start.setdefault(name, spec)
        self.names = list(self.start)

    def __call__(self, values: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        v = dict(zip(self.names, values))
        return sum(f(x, y, *(v[n] for n in params)) for f, params in self.parts)


def constant(x, y, level):
    return np.full(x.shape, level)


def gaussian(x, y, x0, y0, sigma, height):
    return height * np.exp(-((x - x0) ** 2 + (y - y0) ** 2) / (2 * sigma**2))


def ring(x, y, x0, y0, radius, sigma, height):
    return height * np.exp(-((np.hypot(x - x0, y - y0) - radius) ** 2) / (2 * sigma**2))


def disk_lattice(reach: int, radius: float, width: float):
    """Logistic disks at x0 + h u + k v for |h|, |k| <= reach, of one height."""

    def part(x, y, x0, y0, ux, uy, vx, vy, height):
        out = np.zeros(x.shape)
        for h in range(-reach, reach + 1):
            for k in range(-reach, reach + 1):
                r = np.hypot(x - x0 - h * ux - k * vx, y - y0 - h * uy - k * vy)
                out += height / (1 + np.exp(np.clip(4 * (r - radius) / width, -60, 60)))
        return out

    return part


def fit_pattern(a: np.ndarray, model: Model, start: dict[str, float] | None = None, steps: int = 60) -> tuple[np.ndarray, float, int, int]:
    x, y = np.indices(a.shape, dtype=float)
    x0 = [(start or {}).get(n, model.start[n][0]) for n in model.names]
    lo, hi = ([model.start[n][k] for n in model.names] for k in (1, 2))
    return K.least_squares(lambda p: (model(p, x, y) - a).ravel(), x0, lo, hi, steps)


def fit_all(cube: DataFrame, model: Model, meta: CubeMeta = CubeMeta(), start: dict[str, float] | None = None, steps: int = 60) -> DataFrame:
    """Fitted parameters of each pattern with cost, evaluations and status."""

    def fit(a: np.ndarray) -> np.ndarray:
        p, cost, n, status = fit_pattern(a, model, start, steps)
        return np.array([*p, cost, n, status], float)

    return per_frame(cube, fit, ", ".join(f"{n} double" for n in model.names) + ", cost double, nfev long, status long", meta)
