"""Numeric kernels on single images, in numpy."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

# ----- filters and resampling


def gaussian_filter(a: np.ndarray, sigma: float, mode: str = "reflect", truncate: float = 4.0, axes: tuple[int, ...] | None = None) -> np.ndarray:
    """Separable Gaussian along all axes or those given; modes reflect (edge repeated), nearest and wrap."""
    if sigma <= 0:
        return a.astype(float)
    r = int(truncate * sigma + 0.5)
    x = np.arange(-r, r + 1)
    w = np.exp(-0.5 * (x / sigma) ** 2)
    w /= w.sum()
    out = a.astype(float)
    for axis in range(a.ndim) if axes is None else axes:
        pad = [(0, 0)] * a.ndim
        pad[axis] = (r, r)
        wide = np.pad(out, pad, mode={"reflect": "symmetric", "nearest": "edge", "wrap": "wrap"}[mode])
        out = sum(wk * np.take(wide, np.arange(k, k + a.shape[axis]), axis=axis) for k, wk in enumerate(w))
    return out


def butterworth(a: np.ndarray, low: float | None = None, high: float | None = None, order: int = 2) -> np.ndarray:
    """Mean-preserving Fourier envelope; cut-offs in cycles per pixel."""
    k = np.sqrt(np.fft.fftfreq(a.shape[0])[:, None] ** 2 + np.fft.fftfreq(a.shape[1])[None] ** 2)
    env = np.ones_like(k)
    if high is not None:
        env *= 1 - 1 / (1 + (k / high) ** (2 * order))
    if low is not None:
        env *= 1 / (1 + (k / low) ** (2 * order))
    mean = a.mean()
    return np.fft.ifft2(np.fft.fft2(a - mean) * env).real + mean


def fourier_shift(a: np.ndarray, dx: float, dy: float) -> np.ndarray:
    """Periodic shift by a phase ramp."""
    ramp = np.exp(-2j * np.pi * (np.fft.fftfreq(a.shape[0])[:, None] * dx + np.fft.fftfreq(a.shape[1])[None] * dy))
    out = np.fft.ifft2(np.fft.fft2(a) * ramp)
    return out if np.iscomplexobj(a) else out.real


def fourier_resample(a: np.ndarray, shape: tuple[int, int], conserve: bool = False) -> np.ndarray:
    """Crop or pad in Fourier space; keeps the mean, or the sum."""
    f = np.fft.fftshift(np.fft.fft2(a))
    for axis, n in enumerate(shape):
        m = f.shape[axis]
        if n < m:
            start = m // 2 - n // 2
            f = np.take(f, np.arange(start, start + n), axis=axis)
        elif n > m:
            pad = [(0, 0)] * 2
            pad[axis] = (n // 2 - m // 2, n - m - (n // 2 - m // 2))
            f = np.pad(f, pad)
    out = np.fft.ifft2(np.fft.ifftshift(f)).real
    return out if conserve else out * (np.prod(shape) / a.size)


def zoom_bilinear(a: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Bilinear resampling on pixel areas, edges held."""
    out = a.astype(float)
    for axis, n in enumerate(shape):
        m = out.shape[axis]
        x = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        lo = np.minimum(np.floor(x).astype(int), max(m - 2, 0))
        f = x - lo
        f = f[:, None] if axis == 0 else f[None]
        out = np.take(out, lo, axis=axis) * (1 - f) + np.take(out, np.minimum(lo + 1, m - 1), axis=axis) * f
    return out


def savgol(y: np.ndarray, width: int, order: int) -> np.ndarray:
    """Savitzky-Golay smoothing; the ends take the polynomial of the end windows."""
    half = width // 2
    x = np.arange(-half, half + 1)
    hat = np.vander(x, order + 1) @ np.linalg.pinv(np.vander(x, order + 1))
    out = np.convolve(y, hat[half][::-1], mode="same")
    out[:half], out[-half:] = hat[:half] @ y[:width], hat[-half:] @ y[-width:]
    return out


def ewpc(a: np.ndarray) -> np.ndarray:
    """Exit-wave power cepstrum of a pattern: |F(hann * log)|^2."""
    w = np.hanning(a.shape[0])[:, None] * np.hanning(a.shape[1])[None]
    return np.abs(np.fft.fftshift(np.fft.fft2(w * np.log(np.maximum(a, 0.01))))) ** 2


def dct2(a: np.ndarray) -> np.ndarray:
    """Unnormalised cosine transform of type 2 along both axes."""
    for axis in (0, 1):
        n = a.shape[axis]
        k = np.arange(n)
        a = np.moveaxis(np.tensordot(2 * np.cos(np.pi * k[:, None] * (2 * k[None] + 1) / (2 * n)), a, (1, axis)), 0, axis)
    return a


def idct2(a: np.ndarray) -> np.ndarray:
    for axis in (0, 1):
        n = a.shape[axis]
        k = np.arange(n)
        m = np.cos(np.pi * k[None] * (2 * k[:, None] + 1) / (2 * n)) / n
        m[:, 0] /= 2
        a = np.moveaxis(np.tensordot(m, a, (1, axis)), 0, axis)
    return a


def unwrap(phase: np.ndarray) -> np.ndarray:
    """Least-squares unwrapping: wrapped differences, divergence, Poisson equation by cosine transforms."""
    wrap = lambda d: np.angle(np.exp(1j * d))
    dx, dy = np.zeros_like(phase), np.zeros_like(phase)
    dx[:-1], dy[:, :-1] = wrap(np.diff(phase, axis=0)), wrap(np.diff(phase, axis=1))
    rho = dx.copy() + dy
    rho[1:] -= dx[:-1]
    rho[:, 1:] -= dy[:, :-1]
    n, m = phase.shape
    e = 2 * (np.cos(np.pi * np.arange(n) / n)[:, None] + np.cos(np.pi * np.arange(m) / m)[None] - 2)
    e[0, 0] = 1
    f = dct2(rho) / e
    f[0, 0] = 0
    return idct2(f)


# ----- correlation


def correlation(a: np.ndarray, template_ft: np.ndarray, power: float = 1.0) -> np.ndarray:
    """Cross (power 1), phase (0) or hybrid correlation with a transformed template."""
    m = np.fft.fft2(a) * np.conj(template_ft)
    if power != 1:
        m = np.abs(m) ** power * np.exp(1j * np.angle(m))
    return np.fft.ifft2(m).real


def upsampled_dft(m: np.ndarray, factor: int, center: tuple[float, float], size: int) -> np.ndarray:
    """Inverse transform of m on a fine grid of size x size points around a position, by matrix products."""
    fx, fy = np.fft.fftfreq(m.shape[0]), np.fft.fftfreq(m.shape[1])
    o = (np.arange(size) - size // 2) / factor
    return (np.exp(2j * np.pi * np.outer(center[0] + o, fx)) @ m @ np.exp(2j * np.pi * np.outer(fy, center[1] + o))).real / m.size


def _parabola(lo: float, mid: float, hi: float) -> float:
    d = lo - 2 * mid + hi
    return 0.0 if d == 0 else 0.5 * (lo - hi) / d


def refine_peak(m: np.ndarray, factor: int, start: tuple[float, float]) -> tuple[float, float]:
    """Subpixel position of a correlation maximum (m: its transform), upsampled by ``factor``."""
    x, y = (round(v * 2) / 2 for v in start)
    if factor > 2:
        size = 2 * math.ceil(0.75 * factor) + 1
        fine = upsampled_dft(m, factor, (x, y), size)
        i, j = np.unravel_index(fine.argmax(), fine.shape)
        dx = _parabola(*fine[i - 1 : i + 2, j]) if 0 < i < size - 1 else 0.0
        dy = _parabola(*fine[i, j - 1 : j + 2]) if 0 < j < size - 1 else 0.0
        x, y = x + (i - size // 2 + dx) / factor, y + (j - size // 2 + dy) / factor
    return x, y


def align(ref: np.ndarray, a: np.ndarray, factor: int = 4) -> tuple[float, float]:
    """Shift to apply to ``a`` to match ``ref``, within half the image."""
    m = np.fft.fft2(ref) * np.conj(np.fft.fft2(a))
    c = np.fft.ifft2(m).real
    i, j = np.unravel_index(c.argmax(), c.shape)
    n, k = c.shape
    x = i + _parabola(c[i - 1, j], c[i, j], c[(i + 1) % n, j])
    y = j + _parabola(c[i, j - 1], c[i, j], c[i, (j + 1) % k])
    x, y = refine_peak(m, factor, (x, y))
    return (x + n / 2) % n - n / 2, (y + k / 2) % k - k / 2


def local_maxima(a: np.ndarray, edge: int = 1) -> np.ndarray:
    """Where a pattern, or each of a stack, is at least its four later neighbours and above its four earlier ones, off its border."""
    edge = max(edge, 1)
    n, m = a.shape[-2:]
    if n <= 2 * edge or m <= 2 * edge:
        return np.zeros(a.shape, bool)
    at = lambda dx, dy: a[..., edge - dx : n - edge - dx, edge - dy : m - edge - dy]  # noqa: E731  the neighbour at (x - dx, y - dy)
    mid = at(0, 0)
    top = np.zeros(a.shape, bool)
    top[..., edge : n - edge, edge : m - edge] = (mid >= at(-1, 0)) & (mid >= at(0, -1)) & (mid >= at(-1, -1)) & (mid >= at(1, -1)) & (mid > at(1, 0)) & (mid > at(0, 1)) & (mid > at(-1, 1)) & (mid > at(1, 1))
    return top


def maxima_2d(a: np.ndarray, subpixel: str = "pixel", factor: int = 16, sigma: float = 0, least: float = 0, least_relative: float = 0, relative_to: int = 0, spacing: float = 0, edge: int = 1, most: int = 0, transform: np.ndarray | None = None, top: np.ndarray | None = None) -> np.ndarray:
    """Rows (x, y, intensity) of the local maxima, brightest first.

    subpixel: 'pixel', 'poly' (parabola) or 'multicorr' (``transform``, the correlation's Fourier transform, upsampled).
    ``top`` is the local maxima where they are known, as for a pattern of a stack.
    """
    a = gaussian_filter(a, sigma) if sigma else a
    x, y = np.nonzero(local_maxima(a, edge) if top is None else top)
    v = a[x, y]
    order = np.lexsort((-y, -x, -v))
    x, y, v = x[order], y[order], v[order]
    keep = v >= least
    x, y, v = x[keep], y[keep], v[keep]
    if least_relative and len(v):
        keep = v >= least_relative * v[min(relative_to, len(v) - 1)]
        x, y, v = x[keep], y[keep], v[keep]
    if spacing and len(v):
        from lattiq.operators.peaks import thin

        keep = thin(x.astype(float), y.astype(float), spacing)
        x, y, v = x[keep], y[keep], v[keep]
    if most:
        x, y, v = x[:most], y[:most], v[:most]
    fx, fy = x.astype(float), y.astype(float)
    if subpixel != "pixel" and len(x):
        for out, lo, hi in ((fx, a[x - 1, y], a[x + 1, y]), (fy, a[x, y - 1], a[x, y + 1])):
            bend = lo - 2 * v + hi
            out += np.where(bend == 0, 0.0, 0.5 * (lo - hi) / np.where(bend == 0, 1.0, bend))
        if subpixel == "multicorr":
            for k in range(len(x)):
                fx[k], fy[k] = refine_peak(transform, factor, (fx[k], fy[k]))
    return np.column_stack([fx, fy, v])


# ----- morphology


def dilate(mask: np.ndarray, steps: int = 1) -> np.ndarray:
    for _ in range(steps):
        wide = np.pad(mask, 1)
        mask = wide[1:-1, 1:-1] | wide[:-2, 1:-1] | wide[2:, 1:-1] | wide[1:-1, :-2] | wide[1:-1, 2:]
    return mask


def erode(mask: np.ndarray, steps: int = 1) -> np.ndarray:
    return ~dilate(~np.pad(mask, steps), steps)[steps:-steps, steps:-steps] if steps else mask


def opened(mask: np.ndarray, steps: int = 1) -> np.ndarray:
    return dilate(erode(mask, steps), steps)


def closed(mask: np.ndarray, steps: int = 1) -> np.ndarray:
    return erode(dilate(mask, steps), steps)


def distance(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of set pixels to the nearest unset one: lower envelopes along both axes."""
    f = np.where(mask, 1e12, 0.0)
    for axis in (0, 1):
        n = f.shape[axis]
        d2 = (np.arange(n)[:, None] - np.arange(n)[None]) ** 2
        g = np.moveaxis(f, axis, -1)
        f = np.moveaxis((g[..., None, :] + d2).min(axis=-1), -1, axis)
    return np.sqrt(f)


def label(mask: np.ndarray) -> np.ndarray:
    """Connected regions (4 neighbours) numbered from 1 in reading order."""
    out, n = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0), 0
    while True:
        wide = np.pad(out, 1)
        top = np.maximum.reduce([wide[1:-1, 1:-1], wide[:-2, 1:-1], wide[2:, 1:-1], wide[1:-1, :-2], wide[1:-1, 2:]])
        new = np.where(mask, top, 0)
        if np.array_equal(new, out):
            break
        out = new
    names, first = np.unique(out, return_index=True)
    order = [m for _, m in sorted(zip(first, names)) if m]
    for n, m in enumerate(order, 1):
        out = np.where(out == m, -n, out)
    return -out


def fill_holes(mask: np.ndarray) -> np.ndarray:
    outside = np.pad(~mask, 1, constant_values=True)
    seen = np.zeros_like(outside)
    seen[0, 0] = True
    while True:
        grown = dilate(seen) & outside
        if np.array_equal(grown, seen):
            return ~seen[1:-1, 1:-1]
        seen = grown


def edge_window(mask: np.ndarray, width: float) -> np.ndarray:
    """sin^2 ramp from a mask's edge inwards."""
    return np.sin(np.clip(distance(mask) / width, 0, 1) * np.pi / 2) ** 2


def otsu(v: np.ndarray, bins: int = 256) -> float:
    """Threshold of greatest between-class variance."""
    h, e = np.histogram(v, bins)
    c = (e[:-1] + e[1:]) / 2
    w0, m0 = np.cumsum(h), np.cumsum(h * c)
    w1 = w0[-1] - w0
    with np.errstate(divide="ignore", invalid="ignore"):
        var = w0 * w1 * (m0 / w0 - (m0[-1] - m0) / w1) ** 2
    return float(c[np.nanargmax(var[:-1])])


# ----- fits


def least_squares(f: Callable[[np.ndarray], np.ndarray], x0, lower=None, upper=None, steps: int = 100, tol: float = 1e-10) -> tuple[np.ndarray, float, int, int]:
    """Levenberg-Marquardt within bounds: (x, cost, evaluations, status).

    Steps are projected on the bounds and variables held at a bound are frozen.
    Status 1: converged, 0: out of steps, -2: not finite.
    """
    x = np.asarray(x0, float).copy()
    lo = np.full(len(x), -np.inf) if lower is None else np.asarray(lower, float)
    hi = np.full(len(x), np.inf) if upper is None else np.asarray(upper, float)
    x = np.clip(x, lo, hi)
    r = f(x)
    if not np.isfinite(r).all():
        return x, np.inf, 1, -2
    cost, damping, count = 0.5 * float(r @ r), 1e-3, 1
    for _ in range(steps):
        h = 1e-7 * np.maximum(1, np.abs(x))
        h = np.where(x + h > hi, -h, h)
        jac = np.stack([(f(x + np.eye(len(x))[k] * h[k]) - r) / h[k] for k in range(len(x))], axis=1)
        count += len(x)
        g = jac.T @ r
        free = ~(((x <= lo) & (g > 0)) | ((x >= hi) & (g < 0)))
        if not free.any() or np.abs(g[free]).max() < tol:
            return x, cost, count, 1
        a = jac[:, free].T @ jac[:, free]
        while True:
            try:
                d = -np.linalg.solve(a + damping * np.diag(np.maximum(np.diag(a), 1e-12)), g[free])
            except np.linalg.LinAlgError:
                d = -g[free] / max(np.abs(g[free]).max(), 1)
            trial = x.copy()
            trial[free] = np.clip(x[free] + d, lo[free], hi[free])
            rt = f(trial)
            count += 1
            ct = 0.5 * float(rt @ rt) if np.isfinite(rt).all() else np.inf
            if ct < cost:
                small = cost - ct < tol * cost and np.abs(trial - x).max() < 1e-8 * max(1, np.abs(x).max())
                x, r, cost, damping = trial, rt, ct, max(damping / 3, 1e-12)
                if small:
                    return x, cost, count, 1
                break
            damping *= 4
            if damping > 1e12:
                return x, cost, count, 1
    return x, cost, count, 0


def nnls(a: np.ndarray, b: np.ndarray, tol: float = 1e-10) -> tuple[np.ndarray, float]:
    """Least squares with non-negative unknowns, by active sets; and the residual's norm."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    w = a.T @ b
    for _ in range(10 * n + 10):
        if passive.all() or w[~passive].max(initial=-np.inf) <= tol:
            break
        passive[np.argmax(np.where(passive, -np.inf, w))] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            bad = passive & (s <= tol)
            if not bad.any():
                break
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            passive &= x > tol
            x[~passive] = 0
            if not passive.any():
                break
        x = s if passive.any() else x
        w = a.T @ (b - a @ x)
    return x, float(np.linalg.norm(a @ x - b))
