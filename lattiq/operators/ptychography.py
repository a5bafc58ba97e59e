"""Ptychography beyond the single slice: multislice, mixed state, projection sets, constraints.

Every iteration is one distributed pass: object and probe are broadcast, each
partition returns the sums of its updates.  Exit waves that projection sets keep
from one iteration to the next travel in the DataFrame of their position.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.functions import kernels as K
from lattiq.operators.phase import _overlap, block_sums, fresnel, sum_arrays

#: Weights (a, b, c) of the projection-set methods by their parameter.
METHODS = {
    "DM_AP": lambda p: (-p, p, 1 + p),
    "RAAR": lambda p: (1 - 2 * p, p, 2.0),
    "RRR": lambda p: (-p, p, 2.0),
    "SUPERFLIP": lambda p: (0.0, 1.0, 2.0),
}


def _norm(w: np.ndarray, alpha: float) -> np.ndarray:
    return np.sqrt(1e-16 + ((1 - alpha) * w) ** 2 + (alpha * w.max()) ** 2)


def multislice(patterns: DataFrame, slices: int, shape: tuple[int, int], probe: np.ndarray, propagator: np.ndarray, iterations: int = 10, step: float = 0.5, alpha: float = 0.5, fix_probe: bool = True) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Gradient descent through several slices with a propagator between them; object (slices, x, y)."""
    spark = patterns.sparkSession
    obj, probe, errors = np.ones((slices, *shape), complex), probe.astype(complex), []
    for _ in range(iterations):
        state = spark.sparkContext.broadcast((obj, probe))

        def run(batches, state=state):
            o, p = state.value
            up, w, up_p, w_p, err, total = np.zeros(o.shape, complex), np.zeros(o.shape), np.zeros(p.shape, complex), np.zeros(p.shape), 0.0, 0.0
            for pdf in batches:
                amp, at = np.stack(pdf.amplitude.to_numpy()).reshape(-1, *p.shape), pdf[["x", "y"]].to_numpy(float)
                waves, patches, wave = [], [], np.broadcast_to(p, amp.shape)
                for s in range(slices):
                    patch, ix, iy = _overlap(o[s], p, at)
                    waves.append(wave)
                    patches.append(patch)
                    wave = wave * patch
                    if s < slices - 1:
                        wave = np.fft.ifft2(np.fft.fft2(wave) * propagator)
                far = np.fft.fft2(wave)
                err += float(((np.abs(far) - amp) ** 2).sum())
                total += float((amp**2).sum())
                back = np.fft.ifft2(amp * np.exp(1j * np.angle(far)) - far)
                for s in reversed(range(slices)):
                    np.add.at(up[s], (ix[:, :, None], iy[:, None, :]), np.conj(waves[s]) * back)
                    np.add.at(w[s], (ix[:, :, None], iy[:, None, :]), np.abs(waves[s]) ** 2)
                    back = np.conj(patches[s]) * back
                    if s:
                        back = np.fft.ifft2(np.fft.fft2(back) * np.conj(propagator))
                up_p += back.sum(axis=0)
                w_p += (np.abs(patches[0]) ** 2).sum(axis=0)
            yield from block_sums(up, w, up_p, w_p, np.array([err, total]))

        up, w, up_p, w_p, (err, total) = sum_arrays(patterns, run, [obj, obj.real, probe, probe.real, np.zeros(2)])
        errors.append(float(err / max(total, 1e-12)))
        for s in range(slices):
            obj[s] = threshold(obj[s] + step / slices * (up[s] / _norm(w[s], alpha)))
        if not fix_probe:
            probe = probe + step * up_p / _norm(w_p, alpha)
    return obj, probe, errors


def mixed_state(patterns: DataFrame, shape: tuple[int, int], probes: np.ndarray, iterations: int = 10, step: float = 0.5, alpha: float = 0.5, fix_probe: bool = False) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Several incoherent probe modes (modes, x, y): the far field is the root of their summed intensities; modes are kept orthogonal."""
    spark = patterns.sparkSession
    obj, probes, errors = np.ones(shape, complex), probes.astype(complex), []
    for _ in range(iterations):
        state = spark.sparkContext.broadcast((obj, probes))

        def run(batches, state=state):
            o, p = state.value
            up, w, up_p, w_p, err, total = np.zeros(o.shape, complex), np.zeros(o.shape), np.zeros(p.shape, complex), np.zeros(p.shape[1:]), 0.0, 0.0
            for pdf in batches:
                amp = np.stack(pdf.amplitude.to_numpy()).reshape(-1, *p.shape[1:])
                patch, ix, iy = _overlap(o, p[0], pdf[["x", "y"]].to_numpy(float))
                far = np.fft.fft2(patch[:, None] * p[None])
                size = np.sqrt((np.abs(far) ** 2).sum(axis=1))
                err += float(((size - amp) ** 2).sum())
                total += float((amp**2).sum())
                ratio = np.divide(amp, size, out=np.zeros_like(amp), where=size > 1e-12)
                diff = np.fft.ifft2(far * (ratio[:, None] - 1))
                np.add.at(up, (ix[:, :, None], iy[:, None, :]), (np.conj(p)[None] * diff).sum(axis=1))
                np.add.at(w, (ix[:, :, None], iy[:, None, :]), np.broadcast_to((np.abs(p) ** 2).sum(axis=0), patch.shape))
                up_p += (np.conj(patch)[:, None] * diff).sum(axis=0)
                w_p += (np.abs(patch) ** 2).sum(axis=0)
            yield from block_sums(up, w, up_p, w_p, np.array([err, total]))

        up, w, up_p, w_p, (err, total) = sum_arrays(patterns, run, [obj, obj.real, probes, probes[0].real, np.zeros(2)])
        errors.append(float(err / max(total, 1e-12)))
        obj = threshold(obj + step * up / _norm(w, alpha))
        if not fix_probe:
            probes = orthogonal(probes + step * up_p / _norm(w_p, alpha))
    return obj, probes, errors


def projection_sets(patterns: DataFrame, space, shape: tuple[int, int], probe: np.ndarray, method: str = "RAAR", parameter: float = 0.7, iterations: int = 10, fix_probe: bool = True) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Alternating projections x psi + a overlap + b Pi(c overlap + (1 - c) psi), x = 1 - a - b; object and probe are replaced each time.

    ``space`` writes a table and returns it read back (a function of a DataFrame
    and a name); the exit waves of all positions are kept there.
    """
    spark = patterns.sparkSession
    a, b, c = METHODS[method](parameter)
    x = 1 - a - b
    obj, probe, errors = np.ones(shape, complex), probe.astype(complex), []
    frame = patterns.select("x", "y", "amplitude", F.lit(None).cast("array<double>").alias("wave"))
    for it in range(iterations):
        state = spark.sparkContext.broadcast((obj, probe))

        def advance(batches, state=state):
            o, p = state.value
            for pdf in batches:
                amp = np.stack(pdf.amplitude.to_numpy()).reshape(-1, *p.shape)
                patch, _, _ = _overlap(o, p, pdf[["x", "y"]].to_numpy(float))
                over = patch * p
                psi = over if pdf.wave.iloc[0] is None else np.stack([np.asarray(v, float).view(complex).reshape(p.shape) for v in pdf.wave])
                mixed = np.fft.fft2(c * over + (1 - c) * psi)
                new = x * psi + a * over + b * np.fft.ifft2(amp * np.exp(1j * np.angle(mixed)))
                err = ((np.abs(np.fft.fft2(over)) - amp) ** 2).sum(axis=(1, 2))
                yield pdf.assign(wave=[np.ascontiguousarray(w).view(float).ravel() for w in new], err=err)

        frame = space(frame.select("x", "y", "amplitude", "wave").mapInPandas(advance, "x double, y double, amplitude array<double>, wave array<double>, err double"), f"waves-{it}")
        row = frame.agg(F.sum("err"), F.sum(F.aggregate(F.transform("amplitude", lambda v: v * v), F.lit(0.0), lambda s, v: s + v))).first()
        errors.append(float(row[0] / max(row[1], 1e-12)))

        def collect(batches, state=state):
            o, p = state.value
            up, w, up_p, w_p = np.zeros(o.shape, complex), np.zeros(o.shape), np.zeros(p.shape, complex), np.zeros(p.shape)
            for pdf in batches:
                psi = np.stack([np.asarray(v, float).view(complex).reshape(p.shape) for v in pdf.wave])
                patch, ix, iy = _overlap(o, p, pdf[["x", "y"]].to_numpy(float))
                np.add.at(up, (ix[:, :, None], iy[:, None, :]), np.conj(p) * psi)
                np.add.at(w, (ix[:, :, None], iy[:, None, :]), np.broadcast_to(np.abs(p) ** 2, psi.shape))
                up_p += (np.conj(patch) * psi).sum(axis=0)
                w_p += (np.abs(patch) ** 2).sum(axis=0)
            yield from block_sums(up, w, up_p, w_p)

        up, w, up_p, w_p = sum_arrays(frame.select("x", "y", "wave"), collect, [obj, obj.real, probe, probe.real])
        obj = threshold(np.where(w > 1e-9 * w.max(), up / np.maximum(w, 1e-12), obj))
        if not fix_probe:
            probe = up_p / _norm(w_p, 0.05)
    return obj, probe, errors


# ----- constraints


def threshold(obj: np.ndarray, pure_phase: bool = False) -> np.ndarray:
    """Amplitudes at most 1 (or just 1)."""
    size = np.abs(obj)
    return np.where((size > 1) | pure_phase, obj / np.maximum(size, 1e-12), obj)


def shrink_phase(obj: np.ndarray, by: float, mask: np.ndarray | None = None) -> np.ndarray:
    """Phases lowered by ``by``, plus their mean over the mask, not under 0."""
    phase = np.angle(obj)
    return np.abs(obj) * np.exp(1j * np.maximum(phase - by - (phase[mask].mean() if mask is not None else 0.0), 0))


def smooth(obj: np.ndarray, sigma: float, pure_phase: bool = False) -> np.ndarray:
    if pure_phase:
        return np.exp(1j * K.gaussian_filter(np.angle(obj), sigma, "wrap"))
    return K.gaussian_filter(obj.real, sigma, "wrap") + 1j * K.gaussian_filter(obj.imag, sigma, "wrap")


def total_variation(a: np.ndarray, weight: float, steps: int = 60, tolerance: float = 2e-4) -> np.ndarray:
    """Chambolle's dual iteration for total-variation denoising, along all axes; the sum is kept."""
    p, last = np.zeros((a.ndim, *a.shape)), None

    def divergence():
        out = np.zeros_like(a)
        for k in range(a.ndim):
            out += np.diff(p[k], axis=k, prepend=np.zeros_like(np.take(p[k], [0], axis=k)))
        return out

    for _ in range(steps):
        u = a + divergence()
        g = np.stack([np.diff(u, axis=k, append=np.take(u, [-1], axis=k)) for k in range(a.ndim)])
        size = np.sqrt((g**2).sum(axis=0))
        energy = float(((u - a) ** 2).sum() / 2 + weight * size.sum())
        if last is not None and abs(last - energy) < tolerance * abs(last):
            break
        last, tau = energy, 1 / (2 * a.ndim)
        p = (p + tau * g) / (1 + tau / weight * size)
    out = a + divergence()
    return out * (a.sum() / out.sum()) if abs(out.sum()) > 1e-12 else out


def kz_regularize(obj: np.ndarray, gamma: float, spacing: tuple[float, float, float]) -> np.ndarray:
    """Weights 1 - (2 / pi) atan(gamma^2 qz^2 / qr^2) in Fourier space, after padding along z."""
    n = obj.shape[0]
    f = np.fft.fftn(np.pad(obj, ((0, n), (0, 0), (0, 0)), mode="edge"))
    qz, qx, qy = (np.fft.fftfreq(m, d) for m, d in zip(f.shape, spacing))
    qr2 = qx[:, None] ** 2 + qy[None] ** 2
    return np.fft.ifftn(f * (1 - 2 / np.pi * np.arctan2((gamma * qz[:, None, None]) ** 2, qr2[None])))[:n]


def identical_slices(obj: np.ndarray) -> np.ndarray:
    return np.broadcast_to(obj.mean(axis=0), obj.shape).copy()


def orthogonal(probes: np.ndarray) -> np.ndarray:
    """Modes made orthogonal by the eigenvectors of their Gram matrix, brightest first."""
    flat = probes.reshape(len(probes), -1)
    _, vectors = np.linalg.eigh(np.conj(flat) @ flat.T)
    out = vectors.T @ flat
    return out[np.argsort(-(np.abs(out) ** 2).sum(axis=1))].reshape(probes.shape)


def center_probe(probe: np.ndarray) -> np.ndarray:
    """Probe (corner-centred) moved so that its centre of mass is at the corner."""
    w = np.abs(probe) ** 2
    f = [np.fft.fftfreq(n, 1 / n) for n in probe.shape]
    return K.fourier_shift(probe, -float((w * f[0][:, None]).sum() / w.sum()), -float((w * f[1][None]).sum() / w.sum()))


def impose_aperture(probe: np.ndarray, aperture: np.ndarray) -> np.ndarray:
    """The probe with its Fourier phases and a given Fourier modulus."""
    return np.fft.ifft2(aperture * np.exp(1j * np.angle(np.fft.fft2(probe))))


def ring_correlation(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fourier ring correlation of two images, the half-bit curve 2 / sqrt(n / 2) and the ring sizes."""
    fa, fb = np.fft.fft2(a), np.fft.fft2(b)
    n = min(a.shape)
    k = np.hypot(np.fft.fftfreq(a.shape[0])[:, None], np.fft.fftfreq(a.shape[1])[None]) * n
    low = np.floor(k).astype(int).ravel()
    d = k.ravel() - low

    def ring(v):
        return np.bincount(low, v.ravel() * (1 - d), n + 2)[: n // 2] + np.bincount(low + 1, v.ravel() * d, n + 2)[: n // 2]

    top, na, nb, size = ring((fa * np.conj(fb)).real), ring(np.abs(fa) ** 2), ring(np.abs(fb) ** 2), ring(np.ones(a.shape))
    return top / np.maximum(np.sqrt(na * nb), 1e-12), 2 / np.sqrt(np.maximum(size, 1e-12) / 2), size


def propagate(wave: np.ndarray, sampling: float, lam: float, distance: float) -> np.ndarray:
    return np.fft.ifft2(np.fft.fft2(wave) * fresnel(wave.shape[-2:], sampling, lam, distance))
