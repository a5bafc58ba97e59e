"""Phase contrast: centres of mass, rotation search, patch sums, profiles; and iterative reconstructions.

What reduces over patterns is distributed; images of the size of the scan are
held on the driver, whose iterations are those of the reconstruction itself.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattiq.functions import kernels as K
from lattiq.operators.peaks import fit_surface


def normalized_com(com: DataFrame, model: str = "plane", scale: float = 1.0) -> DataFrame:
    """Centres of mass less a fitted surface, times the pixel size; null counts as 0."""
    _, out = fit_surface(com, ["com_x", "com_y"], model)
    return out.select("rx", "ry", *[(F.coalesce(F.col(c) - F.col(f"{c}_fit"), F.lit(0.0)) * scale).alias(c) for c in ("com_x", "com_y")])


def rotation_search(com: DataFrame, angles: list[float], maximize_divergence: bool = False) -> DataFrame:
    """Mean |curl| (or |divergence|) of the rotated field for each angle in degrees, plain and transposed.

    The centred differences of com_x and com_y are taken once, by equi-joins with
    the neighbours, on interior positions; each angle is then a linear form of them, in one aggregate.
    """
    o = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    s = com.select("rx", "ry", "com_x", "com_y", F.explode(o).alias("o")).select((F.col("rx") - F.col("o.a")).alias("rx"), (F.col("ry") - F.col("o.b")).alias("ry"), "com_x", "com_y", F.col("o.a").alias("a"), F.col("o.b").alias("b"))
    d = s.groupBy("rx", "ry").agg(F.count("*").alias("n"), *[(F.sum(F.col(c) * F.col(e)) / 2).alias(f"{c}_{e}") for c in ("com_x", "com_y") for e in ("a", "b")])
    d = d.where("n = 4").join(com.select("rx", "ry"), ["rx", "ry"], "left_semi")
    xa, xb, ya, yb = (F.col(c) for c in ("com_x_a", "com_x_b", "com_y_a", "com_y_b"))
    table = F.array(*[F.struct(F.lit(float(a)).alias("angle"), F.lit(t).alias("transpose")) for a in angles for t in (False, True)])
    d = d.select(xa.alias("xa"), xb.alias("xb"), ya.alias("ya"), yb.alias("yb"), F.explode(table).alias("o"))
    c, n = F.cos(F.radians("o.angle")), F.sin(F.radians("o.angle"))
    ux = lambda e: F.when(F.col("o.transpose"), F.col(f"y{e}")).otherwise(F.col(f"x{e}"))
    uy = lambda e: F.when(F.col("o.transpose"), F.col(f"x{e}")).otherwise(F.col(f"y{e}"))
    if maximize_divergence:
        score = (c * ux("a") - n * uy("a")) + (n * ux("b") + c * uy("b"))
    else:
        score = (n * ux("a") + c * uy("a")) - (c * ux("b") - n * uy("b"))
    return d.groupBy(F.col("o.angle").alias("angle"), F.col("o.transpose").alias("transpose")).agg(F.avg(F.abs(score)).alias("score"))


def best_rotation(scores: DataFrame, maximize: bool = False) -> DataFrame:
    s = -F.col("score") if maximize else F.col("score")
    return scores.agg(F.min(F.struct(s.alias("s"), "angle", "transpose")).alias("b")).select("b.angle", "b.transpose")


def patch_sum(p: DataFrame, nx: int, ny: int, x0: str, y0: str) -> DataFrame:
    """Patches added up at their positions on a periodic grid."""
    return p.groupBy(F.pmod(F.col("qx") + F.col(x0), F.lit(nx)).alias("x"), F.pmod(F.col("qy") + F.col(y0), F.lit(ny)).alias("y")).agg(F.sum("i").alias("value"))


def radial_shells(p: DataFrame, nx: int, ny: int, value: str = "value") -> DataFrame:
    """Mean of corner-centred values over unit rings of frequency, shared linearly: ring, value, n."""
    fx = F.when(F.col("qx") * 2 < nx, F.col("qx")).otherwise(F.col("qx") - nx)
    fy = F.when(F.col("qy") * 2 < ny, F.col("qy")).otherwise(F.col("qy") - ny)
    r = F.sqrt(fx * fx + fy * fy)
    low = F.floor(r)
    parts = F.array(F.struct(low.alias("ring"), (1 - (r - low)).alias("w")), F.struct((low + 1).alias("ring"), (r - low).alias("w")))
    s = p.select(F.col(value).alias("v"), F.explode(parts).alias("c")).select("v", "c.*").where("w > 0")
    return s.groupBy("ring").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("value"), F.sum("w").alias("n"))


def small_correlation(a: DataFrame, b: DataFrame, nx: int, ny: int) -> DataFrame:
    """Circular cross correlation of each pattern with one small pattern: sum a(q) b(q - shift)."""
    t = b.select(F.col("qx").alias("bx"), F.col("qy").alias("by"), F.col("value").alias("t"))
    return a.crossJoin(F.broadcast(t)).groupBy("rx", "ry", F.pmod(F.col("qx") - F.col("bx"), F.lit(nx)).alias("sx"), F.pmod(F.col("qy") - F.col("by"), F.lit(ny)).alias("sy")).agg(F.sum(F.col("i") * F.col("t")).alias("value"))


def image_of(df: DataFrame, value: str, nx: int, ny: int) -> np.ndarray:
    """A scan-sized image on the driver."""
    out = np.zeros((nx, ny))
    for r in df.select("rx", "ry", value).collect():
        out[r["rx"], r["ry"]] = r[value] or 0.0
    return out


# ----- differential phase contrast


def dpc(com_x: np.ndarray, com_y: np.ndarray, iterations: int = 64, step: float = 0.5, gaussian: float = 0.0, low_pass: float | None = None) -> tuple[np.ndarray, list[float]]:
    """Phase whose gradient is the field, by Fourier integration of what is left; the step is halved when the error rises."""
    nx, ny = com_x.shape
    kx, ky = np.fft.fftfreq(nx)[:, None], np.fft.fftfreq(ny)[None]
    sx, sy = 1j * np.sin(2 * np.pi * kx), 1j * np.sin(2 * np.pi * ky)  # centred differences
    power = np.abs(sx) ** 2 + np.abs(sy) ** 2
    inverse = np.divide(1.0, power, out=np.zeros_like(power), where=power > 1e-9)
    phase, errors = np.zeros((nx, ny)), []

    def left(p):
        gx, gy = (np.roll(p, -1, 0) - np.roll(p, 1, 0)) / 2, (np.roll(p, -1, 1) - np.roll(p, 1, 1)) / 2
        dx, dy = com_x - gx, com_y - gy
        return dx, dy, float(np.mean(dx**2 + dy**2))

    dx, dy, error = left(phase)
    for _ in range(iterations):
        update = np.fft.ifft2((np.conj(sx) * np.fft.fft2(dx) + np.conj(sy) * np.fft.fft2(dy)) * inverse).real
        trial = phase + step * update
        if gaussian:
            trial = K.gaussian_filter(trial, gaussian, "wrap")
        if low_pass is not None:
            trial = K.butterworth(trial, low=low_pass)
        tx, ty, e = left(trial)
        if e > error:
            step /= 2
            if step < 1e-6:
                break
            continue
        phase, dx, dy, error = trial, tx, ty, e
        errors.append(error)
    return phase - phase.mean(), errors


# ----- parallax: bright-field images by detector pixel


def bright_field_images(cube: DataFrame, mask, r_nx: int, r_ny: int, meta) -> DataFrame:
    """qx, qy, image: a scan-sized image for each detector pixel under the mask.

    Where the scan has no value the image is null; where it has several, their mean.
    """
    from lattiq.model import pixels

    inside = cube.where(F.col("rx").between(0, r_nx - 1) & F.col("ry").between(0, r_ny - 1))
    p = pixels(inside, meta).select("qx", "qy", (F.col("rx") * r_ny + F.col("ry")).alias("k"), "i")
    whole = cube.sparkSession.range(r_nx * r_ny).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(meta.q_n - 1))).alias("q"))
    whole = whole.select(F.expr(f"q div {meta.q_ny}").cast("long").alias("qx"), (F.col("q") % meta.q_ny).cast("long").alias("qy"), "k", F.lit(None).cast("double").alias("i"))
    each = p.unionByName(whole).where(mask(F.col("qx"), F.col("qy"))).groupBy("qx", "qy", "k").agg(F.avg("i").alias("i"))
    return each.groupBy("qx", "qy").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "i"))), lambda s: s["i"]).alias("image"))


def _filled(image, shape: tuple[int, int]) -> np.ndarray:
    """The image with its mean where it is null, which pulls no shift."""
    a = np.array(image, float).reshape(shape)
    gap = np.isnan(a)
    if gap.any():
        a[gap] = 0.0 if gap.all() else a[~gap].mean()
    return a


def _mean_image(images: DataFrame, column: str, shape: tuple[int, int]) -> np.ndarray:
    def run(batches):
        total, n = np.zeros(shape), 0.0
        for pdf in batches:
            for image in pdf[column]:
                total += _filled(image, shape)
                n += 1
        yield from block_sums(total, np.array([n]))

    total, (n,) = sum_arrays(images.select(column), run, [np.zeros(shape), np.zeros(1)])
    return total / max(n, 1.0)


def parallax(images: DataFrame, r_nx: int, r_ny: int, iterations: int = 4, upsample: int = 4) -> tuple[np.ndarray, pd.DataFrame, list[float]]:
    """Aligned sum of bright-field images.

    Each round broadcasts the running mean (of the scan's size) and aligns every
    image to it by correlation; shifts are centred on their median.  Positions
    without a value (null) count as the image's mean.
    """
    spark = images.sparkSession
    base = images.persist()
    errors: list[float] = []
    shifts = pd.DataFrame()
    try:
        mean = _mean_image(base, "image", (r_nx, r_ny))
        for _ in range(iterations):
            ref = spark.sparkContext.broadcast(mean)

            def run(batches, ref=ref):
                for pdf in batches:
                    rows = []
                    for qx, qy, image in zip(pdf.qx, pdf.qy, pdf.image):
                        a = _filled(image, (r_nx, r_ny))
                        a = a / max(a.mean(), 1e-12)
                        r = ref.value / max(ref.value.mean(), 1e-12)
                        dx, dy = K.align(r, a, upsample)
                        moved = K.fourier_shift(a, dx, dy)
                        rows.append((qx, qy, dx, dy, float(np.abs(moved - r).mean()), moved.ravel()))
                    yield pd.DataFrame(rows, columns=["qx", "qy", "dx", "dy", "error", "moved"])

            out = base.mapInPandas(run, "qx long, qy long, dx double, dy double, error double, moved array<double>").persist()
            shifts = out.select("qx", "qy", "dx", "dy", "error").toPandas().sort_values(["qx", "qy"], ignore_index=True)
            mean = _mean_image(out, "moved", (r_nx, r_ny))
            out.unpersist()
            errors.append(float(shifts.error.mean()))
            shifts[["dx", "dy"]] -= shifts[["dx", "dy"]].median()
    finally:
        base.unpersist()
    return mean, shifts, errors


def aberration_basis(alpha: np.ndarray, phi: np.ndarray, orders: list[tuple[int, int, int]]) -> np.ndarray:
    """Columns alpha^(m+1) cos or sin(n phi) / (m + 1): (m, n, 0 or 1)."""
    return np.stack([alpha ** (m + 1) / (m + 1) * (np.sin(n * phi) if a else np.cos(n * phi)) for m, n, a in orders], axis=-1)


def fit_aberrations(shifts: pd.DataFrame, angles: np.ndarray, orders: list[tuple[int, int, int]]) -> np.ndarray:
    """Coefficients whose surface has the measured shifts as its gradient, by least squares.

    ``angles``: (n, 2) tilts of the detector pixels.
    """
    h = 1e-5

    def surface(q):
        return aberration_basis(np.hypot(*q.T), np.arctan2(q[:, 1], q[:, 0]), orders)

    gx = (surface(angles + [h, 0]) - surface(angles - [h, 0])) / (2 * h)
    gy = (surface(angles + [0, h]) - surface(angles - [0, h])) / (2 * h)
    return np.linalg.lstsq(np.concatenate([gx, gy]), np.concatenate([shifts.dx, shifts.dy]), rcond=None)[0]


# ----- ptychography


def _overlap(obj: np.ndarray, probe: np.ndarray, at: np.ndarray):
    """Exit waves of patches of a periodic object: (n, px, py), and the patch indices."""
    px, py = probe.shape
    ix = (np.rint(at[:, 0]).astype(int)[:, None] + np.arange(px)) % obj.shape[0]
    iy = (np.rint(at[:, 1]).astype(int)[:, None] + np.arange(py)) % obj.shape[1]
    patches = obj[ix[:, :, None], iy[:, None, :]]
    return patches, ix, iy


#: Numbers in a block, in which sums travel: 32 KiB.
BLOCK = 4096


def block_sums(*arrays: np.ndarray):
    """A partition's sums as rows (block, v), BLOCK numbers of one array each, complex ones as pairs; a block its patterns did not touch has no row.

    The rows come in frames of at most 8 MiB.
    """
    at, rows = 0, []
    for a in arrays:
        flat = np.ascontiguousarray(a).reshape(-1).view(float)
        for k in range(0, len(flat), BLOCK):
            part = flat[k : k + BLOCK]
            if part.any():
                rows.append((at + k // BLOCK, part.tobytes()))
            if len(rows) == 256:
                yield pd.DataFrame(rows, columns=["block", "v"])
                rows = []
        at += -(-len(flat) // BLOCK)
    if rows:
        yield pd.DataFrame(rows, columns=["block", "v"])


def sum_arrays(frame: DataFrame, run, like: list[np.ndarray]) -> list[np.ndarray]:
    """The sums over all partitions of what ``run`` gives as block_sums, as arrays of the shapes and types of ``like``.

    Blocks are added up where the shuffle brings them together and reach the
    driver as bytes, a partition at a time: it holds the sums and little else.
    """

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, v in zip(pdf.block, pdf.v):
                if k in total:
                    total[k] += np.frombuffer(v)
                else:
                    total[k] = np.frombuffer(v).copy()
        keys = list(total)
        for k in range(0, len(keys), 256):
            yield pd.DataFrame([(b, total[b].tobytes()) for b in keys[k : k + 256]], columns=["block", "v"])

    out = [np.zeros(a.shape, a.dtype) for a in like]
    flat = [a.reshape(-1).view(float) for a in out]
    first = np.cumsum([0] + [-(-len(f) // BLOCK) for f in flat])
    kind = "block long, v binary"
    for r in frame.mapInPandas(run, kind).repartition("block").mapInPandas(add, kind).toLocalIterator():
        i = int(np.searchsorted(first, r["block"], "right")) - 1
        v = np.frombuffer(r["v"])
        at = (r["block"] - int(first[i])) * BLOCK
        flat[i][at : at + len(v)] = v
    return out


def ptychography(patterns: DataFrame, shape: tuple[int, int], probe: np.ndarray, obj: np.ndarray | None = None, iterations: int = 10, step: float = 0.5, alpha: float = 0.5, fix_probe: bool = False, positivity: bool = False) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Gradient descent on amplitudes, single slice, complex object.

    ``patterns`` (x, y, amplitude array<double>, corner-centred).  An iteration
    broadcasts object and probe, and every partition returns its sums of the
    object and probe updates, which add up; patterns never leave their executors.
    All patterns form one batch.
    """
    spark = patterns.sparkSession
    obj = np.ones(shape, complex) if obj is None else obj.astype(complex)
    probe, errors = probe.astype(complex), []
    for _ in range(iterations):
        state = spark.sparkContext.broadcast((obj, probe))

        def run(batches, state=state):
            o, p = state.value
            up_o, w_o, up_p, w_p, err, total = np.zeros(o.shape, complex), np.zeros(o.shape), np.zeros(p.shape, complex), np.zeros(p.shape), 0.0, 0.0
            for pdf in batches:
                amp = np.stack(pdf.amplitude.to_numpy()).reshape(-1, *p.shape)
                patch, ix, iy = _overlap(o, p, pdf[["x", "y"]].to_numpy(float))
                exit_wave = patch * p
                far = np.fft.fft2(exit_wave)
                err += float(((np.abs(far) - amp) ** 2).sum())
                total += float((amp**2).sum())
                diff = np.fft.ifft2(amp * np.exp(1j * np.angle(far)) - far)
                np.add.at(up_o, (ix[:, :, None], iy[:, None, :]), np.conj(p) * diff)
                np.add.at(w_o, (ix[:, :, None], iy[:, None, :]), np.broadcast_to(np.abs(p) ** 2, diff.shape))
                up_p += (np.conj(patch) * diff).sum(axis=0)
                w_p += (np.abs(patch) ** 2).sum(axis=0)
            yield from block_sums(up_o, w_o, up_p, w_p, np.array([err, total]))

        up_o, w_o, up_p, w_p, (err, total) = sum_arrays(patterns, run, [obj, obj.real, probe, probe.real, np.zeros(2)])
        errors.append(float(err / max(total, 1e-12)))
        norm = lambda w: np.sqrt(1e-16 + ((1 - alpha) * w) ** 2 + (alpha * w.max()) ** 2)
        obj = obj + step * up_o / norm(w_o)
        if not fix_probe:
            probe = probe + step * up_p / norm(w_p)
        amplitude = np.abs(obj)
        obj = np.where(amplitude > 1, obj / np.maximum(amplitude, 1e-12), obj)
        if positivity:
            obj = np.abs(obj) * np.exp(1j * np.maximum(np.angle(obj), 0))
    return obj, probe, errors


def curl_windows(com: DataFrame) -> DataFrame:
    """The curl of the field at interior positions of a full scan, by window functions along each axis."""
    row, col = W.partitionBy("rx").orderBy("ry"), W.partitionBy("ry").orderBy("rx")
    d = com.select("rx", "ry", ((F.lead("com_y").over(col) - F.lag("com_y").over(col)) / 2 - (F.lead("com_x").over(row) - F.lag("com_x").over(row)) / 2).alias("curl"))
    return d.where("curl is not null")


def fresnel(shape: tuple[int, int], sampling: float, lam: float, distance: float) -> np.ndarray:
    kx, ky = np.fft.fftfreq(shape[0], sampling)[:, None], np.fft.fftfreq(shape[1], sampling)[None]
    return np.exp(-1j * math.pi * lam * distance * (kx**2 + ky**2))
