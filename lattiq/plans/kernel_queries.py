"""Queries whose kernels SQL cannot express; the tests hold them against brute force or planted truth."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from lattiq.functions import kernels as K
from lattiq.model import CubeMeta, frames, peaks, pixels
from lattiq.operators import classify as L
from lattiq.operators import crystal as X
from lattiq.operators import cube as C
from lattiq.operators import detect as T
from lattiq.operators import flowlines as O
from lattiq.operators import orientation as A
from lattiq.operators import phase as H
from lattiq.operators import polar as R
from lattiq.operators import ptychography as Y
from lattiq.operators import rings as G
from lattiq.plans.polar_queries import ATOMS, CELL, COEFFICIENTS

MID = (3.5, 3.5)


def _template() -> np.ndarray:
    x, y = np.indices((8, 8))
    r = np.hypot(np.minimum(x, 8 - x), np.minimum(y, 8 - y))
    return 1 / (1 + np.exp(4 * (r - 1.2)))


def _reflections(s) -> pd.DataFrame:
    atoms = s.createDataFrame(ATOMS, "x double, y double, z double, number int, occ double")
    table = s.createDataFrame(COEFFICIENTS, "number int, " + ", ".join(f"{c}{i} double" for c in "ab" for i in range(1, 6)))
    return X.structure_factors(X.reflections(s, CELL, 1.2), atoms, table, CELL).toPandas()


def _centred(s, d):
    """All peaks of each position, centred and in reciprocal Angstrom; a match gives no weight to what lies beyond its shells."""
    return peaks(s, d).select("rx", "ry", ((F.col("qx") - 26) * 0.04).alias("qx"), ((F.col("qy") - 27) * 0.04).alias("qy"), "intensity")


def _plan(s):
    return A.plan(_reflections(s), A.zone_axes([(0, 0, 1), (0, 1, 1), (1, 1, 1)], 9.0), n_gamma=60)


def _orientations(s, d):
    return A.match_orientations(_centred(s, d), _plan(s), 2)


def _phases(s, d):
    hkl = _reflections(s)
    library = {n: A.simulate(hkl, X.orientation(z), 200e3, 0.03) for n, z in (("a", (0, 0, 1)), ("b", (0, 1, 1)), ("c", (1, 1, 1)))}
    return A.phase_weights(_centred(s, d), library, 0.06, 2)


def _scan(s, d) -> tuple[int, int]:
    r = frames(s, d).agg(F.max("rx"), F.max("ry")).first()
    return r[0] + 1, r[1] + 1


def _dpc(s, d):
    nx, ny = _scan(s, d)
    com = H.normalized_com(C.center_of_mass(frames(s, d)))
    phase, _ = H.dpc(H.image_of(com, "com_x", nx, ny), H.image_of(com, "com_y", nx, ny))
    return s.createDataFrame([(i, j, float(phase[i, j])) for i in range(nx) for j in range(ny)], "rx long, ry long, phase double")


def _parallax(s, d):
    nx, ny = _scan(s, d)
    images = H.bright_field_images(frames(s, d), C.circle(3.5, 3.5, 2), nx, ny, CubeMeta())
    _, shifts, _ = H.parallax(images, nx, ny, 2)
    return s.createDataFrame(shifts)


def _ptychography(s, d):
    p = frames(s, d).select((F.col("rx") * 2.0).alias("x"), (F.col("ry") * 2.0).alias("y"), F.transform("data", F.sqrt).alias("amplitude"))
    nx, ny = _scan(s, d)
    _, _, errors = H.ptychography(p, (2 * nx + 8, 2 * ny + 8), _template().astype(complex), iterations=3)
    return s.createDataFrame([(k, e) for k, e in enumerate(errors)], "iteration long, error double")


def _wpf(s, d):
    model = T.Model((T.constant, {"level": (0.05, 0, 1)}), (T.gaussian, {"x0": (3.5, 0, 7), "y0": (3.5, 0, 7), "sigma": (2.0, 0.5, 6), "height": (0.2, 0, 2)}))
    return T.fit_all(frames(s, d), model, steps=15)


def _vectors(s, d):
    return frames(s, d).select("rx", "ry", "data")


def _pca(s, d):
    _, components, values = L.pca(_vectors(s, d), "data", 3)
    return s.createDataFrame([(k, float(v), c.tolist()) for k, (v, c) in enumerate(zip(values, components))], "component long, variance double, loadings array<double>")


def _gmm(s, d):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    whole = _vectors(s, d).select("rx", "ry", array_to_vector("data").alias("whole"))
    f = PCA(k=4, inputCol="whole", outputCol="features").fit(whole).transform(whole).drop("whole")
    return L.gaussian_mixture(f, range(2, 4)).transform(f).select("rx", "ry", F.col("prediction").cast("long").alias("label"))


def _nmf(s, d):
    h, errors = L.nmf(_vectors(s, d), "data", 3, 5)
    return s.createDataFrame([(k, r.tolist(), errors[-1]) for k, r in enumerate(h)], "component long, pattern array<double>, error double")


def _grains(s, d):
    return s.createDataFrame(A.cluster_grains(_orientations(s, d), 15.0))


def _bloch(s, d):
    return s.createDataFrame(A.bloch(_reflections(s), X.orientation((0, 0, 1)), 200e3, [50.0, 100.0, 200.0]))


def _strain(s, d):
    hkl = _reflections(s)
    return A.orientation_strain(_centred(s, d), _orientations(s, d), hkl, 200e3, 0.02, 0.1)


def _flowlines(s, d):
    hist = O.orientation_histogram(peaks(s, d), (26.0, 27.0), [(3.0, 9.0)], 15.0)
    x, y, theta, value = (c.to_numpy() for c in hist.select("x", "y", "theta", "value").toArrow().columns)
    cube = np.zeros((x.max() + 1, y.max() + 1, 12))
    cube[x, y, theta] = value
    lines = O.flowlines(cube, float(np.median(cube)))
    sizes = [len(line) for line in lines]
    points = np.concatenate([np.empty((0, 3)), *lines])
    columns = [np.repeat(np.arange(len(lines)), sizes), np.concatenate([np.arange(0), *map(np.arange, sizes)]), *points.T]
    return s.createDataFrame(pa.table(columns, names=["line", "point", "x", "y", "theta"]), "line long, point long, x double, y double, theta double")


RING_START = dict(zip(G.RING, (0.05, 0.1, 2.0, 0.05, 1.0, 1.0, 3.5, 3.5, 2.5, 0.0, 1.0)))
SPEC = R.PolarSpec(0.0, 5.0, 1.0, 12)


def _ellipse(s, d):
    e = G.fit_ellipse(C.virtual_diffraction(frames(s, d)), MID, 1.0, 4.0)
    return s.createDataFrame([tuple(e.values())], ", ".join(f"{k} double" for k in e))


def _polar_peaks(s, d):
    return G.polar_peaks(R.polar_data(pixels(frames(s, d)), MID, SPEC), 12, least=0.01, most=4)


def _pdf(s, d):
    rows = R.radial_statistics(R.polar_data(pixels(frames(s, d)), MID, SPEC)).orderBy("r").toPandas()
    radii = np.linspace(0.5, 8, 40)
    _, g = G.pair_distribution(rows.r.to_numpy() * 0.1 + 0.05, rows["mean"].to_numpy(), radii, 0.05)
    return s.createDataFrame([(float(a), float(b)) for a, b in zip(radii, g)], "radius double, pdf double")


def _patterns(s, d):
    return frames(s, d).select((F.col("rx") * 2.0).alias("x"), (F.col("ry") * 2.0).alias("y"), F.transform("data", F.sqrt).alias("amplitude"))


def _object_shape(s, d):
    nx, ny = _scan(s, d)
    return 2 * nx + 8, 2 * ny + 8


def _errors(s, errors):
    return s.createDataFrame([(k, e) for k, e in enumerate(errors)], "iteration long, error double")


def _multislice(s, d):
    _, _, errors = Y.multislice(_patterns(s, d), 2, _object_shape(s, d), _template().astype(complex), H.fresnel((8, 8), 1.0, 0.02, 5.0), 2)
    return _errors(s, errors)


def _mixed(s, d):
    modes = np.stack([_template(), 0.3 * np.roll(_template(), 1, 0)]).astype(complex)
    _, _, errors = Y.mixed_state(_patterns(s, d), _object_shape(s, d), modes, 2)
    return _errors(s, errors)


QUERIES = {
    "ellipse_fit": (_ellipse, None),
    "ring_fit": (lambda s, d: G.fit_rings(frames(s, d), RING_START, steps=6), None),
    "ring_strain": (lambda s, d: G.ring_strain(G.fit_rings(frames(s, d), RING_START, steps=6)), None),
    "polar_peaks": (_polar_peaks, None),
    "pair_distribution": (_pdf, None),
    "aligned_probe": (lambda s, d: s.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(T.vacuum_probe(G.aligned_mean(frames(s, d))))], "qx long, qy long, value double"), None),
    "integrated_disks": (lambda s, d: G.integrate_disks(frames(s, d), T.find_disks(frames(s, d), _template(), most=4), 1.5), None),
    "ptycho_multislice": (_multislice, None),
    "ptycho_mixed": (_mixed, None),
    "disk_detect": (lambda s, d: T.find_disks(frames(s, d), _template(), subpixel="poly", spacing=2, edge=1, most=10), None),
    "disk_detect_multicorr": (lambda s, d: T.find_disks(frames(s, d), _template(), power=0.8, subpixel="multicorr", factor=8, edge=1, most=4), None),
    "disk_detect_filtered": (lambda s, d: T.find_disks(frames(s, d), None, filter_function=K.ewpc, most=5), None),
    "frame_origins": (lambda s, d: T.origins(frames(s, d), 1.5), None),
    "frame_origins_friedel": (lambda s, d: T.origins_friedel(frames(s, d)), None),
    "resample_fourier": (lambda s, d: T.resample(frames(s, d), (12, 12)), None),
    "resample_bilinear": (lambda s, d: T.resample(frames(s, d), (5, 6), "bilinear", True), None),
    "fourier_shift": (lambda s, d: T.shift_fourier(frames(s, d), 0.5, -1.25), None),
    "wpf": (_wpf, None),
    "orientation_match": (_orientations, None),
    "orientation_sort": (lambda s, d: A.sort_matches(_orientations(s, d)), None),
    "acom_strain": (_strain, None),
    "phase_nnls": (_phases, None),
    "dominant_phase": (lambda s, d: A.dominant_phase(_phases(s, d)), None),
    "grain_cluster": (_grains, None),
    "bloch_dynamical": (_bloch, None),
    "cbed": (lambda s, d: A.convergent_beam(s, _reflections(s), X.orientation((0, 0, 1)), 200e3, 100.0, 0.005, 5), None),
    "flowlines": (_flowlines, None),
    "pca": (_pca, None),
    "gmm": (_gmm, None),
    "nmf": (_nmf, None),
    "dpc": (_dpc, None),
    "parallax": (_parallax, None),
    "ptycho_gd": (_ptychography, None),
    "gaussian_filter": (lambda s, d: T.map_frames(frames(s, d), lambda a: K.gaussian_filter(a, 1.0)).select("rx", "ry", "data"), None),
}
