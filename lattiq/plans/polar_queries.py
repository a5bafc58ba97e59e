"""Queries on polar views, crystals, classification, display and phase, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lattiq.model import PEAKS_SQL, PIXELS_SQL, frames, peaks, pixels, rounded
from lattiq.operators import classify as L
from lattiq.operators import crystal as X
from lattiq.operators import cube as C
from lattiq.operators import display as V
from lattiq.operators import flowlines as O
from lattiq.operators import peaks as P
from lattiq.operators import phase as H
from lattiq.operators import polar as R

SPEC = R.PolarSpec(0.0, 5.0, 1.0, 12)
TILTED = R.PolarSpec(0.0, 5.0, 1.0, 12, ellipse=(1.1, 1.0, 0.3))
MID = (3.5, 3.5)


def _r(df, keys, *values, digits=6):
    return df.select(*keys, *[rounded(v, digits).alias(v) for v in values])


def _polar(s, d, spec=SPEC):
    return R.polar_data(pixels(frames(s, d)), MID, spec)


def _scatter_sql(r: str, t: str) -> str:
    return f"""{PIXELS_SQL},
q as (select rx, ry, i, {r} as r, {t} as t from p),
f as (select rx, ry, i, floor(r)::bigint as r, floor(t)::bigint as t, r - floor(r) as dr, t - floor(t) as dt from q),
c as (select rx, ry, i, r + a as r, (t + b) % 12 as t, (case a when 1 then dr else 1 - dr end) * (case b when 1 then dt else 1 - dt end) as w from f, (values (0), (1)) as x(a), (values (0), (1)) as y(b)),
s as (select rx, ry, t, r, sum(i * w) as value, sum(w) as norm from c where r >= 0 and r < 5 group by rx, ry, t, r),
n as (select rx, ry, t, r, case when norm >= 0.1 then value / norm end as value from s)"""


def _mod(e: str) -> str:
    return f"(({e}) % (2 * pi()) + 2 * pi()) % (2 * pi())"


U, W_ = "(qx - 3.5::double)", "(qy - 3.5::double)"
POLAR_SQL = _scatter_sql(f"sqrt({U} * {U} + {W_} * {W_})", f"{_mod(f'atan2({W_}, {U})')} / (2 * pi() / 12)")
CT, ST = math.cos(0.3), math.sin(0.3)
XU, XV = f"({U} * {CT!r}::double + {W_} * {ST!r}::double)", f"(({W_} * {CT!r}::double - {U} * {ST!r}::double) * {1.1 / 1.0!r}::double)"
TILTED_SQL = _scatter_sql(f"{1.0 / 1.1!r}::double * sqrt({XU} * {XU} + {XV} * {XV})", f"{_mod(f'atan2({XV}, {XU}) + 0.3::double')} / (2 * pi() / 12)")
RADIAL_SQL = f"{POLAR_SQL}, a as (select rx, ry, r, avg(value) as radial, var_pop(value) as variance from n group by rx, ry, r)"

# ----- a cubic crystal with made-up scattering coefficients
CELL = X.lattice(4.05)
ATOMS = [(0.0, 0.0, 0.0, 13, 1.0), (0.5, 0.5, 0.0, 13, 1.0), (0.5, 0.0, 0.5, 29, 0.5), (0.0, 0.5, 0.5, 13, 1.0)]
COEFFICIENTS = [(13, *[0.9 / k for k in range(1, 6)], *[2.5 / k for k in range(1, 6)]), (29, *[1.7 / k for k in range(1, 6)], *[1.9 / k for k in range(1, 6)])]
VOLTS = 200e3
LAM = X.wavelength(VOLTS)
ZONE = X.orientation((0.0, 0.1, 1.0), (1.0, 0.0, 0.0))


def _factors(s, tolerance=1e-4, k_max=1.2):
    atoms = s.createDataFrame(ATOMS, "x double, y double, z double, number int, occ double")
    table = s.createDataFrame(COEFFICIENTS, "number int, " + ", ".join(f"{c}{i} double" for c in "ab" for i in range(1, 6)))
    return X.structure_factors(X.reflections(s, CELL, k_max), atoms, table, CELL, tolerance)


def _factors_sql(k_max=1.2) -> str:
    f = " + ".join(f"a{i} * (2 + b{i} * g * g) / ((1 + b{i} * g * g) * (1 + b{i} * g * g))" for i in range(1, 6))
    dbl = lambda row: "(" + ", ".join(f"{v!r}::double" if isinstance(v, float) else str(v) for v in row) + ")"
    return f"""atm(x, y, z, zz, occ) as (values {", ".join(map(dbl, ATOMS))}),
sc(zz, {", ".join(f"{c}{i}" for c in "ab" for i in range(1, 6))}) as (values {", ".join(map(dbl, COEFFICIENTS))}),
hk as (select h, k, l, h / 4.05::double as gx, k / 4.05::double as gy, l / 4.05::double as gz, sqrt((h / 4.05::double) ** 2 + (k / 4.05::double) ** 2 + (l / 4.05::double) ** 2) as g
       from range(-4, 5) as x(h), range(-4, 5) as y(k), range(-4, 5) as z(l)),
sf as (select h, k, l, gx, gy, gz, g, sum(({f}) * occ / {4.05**3!r}::double * cos(2 * pi() * (h * x + k * y + l * z))) as f_re,
       sum(({f}) * occ / {4.05**3!r}::double * sin(2 * pi() * (h * x + k * y + l * z))) as f_im from hk, atm join sc using (zz) where g <= {k_max} group by all),
si as (select *, f_re * f_re + f_im * f_im as intensity from sf where sqrt(f_re * f_re + f_im * f_im) > 0.0001)"""


def _row(i: int) -> str:
    return " + ".join(f"{float(ZONE[i, j])!r}::double * {g}" for j, g in enumerate(("gx", "gy", "gz")))


DETECTOR_SQL = f"dq as (select *, {_row(0)} as qx, {_row(1)} as qy, {_row(2)} as qz from si)"
PATTERN_SQL = f"""{_factors_sql()}, {DETECTOR_SQL},
ds as (select *, (2 * qz - {LAM!r}::double * g * g) / (2 - 2 * {LAM!r}::double * qz) as s from dq),
kp as (select h, k, l, qx, qy, s, intensity * exp(-(s * s) / (2 * 0.02::double * 0.02::double)) as intensity from ds where abs(s) <= 0.06::double)"""


def _pattern(s):
    return X.kinematic_pattern(_factors(s), ZONE, VOLTS, 0.02)


# ----- classification over peaks
SITES = [(6.0 + 9 * i, 7.0 + 10 * j) for i in range(5) for j in range(5)]
SITES_SQL = f"si(k, x, y) as (values {', '.join(f'({k}, {x}::double, {y}::double)' for k, (x, y) in enumerate(SITES))})"
LABEL_SQL = f"""{PEAKS_SQL}, {SITES_SQL},
j as (select b.*, k, (qx - x) ** 2 + (qy - y) ** 2 as d2 from b join si on (qx - x) ** 2 + (qy - y) ** 2 < 2.03::double ** 2),
lb as (select rx, ry, intensity, k::bigint as label from j)"""


def _labels(s, d):
    return L.label_sets(L.nearest_site(peaks(s, d), SITES, 2.03))


LABELS_SQL = f"{LABEL_SQL}, ls as (select distinct rx, ry, label from lb)"
FEATURE_SQL = f"""{PEAKS_SQL}, ft as (select rx, ry, (least(floor(qx * 4 / 64), 3) * 4 + least(floor(qy * 4 / 64), 3))::bigint as feature, sum(intensity) as value
from b where qx >= 0 and qy >= 0 and qx < 64 and qy < 64 group by all)"""


def _features(s, d):
    return L.features_in_bins(peaks(s, d), 4, 4, 64, 64, True)


def _image(s, d):
    return C.virtual_image(frames(s, d), C.circle(3.5, 3.5, 2))


IMAGE_SQL = f"{PIXELS_SQL}, im as (select rx, ry, sum(case when (qx - 3.5::double) ** 2 + (qy - 3.5::double) ** 2 < 4 then i else 0 end) as value from p group by rx, ry)"
SORTED_SQL = f"{IMAGE_SQL}, so as (select value, row_number() over (order by value) - 1 as k, count(*) over () as n from im)"
COM_SQL = f"{PIXELS_SQL}, co as (select rx, ry, sum(i * qx) / sum(i) as com_x, sum(i * qy) / sum(i) as com_y from p group by rx, ry)"
ANGLES = [0.0, 15.0, 30.0, 60.0, 90.0, 120.0]


def _com(s, d):
    return C.center_of_mass(frames(s, d))


def _plane_sql(v: str) -> str:
    return f"{v} - (av_{v} + ((sx_{v} * syy - sy_{v} * sxy) * (rx - ax) + (sy_{v} * sxx - sx_{v} * sxy) * (ry - ay)) / (sxx * syy - sxy * sxy))"


def _class_dp_no_bragg(s, d):
    p = pixels(frames(s, d), keep=("label",))
    bright = P.maxima(pixels(frames(s, d)), ["rx", "ry"])
    return C.pixels_off_peaks(p, bright, 1.2).groupBy("label", "qx", "qy").agg(F.avg("i").alias("value"))


QUERIES = {
    "polar_scatter": (lambda s, d: _r(_polar(s, d), ("rx", "ry", "t", "r"), "value"), f"with {POLAR_SQL} select rx, ry, t, r, round(value, 6) as value from n"),
    "polar_ellipse": (lambda s, d: _r(_polar(s, d, TILTED), ("rx", "ry", "t", "r"), "value"), f"with {TILTED_SQL} select rx, ry, t, r, round(value, 6) as value from n"),
    "polar_gather": (
        lambda s, d: _r(R.polar_gather(pixels(frames(s, d)), MID, R.PolarSpec(0.0, 4.0, 1.0, 8)), ("rx", "ry", "t", "r"), "value"),
        f"""with {PIXELS_SQL}, g as (select r, t, 3.5::double + (r + 0.5::double) * cos((t + 0.5::double) * pi() / 4) as x, 3.5::double + (r + 0.5::double) * sin((t + 0.5::double) * pi() / 4) as y from range(4) as a(r), range(8) as b(t)),
h as (select r, t, x, y, least(floor(x), 6)::bigint as fx, least(floor(y), 6)::bigint as fy from g where x >= 0 and y >= 0 and x <= 7 and y <= 7),
w as (select r, t, fx + a as qx, fy + b as qy, (case a when 1 then x - fx else 1 - x + fx end) * (case b when 1 then y - fy else 1 - y + fy end) as w from h, (values (0), (1)) as u(a), (values (0), (1)) as v(b))
select rx, ry, t, r, round(sum(i * w), 6) as value from p join w on p.qx = w.qx and p.qy = w.qy group by rx, ry, t, r""",
    ),
    "radial_stats": (
        lambda s, d: _r(R.radial_statistics(_polar(s, d)), ("r",), "mean", "variance", "variance_norm", digits=8),
        f"with {RADIAL_SQL} select r, round(avg(radial), 8) as mean, round(var_pop(radial), 8) as variance, round(var_pop(radial) / avg(radial) ** 2, 8) as variance_norm from a group by r",
    ),
    "fem_local": (
        lambda s, d: _r(R.local_fluctuation(_polar(s, d)), ("rx", "ry", "r"), "radial", "variance", "variance_norm"),
        f"with {RADIAL_SQL} select rx, ry, r, round(radial, 6) as radial, round(variance, 6) as variance, case when radial > 0 then round(variance / radial ** 2, 6) end as variance_norm from a",
    ),
    "annular_symmetry": (
        lambda s, d: _r(R.annular_symmetry(_polar(s, d), 6, 12), ("rx", "ry", "r", "order"), "power"),
        f"""with {POLAR_SQL},
o as (select rx, ry, r, k as "order", sum(value) as v, count(*) as m, sum(value * cos(2 * pi() * k * t / 12)) as c, sum(value * sin(2 * pi() * k * t / 12)) as s, sum(cos(2 * pi() * k * t / 12)) as c0, sum(sin(2 * pi() * k * t / 12)) as s0
      from n, range(1, 7) as k(k) where value is not null group by all)
select rx, ry, r, "order", round(abs((c * c + s * s) / v ** 2 - (c0 * c0 + s0 * s0) / m ** 2), 6) as power from o""",
    ),
    "radial_background": (
        lambda s, d: _r(R.radial_background(pixels(frames(s, d)), MID), ("rx", "ry", "r"), "background"),
        f"with {PIXELS_SQL} select rx, ry, floor(sqrt({U} ** 2 + {W_} ** 2))::bigint as r, round(median(i), 6) as background from p group by all",
    ),
    "bg_2d_interp": (
        lambda s, d: (lambda p: _r(R.subtract_radial(p, R.radial_background(p, MID), MID), ("rx", "ry", "qx", "qy"), "i", "background"))(pixels(frames(s, d))),
        f"""with {PIXELS_SQL}, q as (select *, sqrt({U} ** 2 + {W_} ** 2) as dd from p), m as (select rx, ry, floor(dd)::bigint as r, median(i) as bg from q group by all),
t as (select q.*, least(floor(dd)::bigint, 4) as lo, least(floor(dd)::bigint + 1, 4) as hi from q),
z as (select t.*, coalesce(a.bg, 0) * (1 - (dd - lo)) + coalesce(b.bg, 0) * (dd - lo) as background from t left join m a on a.rx = t.rx and a.ry = t.ry and a.r = lo left join m b on b.rx = t.rx and b.ry = t.ry and b.r = hi)
select rx, ry, qx, qy, round(greatest(i - background, 0), 6) as i, round(background, 6) as background from z""",
    ),
    "pdf_sine_transform": (
        lambda s, d: (lambda st: _r(R.sine_transform(st.select((F.col("r") * 0.1 + 0.05).alias("k"), (F.col("mean") - 0.1).alias("f")), "k", "f", s.range(1, 41).select((F.col("id") * 0.25).alias("radius")), 0.1), ("radius",), "pdf"))(R.radial_statistics(_polar(s, d))),
        f"""with {RADIAL_SQL}, st as (select r * 0.1::double + 0.05::double as k, avg(radial) - 0.1::double as f from a group by r)
select i * 0.25::double as radius, round(4 * pi() * 0.1::double * sum(f * sin(2 * pi() * k * i * 0.25::double)), 6) + 0 as pdf from st, range(1, 41) as q(i) group by i""",
    ),
    "rdf_phi": (
        lambda s, d: R.radial_statistics(_polar(s, d)).select("r", rounded((F.col("mean") - R.scattering_model((F.col("r") * 0.1 + 0.05) ** 2, 0.02, 0.1, 0.4, 0.03, 0.6)) / R.scattering_model((F.col("r") * 0.1 + 0.05) ** 2, 0.02, 0.1, 0.4, 0.03, 0.6) * (F.col("r") * 0.1 + 0.05)).alias("phi")),
        f"""with {RADIAL_SQL}, st as (select r, r * 0.1::double + 0.05::double as k, avg(radial) as v from a group by r),
m as (select *, 0.02::double + 0.1::double * exp(-(k * k) / (2 * 0.4::double * 0.4::double)) + 0.03::double * exp(-(k ** 4) / (2 * 0.6::double ** 4)) as f from st)
select r, round((v - f) / f * k, 6) + 0 as phi from m""",
    ),
    "lattice_vectors": (
        lambda s, d: s.createDataFrame([(int(i), *map(float, row), *map(float, rec)) for i, (row, rec) in enumerate(zip(X.lattice((3.0, 4.0, 5.0, 80.0, 95.0, 110.0)), X.reciprocal(X.lattice((3.0, 4.0, 5.0, 80.0, 95.0, 110.0)))))], "i long, x double, y double, z double, u double, v double, w double").select("i", *[rounded(c).alias(c) for c in "xyzuvw"]),
        """with c as (select cos(radians(80)) as ca, cos(radians(95)) as cb, cos(radians(110)) as cg, sin(radians(110)) as sg, sin(radians(95)) as sb),
e as (select *, (ca - cb * cg) / sg as f from c),
l as (select 3.0::double as ax, 4 * cg as bx, 4 * sg as b_y, 5 * cb as cx, 5 * f as cy, 5 * sqrt(sb * sb - f * f) as cz from e),
r as (select 0::bigint as i, ax as x, 0.0::double as y, 0.0::double as z, 1 / ax as u, -bx / (ax * b_y) as v, (bx * cy - b_y * cx) / (ax * b_y * cz) as w from l
 union all select 1, bx, b_y, 0, 0, 1 / b_y, -cy / (b_y * cz) from l union all select 2, cx, cy, cz, 0, 0, 1 / cz from l)
select i, round(x, 6) + 0 as x, round(y, 6) + 0 as y, round(z, 6) + 0 as z, round(u, 6) + 0 as u, round(v, 6) + 0 as v, round(w, 6) + 0 as w from r""",
    ),
    "scattering_factor": (
        lambda s, d: _r(s.createDataFrame(COEFFICIENTS, "number int, " + ", ".join(f"{c}{i} double" for c in "ab" for i in range(1, 6))).crossJoin(s.range(21).select((F.col("id") * 0.1).alias("g"))).withColumn("f", X.scattering_factor(F.col("g"))), ("number", "g"), "f"),
        f"""with {_factors_sql().split("hk as")[0].rstrip().rstrip(",")} select zz as number, i * 0.1::double as g, round({" + ".join(f"a{n} * (2 + b{n} * (i * 0.1::double) ** 2) / (1 + b{n} * (i * 0.1::double) ** 2) ** 2" for n in range(1, 6))}, 6) as f from sc, range(21) as r(i)""",
    ),
    "structure_factors": (lambda s, d: _r(_factors(s), ("h", "k", "l"), "g", "f_re", "f_im", "intensity"), f"with {_factors_sql()} select h, k, l, round(g, 6) as g, round(f_re, 6) + 0 as f_re, round(f_im, 6) + 0 as f_im, round(intensity, 6) as intensity from si"),
    "excitation_error": (
        lambda s, d: _r(X.to_detector(_factors(s), ZONE).withColumn("s", X.excitation_error(F.col("qz"), F.col("g"), LAM)), ("h", "k", "l"), "s"),
        f"with {_factors_sql()}, {DETECTOR_SQL} select h, k, l, round((2 * qz - {LAM!r}::double * g * g) / (2 - 2 * {LAM!r}::double * qz), 6) + 0 as s from dq",
    ),
    "precession_error": (
        lambda s, d: _r(X.precession_errors(_factors(s), ZONE, VOLTS, 0.02, 24), ("h", "k", "l", "step"), "s"),
        f"""with {_factors_sql()}, {DETECTOR_SQL}, t as (select *, i as step, qx * cos(2 * pi() * i / 24) * sin(0.02::double) + qy * sin(2 * pi() * i / 24) * sin(0.02::double) + qz * cos(0.02::double) as q from dq, range(24) as r(i))
select h, k, l, step, round((2 * q - {LAM!r}::double * g * g) / (2 - 2 * {LAM!r}::double * q), 6) + 0 as s from t""",
    ),
    "kinematic_pattern": (lambda s, d: _r(_pattern(s), ("h", "k", "l"), "qx", "qy", "s", "intensity"), f"with {PATTERN_SQL} select h, k, l, round(qx, 6) + 0 as qx, round(qy, 6) + 0 as qy, round(s, 6) + 0 as s, round(intensity, 6) as intensity from kp"),
    "ring_pattern": (lambda s, d: _r(X.ring_pattern(_pattern(s)), (), "radius", "intensity"), f"with {PATTERN_SQL} select round(sqrt(qx * qx + qy * qy), 4) as radius, round(sum(intensity), 6) as intensity from kp group by 1"),
    "bragg_k_histogram": (
        lambda s, d: _r(X.k_histogram(_pattern(s), 0.0, 1.5, 0.05, 1.0, 0.5), ("bin",), "value"),
        f"""with {PATTERN_SQL}, q as (select sqrt(qx * qx + qy * qy) / 0.05::double as q, sqrt(intensity) as i from kp),
p as (select floor(q)::bigint as bin, i * (1 - (q - floor(q))) as w from q union all select floor(q)::bigint + 1, i * (q - floor(q)) from q),
f as (select i as bin, coalesce(sum(w), 0) * (i * 0.05::double) as v from range(31) as r(i) left join p on bin = i group by i)
select bin, round(v / (select max(v) from f), 6) as value from f""",
    ),
    "moire_pattern": (
        lambda s, d: _r(X.moire(_pattern(s), _pattern(s), 0.1, None, 0.001), ("h", "k", "l", "h1", "k1", "l1"), "qx", "qy", "intensity"),
        f"""with {PATTERN_SQL}, z as (select * from kp where intensity > 0.001)
select a.h, a.k, a.l, b.h as h1, b.k as k1, b.l as l1, round(a.qx + cos(0.1::double) * b.qx - sin(0.1::double) * b.qy, 6) + 0 as qx, round(a.qy + sin(0.1::double) * b.qx + cos(0.1::double) * b.qy, 6) + 0 as qy, round(sqrt(a.intensity * b.intensity), 6) as intensity from z a, z b""",
    ),
    "voronoi_labels": (lambda s, d: _labels(s, d), f"with {LABELS_SQL} select rx, ry, label from ls"),
    "label_matrix": (
        lambda s, d: _r(L.label_matrix(L.nearest_site(peaks(s, d), SITES, 2.03), True), ("rx", "ry", "label"), "x"),
        f"with {LABEL_SQL} select rx, ry, label, round(max(intensity), 6) as x from lb group by rx, ry, label",
    ),
    "cooccurrence2": (lambda s, d: L.cooccurrence(_labels(s, d), len(SITES)), f"with {LABELS_SQL} select x.label as a, y.label as b, count(*) as n from ls x join ls y on x.rx = y.rx and x.ry = y.ry and x.label < y.label group by 1, 2"),
    "initial_classes": (lambda s, d: s.createDataFrame([(k, sorted(c)) for k, c in enumerate(L.initial_classes(_labels(s, d), len(SITES), 0.75, 4))], "class int, labels array<int>"), None),
    "class_dp": (
        lambda s, d: _r(L.class_pattern(pixels(frames(s, d), keep=("label",)), F.col("label") / 9, 0.3), ("qx", "qy"), "value"),
        f"with {PIXELS_SQL} select qx, qy, round(greatest(sum(i * label / 9) / sum(label::double / 9), 0), 6) as value from p where label::double / 9 > 0.3 group by qx, qy",
    ),
    "class_dp_no_bragg": (
        lambda s, d: _r(_class_dp_no_bragg(s, d), ("label", "qx", "qy"), "value"),
        f"""with {PIXELS_SQL},
w as (select a.rx, a.ry, a.qx, a.qy, a.i, count(*) as n, max(case when b.qx > a.qx and b.qy >= a.qy or b.qx = a.qx and b.qy > a.qy or b.qx < a.qx and b.qy > a.qy then b.i end) as hi,
   max(case when not (b.qx > a.qx and b.qy >= a.qy or b.qx = a.qx and b.qy > a.qy or b.qx < a.qx and b.qy > a.qy) then b.i end) as lo
 from p a join p b on a.rx = b.rx and a.ry = b.ry and abs(a.qx - b.qx) <= 1 and abs(a.qy - b.qy) <= 1 and (a.qx <> b.qx or a.qy <> b.qy) group by all),
m as (select * from w where n = 8 and i >= hi and i > lo)
select label, qx, qy, round(avg(i), 6) as value from p where not exists (select 1 from m where m.rx = p.rx and m.ry = p.ry and (m.qx - p.qx) ** 2 + (m.qy - p.qy) ** 2 <= 1.2::double ** 2) group by label, qx, qy""",
    ),
    "feature_bins": (lambda s, d: _r(_features(s, d), ("rx", "ry", "feature"), "value"), f"with {FEATURE_SQL} select rx, ry, feature, round(value, 6) as value from ft"),
    "minmax": (
        lambda s, d: _r(L.scale_features(_features(s, d), "minmax"), ("rx", "ry", "feature"), "value"),
        f"with {FEATURE_SQL}, st as (select feature, min(value) as lo, max(value) as hi from ft group by feature) select rx, ry, ft.feature, round(case when hi > lo then (value - lo) / (hi - lo) else 0 end, 6) as value from ft join st on ft.feature = st.feature",
    ),
    "robust_scale": (
        lambda s, d: _r(L.scale_features(_features(s, d), "robust"), ("rx", "ry", "feature"), "value"),
        f"with {FEATURE_SQL}, st as (select feature, median(value) as m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as q from ft group by feature) select rx, ry, ft.feature, round((value - m) / case when q <> 0 then q else 1 end, 6) + 0 as value from ft join st on ft.feature = st.feature",
    ),
    "shift_positive": (
        lambda s, d: _r(L.scale_features(_features(s, d).withColumn("value", F.col("value") - 1000), "positive"), ("rx", "ry", "feature"), "value"),
        f"with {FEATURE_SQL}, st as (select feature, min(value) - 1000 as lo from ft group by feature) select rx, ry, ft.feature, round(value - 1000 - least(lo, 0), 6) as value from ft join st on ft.feature = st.feature",
    ),
    "feature_mean": (lambda s, d: _r(_features(s, d).groupBy("feature").agg(F.avg("value").alias("value")), ("feature",), "value"), f"with {FEATURE_SQL} select feature, round(avg(value), 6) as value from ft group by feature"),
    "feature_max": (lambda s, d: _r(_features(s, d).groupBy("feature").agg(F.max("value").alias("value")), ("feature",), "value"), f"with {FEATURE_SQL} select feature, round(max(value), 6) as value from ft group by feature"),
    "scale_ordered": (
        lambda s, d: _r(V.scaled(_image(s, d), "ordered", 0.05, 0.95), ("rx", "ry"), "value"),
        f"with {SORTED_SQL}, lm as (select max(case when k = round_even((n - 1) * 0.05::double, 0) then value end) as lo, max(case when k = round_even((n - 1) * 0.95::double, 0) then value end) as hi from so) select rx, ry, round(least(greatest((value - lo) / (hi - lo), 0), 1), 6) as value from im, lm",
    ),
    "scale_full": (
        lambda s, d: _r(V.scaled(_image(s, d), "ordered:full"), ("rx", "ry"), "value"),
        f"with {IMAGE_SQL} select rx, ry, round((row_number() over (order by value, rx, ry) - 1)::double / (count(*) over () - 1), 6) as value from im",
    ),
    "scale_log": (
        lambda s, d: _r(V.scaled(_image(s, d), "minmax:log"), ("rx", "ry"), "value"),
        f"with {IMAGE_SQL}, lo as (select rx, ry, ln(greatest(value, 1e-12)) as v from im) select rx, ry, round((v - min(v) over ()) / (max(v) over () - min(v) over ()), 6) as value from lo",
    ),
    "scale_power": (
        lambda s, d: _r(V.scaled(_image(s, d), "minmax:power", power=0.25), ("rx", "ry"), "value"),
        f"with {IMAGE_SQL}, lo as (select rx, ry, sign(value) * abs(value) ** 0.25::double as v from im) select rx, ry, round((v - min(v) over ()) / (max(v) over () - min(v) over ()), 6) as value from lo",
    ),
    "scale_std": (
        lambda s, d: _r(V.scaled(_image(s, d), "std", -1.0, 1.0), ("rx", "ry"), "value"),
        f"with {IMAGE_SQL}, lm as (select median(value) - stddev_pop(value) as lo, median(value) + stddev_pop(value) as hi from im) select rx, ry, round(least(greatest((value - lo) / (hi - lo), 0), 1), 6) as value from im, lm",
    ),
    "histogram": (
        lambda s, d: V.histogram(_image(s, d), 16),
        f"with {IMAGE_SQL}, lm as (select min(value) as lo, max(value) as hi from im), b as (select least(floor((value - lo) / (hi - lo) * 16), 15)::bigint as bin from im, lm) select i as bin, count(bin) as n from range(16) as r(i) left join b on bin = i group by i",
    ),
    "orientation_hist": (
        lambda s, d: _r(O.orientation_histogram(peaks(s, d), (26.0, 27.0), [(3.0, 9.0), (8.0, 14.0)], 15.0), ("range", "x", "y", "theta"), "value"),
        f"""with {PEAKS_SQL}, g(k, a, c) as (values (0::bigint, 3, 9), (1, 8, 14)),
s as (select g.k as range, rx, ry, intensity as i, degrees(atan2(qy - 27 + 0.0::double, qx - 26)) / 15 as t from b join g on sqrt((qx - 26) ** 2 + (qy - 27) ** 2) >= a and sqrt((qx - 26) ** 2 + (qy - 27) ** 2) < c),
f as (select range, rx as x, ry as y, (floor(t)::bigint + e + 24) % 12 as theta, i * case e when 1 then t - floor(t) else 1 - (t - floor(t)) end as w from s, (values (0), (1)) as v(e))
select range, x, y, theta, round(sum(w), 6) as value from f where w <> 0 group by all""",
    ),
    "com_normalized": (
        lambda s, d: _r(H.normalized_com(_com(s, d), scale=0.5), ("rx", "ry"), "com_x", "com_y"),
        f"""with {COM_SQL}, m as (select avg(rx) as ax, avg(ry) as ay, avg(com_x) as av_com_x, avg(com_y) as av_com_y from co),
q as (select sum((rx - ax) ** 2) as sxx, sum((ry - ay) ** 2) as syy, sum((rx - ax) * (ry - ay)) as sxy, sum((rx - ax) * com_x) as sx_com_x, sum((ry - ay) * com_x) as sy_com_x, sum((rx - ax) * com_y) as sx_com_y, sum((ry - ay) * com_y) as sy_com_y from co, m)
select rx, ry, round(({_plane_sql("com_x")}) / 2, 6) + 0 as com_x, round(({_plane_sql("com_y")}) / 2, 6) + 0 as com_y from co, m, q""",
    ),
    "com_rotation_curl": (
        lambda s, d: _r(H.rotation_search(_com(s, d), ANGLES), ("angle", "transpose"), "score"),
        f"""with {COM_SQL}, d as (select a.rx, a.ry, (e.com_x - w.com_x) / 2 as xa, (n.com_x - s.com_x) / 2 as xb, (e.com_y - w.com_y) / 2 as ya, (n.com_y - s.com_y) / 2 as yb
 from co a join co e on e.rx = a.rx + 1 and e.ry = a.ry join co w on w.rx = a.rx - 1 and w.ry = a.ry join co n on n.rx = a.rx and n.ry = a.ry + 1 join co s on s.rx = a.rx and s.ry = a.ry - 1),
o(angle, transpose) as (select x, y from (values {", ".join(f"({a}::double)" for a in ANGLES)}) as u(x), (values (false), (true)) as v(y)),
u as (select angle, transpose, cos(radians(angle)) as c, sin(radians(angle)) as z, case when transpose then ya else xa end as pa, case when transpose then yb else xb end as pb, case when transpose then xa else ya end as qa, case when transpose then xb else yb end as qb from d, o)
select angle, transpose, round(avg(abs((z * pa + c * qa) - (c * pb - z * qb))), 6) as score from u group by angle, transpose""",
    ),
    "com_curl": (
        lambda s, d: _r(H.curl_windows(_com(s, d)), ("rx", "ry"), "curl"),
        f"with {COM_SQL}, w as (select rx, ry, (lead(com_y) over (partition by ry order by rx) - lag(com_y) over (partition by ry order by rx)) / 2 - (lead(com_x) over (partition by rx order by ry) - lag(com_x) over (partition by rx order by ry)) / 2 as curl from co) select rx, ry, round(curl, 6) + 0 as curl from w where curl is not null",
    ),
    "patch_scatter": (
        lambda s, d: _r(H.patch_sum(pixels(frames(s, d)).withColumn("x0", F.col("rx") * 3 - 5).withColumn("y0", F.col("ry") * 2 - 3), 32, 32, "x0", "y0"), ("x", "y"), "value"),
        f"with {PIXELS_SQL} select (qx + rx * 3 - 5 + 320) % 32 as x, (qy + ry * 2 - 3 + 320) % 32 as y, round(sum(i), 6) as value from p group by all",
    ),
    "radial_profile_1d": (
        lambda s, d: _r(H.radial_shells(C.virtual_diffraction(frames(s, d)), 8, 8), ("ring",), "value", "n"),
        f"""with {PIXELS_SQL}, m as (select qx, qy, avg(i) as v from p group by qx, qy), r as (select v, sqrt((case when qx < 4 then qx else qx - 8 end) ** 2 + (case when qy < 4 then qy else qy - 8 end) ** 2) as r from m),
s as (select floor(r)::bigint as ring, v, 1 - (r - floor(r)) as w from r union all select floor(r)::bigint + 1, v, r - floor(r) from r)
select ring, round(sum(v * w) / sum(w), 6) as value, round(sum(w), 6) as n from s where w > 0 group by ring""",
    ),
    "fft_corr_small": (
        lambda s, d: _r(H.small_correlation(pixels(frames(s, d)), C.virtual_diffraction(frames(s, d)), 8, 8), ("rx", "ry", "sx", "sy"), "value"),
        f"with {PIXELS_SQL}, t as (select qx as bx, qy as b_y, avg(i) as t from p group by qx, qy) select rx, ry, (qx - bx + 8) % 8 as sx, (qy - b_y + 8) % 8 as sy, round(sum(i * t), 6) as value from p, t group by all",
    ),
}
