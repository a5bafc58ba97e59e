"""Queries over peak lists: calibration, histograms, strain, dark field, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lattiq.functions.columns import axes_to_ellipse, ellipse_to_axes, interaction, wavelength
from lattiq.model import COUNTED_SQL, PEAKS_SQL, PIXELS_SQL, Calibration, counted, frames, peaks, pixels, rounded
from lattiq.operators import cube as C
from lattiq.operators import darkfield as D
from lattiq.operators import peaks as P
from lattiq.operators import strain as S

CENTER = (26.0, 27.0)
G1, G2 = (7.0, 0.6), (-0.4, 6.5)
CAL = Calibration(q_pixel_size=0.02, q_pixel_units="A^-1", a=1.1, b=1.0, theta=0.4, qr_rotation=0.3, qr_flip=True)
XX, XY, YY = CAL.ellipse_matrix()
COS, SIN = math.cos(0.3), math.sin(0.3)
KEYS = ("rx", "ry")

CENTERED_SQL = f"""{PEAKS_SQL},
k as (select rx, ry, qx - (32 + 0.1::double * rx - 0.05::double * ry) as x, qy - (30 - 0.02::double * rx + 0.03::double * ry) as y, intensity from b)"""
CAL_SQL = f"""{CENTERED_SQL},
e as (select rx, ry, {XX!r}::double * x + {XY!r}::double * y as x, {XY!r}::double * x + {YY!r}::double * y as y, intensity from k),
m as (select rx, ry, x * 0.02::double as x, y * 0.02::double as y, intensity from e),
f as (select rx, ry, {COS!r}::double * y - {SIN!r}::double * x as qx, {SIN!r}::double * y + {COS!r}::double * x as qy, intensity from m)"""


def _scan_origin():
    return 32 + 0.1 * F.col("rx") - 0.05 * F.col("ry"), 30 - 0.02 * F.col("rx") + 0.03 * F.col("ry")


def _peak_rows(df):
    return df.select("rx", "ry", rounded("qx").alias("qx"), rounded("qy").alias("qy"), rounded("intensity").alias("intensity"))


def _cal(**steps):
    return lambda s, d: _peak_rows(P.calibrated(peaks(s, d), CAL, _scan_origin(), **{k: steps.get(k, False) for k in ("center", "ellipse", "pixel", "rotate")}))


PEAK_OUT = "select rx, ry, round({x}, 6) + 0 as qx, round({y}, 6) + 0 as qy, round(intensity, 6) as intensity from {t}"
ROWS = "select rx, ry, round(qx, 6) as qx, round(qy, 6) as qy, round(intensity, 6) as intensity from"


def _hist(df, digits=4):
    """Raw values are sums of decimals of 8 or 9 digits, which a rounding to so many keeps apart from ties."""
    return df.select("qx", "qy", rounded("value", digits).alias("value"))


def _hist_sql(ctes: str, source: str, x: str, y: str, n: int, digits: int = 4) -> str:
    return f"""with {ctes},
h as (select {x} as x, {y} as y, intensity as i from {source}),
u as (select x - floor(x) as dx, y - floor(y) as dy, floor(x)::bigint as x, floor(y)::bigint as y, i from h where floor(x) >= 0 and floor(y) >= 0 and ceil(x) < {n} and ceil(y) < {n}),
v as (select x as qx, y as qy, i * (1 - dx) * (1 - dy) as w from u union all select x, y + 1, i * (1 - dx) * dy from u
      union all select x + 1, y, i * dx * (1 - dy) from u union all select x + 1, y + 1, i * dx * dy from u),
w as (select qx, qy, sum(w) as value from v group by qx, qy), g as (select x as qx, y as qy from range({n}) as x(x), range({n}) as y(y))
select g.qx, g.qy, round(coalesce(value, 0), {digits}) as value from g left join w on g.qx = w.qx and g.qy = w.qy"""


def _origin(how):
    return lambda s, d: P.measure_origin(peaks(s, d), CENTER, how).select("rx", "ry", rounded("qx0").alias("qx0"), rounded("qy0").alias("qy0"))


def _origin_sql(score: str) -> str:
    return f"""with {PEAKS_SQL}, s as (select *, (qx - 26) ** 2 + (qy - 27) ** 2 as d2 from b),
r as (select *, row_number() over (partition by rx, ry order by {score}, qx, qy, intensity) as n from s)
select rx, ry, round(qx, 6) as qx0, round(qy, 6) as qy0 from r where n = 1"""


def _measured(s, d):
    return P.measure_origin(peaks(s, d), CENTER, "distance")


MEASURED_SQL = f"""{PEAKS_SQL}, s as (select *, (qx - 26) ** 2 + (qy - 27) ** 2 as d2 from b),
r as (select *, row_number() over (partition by rx, ry order by d2, qx, qy, intensity) as n from s),
o as (select rx, ry, qx as qx0, qy as qy0 from r where n = 1)"""


def _fit(model):
    def query(s, d):
        _, out = P.fit_surface(_measured(s, d), ["qx0", "qy0"], model)
        return out.select("rx", "ry", rounded("qx0_fit", 5).alias("qx0_fit"), rounded("qy0_fit", 5).alias("qy0_fit"))

    return query


def _plane(v: str) -> str:
    """Least-squares plane of v at (rx, ry) by centred moments."""
    return f"""a{v} + ((sxv{v} * syy - syv{v} * sxy) * (rx - ax) + (syv{v} * sxx - sxv{v} * sxy) * (ry - ay)) / nullif(sxx * syy - sxy * sxy, 0)"""


FIT_PLANE_SQL = f"""with {MEASURED_SQL},
c as (select avg(rx) as ax, avg(ry) as ay, avg(qx0) as a1, avg(qy0) as a2 from o),
q as (select sum((rx - ax) ** 2) as sxx, sum((ry - ay) ** 2) as syy, sum((rx - ax) * (ry - ay)) as sxy,
             sum((rx - ax) * (qx0 - a1)) as sxv1, sum((ry - ay) * (qx0 - a1)) as syv1, sum((rx - ax) * (qy0 - a2)) as sxv2, sum((ry - ay) * (qy0 - a2)) as syv2 from o, c)
select rx, ry, round({_plane("1")}, 5) as qx0_fit, round({_plane("2")}, 5) as qy0_fit from o, c, q"""


def _universal(metric):
    return lambda s, d: _peak_rows(P.universal_threshold(peaks(s, d), 0.9, metric))


def _universal_sql(f: str) -> str:
    return f"with {PEAKS_SQL}, t as (select max(intensity) as top from b group by rx, ry), c as (select {f}(top) as cut from t) {ROWS} b, c where intensity > cut * 0.9::double"


def _maxima(subpixel, digits=6):
    def query(s, d):
        out = P.maxima(pixels(frames(s, d)), ["rx", "ry"], subpixel=subpixel)
        return out.select("rx", "ry", rounded("qx", digits).alias("qx"), rounded("qy", digits).alias("qy"), rounded("intensity").alias("intensity"))

    return query


MAXIMA_SQL = f"""with {PIXELS_SQL},
n as (select a.rx, a.ry, a.qx, a.qy, a.i, count(*) as n,
   max(case when b.qx > a.qx and b.qy >= a.qy or b.qx = a.qx and b.qy > a.qy or b.qx < a.qx and b.qy > a.qy then b.i end) as hi,
   max(case when not (b.qx > a.qx and b.qy >= a.qy or b.qx = a.qx and b.qy > a.qy or b.qx < a.qx and b.qy > a.qy) then b.i end) as lo,
   max(case when b.qx = a.qx + 1 and b.qy = a.qy then b.i end) as xp, max(case when b.qx = a.qx - 1 and b.qy = a.qy then b.i end) as xm,
   max(case when b.qx = a.qx and b.qy = a.qy + 1 then b.i end) as yp, max(case when b.qx = a.qx and b.qy = a.qy - 1 then b.i end) as ym
 from p a join p b on a.rx = b.rx and a.ry = b.ry and abs(a.qx - b.qx) <= 1 and abs(a.qy - b.qy) <= 1 and (a.qx <> b.qx or a.qy <> b.qy)
 group by all)
select rx, ry, {{x}} as qx, {{y}} as qy, round(i, 6) as intensity from n where n = 8 and i >= hi and i > lo"""


def _indexed(s, d):
    return S.index_peaks(peaks(s, d), CENTER, G1, G2, 1.97)


INDEXED_SQL = f"""{PEAKS_SQL},
l as (select h, k, 26 + h * {G1[0]}::double + k * {G2[0]}::double as lx, 27 + h * {G1[1]}::double + k * {G2[1]}::double as ly from range(-6, 7) as x(h), range(-6, 7) as y(k)),
j as (select b.*, h, k, (qx - lx) ** 2 + (qy - ly) ** 2 as d2 from b join l on abs(qx - lx) <= 2 and abs(qy - ly) <= 2),
x as (select * from j where d2 <= 1.97::double ** 2)"""
FIT_SQL = f"""{INDEXED_SQL},
w as (select *, intensity ** 2 as w from x),
m as (select rx, ry, count(*) as n, sum(w) as s, sum(w * h) as sh, sum(w * k) as sk, sum(w * h * h) as shh, sum(w * h * k) as shk, sum(w * k * k) as skk,
   sum(w * qx) as sx, sum(w * h * qx) as shx, sum(w * k * qx) as skx, sum(w * qy) as sy, sum(w * h * qy) as shy, sum(w * k * qy) as sky from w group by rx, ry having count(*) >= 5),
d as (select *, s * (shh * skk - shk * shk) - sh * (sh * skk - shk * sk) + sk * (sh * shk - shh * sk) as det from m),
f as (select rx, ry,
   (sx * (shh * skk - shk * shk) - sh * (shx * skk - shk * skx) + sk * (shx * shk - shh * skx)) / det as x0,
   (sy * (shh * skk - shk * shk) - sh * (shy * skk - shk * sky) + sk * (shy * shk - shh * sky)) / det as y0,
   (s * (shx * skk - shk * skx) - sx * (sh * skk - shk * sk) + sk * (sh * skx - shx * sk)) / det as g1x,
   (s * (shy * skk - shk * sky) - sy * (sh * skk - shk * sk) + sk * (sh * sky - shy * sk)) / det as g1y,
   (s * (shh * skx - shx * shk) - sh * (sh * skx - shx * sk) + sx * (sh * shk - shh * sk)) / det as g2x,
   (s * (shh * sky - shy * shk) - sh * (sh * sky - shy * sk) + sy * (sh * shk - shh * sk)) / det as g2y from d)"""
STRAIN_SQL = f"""{FIT_SQL},
r as (select median(g1x) as a, median(g1y) as b, median(g2x) as c, median(g2y) as d from f),
t as (select rx, ry, (d * g1x - b * g2x) / (a * d - b * c) as xx, (d * g1y - b * g2y) / (a * d - b * c) as xy,
      (a * g2x - c * g1x) / (a * d - b * c) as yx, (a * g2y - c * g1y) / (a * d - b * c) as yy from f, r),
z as (select rx, ry, 1 - xx as e_xx, 1 - yy as e_yy, -(xy + yx) / 2 as e_xy, (yx - xy) / 2 as theta from t)"""


def _strain(s, d):
    fit = S.fit_lattice(_indexed(s, d), error=False)
    return S.strain(fit, S.reference(fit))


def _strain_rows(df):
    return df.select("rx", "ry", *[rounded(c).alias(c) for c in ("e_xx", "e_yy", "e_xy", "theta")])


A = math.atan2(1.0, 2.0)
CA, SA = math.cos(A), math.sin(A)
MASKED = [(x, y) for x in range(64) for y in range(64) if (x * 7 + y * 3) % 5 == 0]


def _masked(s):
    return C.grid(s, 64, 64).where((F.col("qx") * 7 + F.col("qy") * 3) % 5 == 0)


def _apertures(s):
    return D.apertures(s, "array", G1, G2, CENTER, (-4, 4), (-4, 4), (0.25, -0.5), (3.0, 30.0), 2.0, (64, 64))


APERTURES_SQL = f"""l as (select i, j, (i + 0.25::double) * {G1[0]}::double + (j - 0.5::double) * {G2[0]}::double as vx, (i + 0.25::double) * {G1[1]}::double + (j - 0.5::double) * {G2[1]}::double as vy from range(-4, 5) as x(i), range(-4, 5) as y(j)),
a as (select i, j, vx + 26 as x, vy + 27 as y from l where sqrt(vx * vx + vy * vy) between 3 and 30 and vx + 26 > 2 and vx + 26 < 62 and vy + 27 > 2 and vy + 27 < 62)"""


def _ellipses(s):
    n = s.range(1, 41)
    return n.select("id", (0.01 + 0.002 * F.col("id")).alias("A"), (0.001 * (F.col("id") % 7) - 0.003).alias("B"), (0.02 + 0.0005 * F.col("id")).alias("C"))


def _ellipse_convert(s, d):
    e = _ellipses(s)
    a, b, t = ellipse_to_axes(F.col("A"), F.col("B"), F.col("C"))
    e = e.select("id", a.alias("a_axis"), b.alias("b_axis"), t.alias("theta"))
    x, y, z = axes_to_ellipse(F.col("a_axis"), F.col("b_axis"), F.col("theta"))
    return e.select("id", rounded("a_axis").alias("a_axis"), rounded("b_axis").alias("b_axis"), rounded("theta").alias("theta"), rounded(x, 9).alias("form_a"), rounded(y, 9).alias("form_b"), rounded(z, 9).alias("form_c"))


def _choose_basis(s, d):
    m = P.maxima(P.histogram(peaks(s, d), 64, 64), [], "value")
    return S.choose_basis(m, CENTER).select(*[rounded(c).alias(c) for c in ("x0", "y0", "g1x", "g1y", "g2x", "g2y")])


def _dq(s, d):
    x = _indexed(s, d).where("h != 0 or k != 0").withColumn("l", F.lit(0)).withColumn("q", F.hypot(F.col("qx") - CENTER[0], F.col("qy") - CENTER[1]))
    return P.pixel_size_from_indexed(x, 4.05, ["rx", "ry"]).select("rx", "ry", rounded("dq", 7).alias("dq"))


def _nms(s, d):
    return _peak_rows(P.min_spacing(peaks(s, d), 6.0))


def _friedel(s, d):
    out = P.friedel_origin(peaks(s, d), CENTER, 4.0, 22.0, 1.5)
    return out.select("rx", "ry", rounded("qx0").alias("qx0"), rounded("qy0").alias("qy0"), "pairs")


W_SQL = "(rx % 3)::double / 2"
HAT = "(select rx, ry, sum(case when {c} then intensity else 0 end) as value from b group by rx, ry)"

QUERIES = {
    "cal_center": (_cal(center=True), f"with {CENTERED_SQL} " + PEAK_OUT.format(x="x", y="y", t="k")),
    "cal_ellipse": (_cal(center=True, ellipse=True), f"with {CAL_SQL} " + PEAK_OUT.format(x="x", y="y", t="e")),
    "cal_pixel": (_cal(pixel=True), f"with {PEAKS_SQL} " + PEAK_OUT.format(x="qx * 0.02::double", y="qy * 0.02::double", t="b")),
    "cal_rotate_flip": (_cal(rotate=True), f"with {PEAKS_SQL} " + PEAK_OUT.format(x=f"{COS!r}::double * qy - {SIN!r}::double * qx", y=f"{SIN!r}::double * qy + {COS!r}::double * qx", t="b")),
    "cal_full": (_cal(center=True, ellipse=True, pixel=True, rotate=True), f"with {CAL_SQL} " + PEAK_OUT.format(x="qx", y="qy", t="f")),
    "bvm_raw": (lambda s, d: _hist(P.histogram(peaks(s, d), 64, 64), 8), _hist_sql(PEAKS_SQL, "b", "qx", "qy", 64, 8)),
    "bvm_cal": (
        lambda s, d: _hist(P.histogram(P.calibrated(peaks(s, d), CAL, _scan_origin()), 128, 128, 2.0, (32.0, 31.0), 0.02)),
        _hist_sql(CAL_SQL, "f", "(qx / 0.02::double + 32) * 2", "(qy / 0.02::double + 31) * 2", 128),
    ),
    "bvm_weighted": (
        lambda s, d: _hist(P.histogram(P.weighted(peaks(s, d), peaks(s, d).select(*KEYS).distinct().withColumn("w", (F.col("rx") % 3) / 2.0), 0.2), 64, 64), 9),
        _hist_sql(PEAKS_SQL + f", y as (select qx, qy, intensity * {W_SQL} as intensity from b where {W_SQL} > 0.2)", "y", "qx", "qy", 64, 9),
    ),
    "bragg_vi_circle": (lambda s, d: P.peak_image(peaks(s, d), CENTER, 0.0, 9.0).select("rx", "ry", rounded("value", 6).alias("value")), f"with {PEAKS_SQL} select rx, ry, round(value, 6) as value from " + HAT.format(c="(qx - 26) ** 2 + (qy - 27) ** 2 < 81")),
    "bragg_vi_annulus": (
        lambda s, d: P.peak_image(peaks(s, d), CENTER, 5.0, 15.0).select("rx", "ry", rounded("value", 6).alias("value")),
        f"with {PEAKS_SQL} select rx, ry, round(value, 6) as value from " + HAT.format(c="(qx - 26) ** 2 + (qy - 27) ** 2 >= 25 and (qx - 26) ** 2 + (qy - 27) ** 2 < 225"),
    ),
    "mask_in_q": (lambda s, d: _peak_rows(P.mask_in_q(peaks(s, d), _masked(s))), f"with {PEAKS_SQL} {ROWS} b where (round_even(qx, 0)::bigint * 7 + round_even(qy, 0)::bigint * 3) % 5 <> 0"),
    "mask_in_r": (lambda s, d: _peak_rows(P.mask_in_r(peaks(s, d), peaks(s, d).where("(rx + ry) % 4 = 1").select(*KEYS).distinct())), f"with {PEAKS_SQL} {ROWS} b where (rx + ry) % 4 <> 1"),
    "origin_distance": (_origin("distance"), _origin_sql("d2")),
    "origin_intensity": (_origin("intensity"), _origin_sql("-intensity")),
    "origin_weighted": (_origin("intensity weighted distance"), _origin_sql("-intensity / (1 + d2)")),
    "fit_origin_constant": (_fit("constant"), f"with {MEASURED_SQL}, c as (select avg(qx0) as x, avg(qy0) as y from o) select rx, ry, round(x, 5) as qx0_fit, round(y, 5) as qy0_fit from o, c"),
    "fit_origin_plane": (_fit("plane"), FIT_PLANE_SQL),
    "fit_origin_parabola": (_fit("parabola"), None),
    "universal_threshold_max": (_universal("maximum"), _universal_sql("max")),
    "universal_threshold_mean": (_universal("average"), _universal_sql("avg")),
    "universal_threshold_median": (_universal("median"), _universal_sql("median")),
    "relative_threshold": (
        lambda s, d: _peak_rows(P.relative_threshold(peaks(s, d), 0.95, 3)),
        f"with {PEAKS_SQL}, r as (select *, nth_value(intensity, 4) over (partition by rx, ry order by intensity desc, qx desc, qy desc rows between unbounded preceding and unbounded following) as ref from b) {ROWS} r where intensity > ref * 0.95::double",
    ),
    "top_n_peaks": (
        lambda s, d: P.brightest(peaks(s, d), 20).select("rx", "ry", "rank", rounded("qx").alias("qx"), rounded("qy").alias("qy"), rounded("intensity").alias("intensity")),
        f"with {PEAKS_SQL}, r as (select *, row_number() over (partition by rx, ry order by intensity desc, qx desc, qy desc) as rank from b) select rx, ry, rank, round(qx, 6) as qx, round(qy, 6) as qy, round(intensity, 6) as intensity from r where rank <= 20",
    ),
    "peak_intensities": (lambda s, d: peaks(s, d).select("rx", "ry", rounded("intensity").alias("intensity")), f"with {PEAKS_SQL} select rx, ry, round(intensity, 6) as intensity from b"),
    "nms_spacing": (_nms, None),
    "friedel_center": (_friedel, None),
    "maxima_pixel": (_maxima(False), MAXIMA_SQL.format(x="qx::double", y="qy::double")),
    "maxima_poly": (_maxima(True), MAXIMA_SQL.format(x="round(qx + (xp - xm) / (4 * i - 2 * xp - 2 * xm), 6)", y="round(qy + (yp - ym) / (4 * i - 2 * yp - 2 * ym), 6)")),
    "electron_count": (
        lambda s, d: P.electron_count(pixels(frames(s, d)), 0.08, 0.4).select("rx", "ry", "qx", "qy", rounded("i").alias("i")),
        f"""with {PIXELS_SQL}, k as (select rx, ry, qx, qy, i from p where i > 0.08 and i < 0.4),
n as (select a.rx, a.ry, a.qx, a.qy, max(b.i) as hi from k a join k b on a.rx = b.rx and a.ry = b.ry and abs(a.qx - b.qx) <= 1 and abs(a.qy - b.qy) <= 1 and (a.qx <> b.qx or a.qy <> b.qy) group by all)
select k.rx, k.ry, k.qx, k.qy, round(i, 6) as i from k left join n on k.rx = n.rx and k.ry = n.ry and k.qx = n.qx and k.qy = n.qy where hi is null or i > hi""",
    ),
    "counting_thresholds": (
        lambda s, d: s.createDataFrame([P.counting_thresholds(pixels(frames(s, d)), 2.0, 6.0)], "background double, xray double").select(rounded("background").alias("background"), rounded("xray").alias("xray")),
        f"with {PIXELS_SQL} select round(avg(i) + 2 * stddev_pop(i), 6) as background, round(avg(i) + 6 * stddev_pop(i), 6) as xray from p",
    ),
    "counted_to_cube": (
        lambda s, d: (lambda p: C.grid(s, 64, 64).join(p.groupBy(F.col("qx").cast("long").alias("qx"), F.col("qy").cast("long").alias("qy")).agg(F.sum("intensity").alias("i")), ["qx", "qy"], "left").select("qx", "qy", rounded(F.coalesce("i", F.lit(0.0)), 4).alias("i")))(counted(s, d)),
        f"with {COUNTED_SQL}, s as (select qx, qy, sum(intensity) as i from c group by qx, qy) select x as qx, y as qy, round(coalesce(i, 0), 4) as i from range(64) as x(x) cross join range(64) as y(y) left join s on x = qx and y = qy",
    ),
    "pixels_off_peaks": (
        lambda s, d: C.pixels_off_peaks(counted(s, d).select(*KEYS).distinct().crossJoin(F.broadcast(C.grid(s, 8, 8).select((F.col("qx") * 8).alias("qx"), (F.col("qy") * 8).alias("qy")))), counted(s, d), 4.0).select("rx", "ry", "qx", "qy"),
        f"with {COUNTED_SQL}, g as (select rx, ry, x * 8 as qx, y * 8 as qy from (select distinct rx, ry from c), range(8) as x(x), range(8) as y(y)) select g.* from g where not exists (select 1 from c where c.rx = g.rx and c.ry = g.ry and (g.qx - c.qx) ** 2 + (g.qy - c.qy) ** 2 <= 16)",
    ),
    "ellipse_convert": (
        _ellipse_convert,
        """with e as (select i as id, 0.01::double + 0.002::double * i as a, 0.001::double * (i % 7) - 0.003::double as b, 0.02::double + 0.0005::double * i as c from range(1, 41) as r(i)),
t as (select *, (a + c) / 2 as m, sqrt((a - c) * (a - c) / 4 + b * b / 4) as r, atan2(-b + 0.0::double, c - a) / 2 as theta from e)
select id, round(1 / sqrt(m - r), 6) as a_axis, round(1 / sqrt(m + r), 6) as b_axis, round(theta, 6) + 0 as theta, round(a, 9) as form_a, round(b, 9) + 0 as form_b, round(c, 9) as form_c from t""",
    ),
    "dq_fit": (
        _dq,
        f"with {INDEXED_SQL} select rx, ry, round(1 / (sum(sqrt((qx - 26) ** 2 + (qy - 27) ** 2) * sqrt(h * h + k * k)) / sum(h * h + k * k) * 4.05), 7) as dq from x where h <> 0 or k <> 0 group by rx, ry",
    ),
    "wavelength": (
        lambda s, d: s.range(1, 11).select((F.col("id") * 30000).alias("volts"), rounded(wavelength(F.col("id") * 30000), 9).alias("wavelength"), rounded(interaction(F.col("id") * 30000), 9).alias("sigma")),
        """with c as (select 6.62607015e-34::double as h, 9.1093837015e-31::double as m, 1.602176634e-19::double as e, 299792458.0::double as c, i * 30000 as v from range(1, 11) as r(i)),
l as (select *, h * 1e10 / sqrt(2 * m * e * v * (1 + e * v / (2 * m * c * c))) as lam from c)
select v as volts, round(lam, 9) as wavelength, round(2 * pi() / (lam * v) * (m * c * c + e * v) / (2 * m * c * c + e * v), 9) as sigma from l""",
    ),
    "choose_basis": (
        _choose_basis,
        _hist_sql(PEAKS_SQL, "b", "qx", "qy", 64).replace("select g.qx, g.qy, round(coalesce(value, 0), 4) as value from g left join w on g.qx = w.qx and g.qy = w.qy", "")
        + """, z as (select g.qx, g.qy, coalesce(value, 0) as i from g left join w on g.qx = w.qx and g.qy = w.qy),
n as (select a.qx, a.qy, a.i, count(*) as n,
   max(case when b.qx > a.qx and b.qy >= a.qy or b.qx = a.qx and b.qy > a.qy or b.qx < a.qx and b.qy > a.qy then b.i end) as hi,
   max(case when not (b.qx > a.qx and b.qy >= a.qy or b.qx = a.qx and b.qy > a.qy or b.qx < a.qx and b.qy > a.qy) then b.i end) as lo
 from z a join z b on abs(a.qx - b.qx) <= 1 and abs(a.qy - b.qy) <= 1 and (a.qx <> b.qx or a.qy <> b.qy) group by all),
q as (select qx::double as x, qy::double as y, sqrt((qx - 26) ** 2 + (qy - 27) ** 2) as d, atan2(qy - 27::double, qx - 26::double) as a from n where n = 8 and i >= hi and i > lo),
r as (select *, row_number() over (order by d, x, y) as k from q),
o as (select x as x0, y as y0 from r where k = 1), o1 as (select x as x1, y as y1, a as a1 from r where k = 2),
o2 as (select x as x2, y as y2 from r, o1 where k > 2 order by d * (cos(a - a1) ** 2 + 0.1::double), x, y limit 1)
select round(x0, 6) as x0, round(y0, 6) as y0, round(x1 - x0, 6) + 0 as g1x, round(y1 - y0, 6) + 0 as g1y, round(x2 - x0, 6) + 0 as g2x, round(y2 - y0, 6) + 0 as g2y from o, o1, o2""",
    ),
    "index_directions": (
        lambda s, d: S.index_directions(peaks(s, d), CENTER, G1, G2).select("rx", "ry", rounded("qx").alias("qx"), rounded("qy").alias("qy"), "h", "k"),
        f"with {PEAKS_SQL}, c as (select {G1[0] * G2[1] - G1[1] * G2[0]!r}::double as det) select rx, ry, round(qx, 6) as qx, round(qy, 6) as qy, round_even(((qx - 26) * {G2[1]}::double - (qy - 27) * {G2[0]}::double) / det, 0)::bigint as h, round_even(((qy - 27) * {G1[0]}::double - (qx - 26) * {G1[1]}::double) / det, 0)::bigint as k from b, c",
    ),
    "index_peaks": (lambda s, d: _indexed(s, d).select("rx", "ry", rounded("qx").alias("qx"), rounded("qy").alias("qy"), "h", "k"), f"with {INDEXED_SQL} select rx, ry, round(qx, 6) as qx, round(qy, 6) as qy, h, k from x"),
    "lattice_fit": (
        lambda s, d: S.fit_lattice(_indexed(s, d)).select("rx", "ry", *[rounded(c, 5).alias(c) for c in ("x0", "y0", "g1x", "g1y", "g2x", "g2y", "error")]),
        f"""with {FIT_SQL}, e as (select x.rx, x.ry, sum(intensity * sqrt((qx - x0 - h * g1x - k * g2x) ** 2 + (qy - y0 - h * g1y - k * g2y) ** 2)) / sum(intensity) as error from x join f on x.rx = f.rx and x.ry = f.ry group by all)
select f.rx, f.ry, {", ".join(f"round({c}, 5) as {c}" for c in ("x0", "y0", "g1x", "g1y", "g2x", "g2y", "error"))} from f join e on f.rx = e.rx and f.ry = e.ry""",
    ),
    "reference_g": (
        lambda s, d: S.reference(S.fit_lattice(_indexed(s, d), error=False)).select(*[rounded(c, 5).alias(c) for c in ("r_g1x", "r_g1y", "r_g2x", "r_g2y")]),
        f"with {FIT_SQL} select round(median(g1x), 5) as r_g1x, round(median(g1y), 5) as r_g1y, round(median(g2x), 5) as r_g2x, round(median(g2y), 5) as r_g2y from f",
    ),
    "strain": (lambda s, d: _strain_rows(_strain(s, d)), f"with {STRAIN_SQL} select rx, ry, {', '.join(f'round({c}, 6) + 0 as {c}' for c in ('e_xx', 'e_yy', 'e_xy', 'theta'))} from z"),
    "strain_rotated": (
        lambda s, d: _strain_rows(S.rotate_strain(_strain(s, d), (2.0, 1.0), True)),
        f"""with {STRAIN_SQL} select rx, ry, round({CA * CA!r}::double * e_xx + {2 * CA * SA!r}::double * e_xy + {SA * SA!r}::double * e_yy, 6) + 0 as e_xx,
round({SA * SA!r}::double * e_xx - {2 * CA * SA!r}::double * e_xy + {CA * CA!r}::double * e_yy, 6) + 0 as e_yy,
round({CA * SA!r}::double * (e_yy - e_xx) + {CA * CA - SA * SA!r}::double * e_xy, 6) + 0 as e_xy, round(-theta, 6) + 0 as theta from z""",
    ),
    "set_hkl": (
        lambda s, d: S.set_hkl(_indexed(s, d), (2, 0, 0), (0, 2, -2)).select("rx", "ry", "h", "k", "miller_h", "miller_k", "miller_l"),
        f"with {INDEXED_SQL} select rx, ry, h, k, 2 * h as miller_h, 2 * k as miller_k, -2 * k as miller_l from x",
    ),
    "point_list": (
        lambda s, d: D.point_list(peaks(s, d), CENTER).select("rx", "ry", rounded("qx").alias("qx"), rounded("qy").alias("qy"), rounded("r").alias("r"), rounded("phi").alias("phi")),
        f"with {PEAKS_SQL} select rx, ry, round(qx - 26, 6) + 0 as qx, round(qy - 27, 6) + 0 as qy, round(sqrt((qx - 26) ** 2 + (qy - 27) ** 2), 6) as r, round(degrees(atan2(-(qx - 26) + 0.0::double, qy - 27)), 6) + 0 as phi from b",
    ),
    "apertures_array": (lambda s, d: _apertures(s).select("i", "j", rounded("x").alias("x"), rounded("y").alias("y")), f"with {APERTURES_SQL} select i, j, round(x, 6) as x, round(y, 6) as y from a"),
    "apertures_subtract": (
        lambda s, d: D.subtract(_apertures(s), D.apertures(s, "array", (9.0, 0.0), (0.0, 9.0), CENTER, (-3, 3), (-3, 3)), 2.5).select("i", "j", rounded("x").alias("x"), rounded("y").alias("y")),
        f"with {APERTURES_SQL}, o as (select 26 + 9 * p as x, 27 + 9 * q as y from range(-3, 4) as x(p), range(-3, 4) as y(q)) select i, j, round(x, 6) as x, round(y, 6) as y from a where not exists (select 1 from o where (a.x - o.x) ** 2 + (a.y - o.y) ** 2 <= 6.25)",
    ),
    "ddf_image": (
        lambda s, d: D.image(peaks(s, d), _apertures(s), 1.5).select("rx", "ry", rounded("value", 6).alias("value")),
        f"with {PEAKS_SQL}, {APERTURES_SQL} select rx, ry, round(sum(intensity), 6) as value from b join a on (qx - x) ** 2 + (qy - y) ** 2 <= 2.25 group by rx, ry",
    ),
    "ddf_radial": (
        lambda s, d: D.radial_image(D.point_list(peaks(s, d), CENTER), 12.0, 1.0).select("rx", "ry", rounded("value", 6).alias("value")),
        f"with {PEAKS_SQL} select rx, ry, round(sum(intensity), 6) as value from b where abs(sqrt((qx - 26) ** 2 + (qy - 27) ** 2) - 12) <= 1 group by rx, ry",
    ),
}
