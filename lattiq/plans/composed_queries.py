"""Queries that compose operators: optics, masks, polar forms, class editing, strain from peaks, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattiq.functions.columns import rotate
from lattiq.model import COUNTED_SQL, PEAKS_SQL, PIXELS_SQL, counted, frames, peaks, pixels, rounded
from lattiq.operators import classify as L
from lattiq.operators import crystal as X
from lattiq.operators import cube as C
from lattiq.operators import peaks as P
from lattiq.operators import polar as R
from lattiq.operators import probes as B
from lattiq.operators import rings as G
from lattiq.operators import strain as S
from lattiq.plans.peak_queries import CENTER, G1, G2, MAXIMA_SQL, STRAIN_SQL
from lattiq.plans.polar_queries import FEATURE_SQL, MID, POLAR_SQL, RADIAL_SQL, SPEC, U, W_

LAM = X.wavelength(200e3)
ABERRATIONS = {(1, 0): (-80.0, 0.0), (1, 2): (30.0, 0.4), (2, 1): (900.0, -0.3), (2, 3): (700.0, 0.9), (3, 0): (12000.0, 0.0)}
ELLIPTIC = R.PolarSpec(0.0, 4.0, 1.0, 180, ellipse=(1.1, 1.0, 0.3))


def _r(df, keys, *values, digits=6):
    return df.select(*keys, *[rounded(v, digits).alias(v) for v in values])


# ----- probe-forming optics on a literal grid of angles


def _angles(s):
    x, y = (F.col("qx") - 16) * 0.0015, (F.col("qy") - 16) * 0.0015
    return C.grid(s, 32, 32).withColumn("alpha", F.sqrt(x * x + y * y)).withColumn("phi", F.atan2(y, x))


ANGLES_SQL = """ag as (select qx, qy, sqrt(((qx - 16) * 0.0015::double) ** 2 + ((qy - 16) * 0.0015::double) ** 2) as alpha,
  atan2((qy - 16) * 0.0015::double + 0.0::double, (qx - 16) * 0.0015::double) as phi from range(32) as x(qx), range(32) as y(qy))"""
CHI_SQL = f"{2 * math.pi / LAM!r}::double * (" + " + ".join(f"alpha ** {n + 1} * {size / (n + 1)!r}::double * cos({m} * (phi - {angle!r}::double))" for (n, m), (size, angle) in ABERRATIONS.items()) + ")"
ALONG_SQL = f"{2 * math.pi / LAM!r}::double * (" + " + ".join(f"alpha ** {n} * {size!r}::double * cos({m} * (phi - {angle!r}::double))" for (n, m), (size, angle) in ABERRATIONS.items()) + ")"
ACROSS_SQL = f"{2 * math.pi / LAM!r}::double * (" + " + ".join(f"alpha ** {n} * {-m * size / (n + 1)!r}::double * sin({m} * (phi - {angle!r}::double))" for (n, m), (size, angle) in ABERRATIONS.items()) + ")"


def _optics(s, d):
    a, p = F.col("alpha"), F.col("phi")
    out = _angles(s).select(
        "qx", "qy", B.phase_error(a, p, ABERRATIONS, LAM).alias("chi"), B.soft_aperture(a, 0.0201, 0.004).alias("aperture"),
        B.temporal_envelope(a, 40.0, LAM).alias("temporal"), B.gaussian_envelope(a, 0.8, LAM).alias("gaussian"),
        B.spatial_envelope(a, p, ABERRATIONS, 0.0005, LAM).alias("spatial"), B.contrast_transfer(a, p, ABERRATIONS, LAM).alias("transfer"),
    )
    return _r(out, ("qx", "qy"), "chi", "aperture", "temporal", "gaussian", "spatial", "transfer", digits=5)


OPTICS_SQL = f"""with {ANGLES_SQL}, ev as (select qx, qy, {CHI_SQL} as chi,
  case when alpha > 0.0201::double then 0 when alpha > 0.0201::double - 0.004::double then (1 + cos(pi() * (alpha - 0.0201::double + 0.004::double) / 0.004::double)) / 2 else 1 end as aperture,
  exp(-((0.5::double * pi() / {LAM!r}::double * 40 * alpha ** 2) ** 2)) as temporal, exp(-0.5::double * 0.8::double ** 2 * alpha ** 2 / {LAM!r}::double ** 2) as gaussian,
  exp(-(0.00025::double ** 2) * (({ALONG_SQL}) ** 2 + ({ACROSS_SQL}) ** 2)) as spatial from ag)
select qx, qy, round(chi, 5) + 0 as chi, round(aperture, 5) + 0 as aperture, round(temporal, 5) as temporal, round(gaussian, 5) as gaussian, round(spatial, 5) as spatial, round(sin(chi), 5) + 0 as transfer from ev"""


# ----- polar forms


def _view(give):
    return lambda s, d: R.polar_view(pixels(frames(s, d)), MID, SPEC, give, 0.4, 1.5)


MODES_SQL = f"""with {POLAR_SQL}, md as (select rx, ry, t, r, value, norm, norm * (2 * pi() / 12) as density, norm * (2 * pi() / 12) < 0.4 as mask, (r / 4.0::double) ** 1.5::double as scale from s)"""
GATHER_SQL = f"""{PIXELS_SQL}, gr as (select r, t, (r + 0.5::double) as rr, (t + 0.5::double) * 2 * pi() / 180 as tt from range(4) as a(r), range(180) as b(t)),
gx as (select r, 3.5::double + rr * cos(tt) * {math.cos(0.3)!r}::double - rr * {1 / 1.1!r}::double * sin(tt) * {math.sin(0.3)!r}::double as x,
              3.5::double + rr * cos(tt) * {math.sin(0.3)!r}::double + rr * {1 / 1.1!r}::double * sin(tt) * {math.cos(0.3)!r}::double as y from gr),
gh as (select r, x, y, least(floor(x), 6)::bigint as fx, least(floor(y), 6)::bigint as fy from gx where x >= 0 and y >= 0 and x <= 7 and y <= 7),
gw as (select r, fx + a as qx, fy + b as qy, sum((case a when 1 then x - fx else 1 - x + fx end) * (case b when 1 then y - fy else 1 - y + fy end)) as w from gh, (values (0), (1)) as u(a), (values (0), (1)) as v(b) group by all)"""


def _stop_sql() -> str:
    return """with gd as (select qx, qy, qx - 20 as x, qy - 12 as y from range(40) as a(qx), range(32) as b(qy)),
wd as (select qx, qy from gd where abs(((atan2(y + 0.0::double, x) - radians(350) + 3 * pi()) % (2 * pi())) - pi()) < radians(15)),
gw as (select distinct g.qx, g.qy from gd g join wd w on abs(g.qx - w.qx) + abs(g.qy - w.qy) <= 3)
select gd.qx, gd.qy, gw.qx is not null or sqrt(x * x + y * y) < 6.5::double as mask from gd left join gw on gd.qx = gw.qx and gd.qy = gw.qy"""


# ----- classes: events by type over positions and coarse detector bins


def _classes(s, d):
    kinds = counted(s, d).select("kind").distinct()  # a handful of event types
    numbered = kinds.select("kind", (F.row_number().over(W.orderBy("kind")) - 1).cast("long").alias("class"))
    c = counted(s, d).join(F.broadcast(numbered), "kind")
    spot = (F.floor(F.col("qx") / 16) * 4 + F.floor(F.col("qy") / 16)).alias("feature")
    return c.groupBy(spot, "class").agg(F.sum("intensity").alias("w")), c.groupBy("rx", "ry", "class").agg(F.sum("intensity").alias("h"))


CLASSES_SQL = f"""{COUNTED_SQL}, nk as (select kind, row_number() over (order by kind) - 1 as class from (select distinct kind from c)), ck as (select c.*, class from c join nk on c.kind = nk.kind),
sp as (select (floor(qx / 16) * 4 + floor(qy / 16))::bigint as feature, class, sum(intensity) as w from ck group by 1, 2), pl as (select rx, ry, class, sum(intensity) as h from ck group by 1, 2, 3)"""
NEXT = "case when class = 3 then 1 when class > 3 then class - 1 else class end"


def _candidates(s, d):
    spots, places = _classes(s, d)
    return _r(L.merge_candidates(spots, places, 16, places.select("rx", "ry").distinct().count(), 0.0, 0.0), ("a", "b"), "cc_w", "cc_h", "score")


def _corr_sql(t: str, keys: str, v: str) -> str:
    return f"(select a.class as a, b.class as b, corr(a.{v}, b.{v}) as cc from z{t} a join z{t} b on {keys} and a.class < b.class group by 1, 2)"


CANDIDATES_SQL = f"""with {CLASSES_SQL},
zs as (select f.feature, nk.class, coalesce(w, 0) as w from range(16) as f(feature) cross join nk left join sp on sp.feature = f.feature and sp.class = nk.class),
zp as (select f.rx, f.ry, nk.class, coalesce(h, 0) as h from (select distinct rx, ry from c) f cross join nk left join pl on pl.rx = f.rx and pl.ry = f.ry and pl.class = nk.class),
cw as {_corr_sql("s", "a.feature = b.feature", "w")}, ch as {_corr_sql("p", "a.rx = b.rx and a.ry = b.ry", "h")}
select cw.a, cw.b, round(cw.cc, 6) as cc_w, round(ch.cc, 6) as cc_h, round(cw.cc * ch.cc, 6) as score from cw join ch on cw.a = ch.a and cw.b = ch.b where cw.cc > 0 and ch.cc > 0"""


# ----- peaks


def _affine(s, d):
    p = peaks(s, d).select("rx", "ry", F.col("qx").alias("x"), F.col("qy").alias("y"), (1.02 * F.col("qx") - 0.1 * F.col("qy") + 3 + F.col("intensity") / 100).alias("u"), (0.07 * F.col("qx") + 0.95 * F.col("qy") - 2 - F.col("intensity") / 50).alias("v"))
    return _r(P.fit_affine(p, ["rx", "ry"]), ("rx", "ry"), *"abcdef", digits=5)


AFFINE_SQL = f"""with {PEAKS_SQL}, pq as (select rx, ry, qx as x, qy as y, 1.02::double * qx - 0.1::double * qy + 3 + intensity / 100 as u, 0.07::double * qx + 0.95::double * qy - 2 - intensity / 50 as v from b),
mo as (select rx, ry, avg(x) as mx, avg(y) as my_, avg(u) as mu, avg(v) as mv, var_pop(x) as xx, var_pop(y) as yy, covar_pop(x, y) as xy, covar_pop(x, u) as xu, covar_pop(x, v) as xv, covar_pop(y, u) as yu, covar_pop(y, v) as yv from pq group by rx, ry),
so as (select *, xx * yy - xy * xy as det from mo), af as (select *, (xu * yy - yu * xy) / det as a, (yu * xx - xu * xy) / det as b, (xv * yy - yv * xy) / det as d, (yv * xx - xv * xy) / det as e from so where det > 1e-12 * xx * yy)
select rx, ry, round(a, 5) + 0 as a, round(b, 5) + 0 as b, round(mu - a * mx - b * my_, 5) + 0 as c, round(d, 5) + 0 as d, round(e, 5) + 0 as e, round(mv - d * mx - e * my_, 5) + 0 as f from af"""


def _strain_map(s, d):
    return _r(S.strain_map(peaks(s, d), CENTER, G1, G2, 1.97, (1.0, 3.0)), ("rx", "ry"), "e_xx", "e_yy", "e_xy", "theta")


SC, SS = math.cos(math.atan2(3.0, 1.0)), math.sin(math.atan2(3.0, 1.0))


def _strain_grid(s, d):
    p = peaks(s, d)
    fit = S.strain_map(p.where((F.col("rx") != 3) | (F.col("qx") > 26)), CENTER, G1, G2, 1.97)
    return _r(S.on_grid(fit, p.select("rx", "ry").distinct()), ("rx", "ry"), "e_xx", "mask")


def _profiles(s, d):
    bins = peaks(s, d).select("ry", F.floor("qx").cast("long").alias("x"), "intensity")
    return bins.groupBy("ry", "x").agg(F.round(F.sum("intensity"), 6).alias("value"))


PROFILE_SQL = f"{PEAKS_SQL}, pf as (select ry, floor(qx)::bigint as x, round(sum(intensity), 6) as value from b group by 1, 2)"


def _disk_means(s, d):
    found = P.maxima(pixels(frames(s, d)), ["rx", "ry"])
    return _r(G.integrate_disks(frames(s, d), found.select("rx", "ry", (F.col("qx") + 0.25).alias("qx"), (F.col("qy") - 0.5).alias("qy")), 1.6), ("rx", "ry", "qx", "qy"), "intensity")


DISKS_SQL = f"""{MAXIMA_SQL.split("select rx, ry, {x}")[0].rstrip().rstrip(",")},
mx as (select rx, ry, qx + 0.25::double as qx, qy - 0.5::double as qy from n where n = 8 and i >= hi and i > lo),
me as (select mx.rx, mx.ry, mx.qx, mx.qy, avg(p.i) as mean from mx join p on mx.rx = p.rx and mx.ry = p.ry and (p.qx - mx.qx) ** 2 + (p.qy - mx.qy) ** 2 <= 1.6::double ** 2 group by all)
select rx, ry, qx, qy, round(mean / max(mean) over (partition by rx, ry), 6) as intensity from me"""


def _pixel_size(s, d):
    top = R.radial_statistics(R.polar_data(pixels(frames(s, d)), MID, SPEC)).where("r > 0").agg(F.max_by("r", "mean").alias("r"))
    return top.select(rounded(1 / (F.col("r") * 2.5), 9).alias("q_pixel_size"))


DEFORM = [[1.02, 0.01, 0.0], [0.01, 0.98, 0.005], [0.0, 0.005, 1.0]]


def _strained(s, d):
    rows = X.strained(X.lattice((3.0, 4.0, 5.0, 90.0, 90.0, 90.0)), DEFORM)
    return _r(s.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "i long, x double, y double, z double"), ("i",), *"xyz")


HOT_SQL = f"""with {PIXELS_SQL}, mp as (select qx, qy, avg(i) as value from p group by qx, qy),
ho as (select a, e from range(-2, 3) as x(a), range(-2, 3) as y(e) where abs(a) + abs(e) < 4),
hn as (select (qx - a + 8) % 8 as qx, (qy - e + 8) % 8 as qy, value from mp, ho),
ht as (select qx, qy, list_reverse_sort(list(value))[2] as lim from hn group by qx, qy),
hk as (select mp.qx as x, mp.qy as y from mp join ht on mp.qx = ht.qx and mp.qy = ht.qy where value - lim > 0.0005::double),
hm as (select p.rx, p.ry, hk.x, hk.y, median(p.i) as med from p join hk on abs(p.qx - hk.x) <= 1 and abs(p.qy - hk.y) <= 1 group by all)
select p.rx, p.ry, p.qx, p.qy, round(coalesce(hm.med, p.i), 6) as i from p left join hm on p.rx = hm.rx and p.ry = hm.ry and p.qx = hm.x and p.qy = hm.y"""


QUERIES = {
    "probe_optics": (_optics, OPTICS_SQL),
    "zero_vacuum": (
        lambda s, d: _r(B.zero_vacuum(C.synthetic_probe(s, 6.0, 2.0, 32, 32), (16.0, 16.0), 6.0, 1.5), ("qx", "qy"), "value"),
        "select x as qx, y as qy, case when sqrt((x - 16) ** 2 + (y - 16) ** 2) < 9 then round(1 / (1 + exp(4 * (sqrt((x - 16) ** 2 + (y - 16) ** 2) - 6) / 2)), 6) else 0 end as value from range(32) as x(x), range(32) as y(y)",
    ),
    "beam_stop": (lambda s, d: B.beam_stop(s, 40, 32, (20.0, 12.0), 350.0, 15.0, 3, 6.5), _stop_sql()),
    "hot_pixel_filter": (lambda s, d: _r(pixels(C.filter_hot_pixels(frames(s, d), 0.0005)), ("rx", "ry", "qx", "qy"), "i"), HOT_SQL),
    "polar_all": (
        lambda s, d: _r(_view("all")(s, d), ("rx", "ry", "t", "r", "mask"), "value", "norm", "density", digits=5),
        f"{MODES_SQL} select rx, ry, t, r, mask, round(case when not mask then value / norm * scale end, 5) as value, round(norm, 5) as norm, round(density, 5) as density from md",
    ),
    "polar_zeros": (lambda s, d: _r(_view("zeros")(s, d), ("rx", "ry", "t", "r"), "value", digits=5), f"{MODES_SQL} select rx, ry, t, r, round(case when not mask then value / norm * scale else 0 end, 5) as value from md"),
    "annular_symmetry_masked": (
        lambda s, d: _r(R.annular_symmetry(R.polar_data(pixels(frames(s, d)), MID, SPEC, 0.7), 6, 12), ("rx", "ry", "r", "order"), "power"),
        f"""with {POLAR_SQL}, am as (select rx, ry, t, r, case when norm >= 0.7::double then value / norm end as value from s),
ao as (select rx, ry, r, k as "order", sum(value) as v, count(*) as m, sum(value * cos(2 * pi() * k * t / 12)) as c, sum(value * sin(2 * pi() * k * t / 12)) as z, sum(cos(2 * pi() * k * t / 12)) as c0, sum(sin(2 * pi() * k * t / 12)) as z0
       from am, range(1, 7) as k(k) where value is not null group by all)
select rx, ry, r, "order", round(abs((c * c + z * z) / v ** 2 - (c0 * c0 + z0 * z0) / m ** 2), 6) as power from ao""",
    ),
    "radial_integral": (
        lambda s, d: _r(R.radial_integral(pixels(frames(s, d)), MID, ELLIPTIC), ("rx", "ry", "r"), "value", digits=5),
        f"with {GATHER_SQL} select rx, ry, r, round(sum(i * w), 5) as value from p join gw on p.qx = gw.qx and p.qy = gw.qy group by rx, ry, r",
    ),
    "class_merge": (
        lambda s, d: _r(L.merge_classes(*_classes(s, d), 1, 3)[0], ("feature", "class"), "w"),
        f"""with {CLASSES_SQL}, tt as (select class, sum(h) as t from pl where class in (1, 3) group by class), ts as (select class, t / sum(t) over () as share from tt)
select feature, {NEXT.replace("class", "sp.class")} as class, round(sum(w * coalesce(share, 1)), 6) as w from sp left join ts on sp.class = ts.class group by 1, 2""",
    ),
    "class_merge_places": (
        lambda s, d: _r(L.merge_classes(*_classes(s, d), 1, 3)[1], ("rx", "ry", "class"), "h"),
        f"with {CLASSES_SQL} select rx, ry, {NEXT} as class, round(sum(h), 6) as h from pl group by 1, 2, 3",
    ),
    "class_remove": (
        lambda s, d: _r(L.remove_class(*_classes(s, d), 2)[1], ("rx", "ry", "class"), "h"),
        f"with {CLASSES_SQL} select rx, ry, case when class > 2 then class - 1 else class end as class, round(h, 6) as h from pl where class <> 2",
    ),
    "class_merge_candidates": (_candidates, CANDIDATES_SQL),
    "feature_median": (lambda s, d: _r(L.feature_medians(L.features_in_bins(peaks(s, d), 4, 4, 64, 64, True)), ("feature",), "value"), f"with {FEATURE_SQL} select feature, round(median(value), 6) as value from ft group by feature"),
    "feature_edit": (
        lambda s, d: (lambda f: _r(L.delete_features(L.concatenate_features(f, f.withColumn("value", F.col("value") * 2), 16), [0, 5, 20]), ("rx", "ry", "feature"), "value"))(L.features_in_bins(peaks(s, d), 4, 4, 64, 64, True)),
        f"with {FEATURE_SQL}, fc as (select rx, ry, feature, value from ft union all select rx, ry, feature + 16, value * 2 from ft) select rx, ry, feature - (feature > 0)::bigint - (feature > 5)::bigint - (feature > 20)::bigint as feature, round(value, 6) as value from fc where feature not in (0, 5, 20)",
    ),
    "affine_fit": (_affine, AFFINE_SQL),
    "strain_map": (
        _strain_map,
        f"""with {STRAIN_SQL} select rx, ry, round({SC * SC!r}::double * e_xx + {2 * SC * SS!r}::double * e_xy + {SS * SS!r}::double * e_yy, 6) + 0 as e_xx,
round({SS * SS!r}::double * e_xx - {2 * SC * SS!r}::double * e_xy + {SC * SC!r}::double * e_yy, 6) + 0 as e_yy,
round({SC * SS!r}::double * (e_yy - e_xx) + {SC * SC - SS * SS!r}::double * e_xy, 6) + 0 as e_xy, round(theta, 6) + 0 as theta from z""",
    ),
    "strain_on_grid": (
        _strain_grid,
        f"""with {STRAIN_SQL.replace("from lineitem)", "from lineitem where l_suppkey % 10 <> 3 or l_quantity::double + 10 * l_discount::double > 26)", 1)},
gp as (select distinct (l_suppkey % 10)::bigint as rx, (l_suppkey // 10)::bigint as ry from lineitem)
select gp.rx, gp.ry, coalesce(round(e_xx, 6), 0) + 0 as e_xx, case when z.rx is null then 0.0 else 1.0 end::double as mask from gp left join z on gp.rx = z.rx and gp.ry = z.ry""",
    ),
    "maxima_1d": (
        lambda s, d: P.maxima_1d(_profiles(s, d), ["ry"], "x", least_relative=0.95, to=1),
        f"""with {PROFILE_SQL}, pn as (select *, coalesce(lead(value) over w, first_value(value) over (w rows between unbounded preceding and unbounded following)) as nx,
  coalesce(lag(value) over w, last_value(value) over (w rows between unbounded preceding and unbounded following)) as pv from pf window w as (partition by ry order by x)),
pr as (select ry, x, value, row_number() over (partition by ry order by value desc, x desc) - 1 as rank from pn where value > nx and value >= pv),
pt as (select *, max(case when rank = 1 then value end) over (partition by ry) as ref from pr) select ry, x, value, rank from pt where value > ref * 0.95::double""",
    ),
    "disk_means": (_disk_means, DISKS_SQL),
    "q_pixel_size": (_pixel_size, f"with {RADIAL_SQL}, st as (select r, avg(radial) as mean from a group by r) select round(1 / (arg_max(r, mean) * 2.5::double), 9) as q_pixel_size from st where r > 0"),
    "strained_cell": (
        _strained,
        """select * from (values (0::bigint, round(3 * 1.02::double, 6), round(3 * 0.01::double, 6), 0.0::double), (1, round(4 * 0.01::double, 6), round(4 * 0.98::double, 6), round(4 * 0.005::double, 6)), (2, 0.0, round(5 * 0.005::double, 6), 5.0)) as t(i, x, y, z)""",
    ),
    "scan_from_detector": (
        lambda s, d: peaks(s, d).select("rx", "ry", *[rounded(c).alias(n) for c, n in zip(rotate(F.col("qx"), F.col("qy"), -0.3), ("x", "y"))]),
        f"with {PEAKS_SQL} select rx, ry, round(cos(0.3::double) * qx + sin(0.3::double) * qy, 6) + 0 as x, round(cos(0.3::double) * qy - sin(0.3::double) * qx, 6) + 0 as y from b",
    ),
    "thresholded_peaks": (
        lambda s, d: _r(P.composed_threshold(peaks(s, d), 0.5, 1, 0.0, 12), ("rx", "ry"), "qx", "qy", "intensity"),
        f"""with {PEAKS_SQL}, k as (select *, row_number() over (partition by rx, ry order by intensity desc, qx desc, qy desc) as n from b),
t as (select *, max(case when n = 2 then intensity end) over (partition by rx, ry) as ref from k)
select rx, ry, round(qx, 6) as qx, round(qy, 6) as qy, round(intensity, 6) as intensity from t where intensity > ref * 0.5::double and n <= 12""",
    ),
}
