"""Queries over the dense cube, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattiq.model import PIXELS_SQL, CubeMeta, frames, pixels, rounded
from lattiq.operators import cube as C

META = CubeMeta()
WEIGHTS = [[float((x * 3 + y * 5) % 7) / 2 for y in range(8)] for x in range(8)]
BAD = [(1, 1), (4, 6), (7, 0)]
R2 = "((qx - 3.5::double) * (qx - 3.5::double) + (qy - 3.5::double) * (qy - 3.5::double))"


def _shift():
    return F.col("rx") % 5 - 2, F.col("ry") % 3 - 1


def _vi(mask):
    return lambda s, d: C.virtual_image(frames(s, d), mask).select("rx", "ry", rounded("value").alias("value"))


def _vi_sql(term: str) -> str:
    return f"with {PIXELS_SQL} select rx, ry, round(sum({term}), 6) as value from p group by rx, ry"


def _vd(**options):
    """Options that are functions are called when the query is, which is when a session exists."""
    return lambda s, d: C.virtual_diffraction(frames(s, d), **{k: v() if callable(v) else v for k, v in options.items()}).select("qx", "qy", rounded("value").alias("value"))


def _vd_sql(expr: str, where: str = "true") -> str:
    return f"with {PIXELS_SQL} select qx, qy, round({expr}, 6) as value from p where {where} group by qx, qy"


def _pixels(f):
    """A query on pixels that ends in rounded i."""
    return lambda s, d: (lambda out: out.select(*[c for c in out.columns if c != "i"], rounded("i").alias("i")))(f(pixels(frames(s, d))))


def _scan_pixels(f):
    """A query on pixels and the shape of their scan, that ends in rounded i."""

    def run(s, d):
        cube = frames(s, d)
        nx, ny = cube.agg(F.coalesce(F.max("rx"), F.lit(-1)) + 1, F.coalesce(F.max("ry"), F.lit(-1)) + 1).first()
        return _pixels(lambda p: f(p, nx, ny))(s, d)

    return run


W_SQL = "(1.0::double + rx % 3 + 0.5::double * (ry % 4))"


def _weight():
    return F.lit(1.0) + F.col("rx") % 3 + 0.5 * (F.col("ry") % 4)


MASK_SQL = "(((qx * 3 + qy * 5) % 7)::double / 2)"
LX = "floor(((rx % 4) - 1.3::double) * 0.7)"


def _shift_bilinear(s, d):
    cube = frames(s, d)
    return C.virtual_image_shifted(cube, C.circle(3.5, 3.5, 2), (F.col("rx") % 4 - 1.3) * 0.7, (F.col("ry") % 5 - 2.1) * 0.4, bilinear=True).select("rx", "ry", rounded("value").alias("value"))


def _mean(s, d):
    return C.virtual_diffraction(frames(s, d))


QUERIES = {
    "vi_point": (_vi(C.point(3.7, 4.2)), _vi_sql("case when qx = 3 and qy = 4 then i else 0 end")),
    "vi_circle": (_vi(C.circle(3.5, 3.5, 2)), _vi_sql(f"case when {R2} < 4 then i else 0 end")),
    "vi_annulus": (_vi(C.annulus(3.5, 3.5, 1, 3)), _vi_sql(f"case when {R2} > 1 and {R2} < 9 then i else 0 end")),
    "vi_rect": (_vi(C.rectangle(1.5, 4.5, 2.5, 6.2)), _vi_sql("case when qx >= 2 and qx < 4 and qy >= 2 and qy < 6 then i else 0 end")),
    "vi_mask_weighted": (_vi(C.weights(WEIGHTS)), _vi_sql(f"i * {MASK_SQL}")),
    "vi_calibrated": (
        _vi(C.circle(*C.detector_to_pixels((0.05, -0.05, 0.2), 0.1, (3.5, 3.5), True, True))),
        _vi_sql("case when (qx - (3.5::double + 0.5::double)) * (qx - (3.5::double + 0.5::double)) + (qy - (3.5::double - 0.5::double)) * (qy - (3.5::double - 0.5::double)) < 4 then i else 0 end"),
    ),
    "vi_sector": (
        _vi(C.sector(3.5, 3.5, 4, 0.1, 1.4)),
        _vi_sql(f"case when {R2} <= 16 and (atan2(qx - 3.5::double, qy - 3.5::double) - 0.1::double + 2 * pi()) % (2 * pi()) <= 1.3::double then i else 0 end"),
    ),
    "vi_shift_int": (
        lambda s, d: C.virtual_image_shifted(frames(s, d), C.circle(3.5, 3.5, 2), *_shift()).select("rx", "ry", rounded("value").alias("value")),
        _vi_sql("case when ((qx - (rx % 5 - 2) + 8) % 8 - 3.5::double) ** 2 + ((qy - (ry % 3 - 1) + 8) % 8 - 3.5::double) ** 2 < 4 then i else 0 end"),
    ),
    "vi_shift_bilinear": (
        _shift_bilinear,
        f"""with {PIXELS_SQL},
s as (select *, (rx % 4 - 1.3::double) * 0.7::double as dx, (ry % 5 - 2.1::double) * 0.4::double as dy from p),
t as (select *, floor(dx) as lx, floor(dy) as ly from s),
c as (select rx, ry, i * (case a when 1 then dx - lx else 1 - (dx - lx) end) * (case e when 1 then dy - ly else 1 - (dy - ly) end)
        * (case when ((qx - (lx + a) + 16) % 8 - 3.5::double) ** 2 + ((qy - (ly + e) + 16) % 8 - 3.5::double) ** 2 < 4 then 1 else 0 end) as v
      from t, (values (0), (1)) as x(a), (values (0), (1)) as y(e))
select rx, ry, round(sum(v), 6) as value from c group by rx, ry""",
    ),
    "vd_mean": (_vd(), _vd_sql("avg(i)")),
    "vd_max": (_vd(method="max"), _vd_sql("max(i)")),
    "vd_median": (_vd(method="median"), _vd_sql("median(i)")),
    "vd_masked_mean": (_vd(where=lambda: (F.col("rx") >= 2) & (F.col("ry") % 2 == 0)), _vd_sql("avg(i)", "rx >= 2 and ry % 2 = 0")),
    "vd_weighted_mean": (_vd(weight=_weight), _vd_sql(f"sum(i * {W_SQL}) / sum({W_SQL})")),
    "vd_weighted_max": (_vd(method="max", weight=_weight), _vd_sql(f"max(i * {W_SQL})")),
    "vd_weighted_median": (_vd(method="median", weight=_weight), _vd_sql(f"median(i * {W_SQL})")),
    "vd_shift_mean": (
        lambda s, d: C.virtual_diffraction_shifted(frames(s, d), *_shift()).select("qx", "qy", rounded("value").alias("value")),
        f"with {PIXELS_SQL}, s as (select (qx + rx % 5 - 2 + 8) % 8 as qx, (qy + ry % 3 - 1 + 8) % 8 as qy, i from p) select qx, qy, round(avg(i), 6) as value from s group by qx, qy",
    ),
    "vd_shift_max": (
        lambda s, d: C.virtual_diffraction_shifted(frames(s, d), *_shift(), "max").select("qx", "qy", rounded("value").alias("value")),
        f"with {PIXELS_SQL}, s as (select (qx + rx % 5 - 2 + 8) % 8 as qx, (qy + ry % 3 - 1 + 8) % 8 as qy, i from p) select qx, qy, round(greatest(max(i), 0), 6) as value from s group by qx, qy",
    ),
    "local_avg_dp": (
        lambda s, d: C.local_average(frames(s, d)).select("rx", "ry", "qx", "qy", rounded("value").alias("value")),
        f"""with {PIXELS_SQL},
o as (select a, e, (2 - abs(a)) * (2 - abs(e)) as w from (values (-1), (0), (1)) as x(a), (values (-1), (0), (1)) as y(e)),
s as (select rx + a as rx, ry + e as ry, qx, qy, i, w from p, o),
t as (select rx, ry, qx, qy, sum(w * i) / sum(w) as value from s group by rx, ry, qx, qy)
select t.rx, t.ry, t.qx, t.qy, round(value, 6) as value from t semi join p on t.rx = p.rx and t.ry = p.ry""",
    ),
    "bin_q": (_pixels(lambda p: C.bin_axes(p, "qx", "qy", 3, 8, 8)), f"with {PIXELS_SQL} select rx, ry, qx // 3 as qx, qy // 3 as qy, round(sum(i), 6) as i from p where qx < 6 and qy < 6 group by all"),
    "bin_q_uint16": (
        lambda s, d: (lambda p: p.groupBy("rx", "ry", F.expr("qx div 2").alias("qx"), F.expr("qy div 2").alias("qy")).agg(C.wrapped(F.sum((F.col("i") * 100000).cast("long"))).alias("i")))(pixels(frames(s, d))),
        f"with {PIXELS_SQL} select rx, ry, qx // 2 as qx, qy // 2 as qy, (sum(trunc(i * 100000)::bigint) % 65536)::bigint as i from p group by all",
    ),
    "bin_r": (_scan_pixels(lambda p, nx, ny: C.bin_axes(p, "rx", "ry", 2, nx, ny)), f"with {PIXELS_SQL} select rx // 2 as rx, ry // 2 as ry, qx, qy, round(sum(i), 6) as i from p where rx < (select (max(rx) + 1) // 2 * 2 from p) and ry < (select (max(ry) + 1) // 2 * 2 from p) group by all"),
    "crop_q": (_pixels(lambda p: C.crop(p, "qx", "qy", 1, 6, 2, 8)), f"with {PIXELS_SQL} select rx, ry, qx - 1 as qx, qy - 2 as qy, round(i, 6) as i from p where qx >= 1 and qx < 6 and qy >= 2 and qy < 8"),
    "crop_r": (_pixels(lambda p: C.crop(p, "rx", "ry", 2, 9, 5, 20)), f"with {PIXELS_SQL} select rx - 2 as rx, ry - 5 as ry, qx, qy, round(i, 6) as i from p where rx >= 2 and rx < 9 and ry >= 5 and ry < 20"),
    "thin_r": (_scan_pixels(lambda p, nx, ny: C.thin_r(p, 3, nx, ny)), f"with {PIXELS_SQL} select rx // 3 as rx, ry // 3 as ry, qx, qy, round(i, 6) as i from p where rx % 3 = 0 and ry % 3 = 0 and rx < (select (max(rx) + 1) // 3 * 3 from p) and ry < (select (max(ry) + 1) // 3 * 3 from p)"),
    "pad_q": (
        lambda s, d: C.pad_q(frames(s, d), (11, 12)).select("rx", "ry", "qx", "qy", rounded("i").alias("i")),
        f"""with {PIXELS_SQL}, r as (select distinct rx, ry from p), g as (select x.x as qx, y.y as qy from range(11) as x(x), range(12) as y(y))
select r.rx, r.ry, g.qx, g.qy, round(coalesce(p.i, 0), 6) as i from r cross join g
left join p on p.rx = r.rx and p.ry = r.ry and p.qx + 1 = g.qx and p.qy + 2 = g.qy""",
    ),
    "swap_rq": (_pixels(C.swap_rq), f"with {PIXELS_SQL} select qx as rx, qy as ry, rx as qx, ry as qy, round(i, 6) as i from p"),
    "swap_rxy": (_pixels(C.swap_rxy), f"with {PIXELS_SQL} select ry as rx, rx as ry, qx, qy, round(i, 6) as i from p"),
    "swap_qxy": (_pixels(C.swap_qxy), f"with {PIXELS_SQL} select rx, ry, qy as qx, qx as qy, round(i, 6) as i from p"),
    "set_scan_shape": (
        lambda s, d: C.set_scan_shape(frames(s, d).select((F.col("rx") * 25 + F.col("ry")).alias("pos"), "label"), 10).select("rx", "ry", "label"),
        f"with {PIXELS_SQL} select (rx * 25 + ry) // 10 as rx, (rx * 25 + ry) % 10 as ry, label from p where qx = 0 and qy = 0",
    ),
    "dark_reference": (
        lambda s, d: C.dark_reference(frames(s, d), 1).select("qx", rounded("dark").alias("dark")),
        f"with {PIXELS_SQL} select qx, round(avg(i), 6) as dark from p where qy < 1 or qy >= 7 group by qx",
    ),
    "dark_subtract": (
        lambda s, d: (lambda c: C.subtract_dark(pixels(c), C.dark_reference(c, 1), ["qx"]).select("rx", "ry", "qx", "qy", rounded("i").alias("i")))(frames(s, d)),
        f"with {PIXELS_SQL}, k as (select qx as x, avg(i) as dark from p where qy < 1 or qy >= 7 group by qx) select rx, ry, qx, qy, round(i - dark, 6) as i from p join k on qx = x",
    ),
    "hot_pixel_mask": (
        lambda s, d: C.hot_pixels(_mean(s, d), 0.0005, 1).select("qx", "qy", rounded("value").alias("value"), rounded("limit").alias("limit"), "hot"),
        f"""with {PIXELS_SQL}, m as (select qx, qy, avg(i) as value from p group by qx, qy),
o as (select a, e from range(-2, 3) as x(a), range(-2, 3) as y(e) where abs(a) + abs(e) < 4),
n as (select (qx - a + 8) % 8 as qx, (qy - e + 8) % 8 as qy, value from m, o),
t as (select qx, qy, list_reverse_sort(list(value))[2] as lim from n group by qx, qy)
select m.qx, m.qy, round(value, 6) as value, round(lim, 6) as "limit", value - lim > 0.0005 as hot from m join t on m.qx = t.qx and m.qy = t.qy""",
    ),
    "median_masked_pixels": (
        lambda s, d: pixels(C.median_replace(frames(s, d), BAD)).select("rx", "ry", "qx", "qy", rounded("i").alias("i")),
        f"""with {PIXELS_SQL}, k(x, y) as (values {", ".join(map(str, BAD))}),
m as (select p.rx, p.ry, k.x, k.y, median(p.i) as med from p join k on abs(p.qx - k.x) <= 1 and abs(p.qy - k.y) <= 1 group by all)
select p.rx, p.ry, p.qx, p.qy, round(coalesce(m.med, p.i), 6) as i from p left join m on p.rx = m.rx and p.ry = m.ry and p.qx = m.x and p.qy = m.y""",
    ),
    "bilinear_shift": (
        lambda s, d: pixels(C.shift_bilinear(frames(s, d), 1.25, -0.6)).select("rx", "ry", "qx", "qy", rounded("i").alias("i")),
        f"""with {PIXELS_SQL}, o(a, e, w) as (values (1, -1, 0.75::double * 0.6::double), (2, -1, 0.25::double * 0.6::double), (1, 0, 0.75::double * 0.4::double), (2, 0, 0.25::double * 0.4::double))
select rx, ry, (qx + a) % 8 as qx, (qy + e + 8) % 8 as qy, round(sum(i * w), 6) as i from p, o group by all""",
    ),
    "bragg_lattice_mask": (
        lambda s, d: C.bragg_mask(s, 64, 64, (9.0, 1.5), (-2.0, 8.0), 3.0, (31.5, 30.0), 28.0, 6),
        """with l as (select h * 9.0::double + k * -2.0::double as vx, h * 1.5::double + k * 8.0::double as vy from range(-6, 7) as x(h), range(-6, 7) as y(k)),
m as (select * from l where sqrt(vx * vx + vy * vy) < 28),
g as (select x as qx, y as qy from range(64) as x(x), range(64) as y(y))
select qx, qy, count(vx) as n from g left join m on (qx - vx - 31.5::double) ** 2 + (qy - vy - 30) ** 2 < 9 group by qx, qy""",
    ),
    "beamstop_threshold": (
        lambda s, d: C.threshold_mask(_mean(s, d), 0.25).select("qx", "qy", "mask"),
        f"""with {PIXELS_SQL}, m as (select qx, qy, avg(i) as value from p group by qx, qy), r as (select value, row_number() over (order by value) - 1 as k from m)
select qx, qy, m.value >= (select value from r where k = 16) as mask from m""",
    ),
    "com": (
        lambda s, d: C.center_of_mass(frames(s, d)).select("rx", "ry", rounded("com_x").alias("com_x"), rounded("com_y").alias("com_y")),
        f"with {PIXELS_SQL} select rx, ry, round(sum(i * qx) / sum(i), 6) as com_x, round(sum(i * qy) / sum(i), 6) as com_y from p group by rx, ry",
    ),
    "com_masked": (
        lambda s, d: C.center_of_mass(frames(s, d), mask=C.circle(3.5, 3.5, 3)).select("rx", "ry", rounded("com_x").alias("com_x"), rounded("com_y").alias("com_y")),
        f"with {PIXELS_SQL} select rx, ry, round(sum(i * qx) / sum(i), 6) as com_x, round(sum(i * qy) / sum(i), 6) as com_y from p where {R2} < 9 group by rx, ry",
    ),
    "radial_reduction": (
        lambda s, d: C.radial_reduction(pixels(frames(s, d)), 3.5, 3.5, 1.0, F.max).select("rx", "ry", "r", rounded("value").alias("value")),
        f"with {PIXELS_SQL} select rx, ry, floor(sqrt({R2}))::bigint as r, round(max(i), 6) as value from p group by all",
    ),
    "synthetic_probe": (
        lambda s, d: C.synthetic_probe(s, 10.0, 2.0, 32, 32).select("qx", "qy", rounded("value").alias("value")),
        "select x as qx, y as qy, round(1 / (1 + exp(4 * (sqrt((x - 16) ** 2 + (y - 16) ** 2) - 10) / 2)), 6) as value from range(32) as x(x), range(32) as y(y)",
    ),
    "probe_size": (
        lambda s, d: C.probe_size(C.synthetic_probe(s, 9.0, 3.0, 40, 40).withColumn("qx", F.col("qx") + 2), 0.01, 0.99, 100).select(rounded("radius").alias("radius"), rounded("x0", 4).alias("x0"), rounded("y0", 4).alias("y0")),
        """with g as (select x + 2 as qx, y as qy, 1 / (1 + exp(4 * (sqrt((x - 20) ** 2 + (y - 20) ** 2) - 9) / 3)) as v from range(40) as x(x), range(40) as y(y)),
m as (select max(v) as top from g), t as (select k, 0.01::double + k * ((0.99::double - 0.01::double) / 99) as t from range(100) as r(k)),
a as (select k, t, sqrt(sum((v > t * top)::int::double) / pi()) as r from g, m, t group by k, t),
d as (select *, case when k = 0 then lead(r) over (order by k) - r when k = 99 then r - lag(r) over (order by k) else (lead(r) over (order by k) - lag(r) over (order by k)) / 2 end as dr from a),
e as (select avg(r) as radius, avg(t) as tm from d where dr <= 0 and dr >= 2 * (select median(dr) from d))
select round(radius, 6) as radius, round(sum(v * qx) / sum(v), 4) as x0, round(sum(v * qy) / sum(v), 4) as y0 from g, m, e where v > tm * top group by radius""",
    ),
}
