"""Queries take every row of their tables."""

import numpy as np

from lattiq.model import peaks
from lattiq.operators import peaks as P
from lattiq.plans import catalogue, kernel_queries

SF = "/root/testdata/sf0.1"


def test_scan_is_as_long_as_the_table(spark):
    for name, nx, ny in (("bin_r", 40, 12), ("thin_r", 26, 8)):  # a scan of 80 x 25
        got = {(r["rx"], r["ry"]) for r in catalogue.queries()[name](spark, SF).select("rx", "ry").distinct().collect()}
        assert got == {(x, y) for x in range(nx) for y in range(ny)}, name


def test_reflected_pairs_equal_the_matrix_of_all():
    x, y = np.random.default_rng(3).uniform(-20, 20, (2, 500))
    d = np.hypot(x[:, None] + x[None], y[:, None] + y[None])
    a, b, near = P.reflected_pairs(x, y, 1.5)
    assert sorted(zip(a, b)) == list(zip(*np.nonzero(np.triu(d <= 1.5, 1)))) and np.array_equal(near, d[a, b])


def test_friedel_pairs_come_from_all_peaks(spark):
    small = "/root/testdata/sf0.01"
    got = {(r["rx"], r["ry"]): r["pairs"] for r in catalogue.queries()["friedel_center"](spark, small).collect()}
    sizes = {(r["rx"], r["ry"]): r["count"] for r in peaks(spark, small).groupBy("rx", "ry").count().collect()}
    assert got.keys() == sizes.keys() and all(n > 30 for n in got.values())  # 60 peaks give 30 pairs at most


def test_orientations_and_phases_take_all_peaks(spark):
    small = "/root/testdata/sf0.01"
    assert kernel_queries._centred(spark, small).count() == peaks(spark, small).count()
