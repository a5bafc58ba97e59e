"""What reaches the driver, and what it does there, stays small for long scans; scans may have gaps."""

import math
import time

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from lattiq.model import CubeMeta
from lattiq.operators import cube as C
from lattiq.operators import flowlines, phase
from lattiq.operators import ptychography as pt


def test_ptychography_sends_blocks_to_the_driver(spark, monkeypatch):
    many = []

    def counted(f):
        def call(self, *a, **b):
            out = f(self, *a, **b)
            out = out if hasattr(out, "__len__") else list(out)
            many.append(len(out))
            return out if hasattr(out, "iloc") else iter(out)

        return call

    for name in ("toPandas", "toLocalIterator", "collect"):
        monkeypatch.setattr(DataFrame, name, counted(getattr(DataFrame, name)))
    rows = [(2.0 * x, 2.0 * y, [1.0] * 64) for x in range(100) for y in range(25)]
    patterns = spark.createDataFrame(rows, "x double, y double, amplitude array<double>")
    pt.multislice(patterns, 2, (208, 58), np.ones((8, 8), complex), phase.fresnel((8, 8), 1.0, 0.02, 5.0), 1)
    assert 0 < sum(many) <= 30  # 72,576 numbers of the object and some of the probe


def test_sums_of_partitions_are_those_of_their_arrays(spark):
    rng = np.random.default_rng(11)
    whole = [rng.random((3, 70, 61)) + 1j * rng.random((3, 70, 61)), rng.random((90, 100)), np.zeros((4, 4)), np.array([5.0, 7.0])]

    def run(batches):
        for pdf in batches:
            for k in pdf.id:
                yield from phase.block_sums(*[(k + 1) * a for a in whole])

    for n in (1, 7):
        got = phase.sum_arrays(spark.range(0, n, 1, 3), run, whole)
        for g, w in zip(got, whole):
            assert g.dtype == w.dtype and np.allclose(g, w * n * (n + 1) / 2, rtol=1e-12)
    assert all(not g.any() for g in phase.sum_arrays(spark.range(0), run, whole))


def test_parallax_takes_scans_with_gaps(spark):
    rng = np.random.default_rng(12)
    base = np.pad(rng.random((14, 13)) + 0.2, 3)
    nx, ny = base.shape
    moves = {(0, 0): (0, 0), (0, 1): (1, 0), (1, 0): (0, -1), (1, 1): (-1, 2)}
    stack = {q: np.roll(base, m, (0, 1)) for q, m in moves.items()}
    cube = [(x, y, [float(stack[q][x, y]) for q in sorted(stack)]) for x in range(nx) for y in range(ny)]
    gaps = [r for r in cube if r[:2] not in {(0, 3), (4, 4), (nx - 1, ny - 1), (nx - 1, ny - 2)}]  # the last line is short
    twice = [*gaps, (2, 2, [v + 2.0 for v in gaps[2 * ny + 1][2]]), (7, 7, None)]
    kind, meta = "rx long, ry long, data array<double>", CubeMeta(2, 2)
    images = {(r["qx"], r["qy"]): r["image"] for r in phase.bright_field_images(spark.createDataFrame(twice, kind), C.circle(0.5, 0.5, 2), nx, ny, meta).collect()}
    assert images.keys() == stack.keys()
    for q, image in images.items():
        want = stack[q].ravel().tolist()
        for x, y in ((0, 3), (4, 4), (nx - 1, ny - 1), (nx - 1, ny - 2)):
            want[x * ny + y] = None
        want[2 * ny + 2] = (stack[q][2, 2] + cube[2 * ny + 1][2][sorted(stack).index(q)] + 2.0) / 2
        assert [v is None for v in image] == [v is None for v in want]
        assert np.allclose(np.array(image, float), np.array(want, float), equal_nan=True)
    for rows in (cube, gaps):
        frames = phase.bright_field_images(spark.createDataFrame(rows, kind), lambda x, y: F.lit(True), nx, ny, meta)
        mean, shifts, _ = phase.parallax(frames, nx, ny, 3)
        assert np.isfinite(mean).all()
        d = shifts[["dx", "dy"]].to_numpy()
        want = -np.array([moves[q] for q in zip(shifts.qx, shifts.qy)])
        assert np.allclose(d - d[0], want - want[0], atol=0.15)


def plain_flowlines(hist, least, spacing, step, longest):
    """As flowlines, with every step compared to all points of earlier lines."""
    nx, ny, nt = hist.shape
    size = math.pi / nt
    seeds = np.argwhere((hist >= np.roll(hist, 1, axis=2)) & (hist > np.roll(hist, -1, axis=2)) & (hist >= least))
    taken, out = np.empty((0, 3)), []

    def at(x, y, t):
        i, j, k = round(x), round(y), round(t / size) % nt
        return hist[i, j, k] if 0 <= i < nx and 0 <= j < ny else -1.0

    def close(x, y, t):
        a, b, c = taken.T
        return bool((((x - a) ** 2 + (y - b) ** 2 < spacing**2) & (np.abs((t - c + math.pi / 2) % math.pi - math.pi / 2) < 2 * size)).any())

    for sx, sy, st in seeds[np.argsort(-hist[tuple(seeds.T)], kind="stable")].tolist():
        if close(sx, sy, st * size):
            continue
        halves = []
        for way in (1, -1):
            x, y, t, line = float(sx), float(sy), st * size, []
            while len(line) < longest:
                x, y = x + way * step * math.cos(t), y + way * step * math.sin(t)
                t = max((t, t - size, t + size), key=lambda a: at(x, y, a))
                if at(x, y, t) < least or close(x, y, t):
                    break
                line.append((x, y, t))
            halves.append(line)
        if halves[0] or halves[1]:
            out.append(np.array(halves[1][::-1] + [(sx, sy, st * size)] + halves[0]))
            taken = np.concatenate([taken, out[-1]])
    return out


def test_flow_lines_equal_the_plain_search():
    hist = np.random.default_rng(13).random((12, 9, 12))
    for spacing, step in ((2.0, 0.5), (0.7, 0.3), (3.3, 1.0)):
        got, want = flowlines.flowlines(hist, 0.5, spacing, step, 40), plain_flowlines(hist, 0.5, spacing, step, 40)
        assert len(got) == len(want) > 10 and all(np.array_equal(a, b) for a, b in zip(got, want))


def test_flow_lines_of_a_long_map_take_time_in_proportion():
    rng, took = np.random.default_rng(14), []
    for n in (50, 1000):
        hist = rng.random((10, n, 12))
        began = time.process_time()
        flowlines.flowlines(hist, 0.5)
        took.append(time.process_time() - began)
    assert took[1] < 80 * took[0]  # 20 times the map; comparing all points takes some 400 times
