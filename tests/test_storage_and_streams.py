import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.functions import kernels as K
from lattiq.model import Calibration, CubeMeta
from lattiq.operators import cube
from lattiq.sources import catalog, formats
from lattiq.streaming import live


def test_file_types(spark):
    names = ["a/x.raw", "b.MIB", "c.dm4", "d.tar.gz", "noext", "e.bin"]
    df = spark.createDataFrame([(n,) for n in names], "p string").select("p", formats.file_type(F.col("p")).alias("t"))
    assert [r["t"] for r in df.collect()] == ["empad", "mib", "dm", None, None, "gatan_K2_bin"]


def test_empad_and_mib_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    a = rng.random((4, 128, 128)).astype(np.float32)
    (tmp_path / "x.raw").write_bytes(formats.write_empad(a))
    got = {(r["rx"], r["ry"]): np.array(r["data"]) for r in formats.read_empad(spark, str(tmp_path / "x.raw")).collect()}
    assert sorted(got) == [(0, 0), (0, 1), (1, 0), (1, 1)] and np.array_equal(got[1, 0], a[2].ravel().astype(float))
    small = formats.read_empad(spark, str(tmp_path / "x.raw"), (4, 1), 64).orderBy("rx").collect()
    assert np.allclose(small[3]["data"], a[3].astype(float).reshape(2, 64, 2, 64).sum(axis=(1, 3)).ravel())
    b = rng.integers(0, 60000, (3, 5, 7))
    (tmp_path / "y.mib").write_bytes(formats.write_mib(b))
    got = formats.read_mib(spark, str(tmp_path / "y.mib")).orderBy("ry").collect()
    assert [r["ry"] for r in got] == [0, 1, 2] and np.array_equal(np.array(got[2]["data"]), b[2].ravel())
    assert formats.mib_scan_size("Frames in Acquisition (Number):\t12\nFrames per Trigger (Number):\t4") == (3, 4)


def test_units():
    assert formats.calibrate_units(0.5, "1/nm") == (0.05, "A^-1")
    size, name = formats.calibrate_units(1.0, "mrad", 300e3)
    assert name == "A^-1" and abs(size - 1e-3 / 0.0196875) < 1e-4
    assert formats.calibrate_units(3.0, "um") == (1.0, "pixels")


def test_catalog_round_trip(spark, tmp_path):
    df = spark.range(5).select(F.col("id").alias("rx"), (F.col("id") * 2.5).alias("v"))
    cal = Calibration(q_pixel_size=0.062, q_pixel_units="A^-1", r_pixel_size=2.8)
    catalog.save(df, str(tmp_path), "image", "RealSlice", cal, {"mode": "circle"}, "cube", partition_by=("rx",))
    got = catalog.read(spark, str(tmp_path), "image")
    assert got.kind == "RealSlice" and got.calibration == cal and got.params == {"mode": "circle"} and got.parent == "cube"
    assert sorted((r["rx"], r["v"]) for r in got.frame.collect()) == [(i, i * 2.5) for i in range(5)]
    with pytest.raises(Exception):
        catalog.save(df, str(tmp_path), "image", "RealSlice")
    old = {"version": 1, "kind": "k", "params": '{"a": 1, "calibration": {"q_pixel_size": 2.0}}', "calibration": None}
    assert catalog.upgrade(old)["calibration"] == '{"q_pixel_size": 2.0}'


def test_ang_lines(spark):
    df = spark.createDataFrame([(0, 0, 0, 0.5, np.eye(3).ravel().tolist()), (1, 0, 0, 0.25, [0.0, 1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0])], "rx long, ry long, match long, corr double, matrix array<double>")
    lines = [r["value"].split() for r in catalog.ang_lines(df, 2.0).collect()]
    assert [float(x) for x in lines[0][:5]] == [0, 0, 0, 0, 0] and abs(float(lines[1][0]) - np.pi / 2) < 1e-4 and lines[1][3] == "2.00000"


def test_live_images_equal_batch(spark, tmp_path):
    rows = [(i // 4, i % 4, f"2024-01-01 00:00:{i:02d}", [float((i * k) % 7) for k in range(64)]) for i in range(8)]
    df = spark.createDataFrame(rows, "rx long, ry long, at string, data array<double>").withColumn("at", F.col("at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    image = live.live_image(live.frames(spark, str(tmp_path / "in")), cube.circle(3.5, 3.5, 2))
    q = image.writeStream.format("memory").queryName("live_image").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    want = {(r["rx"], r["ry"]): r["value"] for r in cube.virtual_image(df, cube.circle(3.5, 3.5, 2)).collect()}
    assert {(r["rx"], r["ry"]): r["value"] for r in spark.table("live_image").collect()} == want
    run = live.running_pattern(live.frames(spark, str(tmp_path / "in")))
    q = run.writeStream.outputMode("complete").format("memory").queryName("live_mean").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["k"]: r["value"] for r in spark.table("live_mean").collect()}
    assert np.allclose([got[k] for k in range(64)], np.mean([r[3] for r in rows], axis=0))


def test_kernels_against_closed_forms():
    rng = np.random.default_rng(1)
    a = rng.random((12, 10))
    assert np.allclose(K.gaussian_filter(np.ones((9, 9)), 1.3), 1) and abs(K.gaussian_filter(np.pad([[1.0]], 20), 2.0).sum() - 1) < 1e-9
    assert np.allclose(K.fourier_shift(a, 3, -2), np.roll(a, (3, -2), (0, 1)))
    assert abs(K.fourier_resample(a, (24, 20)).mean() - a.mean()) < 1e-12 and np.allclose(K.fourier_resample(a, a.shape), a)
    assert np.allclose(K.zoom_bilinear(a, a.shape), a) and np.allclose(K.idct2(K.dct2(a)), a)
    x, y = np.indices((20, 20))
    slope = 0.9 * x - 0.7 * y
    un = K.unwrap(np.angle(np.exp(1j * slope)))
    assert np.allclose(un - un.mean(), slope - slope.mean(), atol=1e-8)
    t = np.arange(30) ** 2.0
    assert np.allclose(K.savgol(t, 7, 2), t)
    m = np.zeros((9, 9), bool)
    m[2:7, 2:7] = True
    d = K.distance(m)
    assert d[4, 4] == 3 and d[0, 0] == 0 and K.erode(m).sum() == 9 and K.opened(m).sum() >= 9
    ring = m.copy()
    ring[4, 4] = False
    assert K.fill_holes(ring).all() == m.all() and K.fill_holes(ring)[4, 4]
    two = np.zeros((6, 6), bool)
    two[0:2, 0:2], two[4:, 4:] = True, True
    assert K.label(two).max() == 2 and K.label(two)[0, 0] == 1
    fit, cost, _, status = K.least_squares(lambda p: p[0] * np.exp(-np.arange(20) * p[1]) - 3 * np.exp(-np.arange(20) * 0.2), [1.0, 1.0], [0, 0], [10, 5])
    assert np.allclose(fit, [3, 0.2], atol=1e-5) and status == 1 and cost < 1e-9
    bound, *_ = K.least_squares(lambda p: p - np.array([5.0, -1.0]), [0.5, 0.5], [0, 0], [1, 1])
    assert np.allclose(bound, [1, 0])
    basis = rng.random((15, 5))
    w, res = K.nnls(basis, basis @ [0, 2, 0, 1, 0.5])
    assert np.allclose(w, [0, 2, 0, 1, 0.5], atol=1e-6) and res < 1e-6
    assert (K.nnls(basis, -np.ones(15))[0] == 0).all()


def test_meta():
    assert CubeMeta(4, 5).q_n == 20
    with pytest.raises(ValueError):
        Calibration().active(center=True)
    with pytest.raises(ValueError):
        cube.annulus(0, 0, 2, 1)
