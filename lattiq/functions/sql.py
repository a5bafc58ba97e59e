"""SQL access: views over a data set, and table functions that turn a pattern into peaks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lattiq import model
from lattiq.functions import kernels as K


def register(spark: SparkSession) -> None:
    """find_peaks(data, nx, ny) and radial_profile(data, nx, ny, x0, y0) for SQL's LATERAL joins."""

    @udtf(returnType="qx double, qy double, intensity double")
    class FindPeaks:
        def eval(self, data: list, nx: int, ny: int):
            for x, y, v in K.maxima_2d(np.asarray(data, float).reshape(nx, ny), "poly"):
                yield float(x), float(y), float(v)

    @udtf(returnType="r int, value double, n int")
    class RadialProfile:
        def eval(self, data: list, nx: int, ny: int, x0: float, y0: float):
            a = np.asarray(data, float).reshape(nx, ny)
            x, y = np.indices(a.shape)
            r = np.floor(np.hypot(x - float(x0), y - float(y0))).astype(int).ravel()
            n = np.bincount(r)
            for k, (total, count) in enumerate(zip(np.bincount(r, a.ravel()), n)):
                if count:
                    yield k, float(total / count), int(count)

    spark.udtf.register("find_peaks", FindPeaks)
    spark.udtf.register("radial_profile", RadialProfile)


def create_views(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views frames, pixels and peaks."""
    cube = model.frames(spark, sf_dir)
    cube.createOrReplaceTempView("frames")
    model.pixels(cube, keep=("label",)).createOrReplaceTempView("pixels")
    model.peaks(spark, sf_dir).createOrReplaceTempView("peaks")
