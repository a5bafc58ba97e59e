"""Live acquisition (an extension): frames that arrive as files become virtual images and running patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.model import CubeMeta
from lattiq.operators.cube import Mask, virtual_image

FRAME_SCHEMA = "rx long, ry long, at timestamp, data array<double>"


def frames(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(FRAME_SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(path)


def live_image(stream: DataFrame, mask: Mask, meta: CubeMeta = CubeMeta()) -> DataFrame:
    """Virtual image of each frame as it comes: stateless, append mode."""
    return virtual_image(stream, mask, meta)


def running_pattern(stream: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Mean pattern by window of acquisition time; state is a sum for each pixel of the open windows.

    Frames later than the watermark are left out.
    """
    p = stream.withWatermark("at", late).select("at", F.posexplode("data").alias("k", "i"))
    return p.groupBy(F.window("at", window), "k").agg(F.avg("i").alias("value"), F.count("*").alias("n"))
