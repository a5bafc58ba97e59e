"""Native storage: a folder of Parquet tables, one for each object, with its kind, parent and calibration.

Saving writes a table beside its description; reading gives the table, the
description and the calibration back.  A schema version in each description
selects upgrades when old folders are read.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.model import Calibration

VERSION = 2


@dataclass
class Stored:
    frame: DataFrame
    kind: str
    params: dict
    calibration: Calibration | None
    parent: str | None = None


def save(frame: DataFrame, root: str, name: str, kind: str, calibration: Calibration | None = None, params: dict | None = None, parent: str | None = None, mode: str = "error", partition_by: tuple[str, ...] = ()) -> None:
    """Write an object; modes as for Spark's writers (error, overwrite, append, ignore)."""
    writer = frame.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root}/{name}/table")
    row = (VERSION, kind, json.dumps(params or {}, sort_keys=True), json.dumps(asdict(calibration)) if calibration else None, parent)
    frame.sparkSession.createDataFrame([row], "version int, kind string, params string, calibration string, parent string").coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}/about")


def upgrade(row: dict) -> dict:
    """Bring an older description up to date; version 1 kept the calibration among the parameters."""
    if row["version"] < 2:
        params = json.loads(row["params"])
        row = row | {"calibration": json.dumps(params.pop("calibration")) if "calibration" in params else None, "params": json.dumps(params), "parent": row.get("parent"), "version": 2}
    return row


def read(spark: SparkSession, root: str, name: str) -> Stored:
    row = upgrade(spark.read.parquet(f"{root}/{name}/about").first().asDict())
    cal = Calibration(**json.loads(row["calibration"])) if row["calibration"] else None
    return Stored(spark.read.parquet(f"{root}/{name}/table"), row["kind"], json.loads(row["params"]), cal, row["parent"])


def save_tree(objects: dict[str, Stored], root: str, mode: str = "error") -> None:
    for name, o in objects.items():
        save(o.frame, root, name, o.kind, o.calibration, o.params, o.parent, mode)


def listing(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """name, kind and parent of stored objects."""
    parts = [spark.read.parquet(f"{root}/{n}/about").select(F.lit(n).alias("name"), "kind", "parent") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def ang_lines(orientations: DataFrame, step: float = 1.0) -> DataFrame:
    """Lines (value) of an EBSD text: Euler angles, position, quality, confidence, phase.

    ``orientations`` has rx, ry, corr and matrix (9 numbers, row-major); angles by
    Bunge's convention.
    """
    m = lambda i, j: F.element_at("matrix", 3 * i + j + 1)
    tilt = F.acos(F.least(F.greatest(m(2, 2), F.lit(-1.0)), F.lit(1.0)))
    flat = F.abs(F.sin(tilt)) < 1e-9
    turn = 6.283185307179586
    phi1 = F.pmod(F.when(flat, F.atan2(m(0, 1), m(0, 0))).otherwise(F.atan2(m(2, 0), -m(2, 1))), F.lit(turn))
    phi2 = F.pmod(F.when(flat, F.lit(0.0)).otherwise(F.atan2(m(0, 2), m(1, 2))), F.lit(turn))
    return orientations.where("match = 0").orderBy("ry", "rx").select(F.format_string("%9.5f %9.5f %9.5f %12.5f %12.5f %8.1f %6.3f %2d", phi1, tilt, phi2, F.col("rx") * step, F.col("ry") * step, F.col("corr") * 100, F.least("corr", F.lit(1.0)), F.lit(1)).alias("value"))


def save_ang(orientations: DataFrame, path: str, step: float = 1.0, mode: str = "error") -> None:
    ang_lines(orientations, step).write.mode(mode).text(path)
