"""Detector file formats read through Spark: type by name, EMPAD raw frames, MIB frames, lazy reductions.

``binaryFile`` hands each file to one task; a file's frames become rows there.
Any file system that Spark reads serves.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File extensions and what they hold.
EXTENSIONS = {
    "h5": "hdf5", "hdf5": "hdf5", "emd": "native", "dm": "dm", "dm3": "dm", "dm4": "dm", "raw": "empad", "mrc": "mrc", "gtg": "gatan_K2_bin", "bin": "gatan_K2_bin",
    "kitware_counted": "kitware_counted", "mib": "mib", "parquet": "catalog", "ang": "ang",
}
EMPAD_ROWS, EMPAD_KEEP, EMPAD_COLS = 130, 128, 128


def file_type(path: Column) -> Column:
    """Type of a file by its extension; null if unknown."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.try_element_at(table, extension)


def read_empad(spark: SparkSession, path: str, shape: tuple[int, int] | None = None, bin_factor: int = 1) -> DataFrame:
    """Frames of raw float32 files of 130 x 128 pixels, whose last two rows are dropped.

    The scan is square unless ``shape`` is given; binning sums blocks while the
    file is read.
    """
    n = EMPAD_KEEP // bin_factor

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content):
                raw = np.frombuffer(content, "<f4").reshape(-1, EMPAD_ROWS, EMPAD_COLS)
                ny = shape[1] if shape else math.isqrt(len(raw))
                if (shape[0] * shape[1] if shape else ny * ny) != len(raw):
                    raise ValueError(f"{name}: {len(raw)} frames do not fill the scan")
                for at in range(0, len(raw), 256):
                    part = raw[at : at + 256, :EMPAD_KEEP].astype(float)
                    if bin_factor > 1:
                        part = part[:, : n * bin_factor, : n * bin_factor].reshape(len(part), n, bin_factor, n, bin_factor).sum(axis=(2, 4))
                    k = np.arange(at, at + len(part))
                    yield pd.DataFrame({"file": name, "rx": k // ny, "ry": k % ny, "data": [p.ravel() for p in part]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, rx long, ry long, data array<double>")


def write_empad(frames: np.ndarray) -> bytes:
    """A raw file of (n, 128, 128) frames, with two empty rows under each."""
    return np.pad(frames.astype("<f4"), ((0, 0), (0, EMPAD_ROWS - EMPAD_KEEP), (0, 0))).tobytes()


def parse_mib_header(head: str) -> dict:
    """Fields of a Merlin frame header: sequence, header bytes, chips, width, height, pixel type, depth."""
    f = head.split(",")
    kind = f[6].strip()
    chips = int(f[3])
    depth = {"U08": 8, "U16": 16, "U32": 32, "U64": 64, "R64": 64}.get(kind)
    if depth is None:
        raise ValueError(f"unknown pixel type {kind}")
    return {"sequence": int(f[1]), "offset": int(f[2]), "chips": chips, "width": int(f[4]), "height": int(f[5]), "type": kind, "depth": depth}


def mib_scan_size(header: str) -> tuple[int, int] | None:
    """Scan size from the text of a .hdr file: frames in acquisition over frames per trigger."""
    total = re.search(r"Frames in Acquisition \(Number\):\s*(\d+)", header)
    line = re.search(r"Frames per Trigger \(Number\):\s*(\d+)", header)
    if not total or not line or int(line[1]) == 0:
        return None
    return int(total[1]) // int(line[1]), int(line[1])


def read_mib(spark: SparkSession, path: str, shape: tuple[int, int] | None = None) -> DataFrame:
    """Frames of Merlin files of whole-byte pixels, big-endian; each frame has its own header.

    Without a shape the scan is one line.
    """

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content):
                h = parse_mib_header(content[:384].decode("latin-1"))
                kind = np.dtype(f">u{h['depth'] // 8}")
                size = h["offset"] + h["width"] * h["height"] * kind.itemsize
                n = len(content) // size
                ny = shape[1] if shape else max(n, 1)
                for k in range(n):
                    a = np.frombuffer(content, kind, h["width"] * h["height"], k * size + h["offset"])
                    yield pd.DataFrame({"file": [name], "rx": [k // ny], "ry": [k % ny], "width": [h["width"]], "height": [h["height"]], "data": [a.astype(float)]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, rx long, ry long, width long, height long, data array<double>")


def write_mib(frames: np.ndarray, depth: int = 16) -> bytes:
    """Frames with a header of 384 bytes each."""
    out = []
    for k, a in enumerate(frames):
        head = f"MQ1,{k + 1:06d},00384,01,{a.shape[1]:04d},{a.shape[0]:04d},U{depth:02d},".ljust(384)
        out.append(head.encode("latin-1") + a.astype(f">u{depth // 8}").tobytes())
    return b"".join(out)


def flat_field(cube: DataFrame, gain: list[float]) -> DataFrame:
    """Frames times median(gain) / gain; dead pixels (gain 0) become 0."""
    mid = float(np.median(gain))
    factor = F.array(*[F.lit(mid / g if g else 0.0) for g in gain])
    return cube.withColumn("data", F.transform("data", lambda v, k: v * F.get(factor, k)))


def calibrate_units(pixel_size: float, units: str, volts: float | None = None) -> tuple[float, str]:
    """Reciprocal pixel size in 1/Angstrom from mrad (with the voltage), 1/nm or 1/Angstrom; other units mean pixels."""
    from lattiq.operators.crystal import wavelength

    name = units.strip().replace("Å", "A").replace("⁻¹", "^-1")
    if name in ("1/nm", "nm^-1"):
        return pixel_size / 10, "A^-1"
    if name in ("1/A", "A^-1"):
        return pixel_size, "A^-1"
    if name == "mrad" and volts:
        return pixel_size * 1e-3 / wavelength(volts), "A^-1"
    return 1.0, "pixels"


def lazy_reduce(cube: DataFrame, over: str, how: str = "mean") -> DataFrame:
    """mean, sum or max over the scan ('r') or over the detector ('q')."""
    if over == "q":
        agg = {"sum": lambda d: F.aggregate(d, F.lit(0.0), lambda a, v: a + v), "max": F.array_max, "mean": lambda d: F.aggregate(d, F.lit(0.0), lambda a, v: a + v) / F.size(d)}[how]
        return cube.select("rx", "ry", agg("data").alias("value"))
    agg = {"sum": F.sum, "max": F.max, "mean": F.avg}[how]
    return cube.select(F.posexplode("data").alias("k", "i")).groupBy("k").agg(agg("i").alias("value"))
