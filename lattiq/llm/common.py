"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys, with a number each, that split_hot broadcasts at most.
HOT_KEYS = 50_000
#: Rows of a few numbers each that a join broadcasts at most, some 200 MB as a hash table.
BROADCAST_ROWS = 4_000_000
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of the frame has them, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir where it is set.

    Where it is unset, a local session gets a temporary folder (tests) and any
    other session the warehouse, never a machine-local folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        found = "file://" + tempfile.mkdtemp(prefix="lattiq-")
        spark.conf.set("spark.checkpoint.dir", found)
        return found
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/lattiq_work"


_spaces: list[Workspace] = []


class Workspace:
    """Written intermediate tables in the shared folder.

    A written table is computed once and survives lost executors, which a cache
    or a local checkpoint does not.  ``drop`` removes a table no longer needed;
    what a lazy result still reads goes with ``sweep``, when that result is stored.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}", {}
        _spaces.append(self)

    def write(self, df: DataFrame, name: str, codec: str = "zstd", batch: int = 2048) -> DataFrame:
        path = f"{self.root}/{name}"
        schema = df.schema
        with batches_of(self.spark, batch):
            df.write.mode("overwrite").option("compression", codec).parquet(path)
        self.paths[name] = path
        release(self.spark)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str) -> None:
        self._delete(self.paths.pop(name))

    def clear(self) -> None:
        self.paths.clear()
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def open_spaces() -> int:
    """How many workspaces are open; for ``sweep``."""
    return len(_spaces)


def sweep(since: int = 0) -> None:
    """Remove the workspaces opened after the first ``since``; for callers that have stored what they were built for."""
    while len(_spaces) > since:
        _spaces.pop().clear()


def release(spark: SparkSession) -> None:
    """Let the driver drop shuffle files of finished steps now rather than at its next full collection.

    Only files that no live DataFrame refers to go; the cleaner works beside the
    next step, after a moment.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def bounded(rows: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow, written frame to join with: broadcast if it has at most ``limit`` rows, else left to be shuffled."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows.hint("merge")


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes that a frame reads (the file sizes for a scan); 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


@contextmanager
def batches_of(spark: SparkSession, rows: int = 2048, size: int = 16 << 20):
    """Arrow batches of at most so many rows and bytes for what runs inside; the session's settings come back after."""
    mine = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k) for k in mine}
    for k, v in mine.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def slices(batches, rows: int, size: int = 16 << 20):
    """Arrow batches cut to at most ``rows`` rows and, where more than one row, about ``size`` bytes.

    Inside the worker, so that no setting of the session changes.  Memory that the
    task no longer uses goes back at its end, as the next task's worker is the same.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        each = max(1, min(rows, batch.num_rows * size // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, each):
            yield batch.slice(at, each)
    batch = None
    pa.default_memory_pool().release_unused()


def modest_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to 2,048 rows and 16 MiB where they are Spark's default.

    For owners of a session (the registered queries and the pipeline): a result is
    lazy, so what bounds its batches has to be there when it is run.  Operators set
    nothing; the values are the same for all of them.
    """
    for key, usual, mine in (("maxRecordsPerBatch", "10000", "2048"), ("maxBytesPerBatch", "67108864b", f"{16 << 20}b")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", mine)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0; a null id is never held out and never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0, F.lit(False))


def hash_share(col, share: float):
    """A repeatable sample of about ``share`` of the rows, chosen by a hash of ``col``."""
    if share >= 1:
        return F.lit(True)
    return F.pmod(F.xxhash64(col, F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))


def split_hot(rows: DataFrame, key: str, member: str, limit: int) -> DataFrame:
    """Deal the rows of keys with more than ``limit`` rows over cells of block pairs.

    Appends cell_i, cell_j and own.  A key's rows fall into k = ceil(rows / limit)
    blocks; a row of block b goes to the k cells (min(b, s), max(b, s)).  All
    pairs of a key then meet in exactly one cell if cells with i < j compare only
    rows of different blocks; no cell has more than about 2 * limit rows, and no
    pair is lost.  Keys under the limit have the one cell (0, 0).
    """
    whole = rows.withColumns({c: F.lit(0) for c in ("cell_i", "cell_j", "own")})
    spark = rows.sparkSession
    hot = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > limit)
    hot = hot.select(F.col(key).alias("__key"), F.ceil(F.col("__n") / limit).cast("int").alias("__k"))
    found = hot.limit(HOT_KEYS + 1).collect()
    if not found:
        return whole
    if len(found) <= HOT_KEYS:  # of checked size: the rows need no shuffle to meet it
        hot = F.broadcast(spark.createDataFrame(found, hot.schema))
    joined = rows.join(hot, F.col(key) == F.col("__key"), "left").withColumn("__k", F.coalesce("__k", F.lit(1)))
    joined = joined.withColumn("own", F.pmod(F.xxhash64(member, F.lit("cell")), F.col("__k")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("__k") - 1), lambda s: F.struct(F.least("own", s).alias("i"), F.greatest("own", s).alias("j")))
    spread = joined.withColumn("__cell", F.explode(cells))
    return spread.withColumn("cell_i", F.col("__cell.i")).withColumn("cell_j", F.col("__cell.j")).drop("__cell", "__k", "__key").select(*whole.columns)
