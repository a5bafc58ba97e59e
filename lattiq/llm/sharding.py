"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that stays together.  Groups in order of
falling size go to the least-loaded shard through a heap.  Groups of one size
are interchangeable, so the heap works on (size, number of groups) classes: the
driver receives one row for each distinct group size, of which there are at most
sqrt(2 * total bytes), however many groups there are.  Runs of many equal groups
are dealt in closed form, which gives just what the heap would have given.

Ranks inside a class and slots inside a shard are prefix sums over salted
blocks, so neither a popular size nor a shard is ever sorted in one task.

Defined results: a null text has no bytes, crc 0 and shares the group of the
empty text; repeated rows are all placed, each with its own slot; an empty
table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace

OVERHEAD = 16
SALTS = 256


def schedule(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Longest-processing-time schedule of (size, count) classes.

    Returns for each class, in order of falling size, runs (shard, number of its
    groups).  Ties between loads go to the lowest shard.
    """
    loads, out = [0] * shards, []
    for size, count in sorted(classes, reverse=True):
        taken = [0] * shards
        if count > 4 * shards and size > 0:
            low, high = min(loads), max(loads) + size * count
            while high - low > 1:  # the highest level under which all starts belong to the schedule
                mid = (low + high) // 2
                if sum(max(0, -(-(mid - x) // size)) for x in loads) <= count:
                    low = mid
                else:
                    high = mid
            taken = [max(0, -(-(low - x) // size)) for x in loads]
            loads = [x + size * k for x, k in zip(loads, taken)]
            count -= sum(taken)
        heap = [(x, j) for j, x in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(count):
            load, j = heap[0]
            heapq.heapreplace(heap, (load + size, j))
            taken[j] += 1
            loads[j] = load + size
        out.append((size, [(j, k) for j, k in enumerate(taken) if k]))
    return out


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the group key; one pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("key"))


def numbered(df: DataFrame, group: list[str], order: list, salt, name: str) -> DataFrame:
    """Append the 0-based rank of each row in its group, counted over salted blocks."""
    spread = df.withColumn("__salt", F.pmod(salt, F.lit(SALTS)))
    before = W.partitionBy(*group).orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)
    blocks = spread.groupBy(*group, "__salt").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(W.partitionBy(*group, "__salt").orderBy(*order))
    return spread.join(blocks, [*group, "__salt"]).withColumn(name, (F.col("__before") + inside - 1).cast("long")).drop("__salt", "__before")


def shard_by_size(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Place every row: doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    space = Workspace(spark, "sharding")
    rows = space.write(digests(docs), "digests")
    groups = space.write(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    classes = [(r["bytes"], r["n"]) for r in groups.groupBy("bytes").agg(F.count("*").alias("n")).toLocalIterator()]
    runs = []
    for size, parts in schedule(classes, shards):
        ends, total = [], 0
        for _, k in parts:
            total += k
            ends.append(total)
        runs.append((size, ends, [j for j, _ in parts]))
    plan = spark.createDataFrame(runs, "bytes long, ends array<long>, targets array<int>")
    salt = F.xxhash64("key")
    ranked = numbered(groups, ["bytes"], ["key"], salt, "rank").join(plan, "bytes")
    placed = ranked.select("key", F.element_at("targets", F.size(F.filter("ends", lambda e: e <= F.col("rank"))) + 1).alias("shard"))
    full = space.write(rows.join(placed, "key").drop("key"), "placed")
    out = numbered(full, ["shard"], ["doc_id", "size", "text_crc32"], F.xxhash64("doc_id", "text_crc32"), "slot")
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")


def shards_of_documents(docs: DataFrame) -> DataFrame:
    """The contract's rows: 40 shards under the law ``bytes`` (sizes near equal)."""
    out = shard_by_size(docs, 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
