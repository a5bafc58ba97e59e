"""Exact quantiles of groups whose values need not fit in memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def grouped_quantiles(rows: DataFrame, keys: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """keys and a column for each share: exact quantiles, linear between neighbouring values.

    Equal values are counted before they are shuffled, so a counting detector
    sends each of its levels once a task; ranks are running sums over the sorted
    distinct values, which spill to disk where a buffer of one group would not
    fit.  Nulls do not count, and a group without values gives no row.
    """
    counts = rows.select(*keys, value.cast("double").alias("__v")).where("__v is not null").groupBy(*keys, "__v").agg(F.count("*").alias("__n"))
    group = W.partitionBy(*keys)
    upto = F.sum("__n").over(group.orderBy("__v").rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = counts.withColumn("__end", upto).withColumn("__last", F.sum("__n").over(group) - 1)

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("__end") - F.col("__n")) & (rank < F.col("__end")), F.col("__v")))

    def quantile(share: float) -> Column:
        place = F.col("__last") * share
        low, high = at(F.floor(place)), at(F.ceil(place))
        return low + (high - low) * F.max(place - F.floor(place))

    return ranked.groupBy(*keys).agg(*[quantile(share).alias(name) for name, share in shares.items()])
