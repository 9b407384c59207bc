"""Joins and running sums that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def join_lookup(big: DataFrame, lookup: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner", heavy_limit: int = 256) -> DataFrame:
    """Join ``big`` to ``lookup``, which has one row a key and in ``weight`` the
    rows of ``big`` that hold the key.

    Keys with more than ``total / heavy_limit`` rows number fewer than
    ``heavy_limit``, whatever the data: only those are broadcast, so that none
    of their rows move.  All other keys are joined by shuffle, where no key is
    larger than ``total / heavy_limit``.  ``how`` is inner or left.
    """
    floor = max(1, total // heavy_limit)
    heavy = lookup.filter(F.col(weight) > floor)
    light = lookup.filter(F.col(weight) <= floor)
    is_heavy = heavy.select(*keys, F.lit(True).alias("_heavy"))
    marked = big.join(F.broadcast(is_heavy), keys, "left")
    one = marked.filter(F.col("_heavy")).drop("_heavy").join(F.broadcast(heavy), keys, "inner")
    two = marked.filter(F.col("_heavy").isNull()).drop("_heavy").join(light, keys, how)
    return one.unionByName(two)


def running_sum(df: DataFrame, group: list[str], order: list[Column], slice_by: Column, amount: str, out: str) -> DataFrame:
    """Inclusive running sum of ``amount`` within ``group``, in order of ``slice_by`` and then ``order``.

    ``slice_by`` is a whole number that never falls along the order and of
    which a group has a bounded number of values.  Only the sums of the slices
    are accumulated over a whole group; rows are accumulated within a slice.
    """
    sliced = df.withColumn("_slice", slice_by)
    sums = sliced.groupBy(*group, "_slice").agg(F.sum(amount).alias("_sum"))
    over = W.orderBy("_slice") if not group else W.partitionBy(*group).orderBy("_slice")
    before = sums.withColumn("_before", F.sum("_sum").over(over.rowsBetween(W.unboundedPreceding, 0)) - F.col("_sum")).drop("_sum")
    inside = W.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    own = sliced.withColumn("_own", F.sum(amount).over(inside))
    return own.join(before, [*group, "_slice"]).withColumn(out, F.col("_before") + F.col("_own")).drop("_before", "_own", "_slice")
