"""Applying a change feed of inserts, updates and deletes (OP-18, 20, 21, 30, 31, 118).

The feed may arrive late, repeated and in any order.  Each change has a place
(``order`` columns, compared left to right); of a key, the change with the
highest place decides.  Deletes stay in the table as tombstones with their
place, so that an older change that arrives later can't revive a key.

Defined results: a change without key, operation or place does nothing, nor
does an unknown operation; of several changes at one place the greatest by
operation and content holds (repeats of one record are equal); an empty feed
leaves the table as it is; columns of the feed that aren't named don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamiz.operators.buckets import BucketTable


def normalize(feed: DataFrame, key: Column, op: Column, order: dict[str, Column], content: Column) -> DataFrame:
    """Changes as ``key``, ``place``, ``deleted``, ``content``."""
    kind = F.lower(F.regexp_replace(op, r"[^\p{L}]+", ""))
    rows = feed.select(
        key.cast("long").alias("key"),
        F.struct(*(c.cast("long").alias(n) for n, c in order.items())).alias("place"),
        F.when(kind.isin("delete", "remove"), True).when(kind.isin("index", "insert", "update", "upsert"), False).alias("deleted"),
        content.alias("content"),
    )
    return rows.filter(F.col("key").isNotNull() & F.col("deleted").isNotNull() & F.expr(" AND ".join(f"place.{n} IS NOT NULL" for n in order))).withColumn("content", F.when(~F.col("deleted"), F.col("content")))


def fold(rows: DataFrame, by: list[str]) -> DataFrame:
    """The last change of each key; combines before it shuffles, so a key with many changes costs one row a task."""
    last = F.max(F.struct("place", "deleted", "content")).alias("last")
    return rows.groupBy(*by).agg(last).select(*by, "last.place", "last.deleted", "last.content")


def later(old: Callable[[str], Column], new: Callable[[str], Column], alone: Column) -> dict[str, Column]:
    """Of the stored and the new last change of a key, the one with the highest place."""
    parts = ["place", "deleted", "content"]
    wins = alone | (F.struct(*map(new, parts)) > F.struct(*map(old, parts)))
    return {c: F.when(wins, new(c)).otherwise(old(c)) for c in parts}


def open_table(spark: SparkSession, path: str, changes: DataFrame, buckets: int | None = None) -> BucketTable:
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in changes.schema])
    return BucketTable(spark, path, schema, ["key"], fold, later, buckets)


def live(table: DataFrame) -> DataFrame:
    """Current state: the keys whose last change is no delete."""
    return table.filter(~F.col("deleted")).select("key", "place.*", "content")
