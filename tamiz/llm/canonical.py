"""Records equal but for formatting (problem 3).

Method: incremental ledger.  A record's canonical key is the hash of its
canonical title and its sorted canonical description fields.  The ledger is a
bucketed table of key, number of records and earliest representative; a new
batch is aggregated by key and joined, full outer and bucket by bucket, with
the buckets it touches: counts add, the smallest id stays.  A batch that comes
with its number is counted once however often it is delivered.

A group with a third of all records is one ledger row; its members find it by a
broadcast of the heavy keys, whose number is bounded (``join_lookup``).

Defined results: records without title or description content, or without id,
are no cases; a record delivered twice counts twice in ``n_records`` and once
in the pairs; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamiz.functions.text import NOT_WORD
from tamiz.operators.buckets import BucketTable
from tamiz.operators.skew import join_lookup

FIELD_BREAK = "[;|•\\r\\n\\x{0b}\\x{0c}\\x{85}\\x{2028}\\x{2029}]|//"


def plain(col: Column) -> Column:
    """Case doesn't count, other characters than letters and digits count as one blank, outer blanks as none."""
    return F.trim(F.regexp_replace(F.lower(col), NOT_WORD, " "))


def canonical_key(title: Column, description: Column) -> Column:
    """16 bytes; null if title or description has no content."""
    fields = F.array_sort(F.filter(F.transform(F.split(description, FIELD_BREAK), plain), lambda x: x != ""))
    head = plain(title)
    text = F.concat(head, F.lit("\n"), F.array_join(fields, ";"))
    return F.when((head != "") & (F.size(fields) > 0), F.unhex(F.md5(text)))


def keyed(docs: DataFrame) -> DataFrame:
    """``key, id, load_id`` of all records; the key of one that is no case is null.

    Not filtered here: the optimizer would move the filter below and compute
    every key twice.  Write the result first, then take its :func:`cases`.
    """
    return docs.select(canonical_key(F.col("title"), F.col("description")).alias("key"), F.col("id").cast("long").alias("id"), "load_id")


def cases(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("key").isNotNull() & F.col("id").isNotNull())


SCHEMA = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("n_records", T.LongType()), T.StructField("keep_id", T.LongType())])


def _fold(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("n_records").alias("n_records"), F.min("keep_id").alias("keep_id"))


def _add(old: Callable[[str], Column], new: Callable[[str], Column], alone: Column) -> dict[str, Column]:
    return {"n_records": new("n_records") + F.coalesce(old("n_records"), F.lit(0)), "keep_id": F.least(old("keep_id"), new("keep_id"))}


def open_ledger(spark: SparkSession, path: str, buckets: int | None = None) -> BucketTable:
    return BucketTable(spark, path, SCHEMA, ["key"], _fold, _add, buckets)


def add_batch(ledger: BucketTable, rows: DataFrame, writer: str | None = None, number: int | None = None) -> int:
    return ledger.commit(cases(rows).select("key", F.lit(1).alias("n_records"), F.col("id").alias("keep_id")), writer, number)


def copies(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """``keep_id, copy_id``: every other record of a group with its representative."""
    groups = ledger.filter(F.col("n_records") > 1)
    total = ledger.agg(F.coalesce(F.sum("n_records"), F.lit(0))).first()[0]
    return join_lookup(cases(rows).select("key", "id"), groups, ["key"], "n_records", total).filter(F.col("id") != F.col("keep_id")).select("keep_id", F.col("id").alias("copy_id")).distinct()
