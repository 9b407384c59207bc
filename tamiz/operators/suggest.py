"""Autocomplete by document frequency (OP-40, 44, 86, 93, 106 to 111)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tamiz.functions.text import lower_tokens, tokenize
from tamiz.plans.request import DEFAULT_SUGGESTIONS, MAX_PREFIX_BYTES, MAX_SUGGESTIONS

MIN_FREQUENCY, MAX_TERMS = 2, 50_000
CONSISTENCY = "eventual"


def field_text(field: str) -> Column:
    """A base field, a string attribute, or a list attribute joined by blanks; else an empty text."""
    if field in ("title", "description", "category"):
        return F.coalesce(F.col(field), F.lit(""))
    attr = F.try_element_at(F.col("attributes"), F.lit(field))
    return F.coalesce(attr["s"], F.array_join(attr["a"], " "), F.lit(""))


def term_rows(docs: DataFrame, fields: tuple[str, ...] = ("title",)) -> DataFrame:
    """``id, field, term``: the distinct lower-case terms of each document and field, not stemmed."""
    parts = [docs.select("id", F.lit(f).alias("field"), F.explode_outer(F.array_distinct(lower_tokens(tokenize(field_text(f))))).alias("term")).filter(F.col("term").isNotNull()) for f in fields]
    return reduce(DataFrame.unionByName, parts)


def frequencies(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A term in two fields of a document counts twice; ``rows`` are distinct within a document and field."""
    return rows.groupBy(*by, "term").agg(F.count("*").alias("df"))


def build(freq: DataFrame, min_frequency: int = MIN_FREQUENCY, max_terms: int = MAX_TERMS, by: tuple[str, ...] = ()) -> DataFrame:
    """``term, df, score``: the ``max_terms`` most frequent terms (0: all) from ``min_frequency``, score in (0, 1]."""
    kept = freq.filter(F.col("df") >= min_frequency)
    if max_terms > 0:
        order = [F.desc("df"), F.asc("term")]
        if by:
            kept = kept.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= max_terms).drop("_r")
        else:
            kept = kept.orderBy(*order).limit(max_terms)
    top = kept.groupBy(*by).agg(F.max("df").alias("top"))
    joined = kept.join(F.broadcast(top), list(by)) if by else kept.crossJoin(F.broadcast(top))  # one row, or one a shard
    return joined.select(*by, "term", "df", (F.col("df") / F.greatest("top", F.lit(1))).alias("score"))


def validated(prefix: str, limit: int | None) -> tuple[str, int]:
    prefix = prefix.strip()
    if len(prefix.encode()) > MAX_PREFIX_BYTES:
        raise ValueError(f"the prefix is longer than {MAX_PREFIX_BYTES} bytes")
    return prefix, min(max(limit if limit is not None else DEFAULT_SUGGESTIONS, 1), MAX_SUGGESTIONS)


def lookup(table: DataFrame, prefix: str, limit: int) -> DataFrame:
    """The best terms that start with ``prefix``; an empty prefix or limit 0 finds nothing."""
    if not prefix or limit <= 0:
        return table.select("term", "score").filter(F.lit(False))
    return table.filter(F.col("term").startswith(prefix.lower())).select("term", "score").orderBy(F.desc("score"), "term").limit(limit)


def lookup_sharded(table: DataFrame, prefix: str, limit: int, shard: str = "shard_id") -> DataFrame:
    """Scores of the shards' own normalisation, merged by the greatest of each term."""
    if not prefix or limit <= 0:
        return table.select("term", "score").filter(F.lit(False))
    found = table.filter(F.col("term").startswith(prefix.lower()))
    best = W.partitionBy(shard).orderBy(F.desc("score"), "term")
    return found.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= limit).groupBy("term").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "term").limit(limit)


def suggest(table: DataFrame, q: str, limit: int | None = None) -> tuple[DataFrame, str]:
    """Suggestions and the consistency that callers may count on: they are as fresh as the last build."""
    prefix, n = validated(q, limit)
    return lookup(table, prefix, n), CONSISTENCY
