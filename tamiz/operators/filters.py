"""Filters over the column table (OP-72 to 78)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.plans.request import Eq, In, Range
from tamiz.schema import IndexSchema


def predicate(schema: IndexSchema, field: str, f: Eq | In | Range, strict: bool = False) -> Column:
    """A field that isn't declared for the kind of filter matches nothing, or raises if ``strict``."""
    keyword = {x.name for x in schema.keyword_fields}
    numeric = {x.name for x in schema.numeric_fields}
    if field not in (numeric if isinstance(f, Range) else keyword):
        if strict:
            raise ValueError(f"no such filter field: {field}")
        return F.lit(False)
    col = F.col(f"`{field}`")
    if isinstance(f, Eq):
        return col == F.lit(f.value)
    if isinstance(f, In):
        return col.isin(list(f.values)) if f.values else F.lit(False)
    out = col.isNotNull()
    if f.gte is not None:
        out &= col >= F.lit(float(f.gte))
    if f.lte is not None:
        out &= (col <= F.lit(float(f.lte))) & ~F.isnan(col)
    return out


def apply_filters(columns: DataFrame, schema: IndexSchema, filters: dict[str, Eq | In | Range], strict: bool = False) -> DataFrame:
    """Rows of the column table that pass all filters."""
    if not filters:
        return columns
    return columns.filter(reduce(Column.__and__, [predicate(schema, k, f, strict) for k, f in filters.items()]))


def facets(matched: DataFrame, columns: DataFrame, schema: IndexSchema, fields: tuple[str, ...]) -> DataFrame:
    """``field, value, count`` over the matched ids, missing values left out (OP-81 to 84): one pass for all fields."""
    known = [f for f in fields if f in {x.name for x in schema.keyword_fields}]
    if not known:
        return columns.sparkSession.createDataFrame([], "field string, value string, count long")
    rows = columns.join(matched.select("id"), "id", "left_semi")
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("value")) for f in known)))
    return rows.select(pairs.alias("x")).select("x.*").filter(F.col("value").isNotNull()).groupBy("field", "value").count()


def ordered_facets(counts: DataFrame) -> DataFrame:
    """By field, then by falling count; ties by value."""
    return counts.orderBy("field", F.desc("count"), "value")
