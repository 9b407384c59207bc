"""Column profiles per load, value masks and changes between loads.

Every figure is exact (distinct counts up to collisions of a 64-bit hash) and
computed over all rows.  Nothing is gathered by load
or by column alone: distinct counts group by (column, load, hash of the value),
value shares by (load, value), medians by (load, bin of the price) and then
within the one or two bins that hold the middle.

Defined results: rows without load id form a load of their own that comes
before all others and is compared with none; an empty table has no rows; a
change needs figures on both sides; nested columns are profiled as their JSON
text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

CENTS_PER_BIN = 16384
MAX_PRICE = 5_000_000
# The spellings that count as right.
CONDITIONS = ["new", "used", "refurbished", "not_specified"]
STATUSES = ["active", "paused", "closed", "under_review"]


def valid_price(price: Column) -> Column:
    """Finite, above 0, at most ``MAX_PRICE``, no more than two decimals."""
    return F.coalesce((price > 0) & (price <= MAX_PRICE) & (F.abs(price * 100 - F.round(price * 100)) <= 1e-4), F.lit(False))


def as_text(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    return F.to_json(F.col(column)) if isinstance(kind, (T.MapType, T.StructType, T.ArrayType)) else F.col(column).cast("string")


def previous_load(loads: DataFrame, load: str = "load_id") -> DataFrame:
    """``load`` and ``prev``, the next smaller one: one row a load."""
    return loads.select(load).filter(F.col(load).isNotNull()).distinct().withColumn("prev", F.lag(load).over(W.orderBy(load)))


def violations(df: DataFrame, table: str, column: str, valid: Column, key: str = "id", load: str = "load_id") -> DataFrame:
    """One row for each value, not null, that breaks the rule."""
    return df.filter(F.col(column).isNotNull() & ~F.coalesce(valid, F.lit(False))).select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), F.col(load).alias("load_id"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("record_id"), F.lit("pattern").alias("finding")).distinct()


def null_share_changes(df: DataFrame, table: str, columns: list[str], load: str = "load_id", above: float = 0.08) -> DataFrame:
    """Loads whose share of nulls differs from that of the load before by more than ``above``."""
    per = df.groupBy(load).agg(F.count("*").alias("n"), *(F.count(c).alias(f"k_{i}") for i, c in enumerate(columns)))
    flat = per.filter(F.col(load).isNotNull()).select(load, F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), (1 - F.col(f"k_{i}") / F.col("n")).alias("share")) for i, c in enumerate(columns)))).alias("x")).select(load, "x.*")
    before = F.lag("share").over(W.partitionBy("column_name").orderBy(load))
    return _finding(flat.withColumn("before", before).filter(F.abs(F.col("share") - F.col("before")) > above), table, load, "null_share")


def value_shift(df: DataFrame, table: str, column: str, load: str = "load_id", above: float = 0.2) -> DataFrame:
    """Loads whose values, as spelled and not null, are distributed otherwise than in the load before."""
    return _finding(value_distance(df, column, load).filter(F.col("distance") > above), table, load, "shift", column)


def value_distance(df: DataFrame, column: str, load: str = "load_id") -> DataFrame:
    """Half the sum over all values of the absolute difference of their shares in a load and in the one before."""
    counts = df.filter(F.col(load).isNotNull() & F.col(column).isNotNull()).groupBy(load, column).count()
    totals = counts.groupBy(load).agg(F.sum("count").alias("total"))
    steps = previous_load(df, load).filter(F.col("prev").isNotNull())
    both = steps.join(totals, load).join(totals.select(F.col(load).alias("prev"), F.col("total").alias("prev_total")), "prev")
    now = counts.join(both, load).select(load, column, (F.col("count") / F.col("total")).alias("d"))
    then = counts.withColumnRenamed(load, "prev").join(both, "prev").select(load, column, (-F.col("count") / F.col("prev_total")).alias("d"))
    return now.unionByName(then).groupBy(load, column).agg(F.abs(F.sum("d")).alias("d")).groupBy(load).agg((F.sum("d") / 2).alias("distance"))


def exact_medians(df: DataFrame, price: str, load: str = "load_id") -> DataFrame:
    """``load`` and ``median`` of its valid prices: counts per bin find the bin of the middle ranks, counts per cent within it the values."""
    cents = df.filter(valid_price(F.col(price))).select(load, F.round(F.col(price) * 100).cast("long").alias("cents")).groupBy(load, "cents").count().withColumn("bin", F.floor(F.col("cents") / CENTS_PER_BIN))
    bins = cents.groupBy(load, "bin").agg(F.sum("count").alias("n"))
    over = W.partitionBy(load)
    placed = bins.withColumn("before", F.sum("n").over(over.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).withColumn("total", F.sum("n").over(over))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)
    middle = placed.filter(((F.col("before") < low) & (low <= F.col("before") + F.col("n"))) | ((F.col("before") < high) & (high <= F.col("before") + F.col("n")))).select(load, "bin", "before", low.alias("low"), high.alias("high"))
    inside = cents.join(middle, [load, "bin"]).withColumn("upto", F.col("before") + F.sum("count").over(W.partitionBy(load, "bin").orderBy("cents").rowsBetween(W.unboundedPreceding, 0)))
    first = F.col("upto") - F.col("count") + 1
    holds = lambda rank: (first <= F.col(rank)) & (F.col(rank) <= F.col("upto"))
    return inside.groupBy(load).agg(((F.max(F.when(holds("low"), F.col("cents"))) + F.max(F.when(holds("high"), F.col("cents")))) / 200.0).alias("median"))


def median_shift(df: DataFrame, table: str, price: str, load: str = "load_id", factor: float = 1.5) -> DataFrame:
    m = exact_medians(df, price, load).filter(F.col(load).isNotNull())
    steps = previous_load(df, load)
    pairs = m.join(steps, load).join(m.select(F.col(load).alias("prev"), F.col("median").alias("before")), "prev")
    return _finding(pairs.filter((F.col("median") / F.col("before") > factor) | (F.col("before") / F.col("median") > factor)), table, load, "shift", price)


def _finding(df: DataFrame, table: str, load: str, finding: str, column: str | None = None) -> DataFrame:
    return df.select(F.lit(table).alias("table_name"), (F.lit(column) if column else F.col("column_name")).alias("column_name"), F.col(load).alias("load_id"), F.lit("").alias("record_id"), F.lit(finding).alias("finding"))


def column_profile(df: DataFrame, table: str, valid: dict[str, Column] | None = None, load: str = "load_id") -> DataFrame:
    """Rows, null share, distinct count, range and rule violations of every column and load."""
    valid = valid or {}
    columns = [c for c in df.columns if c != load]
    texts = [as_text(df, c) for c in columns]
    distinct = df.select(load, F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.xxhash64(t).alias("h"), t.isNull().alias("no")) for c, t in zip(columns, texts)))).alias("x")).filter(~F.col("x.no")).select(load, "x.column_name", "x.h").distinct().groupBy(load, "column_name").agg(F.count("*").alias("n_distinct"))
    aggs = [F.count("*").alias("n_rows")]
    for i, (c, t) in enumerate(zip(columns, texts)):
        aggs += [F.count(t).alias(f"k{i}"), F.min(F.col(c) if not _nested(df, c) else t).cast("string").alias(f"lo{i}"), F.max(F.col(c) if not _nested(df, c) else t).cast("string").alias(f"hi{i}"), F.count_if(F.col(c).isNotNull() & ~valid[c] if c in valid else F.lit(False)).alias(f"v{i}")]
    wide = df.groupBy(load).agg(*aggs)
    tall = wide.select(load, "n_rows", F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"k{i}").alias("n_values"), F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value"), F.col(f"v{i}").alias("n_violations")) for i, c in enumerate(columns)))).alias("x")).select(load, "n_rows", "x.*")
    other = distinct.select(F.col(load).alias("_load"), F.col("column_name").alias("_column"), "n_distinct")
    joined = tall.join(other, F.col(load).eqNullSafe(F.col("_load")) & (F.col("column_name") == F.col("_column")), "left")
    return joined.select(F.lit(table).alias("table_name"), "column_name", F.col(load).alias("load_id"), "n_rows", (1 - F.col("n_values") / F.col("n_rows")).alias("null_share"), F.coalesce("n_distinct", F.lit(0).cast("bigint")).alias("n_distinct"), "min_value", "max_value", "n_violations")


def _nested(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.MapType, T.StructType, T.ArrayType))


# masks ------------------------------------------------------------------


def mask(text: Column, long_mask: int = 64) -> Column:
    """Character-class generalisation: runs of capitals, small letters, digits and blanks as one sign, others as they are.

    In a mask of more than ``long_mask`` signs a group of up to 16 signs that
    comes again and again stands once, with a star.  Masks that are still
    longer, which would all differ, give their set of signs and the power of
    two of their length.
    """
    m = F.regexp_replace(text, r"\p{Lu}+", "A")
    m = F.regexp_replace(m, r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+", "a")
    m = F.regexp_replace(F.regexp_replace(m, r"\p{N}+", "9"), r"\s+", "_")

    def shorter(x: Column) -> Column:
        signs = F.array_join(F.array_sort(F.array_distinct(F.split(x, ""))), "")
        return F.when(F.length(x) <= long_mask, x).otherwise(F.concat(F.lit("~"), F.floor(F.log2(F.length(x))).cast("string"), F.lit(":"), signs))

    # each step as the element of an array, so that it is computed once and not wherever it is mentioned
    once = lambda x, then: F.transform(F.array(x), then)[0]
    return once(m, lambda x: F.when(F.length(x) <= long_mask, x).otherwise(once(F.regexp_replace(x, r"(.{1,16}?)\1+", "$1*"), shorter)))


def mask_counts(df: DataFrame, table: str, load: str = "load_id") -> DataFrame:
    """Rows of each mask by column and load, null left out."""
    columns = [c for c in df.columns if c != load]
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), mask(as_text(df, c)).alias("mask")) for c in columns))
    return df.select(F.col(load).alias("load_id"), F.explode(pairs).alias("x")).filter(F.col("x.mask").isNotNull()).groupBy(F.lit(table).alias("table_name"), F.col("x.column_name").alias("column_name"), "load_id", F.col("x.mask").alias("mask")).agg(F.count("*").alias("n"))


def mask_findings(counts: DataFrame, rare: float = 0.005, diverging: float = 0.2) -> DataFrame:
    """Masks below the share ``rare`` of their column, by load, and loads whose masks diverge from the load before.

    Of a column, the masks at or above ``rare`` are its dominant patterns.  A
    column where these cover less than half the values has no pattern to break
    or to lose, and yields neither violations nor shifts.  ``amount`` is the number of rows or the distance.
    """
    col = ["table_name", "column_name"]
    masks = counts.groupBy(*col, "mask").agg(F.sum("n").alias("mn"))
    totals = masks.groupBy(*col).agg(F.sum("mn").alias("tn"))
    shares = masks.join(F.broadcast(totals), col).withColumn("dominant", F.col("mn") >= rare * F.col("tn"))  # one row a column
    covered = shares.filter("dominant").groupBy(*col).agg((F.sum("mn") / F.first("tn")).alias("covered")).filter("covered >= 0.5")
    odd = shares.filter("NOT dominant").join(F.broadcast(covered), col).select(*col, "mask")
    violating = counts.join(odd, [*col, "mask"]).select(*col, "load_id", "mask", F.col("n").cast("double").alias("amount"), F.lit("rare_mask").alias("finding"))
    per_load = counts.filter(F.col("load_id").isNotNull()).groupBy(*col, "load_id").agg(F.sum("n").alias("ln"))
    steps = per_load.withColumn("next", F.lead("load_id").over(W.partitionBy(*col).orderBy("load_id")))
    share = counts.join(steps, [*col, "load_id"])
    now = share.select(*col, "load_id", "mask", (F.col("n") / F.col("ln")).alias("d"))
    then = share.filter(F.col("next").isNotNull()).select(*col, F.col("next").alias("load_id"), "mask", (-F.col("n") / F.col("ln")).alias("d"))
    first = per_load.groupBy(*col).agg(F.min("load_id").alias("first"))
    moved = now.unionByName(then).groupBy(*col, "load_id", "mask").agg(F.abs(F.sum("d")).alias("d")).groupBy(*col, "load_id").agg((F.sum("d") / 2).alias("amount")).join(F.broadcast(first), col).join(F.broadcast(covered), col).filter((F.col("load_id") > F.col("first")) & (F.col("amount") > diverging))
    return violating.unionByName(moved.select(*col, "load_id", F.lit("").alias("mask"), "amount", F.lit("mask_shift").alias("finding")))
