"""Reading documents and catalogue items (OP-01 to 06, 43, 45)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamiz.schema import DOCUMENT

MAX_BATCH = 10_000
ITEM = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("id", "site_id", "title")),
    T.StructField("price", T.DoubleType()),
    *(T.StructField(n, T.StringType()) for n in ("category_id", "condition")),
    T.StructField("attributes", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("id", "name", "value_name")]))),
    *(T.StructField(n, T.StringType()) for n in ("thumbnail", "status")),
])
_RAW = T.StructType([*(f for f in DOCUMENT if f.name != "attributes"), T.StructField("attributes", T.MapType(T.StringType(), T.StringType()))])


def typed_attribute(raw: Column) -> Column:
    """An attribute in JSON: tagged (``{"String": v}``, Number, Bool, StringArray) or bare."""
    tag = lambda name, kind: F.get_json_object(raw, f"$.{name}").try_cast(kind) if kind != "array<string>" else F.from_json(F.get_json_object(raw, f"$.{name}"), "array<string>")
    tagged = F.ltrim(raw).startswith("{")
    array = F.ltrim(raw).startswith("[")
    # a bare text comes without its quotes; what looks like a number or truth value is taken as one
    number = F.when(~tagged & ~array, raw.try_cast("double"))
    truth = F.when(raw.isin("true", "false"), raw == "true")
    return F.struct(
        F.when(tagged, tag("String", "string")).when(~array & number.isNull() & truth.isNull(), raw).alias("s"),
        F.when(tagged, tag("Number", "double")).otherwise(number).alias("n"),
        F.when(tagged, tag("Bool", "boolean")).otherwise(truth).alias("b"),
        F.when(tagged, tag("StringArray", "array<string>")).when(array, F.from_json(raw, "array<string>")).alias("a"),
    )


def documents_from_raw(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Documents of rows whose attributes are JSON texts; ``keep`` names further columns to keep."""
    attrs = F.coalesce(F.col("attributes"), F.create_map().cast("map<string,string>"))
    return raw.withColumn("attributes", F.map_from_entries(F.transform(F.map_entries(attrs), lambda e: F.struct(e["key"].alias("key"), typed_attribute(e["value"]).alias("value"))))).select(*(keep or []), *DOCUMENT.names)


def read_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Documents of a JSON array, or of one JSON object a line."""
    return documents_from_raw(spark.read.schema(_RAW).option("multiLine", not lines).option("mode", "FAILFAST").json(path))


def check_batch(docs: DataFrame, limit: int | None = MAX_BATCH) -> DataFrame:
    """The batch as it is, or an error for the whole batch: empty, above ``limit`` (None: any size), or a document without title."""
    n, bad = docs.agg(F.count("*"), F.count_if(F.coalesce(F.trim("title"), F.lit("")) == "")).first()
    if n == 0:
        raise ValueError("the batch is empty")
    if limit is not None and n > limit:
        raise ValueError(f"the batch has more than {limit} documents")
    if bad:
        raise ValueError("a document has no title")
    return docs


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue items of a JSON array; unknown keys are ignored."""
    return spark.read.schema(ITEM).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_item_lines(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue items, one JSON object a line; blank lines are skipped; the first bad line fails the read, with its number within its file."""
    lines = spark.read.schema("value string").option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    parsed = lines.filter(F.trim(F.regexp_replace("value", r"[\r\t]", " ")) != "").withColumn("item", F.from_json("value", T.StructType([*ITEM, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = parsed.filter(F.col("item").isNull() | F.col("item._bad").isNotNull() | F.col("item.id").isNull() | F.col("item.site_id").isNull()).orderBy("file", "n").first()
    if bad is not None:
        before = lines.filter((F.col("file") == bad.file) & (F.col("n") <= bad.n)).count()
        raise ValueError(f"line {before}: not a catalogue item")
    return parsed.select(*(F.col(f"item.{n}").alias(n) for n in ITEM.names))


def strip_site(col: Column, site: Column) -> Column:
    """The number after the site prefix; null if there is no prefix or no number."""
    rest = F.when(col.startswith(site), F.substring(col, F.length(site) + 1, F.length(col)))
    return F.when(rest.rlike(r"^\+?[0-9]+$"), rest.try_cast("bigint"))


def map_items(items: DataFrame) -> DataFrame:
    """Documents with ``error``: null, or why the item is no document.

    Attributes without value are dropped and keys lowered, the later of equal
    keys counts; condition, thumbnail and status override them if not empty.
    """
    number, category = strip_site(F.col("id"), F.col("site_id")), strip_site(F.col("category_id"), F.col("site_id"))
    own = F.transform(F.filter(F.coalesce("attributes", F.array().cast(ITEM["attributes"].dataType)), lambda a: a["value_name"].isNotNull() & a["id"].isNotNull()), lambda a: F.struct(F.lower(a["id"]).alias("key"), a["value_name"].alias("value")))
    extra = F.array(*(F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in ("condition", "thumbnail", "status")))
    pairs = F.concat(own, F.filter(extra, lambda e: F.coalesce(e["value"], F.lit("")) != ""))
    # the last of equal keys, without relying on the session's map policy
    last = F.filter(F.transform(pairs, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i"))), lambda e: ~F.exists(F.slice(pairs, e["i"] + 2, F.size(pairs)), lambda o: o["key"] == e["key"]))
    none = F.lit(None)
    attrs = F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("s"), none.cast("double").alias("n"), none.cast("boolean").alias("b"), none.cast("array<string>").alias("a")).alias("value"))))
    error = F.when(number.isNull(), F.concat(F.lit("invalid id: "), F.coalesce("id", F.lit("null")))).when(category.isNull(), F.concat(F.lit("invalid category_id: "), F.coalesce("category_id", F.lit("null"))))
    return items.select(number.alias("id"), "title", F.lit("").alias("description"), "price", category.cast("string").alias("category"), attrs.alias("attributes"), error.alias("error"))


def split_errors(mapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good documents, and the quarantined rows."""
    return mapped.filter(F.col("error").isNull()).drop("error"), mapped.filter(F.col("error").isNotNull())
