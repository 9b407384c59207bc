"""Operation logs as JSON lines (OP-12, 13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamiz.operators.storage import OPERATION
from tamiz.schema import DOCUMENT
from tamiz.sources.ingest import documents_from_raw

_RAW_DOC = T.StructType([*(f for f in DOCUMENT if f.name != "attributes"), T.StructField("attributes", T.MapType(T.StringType(), T.StringType()))])
_RAW = T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("id", T.LongType()), T.StructField("doc", _RAW_DOC)])


def read_operations(spark: SparkSession, path: str, since: int | None = None) -> DataFrame:
    """Records ``{"seq", "op", "id", "doc"}``, one a line; a torn or broken record is dropped, as the tail of a log after a crash."""
    raw = spark.read.schema(_RAW).option("mode", "DROPMALFORMED").json(path).filter(F.col("seq").isNotNull() & F.col("op").isNotNull())
    if since is not None:
        raw = raw.filter(F.col("seq") >= since)
    docs = documents_from_raw(raw.select("seq", "op", F.col("id").alias("_id"), "doc.*"), ["seq", "op", "_id"])
    return docs.select("seq", F.lower(F.trim("op")).alias("op"), F.coalesce("_id", "id").alias("id"), F.when(F.lower(F.trim("op")) != "delete", F.struct(*DOCUMENT.names)).alias("doc")).select(*OPERATION.names)


def write_operations(operations: DataFrame, path: str) -> None:
    """Append a batch as one commit, with attributes in their tagged form."""
    tagged = lambda v: F.to_json(F.struct(v["s"].alias("String"), v["n"].alias("Number"), v["b"].alias("Bool"), v["a"].alias("StringArray")))
    attrs = F.map_from_entries(F.transform(F.map_entries("doc.attributes"), lambda e: F.struct(e["key"], tagged(e["value"]))))
    base = [F.col(f"doc.{f.name}").alias(f.name) for f in DOCUMENT if f.name != "attributes"]
    operations.select("seq", "op", "id", F.when(F.col("doc").isNotNull(), F.struct(*base, attrs.alias("attributes"))).alias("doc")).write.mode("append").json(path)
