"""Index tables of a document collection (OP-23 to 26, 50 to 62, 86).

``postings(term, id, field, tf, dl, head, lead)`` carries the length of the field and
whether the term is among its first three, so that scoring joins nothing but
the expanded terms.  Stemming runs over the distinct vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions.stemmers import stem_by
from tamiz.functions.analysis import term_array
from tamiz.schema import DOCUMENT, IndexSchema
from tamiz.session import spread

HEAD = 3


def tokens(docs: DataFrame, schema: IndexSchema) -> DataFrame:
    """``id, field, dl, pos, term`` of all text fields, from one scan; stemmed by a join with the stems of the distinct terms."""
    fields = schema.text_fields
    if not fields:
        return docs.sparkSession.createDataFrame([], "id long, field string, dl int, pos int, term string")
    # arrays first and lengths beside them, so that a text is analyzed once and its array isn't carried along with each of its terms;
    # explode_outer, since for a plain one the optimizer adds a filter on the array that analyzes every text twice
    arrays = docs.select("id", *(term_array(F.col(f.name), f.analyzer).alias(f"_{i}") for i, f in enumerate(fields)))
    stems_of = lambda f: f.analyzer.language.value if f.analyzer.language and f.analyzer.kind != "keyword" else None
    each = F.array(*(F.struct(F.lit(f.name).alias("field"), F.lit(stems_of(f)).cast("string").alias("lang"), F.size(f"_{i}").alias("dl"), F.col(f"_{i}").alias("terms")) for i, f in enumerate(fields)))
    sized = arrays.select("id", F.explode_outer(each).alias("x")).select("id", "x.field", "x.lang", "x.dl", "x.terms")
    flat = sized.select("id", "field", "lang", "dl", F.posexplode_outer("terms").alias("pos", "term")).filter(F.col("term").isNotNull())
    if not any(map(stems_of, fields)):
        return flat.drop("lang")
    spoken = flat.withColumn("lang", F.coalesce("lang", F.lit("")))
    stems = spoken.select("lang", "term").distinct().withColumn("stem", stem_by("lang", "term"))
    return spoken.join(stems, ["lang", "term"]).select("id", "field", "dl", "pos", F.col("stem").alias("term"))


def postings(tokens_: DataFrame, schema: IndexSchema) -> DataFrame:
    """``term, id, field, tf, dl, head, lead``; ``lead`` marks one row of each term and document, so that counting documents needs no further grouping."""
    fields = [f.name for f in schema.text_fields]
    of = lambda f, c: F.when(F.col("field") == f, F.col(c))
    seen = [x for i, f in enumerate(fields) for x in (F.count_if(F.col("field") == f).cast("int").alias(f"tf{i}"), F.max(of(f, "dl")).alias(f"dl{i}"), F.min(of(f, "pos")).alias(f"pos{i}"))]
    if not fields:
        return tokens_.select("term", "id", "field", F.lit(0).alias("tf"), "dl", F.lit(False).alias("head"), F.lit(False).alias("lead"))
    both = tokens_.groupBy("term", "id").agg(*seen)
    rows = []
    for i, f in enumerate(fields):
        first = F.lit(True)
        for j in range(i):
            first &= F.col(f"tf{j}") == 0
        rows.append(F.struct(F.lit(f).alias("field"), F.col(f"tf{i}").alias("tf"), F.col(f"dl{i}").alias("dl"), (F.col(f"pos{i}") < HEAD).alias("head"), first.alias("lead")))
    return both.select("term", "id", F.explode(F.array(*rows)).alias("x")).select("term", "id", "x.*").filter(F.col("tf") > 0)


def vocabulary(postings_: DataFrame) -> DataFrame:
    """``term, df``: documents that hold the term in any text field."""
    return postings_.groupBy("term").agg(F.count_if("lead").alias("df"))


def field_statistics(postings_: DataFrame, docs: DataFrame, schema: IndexSchema) -> DataFrame:
    """``field, n_docs, avgdl``: all live documents count, with or without text."""
    lengths = postings_.groupBy("field").agg(F.sum("tf").alias("tokens"))
    fields = docs.sparkSession.createDataFrame([(f.name,) for f in schema.text_fields], "field string")
    n = docs.agg(F.count("*").alias("n_docs"))  # one row
    return fields.join(lengths, "field", "left").join(F.broadcast(n)).select("field", "n_docs", F.coalesce(F.col("tokens") / F.greatest("n_docs", F.lit(1)), F.lit(0.0)).alias("avgdl"))


def columns(docs: DataFrame, schema: IndexSchema) -> DataFrame:
    """``id`` and one typed column per filterable or aggregatable field; a value of another type is missing."""
    attr = lambda name: F.try_element_at(F.col("attributes"), F.lit(name))
    out = [F.col("id")]
    for f in schema.keyword_fields:
        out.append((F.col("category") if f.name == "category" else attr(f.name)["s"]).alias(f.name))
    for f in schema.numeric_fields:
        out.append((F.col("price") if f.name == "price" else attr(f.name)["n"]).alias(f.name))
    return docs.select(*out)


@dataclass
class Index:
    schema: IndexSchema
    documents: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    statistics: DataFrame
    columns: DataFrame

    @cached_property
    def stats(self) -> dict[str, tuple[int, float]]:
        """Field to (documents, average length): one row a text field."""
        return {r.field: (r.n_docs, r.avgdl) for r in self.statistics.collect()}

    def persist(self) -> Index:
        """For an index that serves a few requests; one that is kept is written."""
        for t in (self.postings, self.vocabulary, self.columns):
            t.persist()
        return self

    def write(self, path: str) -> Index:
        """Postings and vocabulary in order of terms, so that a scan skips all but the files of its terms; returns the written index.

        The postings are computed once: what derives from them is read from them.
        """
        spark = self.documents.sparkSession
        self.documents.write.mode("overwrite").parquet(f"{path}/documents")
        docs = spark.read.parquet(f"{path}/documents")
        self.postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
        written = spark.read.parquet(f"{path}/postings")
        vocabulary(written).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/vocabulary")
        field_statistics(written, docs, self.schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")
        columns(docs, self.schema).write.mode("overwrite").parquet(f"{path}/columns")
        return Index.open(spark, path, self.schema)

    @staticmethod
    def open(spark: SparkSession, path: str, schema: IndexSchema) -> Index:
        return Index(schema, *(spark.read.parquet(f"{path}/{t}") for t in ("documents", "postings", "vocabulary", "statistics", "columns")))


def live(docs: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """Documents without the deleted ids (OP-07, 77)."""
    return docs if tombstones is None else docs.join(tombstones.select("id").distinct(), "id", "left_anti")


def build(docs: DataFrame, schema: IndexSchema, tombstones: DataFrame | None = None) -> Index:
    docs = live(docs.select(*(F.col(f.name) for f in DOCUMENT)), tombstones)
    p = postings(tokens(spread(docs), schema), schema)
    return Index(schema, docs, p, vocabulary(p), field_statistics(p, docs, schema), columns(docs, schema))
