"""A table kept in hash buckets, changed by copy-on-write and a manifest.

Every bucket is a file sorted by key, in the layout of Spark's bucketed tables.
A commit reduces its batch to one row a key and writes it in the same layout,
which evaluates the batch once.  The touched buckets are then merged with it, bucket
by bucket, as a sort-merge join in which no stored row moves.  The replacement
files go to a folder of their own, and a manifest is published that
names the files of every bucket.  Buckets that held nothing take the batch's
own files.

Readers that hold one of the last ``KEPT`` versions keep a consistent view;
files that only older ones name are deleted.  Of two writers that started from
one version, the second fails.  A batch with a ``writer`` and a number is
applied once: the manifest holds each writer's last number.

The number of buckets follows the size of the table: it starts at
``LEAST_BUCKETS``, or as the first batch needs, and doubles when buckets grow
beyond ``BUCKET_BYTES``, which rewrites the table.  Rows without a whole key
are left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamiz.operators.manifest import Manifests, fresh

BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS, KEPT = 256 << 20, 8, 1 << 16, 2
_UNKNOWN = 1 << 60  # what a plan without statistics is said to hold
_BUCKET = re.compile(r"_(\d+)\.c\d+\..*parquet$")

Reduce = Callable[[DataFrame, list[str]], DataFrame]
Combine = Callable[[Callable[[str], Column], Callable[[str], Column], Column], dict[str, Column]]


class BucketTable:
    """``schema`` is that of the stored rows, ``keys`` identify a row.

    ``reduce`` takes rows of a batch and the columns to group by and returns
    one row a key.  ``combine`` takes the stored and the new value of a column
    by name, and whether the new row is the only one; it returns the other
    columns of the merged row.  Where the order of commits isn't to matter,
    both have to be associative.  ``buckets`` fixes their number.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], reduce: Reduce, combine: Combine, buckets: int | None = None):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, keys
        self.reduce, self.combine, self.buckets = reduce, combine, buckets
        self._manifests = Manifests(spark, f"{path}/_manifest")

    def version(self) -> int:
        """0 if the table is empty."""
        return self._manifests.latest()[0]

    def manifest(self, version: int | None = None) -> dict:
        """``buckets``: their number; ``files``: bucket to files; ``bytes``; ``writers``: last number of each."""
        held = self._manifests.latest()[1] if version is None else self._manifests.read(version)
        held = held or {"buckets": 0, "files": {}, "bytes": {}, "writers": {}}
        return {**held, "files": {int(b): f for b, f in held["files"].items()}, "bytes": {int(b): n for b, n in held["bytes"].items()}}

    # rows ---------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        held = self.manifest(version)
        return self._open(held["buckets"], held["files"])

    def _open(self, buckets: int, files: dict[int, list[str]]) -> DataFrame:
        """The buckets as one frame whose plan knows that it is hashed and sorted by key."""
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return bucketed_scan(self.spark, [f"{self.path}/{f}" for b in sorted(files) for f in files[b]], self.schema, self.keys, buckets)

    def _write(self, rows: DataFrame, folder: str, buckets: int) -> tuple[dict[int, list[str]], dict[int, int]]:
        """Rows by bucket, each sorted by key; files and bytes of every bucket that has rows."""
        name = f"tamiz_{uuid4().hex}"
        rows.write.format("parquet").bucketBy(buckets, *self.keys).sortBy(*self.keys).option("path", f"{self.path}/{folder}").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay
        files: dict[int, list[str]] = {}
        sizes: dict[int, int] = {}
        for n, size in self._manifests.files(f"{self.path}/{folder}"):
            if m := _BUCKET.search(n):
                files.setdefault(int(m.group(1)), []).append(f"{folder}/{n}")
                sizes[int(m.group(1))] = sizes.get(int(m.group(1)), 0) + size
        return files, sizes

    def _merged(self, old: DataFrame, new: DataFrame) -> DataFrame:
        one, two = old.withColumn("_held", F.lit(True)).alias("o"), new.alias("n")
        on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in self.keys]
        both = one.join(two.withColumn("_came", F.lit(True)).alias("n").hint("merge"), on, "full_outer")
        value, change = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
        rest = self.combine(value, change, F.col("_held").isNull())
        untouched = F.col("_came").isNull()
        out = [F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in self.keys]
        out += [F.when(untouched, value(f.name)).otherwise(rest[f.name]).alias(f.name) for f in self.schema if f.name not in self.keys]
        return both.select(*out).select(*self.schema.names)

    def _number(self, held: dict, rows: DataFrame) -> int:
        """Buckets for the table with ``rows`` added; never fewer than it has."""
        if self.buckets:
            return self.buckets
        now = held["buckets"] or LEAST_BUCKETS
        stored = sum(held["bytes"].values())
        if not stored:  # nothing is measured yet: what the optimizer says of the batch, if it can say anything
            said = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            stored = said if said < _UNKNOWN else 0
        while now < MOST_BUCKETS and stored > 2 * now * BUCKET_BYTES:
            now *= 2
        return now

    def commit(self, batch: DataFrame, writer: str | None = None, number: int | None = None) -> int:
        """Merge ``batch``, which has the columns of the table, and return the new version.

        With ``writer``, a batch whose ``number`` isn't above that writer's
        last one was applied before and changes nothing.
        """
        base, _ = self._manifests.latest()
        held = self.manifest(base)
        if writer is not None and held["writers"].get(writer, -1) >= number:
            return base
        named = batch.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema)).dropna(subset=self.keys)
        buckets = self._number(held, named)
        folder = fresh(f"data/{base + 1:010d}")
        with shuffle_partitions(self.spark, buckets):
            files, sizes = self._write(self.reduce(named, self.keys).select(*self.schema.names), f"{folder}/new", buckets)
            if held["files"] and buckets != held["buckets"]:
                everything = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for fs in held["files"].values() for f in fs))
                files, sizes = self._write(self._merged(everything, self._open(buckets, files)), f"{folder}/merged", buckets)
                held = {**held, "files": {}, "bytes": {}}
            elif touched := files.keys() & held["files"].keys():
                old, new = (self._open(buckets, {b: of[b] for b in touched}) for of in (held["files"], files))
                merged, merged_sizes = self._write(self._merged(old, new), f"{folder}/merged", buckets)
                files, sizes = {**files, **merged}, {**sizes, **merged_sizes}
        writers = held["writers"] if writer is None else {**held["writers"], writer: number}
        if not files and writers == held["writers"]:
            return base
        version = self._manifests.publish(base, {"buckets": buckets, "files": {**held["files"], **files}, "bytes": {**held["bytes"], **sizes}, "writers": writers})
        self._manifests.expire(version, KEPT, f"{self.path}/data", lambda m: (f for fs in m["files"].values() for f in fs))
        return version


@contextmanager
def shuffle_partitions(spark: SparkSession, n: int):
    """Shuffles planned inside make as many parts as there are buckets, so that a batch moves once."""
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.legacy.bucketedTableScan.outputOrdering", "spark.sql.sources.bucketing.enabled"]
    before = [spark.conf.get(c, None) for c in names]
    for c, v in zip(names, (str(n), str(n), "true", "true")):
        spark.conf.set(c, v)
    try:
        yield
    finally:
        for c, v in zip(names, before):
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def bucketed_scan(spark: SparkSession, files: Iterable[str], schema: T.StructType, keys: list[str], buckets: int) -> DataFrame:
    """Files of a bucketed write, wherever they lie, as the scan of a bucketed table.

    A catalogue table lies in one folder, a version of this one in many; so the
    relation is made from its parts.
    """
    jvm, session = spark._jvm, spark._jsparkSession
    sources = jvm.org.apache.spark.sql.execution.datasources
    seq = jvm.PythonUtils.toSeq
    paths = jvm.java.util.ArrayList()
    for f in files:
        paths.add(jvm.org.apache.hadoop.fs.Path(f))
    columns = jvm.org.apache.spark.sql.types.DataType.fromJson(schema.json())
    options = jvm.PythonUtils.toScalaMap(jvm.java.util.HashMap())
    none = jvm.scala.Option.empty()
    index = sources.InMemoryFileIndex(session, seq(paths), options, jvm.scala.Some(columns), getattr(getattr(sources, "NoopCache$"), "MODULE$"), none, none)
    by = seq(list(keys))
    spec = jvm.org.apache.spark.sql.catalyst.catalog.BucketSpec(buckets, by, by)
    relation = sources.HadoopFsRelation(index, jvm.org.apache.spark.sql.types.StructType(), columns, jvm.scala.Some(spec), sources.parquet.ParquetFileFormat(), options, session)
    return DataFrame(session.baseRelationToDataFrame(relation), spark)
