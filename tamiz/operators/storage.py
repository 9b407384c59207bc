"""Documents as segments with an operation log (OP-16 to 22, 27 to 32).

A store is a folder: ``segments/<n>`` Parquet folders of documents with their
sequence number, ``oplog/<n>`` folders of operations not yet flushed, and a
manifest naming what counts.  Reading takes, of each id, the row with the
greatest sequence number among segments and log, and drops deletes, so an
update replaces and a delete holds wherever it was written.  Folders that none of
the last ``KEPT`` manifests names are deleted.

A replica is another store: :func:`full_sync` copies the current state with its
sequence numbers, :func:`catch_up` what the log holds beyond them.

The store may also be split by shard: ``shard_of`` gives the shard of an id.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamiz.functions.routing import shard_of
from tamiz.operators.index import build
from tamiz.operators.manifest import Manifests, fresh
from tamiz.schema import DOCUMENT, IndexSchema

OPERATION = T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("id", T.LongType()), T.StructField("doc", DOCUMENT)])
ROW_OVERHEAD, BUFFER_BYTES, KEPT = 64, 64 << 20, 4


@dataclass
class Manifest:
    next_seq: int = 0
    next_part: int = 0
    log_from: int = 0  # the log holds all operations from here on
    segments: dict[str, int] = field(default_factory=dict)  # folder -> rows
    log: dict[str, int] = field(default_factory=dict)  # folder -> bytes


def latest(operations: DataFrame) -> DataFrame:
    """The last operation of each id by sequence number (OP-31, 118)."""
    return operations.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct("op", "doc", "seq"), "seq").alias("x")).select("id", "x.op", "x.doc", "x.seq")


def index_operations(docs: DataFrame) -> DataFrame:
    return docs.select(F.lit("index").alias("op"), "id", F.struct(*DOCUMENT.names).alias("doc"))


def delete_operations(ids: DataFrame) -> DataFrame:
    return ids.select(F.lit("delete").alias("op"), "id", F.lit(None).cast(DOCUMENT).alias("doc"))


def row_bytes(prefix: str = "doc.") -> Column:
    """Bytes of a row in a buffer: its texts plus a fixed overhead (OP-19)."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(f"{prefix}{c}"), F.lit(0)) for c in ("title", "description", "category")]) + ROW_OVERHEAD


def merges(segments: dict[str, int], least: int = 3, most: int = 10) -> list[str]:
    """The segments to merge now: the smallest, from ``least`` on, ``most`` at a time (OP-27)."""
    return sorted(segments, key=lambda s: (segments[s], s))[:most] if len(segments) >= least else []


class Store:
    def __init__(self, spark: SparkSession, path: str, buffer_bytes: int = BUFFER_BYTES):
        self.spark, self.path, self.buffer_bytes = spark, path, buffer_bytes
        self._manifests = Manifests(spark, f"{path}/manifest")
        self.version, held = self._manifests.latest()
        self.manifest = Manifest(**(held or {}))

    def _publish(self, **changes) -> None:
        m = Manifest(**{**self.manifest.__dict__, **changes})
        self.version = self._manifests.publish(self.version, m.__dict__)
        self.manifest = m
        for folder in ("segments", "oplog"):
            self._manifests.expire(m.next_part - 1, KEPT, f"{self.path}/{folder}", lambda x: [*x["segments"], *x["log"]])

    def _write(self, rows: DataFrame, folder: str) -> dict:
        """Write operations and say, from the same pass, how many, how large and up to which sequence number."""
        seen = Observation()
        rows.select(*OPERATION.names).observe(seen, F.count("*").alias("rows"), F.max("seq").alias("top"), F.coalesce(F.sum(row_bytes()), F.lit(0)).alias("bytes")).write.parquet(f"{self.path}/{folder}")
        return seen.get

    def _read(self, folders, schema: T.StructType = OPERATION) -> DataFrame:
        folders = list(folders)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    # writing

    def append(self, operations: DataFrame) -> None:
        """One commit to the log; sequence numbers grow in the order of ``seq`` or ``id`` and never return, also after a flush."""
        m = self.manifest
        part = fresh(f"oplog/{m.next_part:06d}")
        placed = operations.withColumn("_n", F.monotonically_increasing_id()) if "seq" not in operations.columns else operations.withColumnRenamed("seq", "_n")
        self._logged(part, self._write(placed.select((F.col("_n") + m.next_seq).alias("seq"), "op", "id", "doc"), part))

    def _logged(self, part: str, wrote: dict) -> None:
        m = self.manifest
        self._publish(next_part=m.next_part + 1, next_seq=m.next_seq if wrote["top"] is None else wrote["top"] + 1, log={**m.log, part: wrote["bytes"]})
        if sum(self.manifest.log.values()) >= self.buffer_bytes:
            self.flush()

    def apply(self, operations: DataFrame) -> None:
        """Operations that have their sequence numbers already; those that came before change nothing."""
        m = self.manifest
        part = fresh(f"oplog/{m.next_part:06d}")
        self._logged(part, self._write(operations.filter(F.col("seq") >= m.next_seq), part))

    def index(self, docs: DataFrame) -> None:
        self.append(index_operations(docs))

    def delete(self, ids: DataFrame) -> None:
        self.append(delete_operations(ids))

    def flush(self) -> None:
        """The log becomes a segment; small segments are merged."""
        m = self.manifest
        if not m.log:
            return
        part = fresh(f"segments/{m.next_part:06d}")
        rows = self._write(latest(self._read(m.log)), part)["rows"]
        self._publish(next_part=m.next_part + 1, log={}, log_from=m.next_seq, segments={**m.segments, part: rows})
        self.merge(merges(self.manifest.segments))

    def merge(self, folders: list[str]) -> None:
        """Rewrites segments as one; deletes are kept unless all segments are merged."""
        if len(folders) < 2:
            return
        m = self.manifest
        part = fresh(f"segments/{m.next_part:06d}")
        rows = latest(self._read(folders))
        if set(folders) == set(m.segments) and not m.log:
            rows = rows.filter("op = 'index'")
        count = self._write(rows, part)["rows"]
        rest = {k: v for k, v in m.segments.items() if k not in folders}
        self._publish(next_part=m.next_part + 1, segments={**rest, part: count})

    def compact(self) -> int:
        """Flush, then all live documents as one segment (OP-29, with :func:`tamiz.operators.index.build` for the tables derived); returns their number."""
        self.flush()
        m = self.manifest
        part = fresh(f"segments/{m.next_part:06d}")
        rows = self._write(latest(self._read(m.segments)).filter("op = 'index'"), part)["rows"]
        self._publish(next_part=m.next_part + 1, segments={part: rows})
        return rows

    # reading

    def operations(self) -> DataFrame:
        return self._read([*self.manifest.segments, *self.manifest.log])

    def read_since(self, seq: int) -> DataFrame:
        """Operations of the log from a sequence number on (OP-13)."""
        return self._read(self.manifest.log).filter(F.col("seq") >= seq)

    def documents(self) -> DataFrame:
        """Current state (OP-07, 14, 25)."""
        return latest(self.operations()).filter("op = 'index'").select("doc.*")

    def stats(self, shards: int = 1) -> DataFrame:
        """``shard_id, live_docs, segment_rows, buffered_rows, buffered_bytes``, with the total as shard null (OP-32)."""
        shard = shard_of(F.col("id"), shards).alias("shard_id")
        none = F.lit(0).cast("bigint")
        live = self.documents().select(shard, F.lit(1).alias("live"), none.alias("held"), none.alias("buffered"), none.alias("bytes"))
        held = self._read(self.manifest.segments).select(shard, none.alias("live"), F.lit(1).alias("held"), none.alias("buffered"), none.alias("bytes"))
        buffered = self._read(self.manifest.log).select(shard, none.alias("live"), none.alias("held"), F.lit(1).alias("buffered"), row_bytes().cast("bigint").alias("bytes"))
        sums = {"live": "live_docs", "held": "segment_rows", "buffered": "buffered_rows", "bytes": "buffered_bytes"}
        return live.unionByName(held).unionByName(buffered).rollup("shard_id").agg(*(F.sum(c).alias(n) for c, n in sums.items()))

    def summary(self) -> dict[str, int]:
        """Segments, and what is still in the log."""
        log = self._read(self.manifest.log)
        return {"segments": len(self.manifest.segments), "segment_rows": sum(self.manifest.segments.values()), "buffered_rows": log.count(), "buffered_bytes": sum(self.manifest.log.values())}

    def reindex(self, schema: IndexSchema, path: str) -> dict[str, float]:
        """Compacts, and writes the index tables of the live documents under a new schema."""
        began = time.perf_counter()
        rows = self.compact()
        build(self.documents(), schema).write(path)
        return {"docs_reindexed": rows, "elapsed_seconds": time.perf_counter() - began}


def full_sync(store: Store, replica: Store) -> None:
    """The replica becomes what the store is, with its sequence numbers; deletes come along, so that older operations can't revive an id."""
    m = replica.manifest
    part = fresh(f"segments/{m.next_part:06d}")
    rows = replica._write(latest(store.operations()), part)["rows"]
    replica._publish(next_part=m.next_part + 1, next_seq=store.manifest.next_seq, log_from=store.manifest.next_seq, log={}, segments={part: rows})


def catch_up(store: Store, replica: Store) -> str:
    """Brings a replica up to date: ``none``, ``log`` (operations it lacks) or ``full`` (the log doesn't reach back so far)."""
    at = replica.manifest.next_seq
    if at >= store.manifest.next_seq:
        return "none"
    if at < store.manifest.log_from:
        full_sync(store, replica)
        return "full"
    replica.apply(store.read_since(at))
    return "log"


def shard_stats(docs: DataFrame, shards: int) -> DataFrame:
    return docs.select(shard_of(F.col("id"), shards).alias("shard_id")).rollup("shard_id").agg(F.count("*").alias("live_docs"))


def write_sharded(docs: DataFrame, path: str, shards: int) -> None:
    """Documents partitioned by the shard of their id (OP-16, 17)."""
    docs.withColumn("shard_id", shard_of(F.col("id"), shards)).repartition("shard_id").write.mode("append").partitionBy("shard_id").parquet(path)
