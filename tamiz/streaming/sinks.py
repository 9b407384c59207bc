"""Streaming writers (OP-20, 33, 112 to 118): every sink has its own checkpoint, so a restart continues where it ended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tamiz.operators import changefeed
from tamiz.operators.buckets import BucketTable
from tamiz.operators.suggest import term_rows
from tamiz.session import materialize

FLUSH_SECONDS = 5


def _trigger(writer, available_now: bool, seconds: int):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")


def upsert_stream(changes: DataFrame, state: Callable[[DataFrame], BucketTable], checkpoint: str, available_now: bool = False, seconds: int = FLUSH_SECONDS, writer: str | None = None) -> StreamingQuery:
    """Applies a stream of normalized changes to a bucket table.

    A batch that is delivered again after a failure changes nothing: the table
    holds the number of the last batch of ``writer`` (the checkpoint's name
    unless given), and of a key the same change is its own equal.
    """

    def commit(batch: DataFrame, number: int) -> None:
        state(batch).commit(batch, writer or checkpoint, number)

    return _trigger(changes.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint), available_now, seconds).start()


def state_at(path: str) -> Callable[[DataFrame], BucketTable]:
    """The table at ``path``, opened in the session of a batch."""
    return lambda batch: changefeed.open_table(batch.sparkSession, path, batch)


def suggest_counts(documents: DataFrame, fields: tuple[str, ...] = ("title",)) -> DataFrame:
    """Streaming counts of terms, accumulated for ever (complete mode)."""
    return term_rows(documents, fields).groupBy("term").agg(F.count("*").alias("df"))


def suggest_stream(documents: DataFrame, publish: Callable[[DataFrame], None], checkpoint: str, fields: tuple[str, ...] = ("title",), available_now: bool = False, seconds: int = FLUSH_SECONDS) -> StreamingQuery:
    """Rebuilds the suggestion table from the counts on every trigger."""
    return _trigger(suggest_counts(documents, fields).writeStream.outputMode("complete").foreachBatch(lambda df, _: publish(df)).option("checkpointLocation", checkpoint), available_now, seconds).start()


def feed_shards(terms: DataFrame, shards: int) -> DataFrame:
    """The suggest shard of every term, by its hash, so that a term's counts are in one shard."""
    return terms.withColumn("shard_id", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int"))


def suggest_feed_stream(documents: DataFrame, send: Callable[[int, DataFrame], None], shards: int, checkpoint: str, fields: tuple[str, ...] = ("title",), failed: Callable[[int, Exception], None] = lambda shard, error: None, available_now: bool = False, seconds: int = FLUSH_SECONDS) -> StreamingQuery:
    """Hands the terms of new documents to the suggest shards; a shard that fails is reported and doesn't hold up the others."""

    def publish(batch: DataFrame, _: int) -> None:
        terms = materialize(feed_shards(term_rows(batch, fields), shards), "feed")
        for shard in range(shards):
            try:
                send(shard, terms.filter(F.col("shard_id") == shard))
            except Exception as error:  # noqa: BLE001 - a shard may fail in any way
                failed(shard, error)

    return _trigger(documents.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint), available_now, seconds).start()


def replicate_stream(operations: DataFrame, path: str, checkpoint: str, available_now: bool = False, seconds: int = FLUSH_SECONDS) -> StreamingQuery:
    """A durable copy of an operation log; catches up from its checkpoint."""
    return _trigger(operations.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint), available_now, seconds).start()
