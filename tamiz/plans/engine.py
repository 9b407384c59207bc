"""Queries of readers, stores, replicas and streams over the test tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.operators import changefeed, storage, suggest
from tamiz.operators import index as ix
from tamiz.plans.retrieval import SCHEMA, part_documents
from tamiz.plans.retrieval_sql import jump_hash, terms_of
from tamiz.schema import DOCUMENT
from tamiz.session import materialize, scratch_path
from tamiz.sources import ingest, oplog
from tamiz.sources.tables import table
from tamiz.streaming import sinks

# readers ----------------------------------------------------------------------


def documents_json(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue written as JSON lines with tagged attributes, and read back."""
    path = scratch_path(spark, "documents")
    docs = table(spark, d, "catalog_docs").select(*DOCUMENT.names)
    tagged = F.transform_values("attributes", lambda k, v: F.struct(v["s"].alias("String"), v["n"].alias("Number"), v["b"].alias("Bool"), v["a"].alias("StringArray")))
    docs.withColumn("attributes", tagged).write.json(path)
    back = ingest.read_documents(spark, path, lines=True)
    cells = F.aggregate(F.map_values("attributes"), F.lit(0), lambda n, v: n + F.when(v["s"].isNotNull(), 1).when(v["n"].isNotNull(), 100).when(v["b"].isNotNull(), 10_000).when(v["a"].isNotNull(), 1_000_000).otherwise(0))
    return back.select("id", "title", "price", "category", F.size("attributes").alias("n_attributes"), cells.alias("members"))


def items_ndjson(spark: SparkSession, d: str) -> DataFrame:
    """The listings written one JSON object a line, read back and mapped to documents."""
    path = scratch_path(spark, "items")
    table(spark, d, "item_listings").select(F.to_json(F.struct(*ingest.ITEM.names)).alias("value")).write.text(path)
    good, _ = ingest.split_errors(ingest.map_items(ingest.read_item_lines(spark, path)))
    return good.select("id", "title", "price", "category")


def operations_json(spark: SparkSession, d: str) -> DataFrame:
    """An operation log written as JSON lines and read back from a sequence number on."""
    path = scratch_path(spark, "operations")
    oplog.write_operations(_event_operations(spark, d), path)
    return oplog.read_operations(spark, path, 5000).select("seq", "op", "id", "doc.title", "doc.price")


# stores -----------------------------------------------------------------------


def _event_operations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    doc = F.struct(*(c.cast(f.dataType).alias(f.name) for f, c in zip(DOCUMENT, (F.col("user_id"), F.col("event_type"), F.lit(""), F.col("value"), F.lit(None), F.create_map()))))
    return e.select(F.col("event_id").cast("long").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("index").alias("op"), F.col("user_id").cast("long").alias("id"), F.when(F.col("event_type") != "error", doc).alias("doc"))


def oplog_since(spark: SparkSession, d: str) -> DataFrame:
    """From a store's log."""
    store = storage.Store(spark, scratch_path(spark, "store"), buffer_bytes=1 << 60)
    store.append(_event_operations(spark, d))
    return store.read_since(5000).select("seq", "op", "id")


def _store(spark: SparkSession, d: str, name: str = "store") -> storage.Store:
    """Parts in segments and log: all, then without the large ones, then some of these back at another price."""
    store = storage.Store(spark, scratch_path(spark, name))
    docs = part_documents(spark, d)
    large, light = docs.attributes["size"]["n"], docs.category == "SMALL"
    store.index(docs)
    store.flush()
    store.delete(docs.filter(large > 30).select("id"))
    store.flush()
    store.index(docs.filter((large > 40) & light).withColumn("price", F.col("price") * 2))
    return store


def store_documents(spark: SparkSession, d: str) -> DataFrame:
    """The state while changes lie in two segments and the log."""
    return _store(spark, d).documents().select("id", "title", "price")


def store_merged(spark: SparkSession, d: str) -> DataFrame:
    """The state after the segments were merged, read by a store that opens the folder anew."""
    store = _store(spark, d)
    store.flush()
    again = storage.Store(spark, store.path)
    return again.documents().select("id", "title", "price", F.lit(len(again.manifest.segments)).alias("n_segments"))


def store_stats(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).stats(4)


def store_reindex(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the index that a reindex writes, opened from its folder."""
    store, path = _store(spark, d), scratch_path(spark, "reindexed")
    store.reindex(SCHEMA, path)
    return ix.Index.open(spark, path, SCHEMA).vocabulary


def replica_documents(spark: SparkSession, d: str) -> DataFrame:
    """A replica after a full sync and a catch-up from the log."""
    store, replica = _store(spark, d), storage.Store(spark, scratch_path(spark, "replica"))
    storage.catch_up(store, replica)
    docs = part_documents(spark, d)
    store.delete(docs.filter(docs.category == "ECONOMY").select("id"))
    storage.catch_up(store, replica)
    return replica.documents().select("id", "title", "price")


def sharded_write(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "sharded")
    storage.write_sharded(part_documents(spark, d), path, 5)
    return spark.read.parquet(path).select("id", F.col("shard_id").cast("int").alias("shard_id"))


# streams ----------------------------------------------------------------------


def _stream(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """Rows as a stream of files, of which each trigger takes a part."""
    written = materialize(rows, name)
    folder = written.inputFiles()[0].rpartition("/")[0] if written.inputFiles() else None
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(folder)


def stream_state(spark: SparkSession, d: str) -> DataFrame:
    """The shard log as a stream into a bucket table, in two runs over one checkpoint."""
    feed = table(spark, d, "wal_records")
    changes = changefeed.normalize(feed, F.col("entry.id"), F.col("entry.op"), {"wal_gen": F.col("wal_gen"), "seq": F.col("seq")}, F.col("entry.doc"))
    stream, path, check = _stream(spark, changes.repartition(6), "feed"), scratch_path(spark, "state"), scratch_path(spark, "checkpoint")
    for _ in range(2):
        sinks.upsert_stream(stream, sinks.state_at(path), check, available_now=True).awaitTermination()
    return changefeed.live(changefeed.open_table(spark, path, changes).read()).select(F.col("key").alias("doc_id"), "wal_gen", "seq")


def stream_suggest(spark: SparkSession, d: str) -> DataFrame:
    """Suggestion counts accumulated by a stream of documents."""
    out, check = scratch_path(spark, "suggest"), scratch_path(spark, "checkpoint")
    stream = _stream(spark, part_documents(spark, d).repartition(6), "parts")
    sinks.suggest_stream(stream, lambda counts: suggest.build(counts).write.mode("overwrite").parquet(out), check, available_now=True).awaitTermination()
    return spark.read.parquet(out).select("term", "df", F.round("score", 6).alias("score"))


def stream_suggest_feed(spark: SparkSession, d: str) -> DataFrame:
    """Terms handed to four suggest shards by hash; the counts of all shards together."""
    out, check = scratch_path(spark, "shards"), scratch_path(spark, "checkpoint")
    stream = _stream(spark, part_documents(spark, d).repartition(6), "parts")
    sinks.suggest_feed_stream(stream, lambda shard, terms: terms.write.mode("append").parquet(f"{out}/{shard}"), 4, check, available_now=True).awaitTermination()
    fed = spark.read.parquet(*(f"{out}/{shard}" for shard in range(4)))
    return fed.groupBy("term").agg(F.count("*").alias("df"), F.count_distinct("shard_id").alias("n_shards"))


def stream_replica(spark: SparkSession, d: str) -> DataFrame:
    """A durable copy of an operation log, continued from its checkpoint."""
    out, check = scratch_path(spark, "copy"), scratch_path(spark, "checkpoint")
    stream = _stream(spark, _event_operations(spark, d).repartition(6), "log")
    for _ in range(2):
        sinks.replicate_stream(stream, out, check, available_now=True).awaitTermination()
    return spark.read.parquet(out).select("seq", "op", "id")


QUERIES = {
    f.__name__: f
    for f in (
        documents_json, items_ndjson, operations_json, oplog_since, store_documents, store_merged, store_stats, store_reindex, replica_documents, sharded_write,
        stream_state, stream_suggest, stream_suggest_feed, stream_replica,
    )
}

_LIVE = "SELECT p_partkey AS id, p_name AS title, CASE WHEN p_size > 40 THEN p_retailprice * 2 ELSE p_retailprice END AS price, p_type FROM part WHERE p_size <= 30 OR (p_size > 40 AND p_type = 'SMALL')"
_BYTES = "strlen(p_name) + strlen(p_type) * 2 + 64"
_EVENTS = "SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'index' END AS op, user_id AS id, CASE WHEN event_type <> 'error' THEN event_type END AS title, CASE WHEN event_type <> 'error' THEN value END AS price FROM events"


def oracles() -> dict[str, str]:
    titles = f"SELECT term, count(*) AS df FROM (SELECT DISTINCT p_partkey, unnest({terms_of('p_name')}) AS term FROM part) GROUP BY term"
    number = lambda c: f"CASE WHEN starts_with({c}, site_id) AND regexp_full_match(substr({c}, length(site_id) + 1), '[0-9]+') THEN TRY_CAST(substr({c}, length(site_id) + 1) AS BIGINT) END"
    shards = jump_hash("SELECT p_partkey AS id FROM part", 4)
    return {
        "documents_json": """SELECT id, title, price, category, CAST(coalesce(cardinality(attributes), 0) AS INTEGER) AS n_attributes,
            CAST(coalesce(list_sum(list_transform(map_values(attributes), lambda v: CASE WHEN v.s IS NOT NULL THEN 1 WHEN v.n IS NOT NULL THEN 100 WHEN v.b IS NOT NULL THEN 10000 WHEN v.a IS NOT NULL THEN 1000000 ELSE 0 END)), 0) AS INTEGER) AS members FROM catalog_docs""",
        "items_ndjson": f"SELECT num AS id, title, price, CAST(cat AS VARCHAR) AS category FROM (SELECT *, {number('id')} AS num, {number('category_id')} AS cat FROM item_listings) WHERE num IS NOT NULL AND cat IS NOT NULL",
        "operations_json": f"SELECT * FROM ({_EVENTS}) WHERE seq >= 5000",
        "oplog_since": f"SELECT seq, op, id FROM ({_EVENTS}) WHERE seq >= 5000",
        "store_documents": f"SELECT id, title, price FROM ({_LIVE})",
        "store_merged": f"SELECT id, title, price, 1 AS n_segments FROM ({_LIVE})",
        "store_stats": f"""WITH x AS (SELECT p.*, shard_id, p_size > 40 AND p_type = 'SMALL' AS back FROM part p JOIN ({shards}) s ON s.id = p.p_partkey)
            SELECT shard_id, count(*) FILTER (WHERE p_size <= 30 OR back) AS live_docs, count(*) + count(*) FILTER (WHERE p_size > 30) AS segment_rows, count(*) FILTER (WHERE back) AS buffered_rows,
              CAST(coalesce(sum({_BYTES}) FILTER (WHERE back), 0) AS BIGINT) AS buffered_bytes FROM x GROUP BY ROLLUP (shard_id)""",
        "store_reindex": f"SELECT term, count(DISTINCT id) AS df FROM (SELECT id, unnest(list_concat({terms_of('title')}, {terms_of('p_type')})) AS term FROM ({_LIVE})) GROUP BY term",
        "replica_documents": f"SELECT id, title, price FROM ({_LIVE}) WHERE p_type <> 'ECONOMY'",
        "sharded_write": jump_hash("SELECT p_partkey AS id FROM part", 5),
        "stream_state": """SELECT doc_id, wal_gen, seq FROM (SELECT entry.id AS doc_id, wal_gen, seq, lower(regexp_replace(entry.op, '[^A-Za-z]', '', 'g')) AS op, row_number() OVER (PARTITION BY entry.id ORDER BY wal_gen DESC, seq DESC) AS rn
            FROM wal_records WHERE entry IS NOT NULL) WHERE rn = 1 AND op = 'index'""",
        "stream_suggest": f"SELECT term, df, round(df / max(df) OVER (), 6) AS score FROM ({titles}) WHERE df >= 2",
        "stream_suggest_feed": f"SELECT term, df, CAST(1 AS BIGINT) AS n_shards FROM ({titles})",
        "stream_replica": f"SELECT seq, op, id FROM ({_EVENTS})",
    }
