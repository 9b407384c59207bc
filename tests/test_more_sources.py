from pyspark.sql import functions as F

from tamiz.config import Config
from tamiz.operators import index as ix
from tamiz.operators import search as se
from tamiz.operators import storage
from tamiz.plans.request import SearchRequest
from tamiz.schema import Analyzer, FieldConfig, FieldType, IndexSchema, Language
from tamiz.sources import generate, ingest, oplog


def test_oplog_round_trip_and_torn_tail(spark, tmp_path):
    docs = generate.products(spark, 5)
    ops = storage.index_operations(docs).withColumn("seq", F.col("id")).unionByName(storage.delete_operations(docs.filter("id = 3")).withColumn("seq", F.lit(9).cast("long")))
    path = str(tmp_path / "log")
    oplog.write_operations(ops, path)
    (tmp_path / "log" / "tail.json").write_text('{"seq": 10, "op": "index", "id": 99, "doc": {"id"')
    back = oplog.read_operations(spark, path)
    assert back.count() == 6 and oplog.read_operations(spark, path, since=5).count() == 2
    state = storage.latest(back).filter("op = 'index'").select("doc.*")
    key = lambda df: sorted(df.select("id", "title", F.to_json("attributes")).collect())
    assert key(state) == key(docs.filter("id <> 3"))


def test_generators_depend_on_the_row_only(spark):
    few, many = generate.products(spark, 10), generate.products(spark, 200)
    assert sorted(few.select("id", "title", "price").collect()) == sorted(many.filter("id <= 10").select("id", "title", "price").collect())
    good, bad = ingest.split_errors(ingest.map_items(generate.items(spark, 100)))
    assert good.count() == 100 and bad.count() == 0


def test_reindex(spark, tmp_path):
    store = storage.Store(spark, str(tmp_path / "store"))
    store.index(generate.products(spark, 20))
    store.delete(spark.createDataFrame([(1,)], "id long"))
    assert store.summary()["buffered_rows"] == 21
    schema = IndexSchema.default(None)
    assert store.reindex(schema, str(tmp_path / "index"))["docs_reindexed"] == 19
    index = ix.Index.open(spark, str(tmp_path / "index"), schema)
    assert se.search(index, SearchRequest("")).total.first()[0] == 19 and store.summary() == {"segments": 1, "segment_rows": 19, "buffered_rows": 0, "buffered_bytes": 0}


def test_own_tokenizer_and_filters(spark):
    stop = lambda words: F.filter(words, lambda w: ~w.isin("de", "la"))
    synonyms = lambda words: F.transform(words, lambda w: F.when(w == "celular", "teléfono").otherwise(w))
    own = Analyzer("standard", Language.SPANISH, filters=(stop, synonyms))
    schema = IndexSchema((FieldConfig("title", FieldType.TEXT, indexed=True, boost=2.0, analyzer=own),))
    docs = generate.products(spark, 3).withColumn("title", F.lit("funda de la teléfono"))
    index = ix.build(docs, schema).persist()
    assert {r.term for r in index.vocabulary.collect()} == {"fund", "telefon"}
    assert se.search(index, SearchRequest("celular de")).total.first()[0] == 3
    split = Analyzer(tokenizer=lambda c: F.split(c, "-"))
    index = ix.build(docs.withColumn("title", F.lit("AB-cd")), IndexSchema((FieldConfig("title", FieldType.TEXT, indexed=True, analyzer=split),))).persist()
    assert se.search(index, SearchRequest("AB")).total.first()[0] == 3 and se.search(index, SearchRequest("ab", typo_tolerance=False)).total.first()[0] == 0


def test_config(spark):
    c = Config.from_dict({"query_cache": {"enabled": True, "max_entries": 3, "other": 1}, "availability": {"strategy": "static"}, "unknown": {}})
    index = ix.build(generate.products(spark, 5), IndexSchema.default(None)).persist()
    searcher = c.searcher(index)
    assert searcher.cache.entries == 3 and searcher.search(SearchRequest("Norte", destination_zone="x")).hits.count() >= 0
