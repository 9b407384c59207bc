"""Queries of the retrieval engine over the test tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions import text
from tamiz.functions.routing import shard_of
from tamiz.operators import changefeed, ranking, search, storage, suggest
from tamiz.operators import index as ix
from tamiz.operators.filters import apply_filters, facets
from tamiz.plans.request import Eq, In, Range, SearchRequest, Sort
from tamiz.schema import ATTRIBUTE, FieldConfig, FieldType, IndexSchema, Language
from tamiz.session import scratch_path
from tamiz.sources import ingest
from tamiz.sources.tables import table

STEMMED = IndexSchema.default(Language.SPANISH)
SCHEMA = IndexSchema.default(None, (FieldConfig("brand", FieldType.KEYWORD, filterable=True, aggregatable=True), FieldConfig("size", FieldType.NUMERIC, filterable=True)))


def _attr(s=None, n=None):
    none = F.lit(None)
    return F.struct((none if s is None else s).cast("string").alias("s"), (none if n is None else n).cast("double").alias("n"), none.cast("boolean").alias("b"), none.cast("array<string>").alias("a")).cast(ATTRIBUTE)


def part_documents(spark: SparkSession, d: str) -> DataFrame:
    """The part table as a catalogue."""
    p = table(spark, d, "part")
    weight = F.when(F.col("p_size") % 3 != 0, F.col("p_size") * 1.5)  # a third of the parts has none
    south = F.when(F.col("p_size") > 25, F.concat(F.col("p_size").cast("string"), F.lit(".5"))).otherwise("many")
    attrs = F.create_map(F.lit("brand"), _attr(s=F.col("p_brand")), F.lit("size"), _attr(n=F.col("p_size")), F.lit("weight"), _attr(n=weight), F.lit("stock_north"), _attr(n=F.col("p_size") % 5), F.lit("stock_south"), _attr(s=south))
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.col("p_retailprice").alias("price"), F.col("p_type").alias("category"), attrs.alias("attributes"))


def text_documents(spark: SparkSession, d: str) -> DataFrame:
    """The text corpus as documents: the first line is the title."""
    x = table(spark, d, "documents")
    return x.select(F.col("doc_id").alias("id"), F.split("text", r"\r?\n")[0].alias("title"), F.col("text").alias("description"), F.col("n_chars").cast("double").alias("price"), F.col("lang").alias("category"), F.create_map(F.lit("source"), _attr(s=F.col("source"))).alias("attributes"))


_INDEXES: dict[tuple, ix.Index] = {}


def _index(spark: SparkSession, d: str, docs=part_documents, schema: IndexSchema = SCHEMA) -> ix.Index:
    """Written once to the shared folder and opened from there."""
    key = (spark.sparkContext.applicationId, d, docs.__name__, schema)
    if key not in _INDEXES:
        _INDEXES[key] = ix.build(docs(spark, d), schema).write(scratch_path(spark, "index"))
    return _INDEXES[key]


def _hits(spark, d, request: SearchRequest, docs=part_documents) -> DataFrame:
    hits = search.search(_index(spark, d, docs), request).hits
    return hits.withColumn("score", F.round("score", 6))


def _all(spark, d, request: SearchRequest, docs=part_documents, schema: IndexSchema = SCHEMA) -> DataFrame:
    return search.match(_index(spark, d, docs, schema), request)[0].select("id", F.round("score", 6).alias("score"))


# text analysis --------------------------------------------------------------


def tokenize_terms(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.posexplode_outer(text.lower_tokens(text.tokenize(F.col("text")))).alias("pos", "term")).filter(F.col("term").isNotNull())


def term_df(spark, d):
    return _index(spark, d, text_documents).vocabulary


def field_stats(spark, d):
    return _index(spark, d, text_documents).statistics.select("field", "n_docs", F.round("avgdl", 6).alias("avgdl"))


def keyword_terms(spark, d):
    return table(spark, d, "catalog_docs").select("id", F.explode(text.keyword_tokens(F.col("category"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def postings(spark, d):
    return _index(spark, d, text_documents).postings.drop("lead")


def stem_es(spark, d):
    """Stems of the distinct Spanish vocabulary."""
    from tamiz.functions.stemmers import stem_column

    words = table(spark, d, "documents").select(F.explode_outer(text.lower_tokens(text.tokenize(F.col("text")))).alias("term")).filter(F.col("term").isNotNull()).distinct()
    return words.select("term", stem_column("es")("term").alias("stem"))


# retrieval ------------------------------------------------------------------


def bm25_and_topk(spark, d):
    return _hits(spark, d, SearchRequest("red widget", limit=20, typo_tolerance=False))


def bm25_prefix(spark, d):
    return _all(spark, d, SearchRequest("wid", typo_tolerance=False))


def bm25_fuzzy(spark, d):
    return _all(spark, d, SearchRequest("widgat"))


def bm25_or_fallback(spark, d):
    return _all(spark, d, SearchRequest("red zzzzz widget", typo_tolerance=False))


def bm25_documents(spark, d):
    return _all(spark, d, SearchRequest("garantía envío", typo_tolerance=False), text_documents)


def bm25_stemmed(spark, d):
    """By the default schema: Spanish stems in index and query."""
    return _all(spark, d, SearchRequest("garantías del envío", typo_tolerance=False), text_documents, STEMMED)


def bm25_stemmed_typos(spark, d):
    return _all(spark, d, SearchRequest("garrantías", language="es"), text_documents, STEMMED)


def best_candidates(spark, d):
    """Only the 50 best matches go on to facets and total."""
    return _all(spark, d, SearchRequest("widget", typo_tolerance=False, max_candidates=50))


def total_hits(spark, d):
    return search.search(_index(spark, d), SearchRequest("widget", {"price": Range(gte=905.0)}, typo_tolerance=False, limit=3)).total


def search_facets(spark, d):
    """Facets as a search returns them, over the matches and not over the page."""
    return search.search(_index(spark, d), SearchRequest("blue", typo_tolerance=False, limit=1, aggregations=("brand", "category", "nothing"))).facets


def multi_get(spark, d):
    """The parts that were ordered in the largest quantity, by a table of ids; ids that no document has are left out."""
    asked = table(spark, d, "lineitem").filter(F.col("l_quantity") >= 50).select(F.col("l_partkey").alias("id")).unionByName(spark.createDataFrame([(-5,)], "id long"))
    return search.get_documents(_index(spark, d).documents, asked).select("id", "title", "price")


def point_get(spark, d):
    return search.get_documents(_index(spark, d).documents, [7, 11, -1]).select("id", "title", "price")


def title_position_boost(spark, d):
    return _all(spark, d, SearchRequest("el cable", typo_tolerance=False), text_documents)


def empty_query_scan(spark, d):
    return _all(spark, d, SearchRequest("", filters={"price": Range(gte=950.0)}))


def filter_eq(spark, d):
    return apply_filters(_index(spark, d).columns, SCHEMA, {"brand": Eq("Brand#1")}).select("id")


def filter_in(spark, d):
    return apply_filters(_index(spark, d).columns, SCHEMA, {"brand": In(("Brand#1", "Brand#2", "none"))}).select("id")


def filter_range(spark, d):
    return apply_filters(_index(spark, d).columns, SCHEMA, {"size": Range(gte=10, lte=20)}).select("id")


def filter_combo(spark, d):
    return _all(spark, d, SearchRequest("widget", {"brand": Eq("Brand#1"), "price": Range(lte=1500.0)}, typo_tolerance=False))


def filter_unknown_field(spark, d):
    return apply_filters(_index(spark, d).columns, SCHEMA, {"nothing": Eq("x")}).select("id")


def facet_single(spark, d):
    i = _index(spark, d)
    return facets(search.match(i, SearchRequest("widget", typo_tolerance=False))[0], i.columns, SCHEMA, ("category",))


def facet_multi(spark, d):
    i = _index(spark, d)
    return facets(search.match(i, SearchRequest(""))[0], i.columns, SCHEMA, ("category", "brand"))


def sort_price_page(spark, d):
    return search.search(_index(spark, d), SearchRequest("", sort=Sort("price"), offset=15, limit=10)).hits.select("id", "sort_value")


def sort_missing_attr(spark, d):
    """By a number that a third of the documents lacks: these come first."""
    return search.search(_index(spark, d), SearchRequest("", sort=Sort("weight", True), limit=1000)).hits.select("id", "sort_value")


def sort_attr_descending(spark, d):
    return search.search(_index(spark, d), SearchRequest("widget", sort=Sort("weight"), offset=5, limit=40, typo_tolerance=False)).hits.select("id", "sort_value")


def hydrate_hits(spark, d):
    hits = search.search(_index(spark, d), SearchRequest("blue ring", limit=15, typo_tolerance=False, include_docs=True)).hits
    return hits.select("id", F.round("score", 6).alias("score"), "title", "price", "category")


def search_batch(spark, d):
    """Every part name as a query, three best each."""
    queries = table(spark, d, "part").select(F.col("p_name").alias("query")).distinct().select(F.xxhash64("query").alias("qid"), "query")
    found = search.search_many(_index(spark, d), queries, k=3, typo_tolerance=False)
    return found.join(queries, "qid").select("query", "id", F.round("score", 6).alias("score"), "rank")


def search_batch_typos(spark, d):
    """Every catalogue title, with its typing errors and made-up words, as a query on the text corpus."""
    queries = table(spark, d, "catalog_docs").select(F.col("title").alias("query")).filter(F.col("title").isNotNull()).distinct().select(F.xxhash64("query").alias("qid"), "query")
    found = search.search_many(ix.build(text_documents(spark, d), SCHEMA), queries, k=3)  # of that index only the documents are read
    return found.join(queries, "qid").select("query", "id", F.round("score", 6).alias("score"), "mode", "rank")


# suggest --------------------------------------------------------------------


def suggest_build(spark, d):
    freq = suggest.frequencies(suggest.term_rows(part_documents(spark, d), ("title", "category")))
    return suggest.build(freq).select("term", "df", F.round("score", 6).alias("score"))


def suggest_prefix(spark, d):
    freq = suggest.frequencies(suggest.term_rows(text_documents(spark, d), ("description",)))
    return suggest.suggest(suggest.build(freq, max_terms=0), "Co", 10)[0].select("term", F.round("score", 6).alias("score"))


def suggest_attributes(spark, d):
    """Terms of a text attribute instead of a base field."""
    return suggest.build(suggest.frequencies(suggest.term_rows(part_documents(spark, d), ("brand", "size"))), 1, 0).select("term", "df", F.round("score", 6).alias("score"))


def suggest_sharded_merge(spark, d):
    """The raw feed: each shard normalises its own counts, the greatest score of a term counts."""
    feed = table(spark, d, "suggest_terms").filter(F.col("term").isNotNull())
    rows = feed.select("shard_id", F.col("doc_id").alias("id"), F.col("field_name").alias("field"), F.lower("term").alias("term")).distinct()
    shards = suggest.build(suggest.frequencies(rows, ("shard_id",)), max_terms=0, by=("shard_id",))
    return suggest.lookup_sharded(shards, "c", 20).select("term", F.round("score", 6).alias("score"))


# ingest, log, storage ---------------------------------------------------------


def catalogue_map_ok(spark, d):
    good, _ = ingest.split_errors(ingest.map_items(table(spark, d, "item_listings")))
    return good.select("id", "title", "category", F.size("attributes").alias("n_attributes"), F.try_element_at("attributes", F.lit("condition"))["s"].alias("condition"))


def catalogue_map_errors(spark, d):
    return ingest.split_errors(ingest.map_items(table(spark, d, "item_listings")))[1].groupBy("error").agg(F.count("*").alias("n"))


def _event_log(spark, d) -> DataFrame:
    """Events as an operation log: an error deletes its user, anything else writes."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("index").alias("op"), F.col("user_id").alias("id"), F.struct(F.col("event_type").alias("title"), F.col("value").alias("price")).alias("doc"))


def oplog_fold(spark, d):
    return storage.latest(_event_log(spark, d)).filter("op = 'index'").select("id", "seq", "doc.title", "doc.price")


def live_after_deletes(spark, d):
    """Catalogue without the ids that the shard log deleted last."""
    changes = changefeed.normalize(table(spark, d, "wal_records"), F.col("entry.id"), F.col("entry.op"), {"wal_gen": F.col("wal_gen"), "seq": F.col("seq")}, F.lit(None).cast("string"))
    gone = changefeed.fold(changes, ["key"]).filter("deleted").select(F.col("key").alias("id"))
    return ix.live(table(spark, d, "catalog_docs"), gone).select("id").distinct()


def jump_hash_stats(spark, d):
    return storage.shard_stats(part_documents(spark, d), 4)


def shard_rows(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), shard_of(F.col("p_partkey"), 4).alias("shard_id"))


def availability_static(spark, d):
    docs = part_documents(spark, d)
    return ranking.AttributeAvailability(default=False, minimum=2.0).apply(docs.select("id"), docs, "north")


def availability_allow_list(spark, d):
    docs = part_documents(spark, d)
    allowed = table(spark, d, "lineitem").filter(F.col("l_quantity") >= 50).select(F.col("l_partkey").alias("id"))
    return ranking.AllowListAvailability(lambda zone: allowed).apply(docs.select("id"), docs, "any")


def rerank_expr(spark, d):
    ranker = ranking.ExpressionRanker(F.col("score") + F.col("price") / 10000)
    hits = ranking.Searcher(_index(spark, d), ranker).search(SearchRequest("red", limit=20, typo_tolerance=False)).hits
    return hits.select("id", F.round("score", 6).alias("score"))


def availability_text(spark, d):
    """Stock written as text; what isn't a number counts as the default."""
    docs = part_documents(spark, d)
    return ranking.AttributeAvailability(default=True, minimum=40.0).apply(docs.select("id"), docs, "south")


def zone_gate(spark, d):
    """Availability after retrieval, before the page: the page is full although matches were dropped."""
    found = ranking.Searcher(_index(spark, d), availability=ranking.AttributeAvailability(default=False, minimum=3.0)).search(SearchRequest("red", limit=25, offset=5, typo_tolerance=False, destination_zone="north"))
    return found.hits.select("id", F.round("score", 6).alias("score"))


def rerank_remote(spark, d):
    """A remote model in batches of the pool of 200: dearer first."""
    price = lambda query, c: c.assign(score=c["price"])
    found = ranking.Searcher(_index(spark, d), ranking.make_ranker("remote", function=price, batch=64), seconds=30.0).search(SearchRequest("red", limit=20, typo_tolerance=False))
    return found.hits.select("id", F.round("score", 6).alias("score"))


def rerank_fallback(spark, d):
    """A ranker that fails leaves the order as it was."""

    def broken(query, candidates):
        raise RuntimeError("no such service")

    found = ranking.Searcher(_index(spark, d), ranking.FunctionRanker(broken), seconds=30.0).search(SearchRequest("red", limit=20, typo_tolerance=False))
    return found.hits.select("id", F.round("score", 6).alias("score"), F.lit(found.reranked).alias("reranked"))


def cached_page(spark, d):
    """The second page, from the pool that the first one left in the cache."""
    searcher = ranking.Searcher(_index(spark, d), cache=ranking.QueryCache())
    searcher.search(SearchRequest("blue", limit=10, typo_tolerance=False))
    found = searcher.search(SearchRequest("blue", limit=10, offset=10, typo_tolerance=False))
    return found.hits.select("id", F.round("score", 6).alias("score"), F.lit(found.cache_hit).alias("cache_hit"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_terms, term_df, field_stats, keyword_terms, postings, stem_es, bm25_and_topk, bm25_prefix, bm25_fuzzy, bm25_or_fallback, bm25_documents, bm25_stemmed, bm25_stemmed_typos,
        best_candidates, title_position_boost, empty_query_scan, total_hits, search_facets, multi_get, point_get,
        filter_eq, filter_in, filter_range, filter_combo, filter_unknown_field, facet_single, facet_multi, sort_price_page, sort_missing_attr, sort_attr_descending, hydrate_hits, search_batch, search_batch_typos,
        suggest_build, suggest_prefix, suggest_attributes, suggest_sharded_merge, catalogue_map_ok, catalogue_map_errors, oplog_fold, live_after_deletes, jump_hash_stats, shard_rows,
        availability_static, availability_allow_list, availability_text, zone_gate, rerank_expr, rerank_remote, rerank_fallback, cached_page,
    )
}


def oracles() -> dict[str, str]:
    from tamiz.plans import retrieval_sql

    return retrieval_sql.oracles()
