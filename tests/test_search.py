import pytest
from pyspark.sql import functions as F

from tamiz.operators import index as ix
from tamiz.operators import search as se
from tamiz.operators.filters import apply_filters, facets
from tamiz.operators.ranking import AllowListAvailability, AttributeAvailability, BatchedRanker, Breaker, FunctionRanker, QueryCache, ScoreRanker, Searcher, make_ranker
from tamiz.plans.request import Eq, In, Range, SearchRequest, Sort, Understanding
from tamiz.schema import DOCUMENT, FieldConfig, FieldType, IndexSchema, Language

SCHEMA = IndexSchema.default(Language.ENGLISH, (FieldConfig("brand", FieldType.KEYWORD, filterable=True, aggregatable=True),))


def attr(s=None, n=None, b=None, a=None):
    return {"s": s, "n": n, "b": b, "a": a}


def make(spark, rows, schema=SCHEMA):
    full = [(*r, *((None, None, None, {}) [len(r) - 2 :])) if len(r) < 6 else r for r in rows]
    return ix.build(spark.createDataFrame([tuple(x[:6]) for x in full], DOCUMENT), schema).persist()


def ids(spark, rows, query, schema=SCHEMA, **kw):
    return [r.id for r in se.search(make(spark, rows, schema), SearchRequest(query, **kw)).hits.collect()]


PHONES = [(1, "Samsung Galaxy phone", "Great Android phone", 999.0, "electronics", {}), (2, "Apple iPhone", "iOS device", 1199.0, "electronics", {}), (3, "Nike shoes", "Running shoes", 89.0, "clothing", {})]


def test_single_term(spark):
    assert ids(spark, PHONES, "samsung") == [1]


def test_title_outranks_description_with_published_scores(spark):
    rows = [(1, "samsung phone", "generic device", 100.0, "e", {}), (2, "generic phone", "samsung android", 100.0, "e", {})]
    hits = se.search(make(spark, rows), SearchRequest("samsung")).hits.collect()
    assert [(h.id, round(h.score, 6)) for h in hits] == [(1, 0.546965), (2, 0.182322)]


def test_filters_facets_and_empty_query(spark):
    index = make(spark, PHONES)
    assert [h.id for h in se.search(index, SearchRequest("phone", {"category": Eq("electronics")})).hits.collect()] == [1]
    out = se.search(index, SearchRequest("", aggregations=("category", "unknown")))
    assert {(r.value, r["count"]) for r in out.facets.collect()} == {("electronics", 2), ("clothing", 1)}
    assert out.total.first()[0] == 3
    assert se.search(index, SearchRequest("  ")).total.first()[0] == 0 and se.search(index, SearchRequest("!?")).total.first()[0] == 0


def test_and_prefix_fuzzy(spark):
    rows = [(1, "Apple iPhone 15", "", 1.0, "a", {}), (2, "Bafle Iron 15 Pulgadas", "", 2.0, "audio", {}), (3, "iPhone case accessories", "", 3.0, "b", {})]
    assert ids(spark, rows, "iphone 15") == [1]
    assert ids(spark, [(1, "samsung phone", "Android", 1.0, "a", {})], "samsang") == [1]
    assert ids(spark, [(1, "samsung phone", "Android", 1.0, "a", {})], "samsang", typo_tolerance=False) == []
    assert ids(spark, rows, "ipho") == [3, 1] or ids(spark, rows, "ipho") == [1, 3]


def test_or_fallback(spark):
    out = se.search(make(spark, PHONES), SearchRequest("samsung zzzz"))
    assert out.mode == "or_fallback" and [h.id for h in out.hits.collect()] == [1]
    assert se.search(make(spark, PHONES), SearchRequest("zzzz")).hits.collect() == []


def test_candidate_cap_and_or_weight(spark):
    index = make(spark, [(i, "red ring" if i % 2 else "red rod", "", 1.0, "c", {}) for i in range(20)])
    assert se.search(index, SearchRequest("red", max_candidates=7)).total.first()[0] == 7
    both, one = (se.search(index, SearchRequest("red ring zzz", weigh_or=w, limit=1)).hits.first() for w in (True, False))
    assert both.id == one.id and abs(both.score - 2 * one.score) < 1e-9


def test_release(spark):
    out = se.search(make(spark, PHONES), SearchRequest("samsung phone", aggregations=("category",)))
    before = [h.id for h in out.hits.collect()]
    out.release()
    out.release()
    assert [h.id for h in out.hits.collect()] == before == [1]


def test_many_queries_as_one_plan(spark):
    index = make(spark, PHONES)
    queries = spark.createDataFrame([(1, "samsung"), (2, "phone zzzz"), (3, "shoes"), (4, ""), (5, None)], "qid long, query string")
    got = {(r.qid, r.id): (round(r.score, 9), r["mode"]) for r in se.search_many(index, queries).collect()}
    for qid, q in ((1, "samsung"), (2, "phone zzzz"), (3, "shoes")):
        one = se.search(index, SearchRequest(q))
        assert {k[1]: v for k, v in got.items() if k[0] == qid} == {h.id: (round(h.score, 9), one.mode) for h in one.hits.collect()}
    assert not {k for k in got if k[0] in (4, 5)}


def test_many_terms_take_the_other_way(spark, monkeypatch):
    index = make(spark, PHONES)
    want = [(h.id, round(h.score, 9)) for h in se.search(index, SearchRequest("samsang phone")).hits.collect()]
    monkeypatch.setattr(se, "expand_request", lambda *a: None)
    assert [(h.id, round(h.score, 9)) for h in se.search(index, SearchRequest("samsang phone")).hits.collect()] == want


def test_column_store(spark):
    rows = list(zip(range(5), ["x"] * 5, [""] * 5, [799.99, 299.99, 49.99, 999.99, 29.99], ["electronics", "electronics", "clothing", "electronics", "clothing"], [{"brand": attr(b)} for b in ("samsung", "apple", "nike", "samsung", "adidas")]))
    index = make(spark, rows)
    find = lambda **f: {r.id for r in apply_filters(index.columns, SCHEMA, f).collect()}
    assert find(category=Eq("electronics")) == {0, 1, 3} and find(category=Eq("food")) == set()
    assert find(brand=In(("samsung", "apple", "none"))) == {0, 1, 3} and find(brand=In(())) == set()
    assert find(price=Range(100, 800)) == {0, 1} and find(price=Range(gte=500)) == {0, 3} and find(price=Range()) == set(range(5))
    assert find(category=Eq("electronics"), price=Range(gte=500)) == {0, 3}
    assert find(other=Eq("x")) == set()
    with pytest.raises(ValueError):
        apply_filters(index.columns, SCHEMA, {"other": Eq("x")}, strict=True)
    matched = apply_filters(index.columns, SCHEMA, {"price": Range(gte=200)})
    assert {(r.value, r["count"]) for r in facets(matched, index.columns, SCHEMA, ("brand",)).collect()} == {("samsung", 2), ("apple", 1)}


def test_sort_paging_hydration(spark):
    rows = [(i, "Samsung", "", float(i % 3) if i else None, "c", {"weight": attr(n=float(i))} if i % 2 else {}) for i in range(10)]
    index = make(spark, rows)
    page = lambda **kw: [h.id for h in se.search(index, SearchRequest("samsung", **kw)).hits.collect()]
    assert page(limit=3) == [0, 1, 2] and page(limit=3, offset=8) == [8, 9] and page(limit=0) == []
    assert page(sort=Sort("weight"), limit=3) == [9, 7, 5] and page(sort=Sort("weight", True), limit=6) == [0, 2, 4, 6, 8, 1]
    whole = se.search(index, SearchRequest("samsung", limit=1, include_docs=True)).hits.first()
    assert whole.title == "Samsung" and whole.score > 0
    assert {r.id for r in se.get_documents(index.documents, [1, 2, 99]).collect()} == {1, 2} and se.get_documents(index.documents, []).count() == 0


def test_nulls_empty_and_long_texts(spark):
    rows = [(1, None, None, None, None, None), (2, "", "word " * 50_000, 1.0, "c", {}), (None, "word", "", 1.0, "c", {}), (3, "word", None, float("nan"), "c", {})]
    index = make(spark, rows)
    assert {h.id for h in se.search(index, SearchRequest("word")).hits.collect()} == {2, 3, None}
    empty = ix.build(spark.createDataFrame([], DOCUMENT), SCHEMA)
    assert se.search(empty, SearchRequest("word")).hits.collect() == [] and se.search(empty, SearchRequest("")).total.first()[0] == 0


def test_written_index_gives_the_same(spark, tmp_path):
    index = make(spark, PHONES)
    index.write(str(tmp_path))
    again = ix.Index.open(spark, str(tmp_path), SCHEMA)
    q = SearchRequest("phone samsung")
    assert se.search(index, q).hits.collect() == se.search(again, q).hits.collect()


def test_tombstones(spark):
    docs = spark.createDataFrame([(i, f"Samsung {i}", "", 1.0, "c", {}) for i in range(10)], DOCUMENT)
    index = ix.build(docs, SCHEMA, spark.createDataFrame([(0,), (1,), (1,)], "id long"))
    assert index.documents.count() == 8 and se.search(index, SearchRequest("samsung")).total.first()[0] == 8


def test_request_limits_and_language():
    with pytest.raises(ValueError):
        SearchRequest("x" * 1025).validated()
    with pytest.raises(ValueError):
        SearchRequest(limit=1001).validated()
    r = SearchRequest.from_json({"query": "a", "filters": {"c": {"in": ["x"]}, "p": {"gte": 1}, "b": {"eq": "z"}}, "sort": {"field": "price"}, "other": 1})
    assert r.filters == {"c": In(("x",)), "p": Range(1, None), "b": Eq("z")} and r.sort == Sort("price", False)
    assert Understanding.default(IndexSchema.default()).run("Zapatos").tokens == ("zapat",)
    assert Understanding.default(IndexSchema.default(), "en").run("shoes").tokens == ("shoe",)


def test_rankers(spark):
    index = make(spark, [(1, "red ring", "", 1.0, "c", {}), (2, "red", "", 9.0, "c", {})])
    flip = FunctionRanker(lambda q, c: c.sort_values("price", ascending=False)[["id", "score"]])
    out = Searcher(index, flip, seconds=30).search(SearchRequest("red"))
    assert out.reranked and [h.id for h in out.hits.collect()] == [2, 1]
    out = Searcher(index, FunctionRanker(lambda q, c: 1 / 0), seconds=30).search(SearchRequest("red"))
    assert not out.reranked and out.hits.count() == 2
    out = Searcher(index, ScoreRanker(lambda s: -s), seconds=30).search(SearchRequest("red"))
    base = [h.id for h in se.search(index, SearchRequest("red")).hits.collect()]
    assert [h.id for h in out.hits.collect()] == base[::-1]
    assert not Searcher(index).search(SearchRequest("red")).reranked
    clock = [0.0]
    breaker = Breaker(FunctionRanker(lambda q, c: 1 / 0), failures=1, seconds=10, clock=lambda: clock[0])
    Searcher(index, breaker, seconds=30).search(SearchRequest("red"))
    assert breaker.is_open()
    clock[0] = 11.0
    assert not breaker.is_open()
    with pytest.raises(ValueError):
        make_ranker("other")


def test_availability(spark):
    docs = [(1, "Samsung Galaxy phone", "", 1.0, "c", {"stock_north": attr(n=10.0)}), (2, "Apple iPhone", "", 1.0, "c", {"stock_north": attr("0")}), (3, "Samsung tablet", "", 1.0, "c", {})]
    index = make(spark, docs)
    find = lambda a, q="samsung": [h.id for h in Searcher(index, availability=a).search(SearchRequest(q, destination_zone="north")).hits.collect()]
    assert find(AttributeAvailability(default=False)) == [1]
    assert set(find(AttributeAvailability())) == {1, 3}
    assert find(AllowListAvailability(lambda z: spark.createDataFrame([(3,)], "id long"))) == [3]
    assert set(find(AllowListAvailability(lambda z: 1 / 0))) == {1, 3}


def test_cache(spark):
    index = make(spark, PHONES)
    clock = [0.0]
    cache = QueryCache(entries=2, seconds=10, clock=lambda: clock[0])
    searcher = Searcher(index, cache=cache)
    first = searcher.search(SearchRequest("phone", limit=1))
    again = searcher.search(SearchRequest("phone", limit=20, include_docs=True))
    assert not first.cache_hit and again.cache_hit and again.hits.first().title
    clock[0] = 11.0
    assert not searcher.search(SearchRequest("phone")).cache_hit
    assert QueryCache.key(SearchRequest("a", {"c": In(("x", "y"))})) == QueryCache.key(SearchRequest("a", {"c": In(("y", "x"))}, offset=5))
    assert QueryCache.key(SearchRequest("a", {"c": In(("a,b",))})) != QueryCache.key(SearchRequest("a", {"c": In(("a", "b"))}))


def test_no_python_in_the_scoring_plan(spark):
    index = make(spark, PHONES, IndexSchema.default(None))
    plan = se.search(index, SearchRequest("phone")).hits._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "TakeOrdered" in plan


def test_typing_errors_meet_by_keys(spark):
    import random

    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcñ") for _ in range(n))

    def mistyped(w):
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcñ") + w[i:], w[:i] + rng.choice("abcñ") + w[i + 1 :]])
        return w or "a"

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
            row = now
        return row[-1]

    lengths = [1, 2, 3, 4, 5, 6, 7, 8, *range(se.LONG_TERM - 2, se.LONG_TERM + 5), 30]
    terms = {word(rng.choice(lengths)) for _ in range(300)} | {"x" * 2000}
    asked = {mistyped(rng.choice(sorted(terms))) for _ in range(200)} | {"x" * 2000, "x" * 1500}
    vocabulary, q = spark.createDataFrame([(t, 1) for t in terms], "term string, df long"), spark.createDataFrame([(w,) for w in asked], "q string")
    rows = se.expand(vocabulary, q, True).collect()
    near = lambda a, b: abs(len(a) - len(b)) <= 2 and distance(a, b) <= (1 if len(a.encode()) <= 4 else 2)
    assert {(r.q, r.term) for r in rows if r.f} == {(a, b) for a in asked for b in terms if len(a.encode()) >= 3 and near(a, b)}
    assert {(r.q, r.term) for r in rows if r.p} == {(a, b) for a in asked for b in terms if b.startswith(a)}


def test_a_term_said_twice_counts_twice(spark):
    index = make(spark, PHONES)
    once, twice = (se.search(index, SearchRequest(q)).hits.collect() for q in ("samsung phone", "samsung samsung phone"))
    assert [h.id for h in once] == [h.id for h in twice] == [1] and twice[0].score > once[0].score


def test_facets_come_in_order(spark):
    rows = [(i, "red thing", "", 1.0, c, {}) for i, c in enumerate(["b", "a", "a", "c", "b", "d"])]
    found = se.search(make(spark, rows), SearchRequest("", aggregations=("category",)))
    assert [(r.value, r["count"]) for r in found.facets.collect()] == [("a", 2), ("b", 2), ("c", 1), ("d", 1)]


def test_written_index_skips_other_terms(spark, tmp_path):
    index = make(spark, PHONES).write(str(tmp_path))
    assert [h.id for h in se.search(index, SearchRequest("samsung")).hits.collect()] == [1]
    plan = index.postings.filter(F.col("term").isin(["samsung"]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [samsung])]" in plan or "EqualTo(term,samsung)" in plan


def test_batched_ranker():
    import pandas as pd

    candidates = pd.DataFrame({"id": range(10), "score": [1.0] * 10})
    answer = lambda q, c: c.assign(score=c["id"].astype(float)).iloc[1:]  # noqa: E731 - the first of each call stays without an answer
    got = BatchedRanker(answer, batch=4).rerank("q", candidates)
    assert list(got["id"]) == [9, 7, 6, 5, 3, 2, 1, 0, 4, 8]
