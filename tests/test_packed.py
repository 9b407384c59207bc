import random

import pyarrow as pa
import pytest

from tamiz.operators import index as ix
from tamiz.operators import packed as pk
from tamiz.operators import search as se
from tamiz.plans.request import SearchRequest
from tamiz.schema import DOCUMENT, FieldConfig, FieldType, IndexSchema, Language

WORDS = ["de", "para", "con", "taza", "tazas", "lámpara", "lampara", "termo", "termos", "azul", "azules", "750", "7500", "xy33899", "garantía", "portátil", "a"]


def texts(n, seed, least=1, most=7):
    r = random.Random(seed)
    return [" ".join(r.choices(WORDS, range(len(WORDS), 0, -1), k=r.randint(least, most))) for _ in range(n)]


@pytest.mark.parametrize("language", [None, Language.SPANISH])
def test_same_as_single_requests(spark, monkeypatch, language):
    monkeypatch.setattr(pk, "BLOCK", 40)
    monkeypatch.setattr(pk, "CHUNK", 8)
    titles, bodies = texts(300, 1), texts(300, 2, 0, 12)
    docs = spark.createDataFrame([(i // 2 if i < 20 else i if i < 299 else None, t if i % 9 else None, b, None, None, {}) for i, (t, b) in enumerate(zip(titles, bodies))] + [(1000 + i, "taza azul", "taza azul", None, None, {}) for i in range(9)], DOCUMENT)
    # rows of the same id must not differ in length: which length counts isn't defined
    docs = docs.filter("id IS NULL OR id >= 10 OR id % 2 = 0").dropDuplicates(["id"]) if language else docs.filter("id IS NULL OR id >= 10").union(docs.filter("id = 40"))
    index = ix.build(docs, IndexSchema.default(language)).persist()
    asked = [*texts(20, 3), "taza azul", "termo termo zzzz", "lampra azl", "zzzz", "xy33898 de", "", "a", "garantia de 750"]
    queries = spark.createDataFrame(list(enumerate(asked)), "qid long, query string")
    got = {}
    for r in se.search_many(index, queries, k=5).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.id, round(r.score, 8), r["mode"]))
    for qid, q in enumerate(asked):
        one = se.search(index, SearchRequest(q, limit=5)) if q else None
        assert got.get(qid, []) == ([(h.id, round(h.score, 8), one.mode) for h in one.hits.collect()] if q else []), q


def test_only_the_best_leave_a_block(spark, monkeypatch):
    """Each query meets every document by its common terms; what is shuffled grows with queries and blocks, not with their pairs."""
    monkeypatch.setattr(pk, "BLOCK", 100)
    docs = spark.createDataFrame([(i, f"para de {w}", None, None, None, {}) for i, w in enumerate(texts(400, 5))], DOCUMENT)
    queries = spark.createDataFrame([(i, f"para de {w} otro") for i, w in enumerate(texts(60, 6))], "qid long, query string")
    left = []
    monkeypatch.setattr(se, "best", lambda *a, run=se.best: left.append(run(*a)) or left[0])
    found = se.search_many(ix.build(docs, IndexSchema.default(None)), queries, k=3)
    assert found.count() == 180
    assert left[0].count() <= 60 * 3 * pk_blocks(docs)


def pk_blocks(docs):
    return -(-docs.count() // pk.BLOCK)


def test_a_field_without_weight(spark):
    schema = IndexSchema((FieldConfig("title", FieldType.TEXT, indexed=True, boost=0.0), FieldConfig("description", FieldType.TEXT, indexed=True)))
    docs = spark.createDataFrame([(1, "taza azul", None, None, None, {}), (2, None, "taza", None, None, {})], DOCUMENT)
    got = se.search_many(ix.build(docs, schema), spark.createDataFrame([(7, "taza azul")], "qid long, query string")).collect()
    assert [(r.id, r["mode"]) for r in got] == [(2, "or_fallback")]


def test_rows_of_an_id_stay_in_one_block(monkeypatch):
    monkeypatch.setattr(pk, "BLOCK", 4)
    monkeypatch.setattr(pk, "LEAST_BLOCK", 2)
    ids = [1] * 11 + [2, 2, 3, None, 5, 6, 7, 8, 9, 10, 10, 10]
    batches = [pa.record_batch([pa.array(ids[i : i + 5], pa.int64()), pa.array([["w", f"v{x}"] for x in ids[i : i + 5]])], names=["id", "_0"]) for i in range(0, len(ids), 5)]
    blocks = [b.to_pydict() for b in pk._packer([None], [0])(iter(batches))]
    assert len(blocks) > 1 and sum(b["n"][0] for b in blocks) == len(ids) and sum(b["lengths"][0][0] for b in blocks) == 2 * len(ids)
    held = [[None if i in x["null"] else v for i, v in enumerate(x["ids"].tolist())] for x in (pk._unpack(b["packed"][0]) for b in blocks)]
    assert sorted(map(str, sum(held, []))) == sorted(map(str, set(ids)))
