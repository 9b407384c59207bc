import json

import pytest
from pyspark.sql import functions as F

from tamiz.functions.routing import shard_of
from tamiz.operators import storage
from tamiz.operators.suggest import build, frequencies, lookup, lookup_sharded, suggest, term_rows
from tamiz.schema import DOCUMENT
from tamiz.sources import ingest


def test_documents_json(spark, tmp_path):
    p = tmp_path / "d.json"
    p.write_text(json.dumps([{"id": 1, "title": "A", "description": "", "price": 2.5, "category": "c", "attributes": {"brand": {"String": "Acme"}, "w": {"Number": 2}, "ok": {"Bool": True}, "tags": {"StringArray": ["x", "y"]}, "bare": "Acme", "num": 7, "list": ["p"]}}, {"id": 2, "title": "B", "price": 1.0}]))
    one, two = ingest.read_documents(spark, str(p)).orderBy("id").collect()
    a = {k: tuple(v) for k, v in one.attributes.items()}
    assert a == {"brand": ("Acme", None, None, None), "w": (None, 2.0, None, None), "ok": (None, None, True, None), "tags": (None, None, None, ["x", "y"]), "bare": ("Acme", None, None, None), "num": (None, 7.0, None, None), "list": (None, None, None, ["p"])}
    assert two.attributes == {}
    assert ingest.check_batch(ingest.read_documents(spark, str(p))).count() == 2


def test_batch_checks(spark):
    docs = lambda *t: spark.createDataFrame([(i, x, "", 1.0, "c", {}) for i, x in enumerate(t)], DOCUMENT)
    for bad in (docs(), docs("a", ""), docs("a", None)):
        with pytest.raises(ValueError):
            ingest.check_batch(bad)
    with pytest.raises(ValueError):
        ingest.check_batch(docs("a", "b"), limit=1)


ITEM = {"id": "MLA1136716168", "site_id": "MLA", "title": "t", "price": 1.0, "category_id": "MLA109027", "condition": "new", "thumbnail": "", "status": None, "attributes": [{"id": "BRAND", "name": "Marca", "value_name": "Propia"}, {"id": "MODEL", "name": "m", "value_name": None}, {"id": "Brand", "name": "Marca", "value_name": "Otra"}, {"id": "CONDITION", "name": "c", "value_name": "old"}], "extra": 1}


def test_items(spark, tmp_path):
    p = tmp_path / "i.json"
    p.write_text(json.dumps([ITEM, {**ITEM, "id": "MLAINVALID"}, {**ITEM, "category_id": "X1"}, {**ITEM, "id": None, "attributes": None}]))
    good, bad = ingest.split_errors(ingest.map_items(ingest.read_items(spark, str(p))))
    (doc,) = good.collect()
    assert (doc.id, doc.category, doc.description) == (1136716168, "109027", "")
    assert {k: v.s for k, v in doc.attributes.items()} == {"brand": "Otra", "condition": "new"}
    assert sorted(r.error for r in bad.collect()) == ["invalid category_id: X1", "invalid id: MLAINVALID", "invalid id: null"]


def test_item_lines(spark, tmp_path):
    p = tmp_path / "ok.ndjson"
    p.write_text(json.dumps(ITEM) + "\n\n  \n" + json.dumps(ITEM) + "\n")
    assert ingest.read_item_lines(spark, str(p)).count() == 2
    q = tmp_path / "bad.ndjson"
    q.write_text(json.dumps(ITEM) + "\n\n{broken\n" + json.dumps(ITEM))
    with pytest.raises(ValueError, match="line 3"):
        ingest.read_item_lines(spark, str(q))


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, "", 1.0, "c", {}) for i, t in rows], DOCUMENT)


def ids(df):
    return sorted((r.id, r.title) for r in df.collect())


def test_store(spark, tmp_path):
    s = storage.Store(spark, str(tmp_path))
    s.index(docs(spark, (1, "a"), (2, "b")))
    s.delete(spark.createDataFrame([(2,), (42,)], "id long"))
    seqs = sorted(r.seq for r in s.operations().collect())
    assert ids(s.documents()) == [(1, "a")] and len(set(seqs)) == 4 and s.read_since(seqs[2]).count() == 2
    s.flush()
    s.index(docs(spark, (1, "a2"), (3, "c")))
    assert ids(s.documents()) == [(1, "a2"), (3, "c")]
    again = storage.Store(spark, str(tmp_path))  # recovery
    assert ids(again.documents()) == [(1, "a2"), (3, "c")]
    again.delete(spark.createDataFrame([(1,)], "id long"))
    again.flush()
    again.index(docs(spark, (2, "back")))
    again.flush()
    assert len(again.manifest.segments) == 1  # three segments were merged
    assert ids(again.documents()) == [(2, "back"), (3, "c")]
    assert again.compact() == 2 and ids(again.documents()) == [(2, "back"), (3, "c")]
    assert {r.shard_id: r.live_docs for r in again.stats(2).collect()}[None] == 2
    assert again.manifest.next_seq >= 7


def test_store_flushes_by_size(spark, tmp_path):
    s = storage.Store(spark, str(tmp_path), buffer_bytes=100)
    s.index(docs(spark, (1, "a")))
    assert s.manifest.log
    s.index(docs(spark, (2, "b")))
    assert not s.manifest.log and s.manifest.segments
    assert storage.Store(spark, str(tmp_path / "none")).documents().count() == 0


def test_folders_of_old_manifests_go(spark, tmp_path):
    s = storage.Store(spark, str(tmp_path))
    for i in range(10):
        s.index(docs(spark, (i, "a"), (i + 1, "b")))
        s.flush()
    named = {*s.manifest.segments, *s.manifest.log}
    left = [p for kind in ("segments", "oplog") for p in (tmp_path / kind).iterdir() if p.is_dir()]
    assert len(left) <= 2 * storage.KEPT + len(named) and len(list((tmp_path / "manifest").glob("*.json"))) <= storage.KEPT
    assert s.documents().count() == 11 and storage.Store(spark, str(tmp_path)).documents().count() == 11


def test_store_without_operations(spark, tmp_path):
    s = storage.Store(spark, str(tmp_path))
    s.index(docs(spark))
    s.index(docs(spark, (1, "a")).filter("false"))
    s.flush()
    s.delete(spark.createDataFrame([], "id long"))
    assert s.manifest.next_seq == 0 and s.compact() == 0 and s.documents().count() == 0


def test_replica(spark, tmp_path):
    s, r = storage.Store(spark, str(tmp_path / "s")), storage.Store(spark, str(tmp_path / "r"))
    s.index(docs(spark, (1, "a"), (2, "b")))
    s.flush()
    assert storage.catch_up(s, r) == "full" and ids(r.documents()) == [(1, "a"), (2, "b")] and storage.catch_up(s, r) == "none"
    s.delete(spark.createDataFrame([(2,)], "id long"))
    s.index(docs(spark, (1, "c")))
    assert storage.catch_up(s, r) == "log" and ids(r.documents()) == [(1, "c")]
    r.apply(s.read_since(0))  # what came before changes nothing
    assert ids(r.documents()) == [(1, "c")] and r.manifest.next_seq == s.manifest.next_seq
    s.flush()
    assert storage.catch_up(s, r) == "none"
    s.index(docs(spark, (3, "d")))
    s.flush()
    assert storage.catch_up(s, r) == "full" and ids(r.documents()) == [(1, "c"), (3, "d")]


def test_merge_policy():
    assert storage.merges({"a": 1, "b": 2}) == []
    assert storage.merges({"a": 5, "b": 2, "c": 9}) == ["b", "a", "c"]
    assert len(storage.merges({str(i): i for i in range(20)})) == 10


def test_write_sharded(spark, tmp_path):
    storage.write_sharded(docs(spark, *((i, "t") for i in range(50))), str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 50 and back.filter(F.col("shard_id") != shard_of(F.col("id"), 4)).count() == 0


def test_suggest(spark):
    d = docs(spark, (1, "wireless mouse"), (2, "wireless keyboard"), (3, "wired mouse"), (4, "wireless wireless"), (5, None))
    table = build(frequencies(term_rows(d)), 1)
    assert [r.term for r in lookup(table, "WIRE", 5).collect()] == ["wireless", "wired"]
    assert {r.term: round(r.score, 6) for r in table.collect()}["wireless"] == 1.0
    assert lookup(table, "", 5).count() == 0 and lookup(table, "w", 0).count() == 0
    assert [r.term for r in lookup(build(frequencies(term_rows(d)), 2), "wire", 5).collect()] == ["wireless"]
    assert build(frequencies(term_rows(d)), 1, max_terms=2).count() == 2
    assert build(frequencies(term_rows(docs(spark))), 1).count() == 0
    df, consistency = suggest(table, " wire ", 99)
    assert consistency == "eventual" and df.count() == 2
    with pytest.raises(ValueError):
        suggest(table, "x" * 101)


def test_suggest_shards(spark):
    rows = spark.createDataFrame([(0, "wireless", 5), (0, "wired", 2), (1, "wired", 4)], "shard_id int, term string, df long")
    table = build(rows, 1, by=("shard_id",))
    assert [(r.term, r.score) for r in lookup_sharded(table, "wi", 5).collect()] == [("wired", 1.0), ("wireless", 1.0)]
