import pytest

from tamiz.plans import engine, maintenance, retrieval

_PARTS = (maintenance, retrieval, engine)
_QUERIES = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
_ORACLES = {k: s for p in _PARTS for k, s in p.oracles().items()}


@pytest.mark.parametrize("name", sorted(_ORACLES))
def test_same_as_sql(name, compare):
    compare(_QUERIES[name], _ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(_QUERIES) - set(_ORACLES)))
def test_runs(name, spark, data):
    _QUERIES[name](spark, data).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_live_after_deletes_takes_the_last_change(spark, tmp_path):
    log = [(0, 1, "delete", 1), (0, 2, "Index", 1), (0, 9, "index", 2), (1, 1, " DELETE ", 2), (1, 3, "index", 3), (0, 8, "delete", 3), (0, 1, "delete", 4), (0, 1, "delete", 99)]
    spark.createDataFrame([(g, s, (op, i)) for g, s, op, i in log] + [(2, 1, None)], "wal_gen long, seq long, entry struct<op:string,id:long>").write.parquet(str(tmp_path / "wal_records.parquet"))
    spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 5)], "id long").write.parquet(str(tmp_path / "catalog_docs.parquet"))
    assert sorted(r.id for r in retrieval.live_after_deletes(spark, str(tmp_path)).collect()) == [1, 3, 5]
