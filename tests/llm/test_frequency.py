import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tamiz.llm import frequency as fr

positions = st.sets(st.integers(0, fr.CHUNK - 1), min_size=1, max_size=300).map(sorted)


@settings(max_examples=100, deadline=None)
@given(positions, positions)
def test_containers_round_trip_and_union(a, b):
    x, y = fr.encode(np.array(a)), fr.encode(np.array(b))
    assert fr.decode(x).tolist() == a and fr.cardinality(x) == len(a)
    both = fr.union([x, y])
    assert fr.decode(both).tolist() == sorted(set(a) | set(b)) and fr.cardinality(both) == len(set(a) | set(b))


def test_container_kinds():
    full, dense, sparse = np.arange(fr.CHUNK), np.arange(0, fr.CHUNK, 2), np.array([5])
    assert len(fr.encode(full)) == 7 and len(fr.encode(dense)) == 3 + fr.CHUNK // 8 and len(fr.encode(sparse)) == 5
    for p in (full, dense, sparse):
        assert fr.decode(fr.encode(p)).tolist() == p.tolist()


def tokens(spark, rows):
    return spark.createDataFrame(rows, "field string, term string, rid long")


def brute(rows):
    out = {}
    for f, t, r in rows:
        n, ids = out.setdefault((f, t), [0, set()])
        out[f, t][0] += 1
        if r is not None:
            ids.add(r)
    return {k: (n, len(ids)) for k, (n, ids) in out.items()}


def read(index):
    return {(r.field, r.term): (r.occurrences, r.records) for r in fr.statistics(index).collect() if r.term is not None}


def test_counts_merge_and_marks(spark):
    rng = random.Random(5)
    rows = [("f", rng.choice(["hot"] * 20 + [f"t{i}" for i in range(40)]), rng.choice([None, -3, 7, rng.randrange(200_000)])) for _ in range(1500)]
    assert read(fr.build_index(tokens(spark, rows))) == brute(rows)
    merged = fr.merge_indexes(fr.build_index(tokens(spark, rows[:900])), fr.build_index(tokens(spark, rows[700:])))
    twice = brute(rows[:900] + rows[700:])
    assert read(merged) == twice
    n = {r.field: r.field_records for r in fr.records_of_fields(fr.statistics(fr.build_index(tokens(spark, rows)))).collect()}
    assert n == {"f": len({r for _, _, r in rows if r is not None})}
    marks = fr.mark(fr.statistics(fr.build_index(tokens(spark, rows))))
    for r in marks.collect():
        assert r.finding == ("rare" if r.records <= 2 else "common" if r.records > 0.2 * n["f"] else None)


def test_empty(spark):
    empty = tokens(spark, [])
    assert read(fr.build_index(empty)) == {} and fr.records_of_fields(fr.statistics(fr.build_index(empty))).count() == 0
    assert fr.mark(fr.statistics(fr.build_index(empty))).count() == 0


def test_containers_before_the_shuffle(spark):
    rng = random.Random(8)
    rows = [(f, t, rng.choice([None, -1, 5, rng.randrange(70_000)])) for f in "fg" for t in ["hot"] * 30 + list("abc") for _ in range(20)] + [("f", None, 1)]
    few = fr.containers(tokens(spark, rows).coalesce(2), rows=100)
    assert few.count() < len(rows) * 2 and read(fr.unite(few)) == brute([r for r in rows if r[1]])
    plan = fr.build_index(tokens(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("MapInArrow")  # plans are printed from the last step to the first
