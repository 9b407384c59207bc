import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamiz.operators import changefeed, profile, skew, wide
from tamiz.operators.buckets import BucketTable
from tamiz.operators.manifest import Manifests
from tamiz.session import materialize, scratch_path

# buckets and change feeds -----------------------------------------------------

FEED = "shard int, gen long, seq long, op string, id long, title string, key string, deleted boolean"


def feed(spark, rows):
    return spark.createDataFrame([(*r, "extra", True) for r in rows], FEED)


def normal(df):
    return changefeed.normalize(df, F.col("id"), F.col("op"), {"gen": F.col("gen"), "seq": F.col("seq")}, F.struct("title"))


def state(spark, *batches, buckets=4):
    table = changefeed.open_table(spark, scratch_path(spark, "t"), normal(batches[0]), buckets)
    for b in batches:
        table.commit(normal(b))
    return table


def rows_of(table):
    return sorted((r.key, r.gen, r.seq, r.content.title) for r in changefeed.live(table.read()).collect())


def test_order_decides_not_arrival(spark):
    late = feed(spark, [(0, 0, 1, "Index", 7, "old"), (0, 1, 1, "Index", 8, "x")])
    early = feed(spark, [(0, 0, 9, " DELETE ", 7, None), (0, 0, 5, "INDEX", 7, "mid"), (0, 0, 9, " DELETE ", 7, None), (0, 2, 1, "delete", 99, None)])
    back = feed(spark, [(0, 1, 0, "index", 7, "new")])
    assert rows_of(state(spark, early, late)) == [(8, 1, 1, "x")]
    for order in ((late, early, back), (back, early, late), (early, back, late, late)):
        assert rows_of(state(spark, *order)) == [(7, 1, 0, "new"), (8, 1, 1, "x")]


def test_nulls_unknown_and_empty(spark):
    odd = feed(spark, [(0, None, 1, "index", 1, "a"), (0, 1, None, "index", 1, "a"), (0, 1, 1, None, 1, "a"), (0, 1, 1, "touch", 1, "a"), (0, 1, 1, "index", None, "a"), (0, 1, 1, "index", 2, None), (0, 1, 2, "index", 3, "x" * 100_000)])
    assert [(k, g, s) for k, g, s, _ in rows_of(state(spark, odd))] == [(2, 1, 1), (3, 1, 2)]
    assert rows_of(state(spark, feed(spark, []))) == []


def test_one_key_with_a_third_of_all_rows(spark):
    rng = random.Random(1)
    rows = [(0, rng.randrange(3), i, "delete" if rng.random() < 0.3 else "index", 1 if i % 3 == 0 else i % 50, str(i)) for i in range(900)]
    want = {}
    for _, g, s, op, k, t in rows:
        if k not in want or (g, s) > want[k][:2]:
            want[k] = (g, s, op, t)
    rng.shuffle(rows)
    got = rows_of(state(spark, feed(spark, rows[:300]), feed(spark, rows[300:])))
    assert got == sorted((k, g, s, t) for k, (g, s, op, t) in want.items() if op == "index")


def test_only_touched_buckets_are_rewritten(spark):
    table = state(spark, feed(spark, [(0, 0, i, "index", i, "a") for i in range(40)]), buckets=8)
    before = table.manifest()["files"]
    table.commit(normal(feed(spark, [(0, 1, 1, "index", 5, "b")])))
    after = table.manifest()["files"]
    assert sum(before[b] != after[b] for b in before) == 1 and table.version() == 2
    assert rows_of(table)[5] == (5, 1, 1, "b")
    assert table.read(version=1).filter("content.title = 'b'").count() == 0  # the older version still reads


SUMS = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType())])


def sums(spark, path, buckets=None):
    add = lambda rows, by: rows.groupBy(*by).agg(F.sum("n").alias("n"))
    return BucketTable(spark, path, SUMS, ["k"], add, lambda old, new, alone: {"n": new("n") + F.coalesce(old("n"), F.lit(0))}, buckets)


def test_two_writers_one_wins(spark):
    path = scratch_path(spark, "w")
    one, two = sums(spark, path, 2), sums(spark, path, 2)
    one.commit(spark.createDataFrame([(1, 1)], SUMS))
    late, reduce = spark.createDataFrame([(1, 1)], SUMS), two.reduce
    two.reduce = lambda rows, by: (one.commit(late), reduce(rows, by))[1]  # the other writer is done first
    with pytest.raises(Exception):
        two.commit(spark.createDataFrame([(1, 5)], SUMS))
    assert [tuple(r) for r in one.read().collect()] == [(1, 2)]


def test_a_batch_counts_once_however_often_it_comes(spark):
    table = sums(spark, scratch_path(spark, "w"))
    batch = spark.createDataFrame([(1, 1), (1, 4), (2, 7), (None, 9)], SUMS)
    for number in (0, 0, 1, 0, 1):
        table.commit(batch, "feed", number)
    table.commit(batch, "other", 0)
    assert sorted(map(tuple, table.read().collect())) == [(1, 15), (2, 21)] and table.version() == 3
    assert table.commit(batch.filter("false")) == 3


def test_stored_rows_do_not_move(spark):
    from tamiz.operators.buckets import shuffle_partitions

    table = sums(spark, scratch_path(spark, "w"), 8)
    table.commit(spark.range(500).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("n")))
    held = table.manifest()
    with shuffle_partitions(spark, 8):
        new, _ = table._write(spark.createDataFrame([(i, 1) for i in range(400, 600)], SUMS), "data/9-x/new", 8)
        plan = table._merged(table._open(8, held["files"]), table._open(8, new))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Bucketed: true") == 2 and "SortMergeJoin" in plan


def test_files_of_old_versions_go(spark):
    path = scratch_path(spark, "w")
    table = sums(spark, path, 4)
    for i in range(12):
        table.commit(spark.createDataFrame([(k, 1) for k in (range(100) if not i else range(i, i + 3))], SUMS))
    folder = table._manifests._path(f"{path}/data")
    files, walk = [], table._manifests._fs.listFiles(folder, True)
    while walk.hasNext():
        files.append(walk.next().getPath().getName())
    kept = {f for v in (table.version(), table.version() - 1) for fs in table.manifest(v)["files"].values() for f in fs}
    assert len([f for f in files if f.endswith(".parquet") and f[0] != "."]) <= len(kept) + 4 and len(table._manifests._numbers()) == 2
    assert table.read().agg(F.sum("n")).first()[0] == 133 and table.read(table.version() - 1).agg(F.sum("n")).first()[0] == 130


def test_buckets_follow_the_size(spark, monkeypatch):
    from tamiz.operators import buckets

    table = sums(spark, scratch_path(spark, "w"))
    grow = lambda lo, hi: table.commit(spark.range(lo, hi).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("n")))
    grow(0, 100)
    assert table.manifest()["buckets"] == buckets.LEAST_BUCKETS
    monkeypatch.setattr(buckets, "BUCKET_BYTES", 300)
    grow(50, 150)
    assert table.manifest()["buckets"] > buckets.LEAST_BUCKETS
    grow(100, 200)
    assert sorted(map(tuple, table.read().collect())) == [(k, 1 + (50 <= k < 150 and k < 100 or 100 <= k < 150)) for k in range(200)]


def test_an_unfinished_version_does_not_count(spark, tmp_path):
    m = Manifests(spark, str(tmp_path / "m"))
    assert m.latest() == (0, None) and m.publish(0, {"a": 1}) == 1
    (tmp_path / "m" / "0000000002.json").write_text('{"a"')
    assert m.latest() == (1, {"a": 1}) and m.publish(1, {"a": 2}) == 3 and m.latest() == (3, {"a": 2})
    with pytest.raises(RuntimeError):
        m.publish(1, {"a": 9})


# skew -------------------------------------------------------------------------


def test_join_lookup(spark):
    big = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(100)] + [(None, 1)], "k string, v int")
    lookup = big.filter("k is not null").groupBy("k").agg(F.count("*").alias("n")).filter("k != 'k5'")
    got = skew.join_lookup(big, lookup, ["k"], "n", 400, heavy_limit=10)
    assert got.count() == 399
    assert skew.join_lookup(big, lookup, ["k"], "n", 400, "left", 10).filter("n is null").count() == 2
    assert skew.join_lookup(big, lookup.filter("false"), ["k"], "n", 400, "left").count() == 401


def test_running_sum(spark):
    df = spark.createDataFrame([(i % 2, i, 1) for i in range(100)], "g int, o int, a int")
    got = skew.running_sum(df, ["g"], [F.col("o")], F.floor(F.col("o") / 7), "a", "s").orderBy("g", "o").collect()
    assert [r.s for r in got] == list(range(1, 51)) * 2
    assert skew.running_sum(df, [], [F.col("o")], F.floor(F.col("o") / 7), "a", "s").agg(F.max("s")).first()[0] == 100


# wide tables ------------------------------------------------------------------

DEFS = [("BRAND", "Marca", "text", None), ("COLOR", "Color", "list", None), ("WEIGHT", "Peso", "number", "g"), ("PACK_UNITS", "Unidades por pack", "number", "units"), ("WIRELESS", "Inalámbrico", "flag", None), ("STORAGE", "Almacenamiento", "number", "gb")]


def defs(spark):
    return spark.createDataFrame(DEFS, "id string, name string, value_type string, unit string")


def cells(spark, rows, docs=None):
    t = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    items = spark.createDataFrame([(i, *r[:4], t(r[4]), "clash", "clash") for i, r in enumerate(rows)], "row_id long, item_id string, id string, name string, value_name string, updated_at timestamp, origin string, cell string")
    return {(r.entity_id, r.attr_id): r.cell_value for r in wide.unpivot(wide.pivot(wide.item_rows(items), defs(spark))).collect()}


def test_cells(spark):
    rows = [
        ("a", " Brand", None, "  Acme   Co ", 1), ("a", "BRAND", None, "N/A", 2), ("a", "pack-units", None, "x6", 1), ("a", None, "Peso:", "2,05 kg", 1), ("a", "WEIGHT", None, "ver descripción", 5),
        ("a", "", " INALAMBRICO ", "Sí", 1), ("a", "COLOR", None, "Rojo / azul;ROJO", 1), ("a", "storage", None, "1TB", 1), ("a", "X_OTHER", "Marca", "no", 1),
        ("b", "WEIGHT", None, "500", 1), ("b", "WEIGHT", None, "600", 1), ("b", "WIRELESS", None, "0", 1), ("b", "COLOR", None, "-", 1), ("b", "STORAGE", None, "x5", 1), ("b", "BRAND", None, None, 9), ("b", "BRAND", None, "z" * 50_000, 1),
        (None, "BRAND", None, "lost", 1), ("c", "BRAND", None, "", 1),
    ]
    got = cells(spark, rows)
    assert got == {("a", "BRAND"): "Acme Co", ("a", "PACK_UNITS"): "6", ("a", "WEIGHT"): "2050", ("a", "WIRELESS"): "true", ("a", "COLOR"): "azul,rojo", ("a", "STORAGE"): "1024", ("b", "WEIGHT"): "600", ("b", "WIRELESS"): "false", ("b", "BRAND"): "z" * 50_000}
    assert cells(spark, []) == {}


def test_typed_columns_keep_failures(spark):
    rows = [("a", "WEIGHT", None, "grande", 1), ("a", "WEIGHT", None, "mucho", 2), ("a", "COLOR", None, "rojo, azul", 1)]
    items = spark.createDataFrame([(i, *r[:4], dt.datetime(2024, 1, r[4])) for i, r in enumerate(rows)], "row_id long, item_id string, id string, name string, value_name string, updated_at timestamp")
    (r,) = wide.project(wide.pivot(wide.item_rows(items), defs(spark)), defs(spark)).collect()
    assert r.weight is None and r.color == ["azul", "rojo"] and [tuple(x) for x in r.cast_failures] == [("WEIGHT", "mucho", 2)]


def test_document_members(spark):
    member = "struct<s:string,n:double,b:boolean,a:array<string>>"
    docs = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), {"weight": (None, 300.4, None, None), "Wireless": (None, None, True, None), "COLOR": (None, None, None, ["Verde", "azul", "verde"]), "brand": (None, 7.0, None, None), "STORAGE": (None, float("nan"), None, None)}), (2, None, None), (3, None, {})], f"id long, loaded_at timestamp, attributes map<string,{member}>")
    got = {(r.entity_id, r.attr_id): r.cell_value for r in wide.unpivot(wide.pivot(wide.document_rows(docs), defs(spark))).collect()}
    assert got == {("1", "WEIGHT"): "300", ("1", "WIRELESS"): "true", ("1", "COLOR"): "azul,verde", ("1", "BRAND"): "7"}


def test_entities_without_cells_keep_a_row(spark, tmp_path):
    from tamiz.plans import maintenance

    t = dt.datetime(2024, 1, 1)
    member = "struct<s:string,n:double,b:boolean,a:array<string>>"
    defs(spark).write.parquet(str(tmp_path / "attr_defs.parquet"))
    spark.createDataFrame([(1, "a", "BRAND", None, "Acme", t), (2, "b", "NOT_DEFINED", None, "x", t), (3, None, "BRAND", None, "x", t)], "row_id long, item_id string, id string, name string, value_name string, updated_at timestamp").write.parquet(str(tmp_path / "item_attrs.parquet"))
    spark.createDataFrame([(1, t, {"BRAND": ("Luna", None, None, None)}), (2, t, None), (3, t, {}), (1, t, None), (None, t, None)], f"id long, loaded_at timestamp, attributes map<string,{member}>").write.parquet(str(tmp_path / "catalog_docs.parquet"))
    got = sorted((r.origin, r.entity_id, r.brand, r.cast_failures) for r in maintenance.p4_wide(spark, str(tmp_path)).collect())
    assert got == [("document", "1", "Luna", []), ("document", "2", None, []), ("document", "3", None, []), ("item", "a", "Acme", []), ("item", "b", None, [])]


# profiles ---------------------------------------------------------------------


def loads(spark, rows):
    return spark.createDataFrame(rows, "id string, price double, status string, load_id long")


def test_exact_medians(spark):
    rng = random.Random(3)
    prices = {k: [round(rng.lognormvariate(7, 2), 2) + 0.01 for _ in range(n)] for k, n in ((1, 201), (2, 500), (3, 1), (4, 2))}
    rows = [(str(i), p, "a", k) for k, ps in prices.items() for i, p in enumerate(ps)]
    rows += [("x", v, "a", 1) for v in (None, float("nan"), float("inf"), -1.0, 0.0, 1e12, 1.234)] + [("y", None, "a", 5)]
    got = {r.load_id: r.median for r in profile.exact_medians(loads(spark, rows), "price").collect()}
    want = {k: statistics.median(p for p in ps if p <= profile.MAX_PRICE) for k, ps in prices.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_changes_between_loads(spark):
    rows = [(str(i), 10.0, "active", 1) for i in range(10)] + [(str(i), 20.0 if i else None, "paused" if i < 3 else "active", 3) for i in range(10)] + [(str(i), 20.0, None if i < 5 else "active", 7) for i in range(10)] + [("n", 1.0, "x", None)]
    df = loads(spark, rows)
    assert [(r.load_id, r.finding) for r in profile.median_shift(df, "t", "price").collect()] == [(3, "shift")]
    assert sorted((r.column_name, r.load_id) for r in profile.null_share_changes(df, "t", ["price", "status"]).collect()) == [("price", 3), ("price", 7), ("status", 7)]
    assert sorted(r.load_id for r in profile.value_shift(df, "t", "status").collect()) == [3, 7]
    bad = profile.violations(df, "t", "status", F.col("status").isin("active", "paused")).collect()
    assert [(r.record_id, r.load_id) for r in bad] == [("n", None)]
    empty = loads(spark, [])
    for f in (profile.median_shift(empty, "t", "price"), profile.value_shift(empty, "t", "status"), profile.null_share_changes(empty, "t", ["price"]), profile.column_profile(empty, "t")):
        assert f.collect() == []


def test_column_profile(spark):
    df = loads(spark, [("a", 1.0, None, 1), ("a", 2.0, None, 1), (None, -1.0, "x", None)]).withColumn("m", F.create_map(F.lit("k"), F.col("id"))).withColumn("n_rows", F.lit(1)).withColumn("x", F.lit("clash"))
    got = {(r.column_name, r.load_id): r for r in profile.column_profile(df, "t", {"price": profile.valid_price(F.col("price"))}).collect()}
    assert (got["id", 1].n_distinct, got["id", 1].null_share, got["status", 1].n_distinct, got["status", 1].null_share) == (1, 0.0, 0, 1.0)
    assert got["price", None].n_violations == 1 and got["price", 1].max_value == "2.0" and got["m", 1].n_distinct == 1


def test_masks(spark):
    texts = ["AB-12 x", "ñandú", "", None, "a" * 70, "Peso: 1 kg; " * 40, "x,1;y.2" * 3 + "".join(chr(0x2190 + i) for i in range(70))]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = [r[0] for r in df.select(profile.mask(F.col("v"))).collect()]
    assert got[:5] == ["A-9_a", "a", "", None, "a"]
    assert got[5].endswith("*") and len(got[5]) < 30 and got[6].startswith("~")
    rows = [(f"QSA{i}", float(i), "active", 1 + i % 2) for i in range(400)] + [("???", 1.0, "ACTIVE!", 2)] + [(str(i), 1.0, "1", 3) for i in range(100)]
    found = {(r.column_name, r.load_id, r.finding) for r in profile.mask_findings(materialize(profile.mask_counts(loads(spark, rows), "t"), "m")).collect()}
    assert {("id", 2, "rare_mask"), ("status", 2, "rare_mask"), ("id", 3, "mask_shift"), ("status", 3, "mask_shift")} <= found
    assert ("id", 2, "mask_shift") not in found
    free = [("".join(chr(0x2190 + (i * k) % 101) for k in (1, 3, 7, 11)) + chr(0x2200 + i), 1.0, "active", 1 + i // 200) for i in range(400)]  # a column without patterns can't lose one
    counts = materialize(profile.mask_counts(loads(spark, free), "t"), "m")
    assert not [r for r in profile.mask_findings(counts).collect() if r.column_name == "id"]
