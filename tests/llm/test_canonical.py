from tamiz.llm import canonical as ca
from tamiz.session import scratch_path

SCHEMA = "id long, title string, description string, load_id long, key string, n_records long, keep_id string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 9, "x") for r in rows], SCHEMA)


def run(spark, *batches):
    ledger = ca.open_ledger(spark, scratch_path(spark, "l"), 4)
    keyed = [ca.keyed(docs(spark, b)) for b in batches]
    rows = keyed[0]
    for k in keyed:
        ca.add_batch(ledger, k)
    for k in keyed[1:]:
        rows = rows.unionByName(k)
    pairs = sorted((r.keep_id, r.copy_id) for r in ca.copies(rows, ledger.read()).collect())
    return pairs, sorted((r.keep_id, r.n_records) for r in ledger.read().collect())


A = "Color: azul; Peso: 1 kg"


def test_formatting_does_not_count(spark):
    rows = [(5, "Taza  AZUL", A, 1), (3, "«taza azul»", "PESO 1 KG // color-azul", 1), (9, "Taza azul!", "Peso: 1 kg\n\n•Color: azul|", 2), (4, "Taza azúl", A, 1), (6, "Taza azul", "Color: azul", 1), (3, "«taza azul»", "PESO 1 KG // color-azul", 2)]
    assert run(spark, rows) == ([(3, 5), (3, 9)], [(3, 4), (4, 1), (6, 1)])


def test_batches_in_any_cut_give_the_same(spark):
    rows = [(i, f"t {i % 7}", A, i % 3) for i in range(60)]
    assert run(spark, rows) == run(spark, rows[40:], rows[:10], rows[10:40])


def test_no_content_and_nulls(spark):
    rows = [(1, None, A, 1), (2, "", A, 1), (3, "--", A, 1), (4, "a", None, 1), (5, "a", " ; // ", 1), (None, "a", A, 1), (6, "a", A, None), (7, "A", A, None)]
    assert run(spark, rows) == ([(6, 7)], [(6, 2)])
    assert run(spark, []) == ([], [])


def test_slash_is_no_field_break(spark):
    assert run(spark, [(1, "a", "x/y; z", 1), (2, "a", "z // x y", 1), (3, "a", "x // y // z", 1)])[0] == [(1, 2)]


def test_one_group_with_a_third(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}", A + " w" * 5000 * (i == 0), 1) for i in range(300)]
    rows[0] = (0, "hot", A, 1)
    assert run(spark, rows)[0] == [(0, i) for i in range(3, 300, 3)]


def test_a_batch_delivered_twice_counts_once(spark):
    ledger = ca.open_ledger(spark, scratch_path(spark, "l"))
    rows = ca.keyed(docs(spark, [(1, "a", A, 1), (2, "A", A, 1)]))
    for _ in range(2):
        ca.add_batch(ledger, rows, "loads", 1)
    assert [tuple(r)[1:] for r in ledger.read().collect()] == [(2, 1)]
