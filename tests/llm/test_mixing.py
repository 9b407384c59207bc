import random
from collections import Counter

import pytest

from tamiz.llm import mixing
from tamiz.session import materialize

TARGETS = [("a", 0.5, 1), ("B ", 0.3, 3), ("c", 0.15, 2), ("empty", 0.05, 2), ("zero", 0.0, 5), (None, 0.1, 1)]


def tables(spark, docs, targets=TARGETS):
    return spark.createDataFrame(docs, "doc_id long, text string, source string, tokens int, weight string"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def corpus(n=400):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("uno dos tres cuatro") for _ in range(rng.randrange(1, 30))) + f" {i}", rng.choice(["a"] * 6 + ["b", " B", "C", "other", None]), 1, "x") for i in range(n)]
    return rows + [(n, None, "a", 1, "x"), (n + 1, " \n", "a", 1, "x"), (None, "texto", "a", 1, "x"), (n + 2, rows[0][1], "c", 1, "x")]


def test_tokens_of_a_public_vocabulary(spark):
    df = spark.createDataFrame([("Hello world",), (None,), ("",), ("ñandú",)], "t string")
    assert [r[0] for r in df.select(mixing.token_counter()("t")).collect()][:3] == [2, 0, 0]


def test_shares_and_repeats(spark):
    docs, targets = tables(spark, corpus())
    sized = materialize(mixing.sized_texts(docs, targets), "s")
    texts = {r.doc_id: r for r in sized.collect()}
    assert len({d for d in texts}) == len(texts) and 402 not in texts and 400 not in texts
    mixture, budget = mixing.mix(sized)
    rows = mixture.collect()
    assert sum(r.tokens for r in rows) <= budget and budget - sum(r.tokens for r in rows) <= max(r.tokens for r in rows)
    uses = Counter(r.doc_id for r in rows)
    assert all(uses[d] <= texts[d].max_repeats for d in uses) and len({(r.doc_id, r.use) for r in rows}) == len(rows)
    report = {r.source: r for r in mixing.report(mixture, targets).collect()}
    for s in ("a", "b", "c"):
        assert abs(report[s].actual_share - report[s].reachable_share) < 0.02
    assert report["empty"].actual_share == 0 and report["empty"].tokens == 0
    # a second use only after all texts of the source came once
    for s in "abc":
        assert max((r.finish for r in rows if r.source == s and r.use == 1), default=0) <= min((r.finish for r in rows if r.source == s and r.use == 2), default=float("inf"))
    again = sorted((r.doc_id, r.use) for r in mixing.mix(sized)[0].collect())
    assert again == sorted((r.doc_id, r.use) for r in rows)


def test_against_a_queue_simulation(spark):
    docs, targets = tables(spark, corpus(150))
    sized = materialize(mixing.sized_texts(docs, targets), "s")
    mixture, _ = mixing.mix(sized, budget=900)
    rows = sorted(mixture.collect(), key=lambda r: (r.finish, r.source, r.doc_id, r.use))
    upto = Counter()
    weight = {r.source: r.weight for r in sized.collect()}
    for r in rows:  # virtual finish time is the running sum of the source over its weight
        upto[r.source] += r.tokens
        assert abs(r.finish - upto[r.source] / weight[r.source]) < 1e-6
    out = mixing.sorted_mixture(mixture).collect()
    assert [r.finish for r in out] == [r.finish for r in rows]


def test_cut_is_where_the_running_sum_reaches_the_budget(spark):
    docs, targets = tables(spark, corpus(120))
    sized = materialize(mixing.sized_texts(docs, targets), "s")
    every = sorted(mixing.mix(sized, budget=10**9)[0].collect(), key=lambda r: (r.finish, r.source, r.doc_id, r.use))
    for budget in (0, 1, 57, 333, 1000):
        want, total = [], 0
        for r in every:
            total += r.tokens
            if total <= budget:
                want.append((r.doc_id, r.use))
        assert sorted((r.doc_id, r.use) for r in mixing.mix(sized, budget)[0].collect()) == sorted(want)


def test_equal_texts_belong_to_a_target_source(spark):
    docs, targets = tables(spark, [(1, "mismo texto", "other", 1, "x"), (2, "mismo texto", "c", 1, "x"), (3, "mismo texto", "a", 1, "x"), (3, "mismo texto", "a", 1, "x")])
    assert [(r.doc_id, r.source) for r in mixing.sized_texts(docs, targets).collect()] == [(2, "c")]


def test_a_source_that_runs_dry(spark):
    docs, targets = tables(spark, corpus())
    sized = materialize(mixing.sized_texts(docs, targets), "s")
    rows = mixing.mix(sized, budget=10**9)[0].collect()
    texts = sized.collect()
    assert len(rows) == sum(r.max_repeats for r in texts)


def test_empty(spark):
    docs, targets = tables(spark, [])
    sized = materialize(mixing.sized_texts(docs, targets), "s")
    mixture, budget = mixing.mix(sized)
    assert budget == 0 and mixture.count() == 0
    assert mixing.report(mixture, targets).count() == 6
    with pytest.raises(Exception):
        spark.createDataFrame([("x",)], "t string").select(mixing.token_counter("/nowhere")("t")).collect()
