import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tamiz.llm import leaks


def nearest(pattern, text):
    """Edit distance to any stretch, by the full table."""
    row = [0] * (len(text) + 1)
    for p in pattern:
        new = [row[0] + 1]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), st.lists(st.sampled_from("abc"), max_size=20))
def test_bit_parallel_distance(pattern, text):
    assert leaks.myers_nearest(pattern, text) == nearest(pattern, text)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 2))
def test_pieces_lose_nothing(seed, edits):
    rng = random.Random(seed)
    item = [rng.choice("abcdefghij") for _ in range(18)]
    words = [rng.choice("klmnopqrst") for _ in range(40)]
    part = item[3:16]
    for _ in range(rng.randrange(3)):
        part[rng.randrange(len(part))] = "z"
    words[10:10] = part
    found = leaks.Matcher([item], 10, edits).find(words)
    best = min(nearest(item[i : i + 10], words) for i in range(9))
    assert (found[0][0] if found else None) == (best if best <= edits else None)


ITEM = "Un juez marcó como irrelevante la consulta del plato azul número doce en la ronda siete"


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    return {(r.doc_id, r.item_id): r for r in leaks.find_leaks(d, i, **kw).collect()}


def test_leaks(spark):
    words = ITEM.split()
    docs = [
        (1, f"antes. {ITEM.upper()}! después", "x"), (2, "hola " + " ".join(words[2:12]), "x"), (3, " ".join(words[2:11]) + " otra", "x"),
        (4, None, "x"), (5, "", "x"), (None, ITEM, "x"), (6, "MARCO COMO irrelevante la consulta, del plato; azul numero doce", "x"), (7, "w " * 100_000 + ITEM, "x"), (1, ITEM, "x"),
    ]
    items = [(10, ITEM, "x"), (11, ITEM + ".", "x"), (12, "corto texto", "x"), (13, None, "x"), (None, ITEM, "x")]
    for kw in ({}, {"block_words": 20}):
        got = run(spark, docs, items, **kw)
        assert {k for k, r in got.items() if r.distance == 0} == {(d, i) for d in (1, 2, 6, 7) for i in (10, 11)}
        assert got[3, 10].distance == 1 and got[1, 10].n_stretches == got[1, 10].item_stretches == len(words) - 9
    assert run(spark, [], items) == {} and run(spark, docs, []) == {}
