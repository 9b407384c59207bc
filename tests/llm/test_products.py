import random
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamiz.llm import listing_parser as lp
from tamiz.llm import products as pr


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_one_typing_error(a, b):
    assert lp.damerau_at_most_one(a, b) == (osa(a, b) <= 1)


def test_parts():
    p = lp.parts("¡Oferta! Caixa de som - SJ.3580 - 0,4 kW preto pack x3", [{"id": "BRAND", "name": "", "value_name": "ACME"}, {"id": "MODEL", "name": "", "value_name": None}, None])
    assert (p["brand_a"], p["code_t"], p["size_t"], p["color_t"], p["pack_t"]) == ("acme", "sj3580", "w400", "negro", 3)
    p = lp.parts("Línea Prisma Viva-174 1TB", [{"id": "LINE", "name": "", "value_name": "Línea Prisma Viva 174"}, {"id": "STORAGE", "name": "", "value_name": "1024 gigas"}])
    assert p["line_a"] == ("prisma", "viva", "174") and p["size_a"] == p["size_t"] == "gb1024"
    assert lp.parts(None, None)["words"] == []


SCHEMA = "id string, title string, category_id string, attributes array<struct<id:string,name:string,value_name:string>>, rec string, product string"
KINDS = [("parlante portatil", "caixa de som", "QS4130"), ("pava electrica", "chaleira", "QS4101"), ("cable ethernet", "cabo ethernet", "QS4121")]
NOISE = ["oferta", "envio gratis", "stock ya", "12 cuotas", ""]
COLORS = [("negro", "preto"), ("rojo", "vermelho"), ("azul", "azul")]


def catalogue(seed=4, n=60, brands=("gairrais", "plandupai", "xasallek", "trojelfu"), tones=COLORS):
    """Listings with their true product."""
    rng, rows, truth = random.Random(seed), [], {}
    for p in range(n):
        kind, brand, color, size, pack = rng.randrange(3), rng.choice(brands), rng.randrange(3), rng.choice([400, 1500]), rng.choice([1, 1, 3])
        model = f"ab{1000 + p // 3}"  # neighbours share a model and differ in size, colour, pack or kind
        for k in range(rng.choice([1, 2, 3, 5])):
            name, tone = KINDS[kind][rng.randrange(2)], tones[color][rng.randrange(2)]
            shown = brand if rng.random() < 0.8 else brand[:3] + brand[4:]
            words = [rng.choice(NOISE), name.upper() if rng.random() < 0.2 else name, shown, rng.choice([model, model[:2] + "-" + model[2:], model.upper()]), rng.choice([f"{size}w", f"{size} W", f"{size / 1000} kW"]), f"color {tone}", f"pack x{pack}" if pack > 1 else ""]
            attrs = [("BRAND", "", brand)] if rng.random() < 0.6 else []
            i = f"QS{p:03d}{k}"
            rows.append((i, " ".join(w for w in words if w), KINDS[kind][2], attrs, "x", "x"))
            truth[i] = (kind, brand, model, size, color, pack)
    rng.shuffle(rows)
    return rows, truth


def test_groups_against_truth(spark):
    rows, truth = catalogue()
    df = spark.createDataFrame([*rows, rows[0], rows[1]], SCHEMA)
    got = {tuple(r) for r in pr.pairs(pr.group_products(df)).collect()}
    want = {(a, b) for a, b in combinations(sorted(truth), 2) if truth[a] == truth[b]}
    assert got == want


@pytest.mark.parametrize("n", [40, 600])
def test_recall_on_brands_and_colours_not_seen_before(spark, n):
    rows, truth = catalogue(11, n, ("zumbelor", "ortiquea", "fenwalda", "quispamo", "hadrelun"), [("turquesa", "turquoise"), ("plateado", "silver"), ("naranja", "laranja")])
    got = {tuple(r) for r in pr.pairs(pr.group_products(spark.createDataFrame(rows, SCHEMA))).collect()}
    by = {}
    for i, t in truth.items():
        by.setdefault(t, []).append(i)
    want = {p for ids in by.values() for p in combinations(sorted(ids), 2)}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.98 * len(got)


def test_leaders_of_runs_cut_between_tasks(spark):
    rng = random.Random(2)
    rows = [(f"i{i:03d}", *("k", "b", f"m{0 if i % 3 == 0 else rng.randrange(20)}", None, "c", 1), f"a{i % 2}") for i in range(300)]
    rows += rows[:40] + [("i000", "k", "b", "other", None, "c", 1, "a")]  # repeated rows, and an id with two readings
    df = spark.createDataFrame(rows, "id string, kind string, brand string, model string, size string, color string, pack long, article string").repartition(6)
    placed, recs = pr.contract(df)
    parts = {r.rec: (r.model, r.n) for r in recs.collect()}
    assert sorted(m for m, _ in parts.values()) == sorted({r[3] for r in rows}) and sum(n for _, n in parts.values()) == len(rows)
    assert {(r.id, parts[r.rec][0], r.article) for r in placed.collect()} == {(r[0], r[3], r[7]) for r in rows}


def test_nulls_and_empty(spark):
    rows = [("a", None, None, None, "x", "x"), ("b", "", "", [], "x", "x"), ("c", "x " * 20_000, None, [("BRAND", None, None)], "x", "x"), (None, "t", "c", None, "x", "x")]
    groups = {r.id for r in pr.group_products(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert groups == {"a", "b", "c"}
    empty = pr.group_products(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and pr.pairs(empty).count() == 0


def test_soft_alignment():
    a = ("k1", "acme", "luna viva 12", "w400", "azul", 1, "parlante")
    alike = lambda **kw: pr.same_product(a, tuple(kw.get(n, v) for n, v in zip(("kind", "brand", "model", "size", "color", "pack", "article"), a)))
    assert alike() and alike(kind=None) and alike(model="luna vvia 12") is False and alike(model="lunna viva 12") is False
    assert alike(brand=None) and not alike(brand=None, kind=None) and not alike(pack=2) and not alike(model="luna viva 13") and not alike(size="w500")
    assert alike(kind="k2", article="parlante") and not alike(kind="k2", article="pava")


def test_neighbours_across_blocks(spark):
    rows = [("k", "b", f"m{i // 2:04d}", "s", "c", 1, 1, "art" if i % 2 else "arts", f"r{i}") for i in range(60)]
    rows = [(None if i % 2 else r[0], *r[1:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "kind string, brand string, model string, size string, color string, pack long, n long, article string, rec string")
    want = {(f"r{2 * i}", f"r{2 * i + 1}") for i in range(30)}
    for block in (4, 7, 1000):
        got = {tuple(sorted(p, key=lambda x: int(x[1:]))) for p in (tuple(r) for r in pr.neighbours(df, pr.PASSES[:1], 3, block).collect())}
        assert got == want
        assert {tuple(sorted(p, key=lambda x: int(x[1:]))) for p in (tuple(r) for r in pr.neighbours(df, pr.PASSES, 3, block).collect())} >= want


def test_pivot_clusters(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", "z")], "a string, b string")
    weights = spark.createDataFrame([("a", 1), ("b", 5), ("c", 2), ("d", 1), ("x", 1), ("y", 9)], "rec string, n long")
    roots = {r.rec: r.root for r in pr.pivot_clusters(edges, weights).collect()}
    assert roots == {"a": "b", "c": "b", "x": "y"}
    assert pr.pivot_clusters(edges.filter("false"), weights).count() == 0


def test_salted_pairs(spark):
    groups = spark.createDataFrame([(f"i{i:02d}", "p" if i < 20 else f"q{i}") for i in range(25)], "id string, product string")
    found = [tuple(r) for r in pr.pairs(groups, per_task=6).collect()]
    got = set(found)
    assert len(found) == len(got)
    assert got == set(combinations([f"i{i:02d}" for i in range(20)], 2))


def test_no_word_is_lost_as_the_table_grows(spark, monkeypatch):
    rows, truth = catalogue()
    parsed = pr.parse(spark.createDataFrame(rows, SCHEMA)).cache()
    read = lambda: sorted((tuple(r) for r in pr.resolve(parsed, *pr.learn(parsed)).collect()), key=repr)
    whole = read()
    for most in (1, 8, 40):
        monkeypatch.setattr(pr, "MAX_WORDS", most)  # as if there were so many more words
        assert read() == whole


@settings(max_examples=25, deadline=None)
@given(st.text("ab", min_size=38, max_size=43), st.integers(0, 42), st.sampled_from(["cut", "put", "swap", "set"]))
def test_spelling_keys_of_long_words(spark, w, i, how):
    i = min(i, len(w) - 2)
    v = {"cut": w[:i] + w[i + 1 :], "put": w[:i] + "c" + w[i:], "swap": w[:i] + w[i + 1] + w[i] + w[i + 2 :], "set": w[:i] + "c" + w[i + 1 :]}[how]
    keys = spark.createDataFrame([(w, v)], "w string, v string").select(pr._spelling_keys(pr.F.col("w"), 3), pr._spelling_keys(pr.F.col("v"), 4)).first()
    assert lp.damerau_at_most_one(v, w) and set(keys[0]) & set(keys[1])


def test_every_name_of_an_article_counts(spark):
    rest = "acme ab1000 400 W color negro"
    rows = [("i1", f"abanico {rest}", "QS1", []), ("i2", f"mesa {rest}", "QS1", []), ("i3", f"pesa {rest}", "QS1", []), ("i4", f"silla {rest}", "QS3", [])]
    for k, (name, category) in enumerate([("abanico", "QS1"), ("mesa", "QS1"), ("pesa", "QS2"), ("silla", "QS3")]):
        rows += [(f"x{k}{i:02d}", f"{name} zz{5000 + 100 * k + i} {300 + i} W color rojo", category, [("BRAND", "", "acme")]) for i in range(10)]
    groups = {r.id: r.product for r in pr.group_products(spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA)).collect()}
    assert groups["i1"] == groups["i2"] == groups["i3"] != groups["i4"]


def test_runs_longer_than_the_window(spark):
    brands = [f"{c}airrais" for c in "abcdefghijklmnopqrst"] + [None, "otramarca"]
    rows = [("k", b, "m1", "s", "c", 1, 1, "art", f"r{i:02d}") for i, b in enumerate(brands)]
    rows += [(f"k{i}", "b", "m2", "s", "c", 1, 1, f"mes{'abcdefghijklmnop'[i]}", f"s{i:02d}") for i in range(15)]
    df = spark.createDataFrame(rows, "kind string, brand string, model string, size string, color string, pack long, n long, article string, rec string")
    got = {tuple(sorted(r)) for r in pr.neighbours(df, pr.PASSES).collect()}
    alike = [f"r{i:02d}" for i in range(21)]
    assert got == {*combinations(alike, 2), ("r20", "r21"), *combinations([f"s{i:02d}" for i in range(15)], 2)}
