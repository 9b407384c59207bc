from hypothesis import given, settings
from hypothesis import strategies as st

from tamiz.llm import repetition as re_


def brute(words, run=5):
    seen, rep = {}, set()
    for i in range(len(words) - run + 1):
        k = tuple(words[i : i + run])
        if k in seen:
            rep |= set(range(i, i + run))
        seen.setdefault(k, i)
    return len(rep)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=40), st.integers(1, 6))
def test_against_brute_force(words, run):
    assert re_.count_repeated(words, run) == brute(words, run)


def test_shares(spark):
    once = "uno dos tres cuatro cinco"
    rows = [(1, f"{once}. {once.upper()}!", "x", 1), (2, None, "x", 1), (3, "", "x", 1), (4, "...", "x", 1), (5, "a a a a a a", "x", 1), (6, "w " * 200_000, "x", 1), (1, once, "x", 1), (None, once, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text string, n_words int")
    got = sorted(((r.doc_id, r.n_words, r.n_repeated, r.share) for r in re_.repeated_share(df).collect()), key=repr)
    assert got == sorted([(1, 10, 5, 0.5), (2, 0, 0, 0.0), (3, 0, 0, 0.0), (4, 0, 0, 0.0), (5, 6, 5, 5 / 6), (6, 200_000, 199_999, 199_999 / 200_000), (1, 5, 0, 0.0), (None, 5, 0, 0.0)], key=repr)
    assert re_.repeated_share(df.filter("false")).count() == 0


def test_line_filter(spark):
    boiler = "Envío GRATIS hoy"
    rows = [(i, f"{boiler}\nlinea propia numero {i}", 7) for i in range(5)] + [(10, f"{boiler}\r\n{boiler}", 7), (11, boiler, 8), (12, None, 7), (13, "", 7), (14, boiler, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, seller_id long")
    got = {r.doc_id: r for r in re_.line_filter(df, "seller_id", limit=3, keep_share=0.6).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 10, 11, 14}
    assert (got[0].n_lines, got[0].n_removed, got[0].rejected) == (2, 1, True) or got[0].kept_share < 0.6
    assert (got[10].n_removed, got[10].kept_share, got[10].rejected) == (2, 0.0, True)
    assert not got[11].rejected and not got[14].rejected
    assert re_.line_filter(df.filter("false"), "seller_id").count() == 0


def test_some_lines_are_removed_and_some_documents_rejected(spark, data):
    from tamiz.llm import queries

    got = queries.p9_method(spark, data.replace("sf0.001", "sf0.01")).collect()
    assert any(r.n_removed and not r.rejected for r in got) and any(r.rejected for r in got) and any(not r.n_removed for r in got)
