"""Ranked retrieval over an index (OP-50 to 69, 79 to 92).

A query's terms are expanded on the vocabulary, which is small, and only then
joined to the postings; of one query, up to ``PUSHED_TERMS`` expanded terms go
to the scan as a predicate, which skips all other parts of a table sorted by
term.  Documents are scored by term on one shuffle by document, and queries join
the scored terms.  Many queries run over packed blocks of documents; a term that
many of them hold is expanded once.

Retrieval is exact: no cut of candidates before the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tamiz.functions.analysis import term_array
from tamiz.functions.stemmers import stem_column
from tamiz.operators.filters import apply_filters, facets, ordered_facets
from tamiz.operators.index import Index
from tamiz.operators.packed import RESULT, Scoring, best, chunks, pack
from tamiz.plans.request import SearchRequest, SearchResult, Understanding
from tamiz.session import materialize

K1, B = 1.2, 0.75
PUSHED_TERMS = 1000
LONG_TERM = 20
TITLE_BOOST = 1.5
TOKENS = T.StructType([T.StructField("qid", T.LongType()), T.StructField("qpos", T.IntegerType()), T.StructField("q", T.StringType())])


def idf(n_docs: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log(1 + (n_docs - df + 0.5) / (df + 0.5)))


def term_score(tf: Column, dl: Column, avgdl: Column, weight: Column) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.greatest(avgdl, F.lit(1.0))))


def query_tokens(queries: DataFrame, index: Index) -> DataFrame:
    """``qid, qpos, q`` of a table ``qid, query``, analyzed as the first text field is."""
    analyzer = index.schema.query_analyzer
    flat = queries.select("qid", F.posexplode_outer(term_array(F.col("query"), analyzer)).alias("qpos", "q")).filter(F.col("q").isNotNull())
    return flat.withColumn("q", stem_column(analyzer.language.value)("q")) if analyzer.language and analyzer.kind != "keyword" else flat


def expand(vocabulary: DataFrame, terms: DataFrame, typo_tolerance: bool = True) -> DataFrame:
    """``q, term, e, p, f, df``: how each vocabulary term serves each distinct query term.

    ``e``: it retrieves (prefix; if the query term is no prefix of any term and
    longer than 4 bytes, within 1 or 2 edits); ``p``: it counts as an
    occurrence (prefix); ``f``: it counts where no prefix term does (within 1
    or 2 edits, from 3 bytes).  ``df``: documents of the exact term, else 1.
    Both meet by equi-joins, on beginnings and on spellings (:func:`_near_keys`).
    """
    q = terms.select("q").distinct()
    lengths = q.agg(F.collect_set(F.length("q")).alias("_lengths"))  # one row: the lengths that occur among the query's terms
    begins = F.transform(F.filter("_lengths", lambda n: n <= F.length("term")), lambda n: _start_key(F.substr("term", F.lit(1), n)))
    wide, own = vocabulary.crossJoin(F.broadcast(lengths)), F.array(_start_key(F.col("q")))
    near = F.octet_length("q") >= 3 if typo_tolerance else F.lit(False)
    # both kinds of keys meet in one join: a union of two joins may zip unequal numbers of partitions; not by broadcast, which goes by the size before the keys
    held = wide.select("term", "df", F.explode(F.concat(begins, _near_keys(F.col("term"))) if typo_tolerance else begins).alias("key"))
    asked = q.select("q", F.explode(F.when(near, F.concat(own, _asked_keys(F.col("q"), _count_edits()))).otherwise(own) if typo_tolerance else own).alias("key"))
    pairs = held.join(asked.hint("merge"), "key").select("q", "term", "df").distinct()
    met = pairs.select("q", "term", F.col("term").startswith(F.col("q")).alias("p"), F.when(near, F.levenshtein("q", "term", 2)).alias("dist"))
    met = met.withColumn("f", F.coalesce((F.col("dist") >= 0) & (F.col("dist") <= _count_edits()), F.lit(False))).filter(F.col("p") | F.col("f"))
    known = met.groupBy("q").agg(F.max("p").alias("has"))
    exact = vocabulary.join(q.withColumnRenamed("q", "term"), "term", "left_semi").select(F.col("term").alias("q"), "df")
    joined = met.join(known, "q").join(exact, "q", "left")
    retrieves = F.col("p") | (~F.col("has") & (F.octet_length("q") > 4) & F.coalesce(F.col("f") & (F.col("dist") <= F.when(F.octet_length("q") <= 6, 1).otherwise(2)), F.lit(False)))
    return joined.select("q", "term", retrieves.alias("e"), "p", "f", F.coalesce("df", F.lit(1)).alias("df"))


def _start_key(start: Column) -> Column:
    return F.xxhash64(F.lit("start"), start)


def _without(w: Column, most: Column) -> Column:
    """A word and what is left of it without one letter and, where ``most`` is 2, without two."""
    n = F.length(w)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    one = F.transform(places, lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    after = lambda i: F.when(i < n, F.sequence(i + 1, n)).otherwise(F.array().cast("array<int>"))
    two = F.flatten(F.transform(places, lambda i: F.transform(after(i), lambda j: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, j - i - 1), F.substr(w, j + 1)))))
    return F.concat(F.array(w), one, F.when(most >= 2, two).otherwise(F.array().cast("array<string>")))


def _thirds(n: Column) -> list[tuple[Column, Column]]:
    """Start and length of three parts of a word of ``n`` letters: two edits leave one of them whole."""
    a, b = F.floor(n / 3).cast("int"), F.floor(n * 2 / 3).cast("int")
    return [(F.lit(1), a), (a + 1, b - a), (b + 1, n - b)]


def _hashed(keys: Column) -> Column:
    return F.array_distinct(F.transform(keys, lambda k: F.xxhash64(k)))


def _near_keys(term: Column) -> Column:
    """Keys of a vocabulary term: what is left of it without up to two letters; of one longer than ``LONG_TERM``, its thirds with its length."""
    n = F.length(term)
    parts = F.array(*(F.concat_ws("|", n.cast("string"), F.lit(str(i)), F.substr(term, at, size)) for i, (at, size) in enumerate(_thirds(n))))
    return _hashed(F.when(n <= LONG_TERM, _without(term, F.lit(2))).otherwise(parts))


def _asked_keys(q: Column, edits: Column) -> Column:
    """Keys of a query term: each vocabulary term within ``edits`` (1 or 2) has one of them."""
    n = F.length(q)
    sizes = F.filter(F.sequence(n - 2, n + 2), lambda m: m > LONG_TERM)

    def moved(m: Column) -> Column:
        """The thirds of a term of ``m`` letters, wherever two edits may have moved them."""
        tries = [F.concat_ws("|", m.cast("string"), F.lit(str(i)), F.substr(q, at + by, size)) for i, (at, size) in enumerate(_thirds(m)) for by in range(-2, 3) if i or by >= 0]
        return F.array(*tries)

    none = F.array().cast("array<string>")
    short = F.when(n <= LONG_TERM + 2, _without(q, edits)).otherwise(none)
    return _hashed(F.concat(short, F.flatten(F.transform(sizes, moved))))


def _count_edits() -> Column:
    return F.when(F.octet_length("q") <= 4, 1).otherwise(2)


def expand_request(vocabulary: DataFrame, tokens: tuple[str, ...], typo_tolerance: bool, limit: int = PUSHED_TERMS) -> dict[str, list[tuple]] | None:
    """The same for one request in one pass over the vocabulary: query term to ``(term, e, p, f, df)``; None if more than ``limit`` come out."""
    tries = []
    for q in dict.fromkeys(tokens):
        edits = 0 if not typo_tolerance or len(q.encode()) < 3 else 1 if len(q.encode()) <= 4 else 2
        dist = F.when(F.abs(F.length("term") - len(q)) <= edits, F.levenshtein(F.lit(q), "term", edits)).otherwise(-1) if edits else F.lit(-1)
        tries.append(F.struct(F.lit(q).alias("q"), F.col("term").startswith(q).alias("p"), dist.alias("dist")))
    flat = vocabulary.select("term", "df", F.explode_outer(F.filter(F.array(*tries), lambda x: x["p"] | (x["dist"] >= 0))).alias("x")).filter(F.col("x").isNotNull())
    found = flat.select("term", "df", "x.*").limit(limit + 1).collect()
    if len(found) > limit:
        return None
    out: dict[str, list[tuple]] = {q: [] for q in tokens}
    prefixes = {r.q for r in found if r.p}
    exact = {r.q: r.df for r in found if r.term == r.q}
    for r in found:
        size = len(r.q.encode())
        retrieves = r.p or (r.q not in prefixes and size > 4 and 0 <= r.dist <= (1 if size <= 6 else 2))
        out[r.q].append((r.term, retrieves, r.p, r.dist >= 0, exact.get(r.q, 1)))
    return out


MATCHES = T.StructType([T.StructField("q", T.StringType()), T.StructField("term", T.StringType()), *(T.StructField(c, T.BooleanType()) for c in "epf"), T.StructField("df", T.LongType())])


def score(index: Index, terms: DataFrame, matches: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """``qid, id, n_tokens, n_matched, and_score, or_score`` of every document that a term retrieves.

    ``terms`` are the positions of all queries (``TOKENS``), ``matches`` what
    :func:`expand` says of their distinct terms.  A term's documents are scored
    once, however many queries ask for it; all groupings are on one shuffle by
    document, and queries join the scored terms.
    """
    postings = index.postings if postings is None else postings
    boosts = {f.name: f.boost for f in index.schema.text_fields}
    stats = index.stats
    pick = lambda values, default: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, v in values.items() for x in (k, float(v)))), F.col("field")), F.lit(default))
    n_docs = float(max((n for n, _ in stats.values()), default=0))
    hits = postings.join(matches, "term").repartition("id")
    per_field = hits.groupBy("q", "id", "field").agg(
        F.max("e").alias("e"),
        F.sum(F.when(F.col("p"), F.col("tf"))).alias("ptf"),
        F.sum(F.when(F.col("f"), F.col("tf"))).alias("ftf"),
        F.max(F.col("p") & F.col("head") & (F.col("field") == "title")).alias("head"),
        F.first("dl").alias("dl"),
        F.first("df").alias("df"),
    )
    weight = idf(F.lit(n_docs), F.col("df"))
    avgdl = pick({k: a for k, (_, a) in stats.items()}, 1.0)
    value = lambda tf: pick(boosts, 1.0) * term_score(tf, F.col("dl"), avgdl, weight)
    scored = per_field.select("q", "id", "e", "head", value(F.coalesce("ptf", "ftf")).alias("and_part"), value(F.col("ptf")).alias("or_part"))
    per_term = scored.groupBy("q", "id").agg(F.max("e").alias("e"), F.max("head").alias("head"), F.sum("and_part").alias("and_part"), F.sum("or_part").alias("or_part"))
    counts = terms.groupBy("qid").agg(F.count("*").cast("int").alias("n_tokens"))
    asked = terms.groupBy("qid", "q").agg(F.count("*").cast("int").alias("times")).join(counts, "qid")
    per_doc = per_term.join(asked, "q").groupBy("qid", "id").agg(
        F.first("n_tokens").alias("n_tokens"),
        F.sum(F.when(F.col("e"), F.col("times"))).cast("int").alias("n_matched"),
        F.sum(F.when(F.col("head"), F.col("times"))).cast("int").alias("n_head"),
        F.coalesce(F.sum(F.col("and_part") * F.col("times")), F.lit(0.0)).alias("plain"),
        F.coalesce(F.sum(F.col("or_part") * F.col("times")), F.lit(0.0)).alias("loose"),
    )
    boosted = F.when(F.col("n_head") == F.col("n_tokens"), F.col("plain") * TITLE_BOOST).otherwise(F.col("plain"))
    return per_doc.filter(F.col("n_matched") > 0).select("qid", "id", "n_tokens", "n_matched", F.when(F.col("n_matched") == F.col("n_tokens"), boosted).otherwise(0.0).alias("and_score"), (F.col("loose") * F.col("n_matched")).alias("or_score"))


def even_score() -> Column:
    """The score without the noise of the order in which its parts were added, so that equal scores are ties."""
    return F.round("score", 9)


def search_many(index: Index, queries: DataFrame, k: int = 20, typo_tolerance: bool = True) -> DataFrame:
    """``qid, id, score, mode, rank``: the best documents of each row of ``qid, query``.

    Blocks of documents meet chunks of queries (:mod:`tamiz.operators.packed`);
    of each pair the ``k`` best of a query leave it.  Made of the index's
    documents alone, so an index that serves nothing else needs no tables.
    """
    fields = index.schema.text_fields
    if not fields or k < 1:
        return queries.sparkSession.createDataFrame([], f"{RESULT}, rank int")
    terms = query_tokens(queries, index)
    packed = pack(index.documents, index.schema)
    words = materialize(terms.select("q").distinct(), "words")
    matches = materialize(expand(packed.vocabulary, words, typo_tolerance), "matches")
    how = Scoring(packed.n_docs, tuple(f.boost for f in fields), packed.lengths, K1, B, TITLE_BOOST, k)
    found = best(packed, chunks(terms, matches, queries.count()), how)
    # a query whose terms some document holds all of takes those of all blocks, and no others
    ranked = found.withColumn("_mode", F.min("mode").over(W.partitionBy("qid"))).filter(F.col("mode") == F.col("_mode"))
    return ranked.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc(even_score()), F.asc("id")))).filter(F.col("rank") <= k).drop("_mode")


def match(index: Index, request: SearchRequest, strict: bool = False) -> tuple[DataFrame, str]:
    """All matches ``id, score`` of one request, and the retrieval mode.

    The scores of a query of several terms are kept until :func:`release`,
    since hits, facets and total are read from them.
    """
    spark = index.documents.sparkSession
    allowed = apply_filters(index.columns, index.schema, request.filters, strict).select("id") if request.filters else None
    if request.query == "":
        ids = index.documents.select("id") if allowed is None else allowed
        return ids.select("id", F.lit(1.0).alias("score")), "and"
    parsed = Understanding.default(index.schema, request.language).run(request.query)
    tokens, postings = parsed.tokens, index.postings
    found = expand_request(index.vocabulary, tokens, request.typo_tolerance) if tokens else {}
    terms = F.broadcast(spark.createDataFrame([(0, i, t) for i, t in enumerate(tokens)], TOKENS))  # a query of bounded length
    if found is None:
        matches = expand(index.vocabulary, terms, request.typo_tolerance)
    else:
        matches = F.broadcast(spark.createDataFrame([(q, *m) for q, ms in found.items() for m in ms], MATCHES))  # at most PUSHED_TERMS rows
        postings = postings.filter(F.col("term").isin(sorted({m[0] for ms in found.values() for m in ms})))
    if allowed is not None:
        postings = postings.join(allowed, "id", "left_semi")
    scored = score(index, terms, matches, postings)
    if len(tokens) > 1:
        impossible = found is not None and not all(any(m[1] for m in found[q]) for q in tokens)
        if not impossible:
            scored = scored.persist()
        if impossible or scored.filter(F.col("and_score") > 0).isEmpty():
            return _matched(scored, F.col("or_score") if request.weigh_or else F.col("or_score") / F.col("n_matched"), request), "or_fallback"
    return _matched(scored, F.col("and_score"), request), "and"


def _matched(scored: DataFrame, value: Column, request: SearchRequest) -> DataFrame:
    out = scored.select("id", value.alias("score")).filter(F.col("score") > 0)
    if request.max_candidates is not None:
        out = out.orderBy(F.desc(even_score()), "id").limit(request.max_candidates)
    out._tamiz_held = scored  # see release()
    return out


def release(matched: DataFrame) -> None:
    """Free the scores that hits, facets and total of one request share."""
    held = getattr(matched, "_tamiz_held", None)
    if held is not None and held.is_cached:
        held.unpersist()


def sort_column(documents: DataFrame, field: str) -> Column:
    """Price or a number attribute; anything else is missing (OP-89)."""
    if field == "price":
        return documents["price"]
    return F.try_element_at(documents["attributes"], F.lit(field))["n"]


def order_hits(index: Index, matched: DataFrame, request: SearchRequest) -> DataFrame:
    """In the requested order, else by score; ties by id.  A missing sort value comes first ascending, last descending."""
    if request.sort is None:
        return matched.orderBy(F.desc(even_score()), "id")
    values = index.documents.select("id", sort_column(index.documents, request.sort.field).alias("sort_value"))
    with_value = matched.join(values, "id", "left")
    order = F.asc_nulls_first("sort_value") if request.sort.ascending else F.desc_nulls_last("sort_value")
    return with_value.orderBy(order, "id")


def hydrate(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Whole documents beside the hits; a hit without document stays (OP-79)."""
    return hits.join(documents, "id", "left")


def search(index: Index, request: SearchRequest, strict: bool = False) -> SearchResult:
    request = request.validated()
    matched, mode = match(index, request, strict)
    page = order_hits(index, matched, request).offset(request.offset).limit(request.limit)
    if request.include_docs:
        page = hydrate(page, index.documents)
    return SearchResult(page, ordered_facets(facets(matched, index.columns, index.schema, request.aggregations)), matched.agg(F.count("*").alias("total_hits")), mode, release=lambda: release(matched))


def get_documents(documents: DataFrame, ids: list[int] | DataFrame) -> DataFrame:
    """Multi-get by id (OP-08 to 10); unknown ids are left out."""
    if isinstance(ids, DataFrame):
        return documents.join(ids.select("id").distinct(), "id", "left_semi")
    return documents.filter(F.col("id").isin(list(ids))) if ids else documents.filter(F.lit(False))
