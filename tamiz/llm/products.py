"""Listings of one product, grouped (problem 6).

Method: multi-pass sorted neighbourhood and correlation clustering.

1. Every listing is read into kind of article, brand, model, size, colour and
   pack, with lexicons learned from all rows (see ``listing_parser``).
2. The first pass sorts all listings by a key of their normalised parts.  The
   window's first listing leads it; while the next ones align with it in every
   part the window moves on, and they are contracted into their leader, a
   *record* with a count.  So copies never meet each other in pairs, and a
   product with a third of all rows is led, not paired (:func:`leaders`).
3. The further passes sort the records by several keys.  Each key puts the parts
   in another order, one part last, so that records which agree in all others
   are neighbours however that part is spelled or missing.  Within a sliding
   window neighbours are compared by soft token alignment; where only their
   kinds differ, by all names that their listings give the article.
4. Correlation clustering by pivots joins the records; those with more listings
   are pivots first.

The window doesn't bound the listings of a product: it moves on with them.  Nor
does it bound the records that agree in all parts but the last of a pass: where
these are more than the window, all that are the same product meet by keys of
the last part (:func:`long_runs`).

Lexicons are a table of all words with at least ``LEAST`` rows.  Those with a
least share of all word occurrences, so that their number is bounded
(``MAX_WORDS``) whatever the data, are broadcast; the others are joined by
shuffle to the words that are, misspell or run together one of them.  Sorting is
global but in slices: rows are placed by range partition and compared in blocks
of ``BLOCK`` rows with an overlap.

Defined results: a listing without id is ignored; repeated rows count once; a
listing of which nothing but the pack is known is a group of its own; a part
that neither title nor attributes state agrees with anything, but two records
join only if at least four of five other parts are stated and agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tamiz.llm.listing_parser import MEND_RATIO, Lexicon, Speller, damerau_at_most_one, parts
from tamiz.operators.skew import join_lookup
from tamiz.session import materialize, spread

MAX_WORDS = 100_000
LEAST = 3
LONG = 40  # letters from which words are matched by their ends instead of by deletions
ROLES = ["brand", "first", "second"]
TOP_CATEGORIES = 6
WINDOW = 10
BLOCK = 5000
FIELDS = ["kind", "brand", "model", "size", "color", "pack"]
PASSES = [
    ["brand", "model", "size", "color", "pack", "kind"],
    ["model", "size", "color", "pack", "kind", "brand"],
    ["brand", "kind", "size", "color", "pack", "model"],
    ["brand", "model", "kind", "color", "pack", "size"],
    ["brand", "model", "kind", "size", "pack", "color"],
]

_PARTS = "id string, category string, brand_a string, code_a string, line_a array<string>, color_a string, pack_a long, size_a string, code_t string, color_t string, pack_t long, size_t string, lines_t array<array<string>>, words array<string>"
_RESOLVED = "id string, kind string, brand string, model string, size string, color string, pack long, article string"


def parse(listings: DataFrame) -> DataFrame:
    """What title and attributes of each listing say."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _PARTS.split(", ")][2:]
        for b in batches:
            rows = [parts(t, a) for t, a in zip(b["title"], b["attributes"])]
            out = pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype="object") for n in names})
            for n in ("pack_a", "pack_t"):
                out[n] = out[n].astype("Int64")
            out.insert(0, "id", b["id"].values)
            out.insert(1, "category", b["category"].values)
            yield out

    category = F.regexp_extract(F.col("category_id"), r"([0-9]+)\s*$", 1)
    rows = listings.filter(F.col("id").isNotNull()).select("id", F.when(category != "", category).alias("category"), "title", F.transform("attributes", lambda x: F.struct(x["id"].alias("id"), x["value_name"].alias("value_name"))).alias("attributes"))
    return spread(rows).mapInPandas(run, _PARTS)


def _least(total: int) -> int:
    """Rows from which a word is broadcast: so many that at most MAX_WORDS of ``total`` can have them."""
    return max(LEAST, math.ceil(total / MAX_WORDS))


def learn(parsed: DataFrame) -> tuple[Lexicon, DataFrame | None]:
    """Lexicons from counts over all listings: the frequent words, and by listing the rare ones it needs, see :func:`rare_words`."""
    said = {"brand": F.col("brand_a"), "first": F.col("line_a")[0], "second": F.col("line_a")[1], "category": F.col("category")}
    roles = parsed.select(F.explode(F.array(*(F.struct(F.lit(k).alias("role"), c.alias("w")) for k, c in said.items()))).alias("x")).select("x.*").filter(F.col("w").isNotNull())
    counts = materialize(roles.groupBy("role", "w").agg(F.count("*").alias("n")), "roles")
    sums = {r.role: r for r in counts.groupBy("role").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("n") >= LEAST, F.col("n"))).alias("kept")).collect()}  # four rows
    words = parsed.select("category", F.explode(F.array_distinct("words")).alias("w"))
    by = words.groupBy("w", "category").agg(F.count("*").alias("n"))
    by = materialize(by, "words")
    totals = by.groupBy("w").agg(F.sum("n").alias("rows"))
    total = totals.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    least = {k: _least(sums[k].total if k in sums else 0) for k in ROLES} | {"rows": _least(total)}
    foremost = W.partitionBy("w").orderBy(F.desc("n"), "category")
    top = by.filter(F.col("category").isNotNull()).join(totals.filter(F.col("rows") >= LEAST), "w").withColumn("r", F.row_number().over(foremost)).filter(F.col("r") <= TOP_CATEGORIES)
    counted = counts.filter(F.col("n") >= LEAST)
    priors = counted.filter("role = 'category'").select(F.col("w").alias("category"), F.col("n").alias("prior"))
    kinds = top.join(priors, "category", "left").groupBy("w").agg(F.max("rows").alias("rows"), F.collect_list(F.struct("category", "n", "prior")).alias("tops"))
    spelled = counted.filter("role != 'category'").groupBy("w").agg(*(F.max(F.when(F.col("role") == k, F.col("n"))).alias(k) for k in ROLES))
    table = materialize(spelled.join(kinds, "w", "full_outer").select("w", *ROLES, "rows", "tops"), "lexicon")
    frequent = {k: F.col(k) >= n for k, n in least.items()}
    lexicons: dict[str, dict[str, int]] = {k: {} for k in ROLES}
    bycategory: dict[str, tuple[int, dict[str, int]]] = {}
    prior: dict[str, int] = {}
    named = set()
    kept = [F.when(c, F.col(k)).alias(k) for k, c in frequent.items()]
    for r in table.filter(F.coalesce(*(F.when(c, True) for c in frequent.values()))).select("w", *kept, F.when(frequent["rows"], F.col("tops")).alias("tops"), F.coalesce(*ROLES).isNotNull().alias("named")).collect():  # at most MAX_WORDS a role
        for k in ROLES:
            if r[k] is not None:
                lexicons[k][r.w] = r[k]
        if r["rows"] is not None:
            bycategory[r.w] = (r["rows"], {t.category: t.n for t in r.tops})
            prior.update((t.category, t.prior) for t in r.tops if t.prior is not None)
            if r.named:
                named.add(r.w)
    listings = sums["category"].kept or 0 if "category" in sums else 0
    lexicon = Lexicon(lexicons["brand"], lexicons["first"], lexicons["second"], bycategory, prior, LEAST, total=listings, named=frozenset(named))
    rare = table.withColumn("most", F.greatest(*(F.when(~c, F.col(k)) for k, c in frequent.items()))).filter(F.col("most").isNotNull())
    return lexicon, None if rare.isEmpty() else rare_words(parsed, table, rare, lexicon.dominant)


def _spelling_keys(w: Column, least: int) -> Column:
    """Words within one typing error share a key, if they have ``least`` letters or more."""
    cut = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    ends = F.array(F.concat(F.lit("<"), F.substr(w, F.lit(1), F.lit(15))), F.concat(F.lit(">"), F.substr(w, F.length(w) - 14)))  # an error can't touch both
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(w), F.when((F.length(w) >= least) & (F.length(w) <= LONG), cut).otherwise(none), F.when(F.length(w) >= LONG - 1, ends).otherwise(none)))


def rare_words(parsed: DataFrame, table: DataFrame, rare: DataFrame, dominant: float, ratio: int = MEND_RATIO) -> DataFrame:
    """``id, hits, rare``: by listing, the words of ``rare`` that one of its words is, may be mended to, or holds in a half.

    Left out are words that :class:`Lexicon` wouldn't use: too few rows to mend
    a word to, or halves of a word that is known as it is.
    """
    tokens = parsed.select("id", F.explode(F.array_distinct(F.concat("words", F.flatten("lines_t")))).alias("v"))
    vocabulary = materialize(tokens.groupBy("v").agg(F.count("*").alias("n")), "vocabulary")
    v, w = F.col("v"), F.col("w")
    whole = F.coalesce(*ROLES).isNotNull() | F.coalesce(F.array_max(F.transform("tops", lambda t: t["n"])) >= dominant * F.col("rows"), F.lit(False))
    known = table.select(w.alias("v"), F.col("rows").alias("v_rows"), whole.alias("whole"))
    said = materialize(vocabulary.join(known, "v", "left").select("v", F.coalesce("v_rows", F.lit(1)).alias("v_rows"), F.coalesce("whole", F.lit(False)).alias("whole")), "said")
    longest, most = table.agg(F.max(F.length("w"))).first()[0], rare.agg(F.max("most")).first()[0]
    exact = vocabulary.select("v", v.alias("w")).join(rare.select("w"), "w").select("v", "w")
    ours = said.filter(F.col("v_rows") * ratio <= most).select("v", "v_rows", F.explode(_spelling_keys(v, 4)).alias("key"))
    theirs = rare.filter(F.col("most") >= ratio).select("w", "most", F.explode(_spelling_keys(w, 3)).alias("key"))
    near = ours.join(theirs, "key").filter((F.col("v_rows") * ratio <= F.col("most")) & (F.levenshtein(v, w, 2) >= 0)).select("v", "w")
    cuts = F.sequence(F.lit(3), F.length(v) - 3)
    halves = said.filter(~F.col("whole") & (F.length(v) >= 6) & (F.length(v) <= 2 * longest)).select("v", F.explode(F.transform(cuts, lambda i: F.struct(F.substr(v, F.lit(1), i).alias("l"), F.substr(v, i + 1).alias("r")))).alias("x")).select("v", "x.*")
    kinds = table.filter(F.col("rows").isNotNull())
    halves = halves.join(kinds.select(w.alias("l")), "l").join(kinds.select(w.alias("r")), "r").select("v", F.explode(F.array("l", "r")).alias("w")).join(rare.select("w"), "w").select("v", "w")
    related = near.unionByName(exact).unionByName(halves).distinct()
    entries = related.join(rare.select("w", F.struct("w", *ROLES, "rows", "tops").alias("entry")), "w").groupBy("v").agg(F.collect_list("entry").alias("entries"))
    lookup = materialize(entries.join(vocabulary, "v"), "rare")
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hits = join_lookup(tokens, lookup, ["v"], "n", total).select("id", F.explode("entries").alias("entry"))
    return materialize(hits.groupBy("id").agg(F.count("*").alias("hits"), F.collect_set("entry").alias("rare")), "needed")


def resolve(parsed: DataFrame, lexicon: Lexicon, rare: DataFrame | None = None) -> DataFrame:
    if rare is not None:
        total = rare.agg(F.coalesce(F.sum("hits"), F.lit(0))).first()[0]
        parsed = join_lookup(parsed, rare, ["id"], "hits", total, "left").drop("hits")
    sent = parsed.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = sent.value
        names = [c.split()[0] for c in _RESOLVED.split(", ")][1:]
        for b in batches:
            rows = []
            said = [c for c in b.columns if c != "id"]
            for values in zip(*(b[c].tolist() for c in said)):
                p = dict(zip(said, values))
                more = p.pop("rare", None)
                for c in ("words", "lines_t", "line_a"):
                    p[c] = [] if p[c] is None else list(p[c])
                for c in ("pack_a", "pack_t"):  # null numbers come as not-a-number
                    p[c] = p[c] if p[c] == p[c] else None
                rows.append((lex if more is None else lex.with_words(more)).resolve(p))
            out = pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype="object") for n in names})
            out["pack"] = out["pack"].astype("int64")
            out.insert(0, "id", b["id"].values)
            yield out

    return parsed.drop("category").mapInPandas(run, _RESOLVED)


# the first pass -----------------------------------------------------------


def token_key(order: list[str]) -> Column:
    """The normalised parts in an order, as one text to sort by."""
    return F.concat_ws("\x01", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order))


def leaders(rows: DataFrame, spread_ties: bool) -> DataFrame:
    """``rows`` of ``key, rec, ...`` with ``leader`` in place of the key: in order of their keys, the first ``rec`` of the window with which a row aligns in every part.

    With ``spread_ties`` a task takes any stretch of the order, however many
    rows share a key; a run cut between tasks has a leader in each.  Without, a
    run is in one task.
    """
    kept = [f for f in rows.schema if f.name != "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, leader = None, None
        for b in batches:
            if not b.num_rows:
                continue
            key, rec = b.column("key"), b.column("rec")
            goes_on = np.r_[key[0].as_py() == last, pc.equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)].astype(bool)
            first = np.maximum.accumulate(np.where(goes_on, -1, np.arange(len(goes_on))))
            found = pa.concat_arrays([pa.array([leader], rec.type), rec]).take(pa.array(first + 1))  # at 0 stands the leader of a run begun before
            last, leader = key[-1].as_py(), found[-1].as_py()
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), found], names=[*(f.name for f in kept), "leader"])

    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ties = ["rec"] if spread_ties else []
    return rows.repartitionByRange(n, "key", *ties).sortWithinPartitions("key", "rec").mapInArrow(run, T.StructType([*kept, T.StructField("leader", T.StringType())]))


def contract(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, rec, article`` of all listings, and their records ``rec, n`` and parts.

    Runs are led twice: by stretches of any size, and then, of the leaders that
    a run has in several tasks, by whole runs, of which none is longer than
    there were tasks.
    """
    rows = resolved.select("*", token_key(PASSES[0]).alias("key"))
    rows = rows.withColumn("rec", F.concat_ws(":", "id", F.hex(F.xxhash64("key"))))  # an id may come with several readings
    one = materialize(leaders(rows, True), "led")
    sizes = one.groupBy("leader").agg(F.count("*").alias("n"))
    heads = one.filter(F.col("rec") == F.col("leader")).select("rec", *FIELDS).dropDuplicates(["rec"]).join(sizes.withColumnRenamed("leader", "rec"), "rec")
    two = materialize(leaders(materialize(heads.select(token_key(PASSES[0]).alias("key"), "*"), "heads"), False), "leaders")
    recs = two.groupBy(F.col("leader").alias("rec"), *FIELDS).agg(F.sum("n").alias("n"))
    lookup = two.select(F.col("rec").alias("leader"), F.col("leader").alias("top"), "n")
    placed = join_lookup(one.select("id", "article", "leader"), lookup, ["leader"], "n", resolved.count())
    return materialize(placed.select("id", F.col("top").alias("rec"), "article"), "placed"), materialize(recs, "records")


def article_names(placed: DataFrame) -> DataFrame:
    """``rec, article``: every name that the listings of a record give the article."""
    return placed.filter(F.col("article") != "").select("rec", "article").distinct()


# comparison -------------------------------------------------------------


def _soft(a: str, b: str) -> bool:
    """Tokens of two names align one by one, numbers exactly, words within one typing error."""
    if a == b:
        return True
    x, y = a.split(), b.split()
    return len(x) == len(y) and all(u == v or (len(u) > 4 and u.isalpha() and v.isalpha() and damerau_at_most_one(u, v)) for u, v in zip(x, y))


def _same_letters(a: str, b: str, errors: int = 1) -> bool:
    """Two names of an article are one but for misplaced blanks and ``errors`` typing errors."""
    return bool(a) and bool(b) and (damerau_at_most_one(a, b) if errors == 1 else a == b)


def _aligned(a: tuple, b: tuple) -> bool | None:
    """Soft alignment of two records ``(kind, brand, model, size, color, pack)``; null if only their kinds differ and the names of the article decide."""
    if a[5] != b[5]:
        return False
    stated = 0
    for i in (3, 4):  # size and colour are values: alike or not
        if a[i] is not None and b[i] is not None:
            if a[i] != b[i]:
                return False
            stated += 1
    for i in (1, 2):
        if a[i] is not None and b[i] is not None:
            if not _soft(a[i], b[i]):
                return False
            stated += 1
    if a[0] is None or b[0] is None:
        return stated >= 4
    if stated < 3:
        return False
    return True if a[0] == b[0] else None


def same_product(a: tuple, b: tuple) -> bool:
    """Soft alignment of two records ``(kind, brand, model, size, color, pack, article)``, each with one name of its article."""
    alike = _aligned(a, b)
    return _same_letters(a[6], b[6]) if alike is None else alike


@F.pandas_udf(T.BooleanType())
def _letters_alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_same_letters(x, y) for x, y in zip(a, b)], dtype="bool")


def same_names(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """The ``a, b`` of which any names of their articles are one; joined, so that no record gathers its names."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("rec")).distinct()
    keyed = names.join(asked, "rec", "left_semi").select("rec", "article", F.explode(_spelling_keys(F.col("article"), 1)).alias("key"))
    left, right = (keyed.select(F.col("rec").alias(c), F.col("article").alias(f"name_{c}"), "key") for c in "ab")
    return pairs.join(left, "a").join(right, ["b", "key"]).filter(_letters_alike("name_a", "name_b")).select("a", "b").distinct()


# sorted neighbourhood ---------------------------------------------------


def _placed(recs: DataFrame, passes: list[list[str]]) -> DataFrame:
    """Every record once a pass, with its position in the order by pass and key: one global sort for all passes."""
    n = max(1, int(recs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.struct(F.lit(i).alias("pass"), F.concat_ws("\x01", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order)).alias("key")) for i, order in enumerate(passes)]
    order = ["pass", "key", "rec"]
    rows = recs.select("rec", *FIELDS, F.explode(F.array(*keys)).alias("k")).select("k.pass", "k.key", "rec", *FIELDS)
    sorted_ = materialize(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("key").withColumn("_m", F.monotonically_increasing_id()), "sorted")
    sorted_ = sorted_.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = sorted_.groupBy("_p").agg(F.count("*").alias("_c"))  # one row a partition
    starts = sizes.withColumn("_start", F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")).select("_p", "_start")
    return sorted_.join(F.broadcast(starts), "_p").withColumn("pos", F.col("_start") + F.col("_i")).drop("_m", "_p", "_i", "_start")


def neighbours(recs: DataFrame, passes: list[list[str]], window: int = WINDOW, block: int = BLOCK, names: DataFrame | None = None) -> DataFrame:
    """``a, b``: records within the window of a pass that are the same product; ``names`` are those of :func:`article_names`."""
    placed = _placed(recs, passes)
    own = F.floor(F.col("pos") / block).cast("long")
    blocks = F.when((F.pmod("pos", F.lit(block)) < window - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        upto = int((pdf["_block"] == pdf["_own"]).sum())  # the rows after that belong to the next block
        pdf = pdf.astype(object).where(pdf.notna(), None)
        rows = list(zip(*(pdf[c] for c in FIELDS)))
        recs_, turns, out = list(pdf["rec"]), list(pdf["pass"]), []
        for i in range(upto):
            a = rows[i]
            for j in range(i + 1, min(i + window, len(rows))):
                if turns[j] != turns[i]:
                    break
                if a[5] == rows[j][5] and (alike := _aligned(a, rows[j])) is not False:
                    out.append((recs_[i], recs_[j], alike is True))
        return pd.DataFrame(out, columns=["a", "b", "sure"])

    compared = placed.withColumn("_own", own).withColumn("_block", F.explode(blocks)).groupBy("_block").applyInPandas(compare, "a string, b string, sure boolean")
    compared = materialize(compared, "compared")
    sure, asked = compared.filter("sure").select("a", "b"), compared.filter("NOT sure").select("a", "b").distinct()
    names = recs.select("rec", "article") if names is None else names
    return sure.unionByName(same_names(asked, names)).unionByName(long_runs(recs, passes, window, names))


# runs longer than the window --------------------------------------------


def _last_keys(value: str) -> set[str]:
    """Names that :func:`_soft` aligns share a key: their tokens, of the first two words without a letter."""
    keys, free = [""], 2
    for t in value.split():
        if len(t) < 4 or not t.isalpha():
            forms = {t}
        elif not free:
            forms = {"*"}
        else:
            forms, free = Speller._deletions(t) if len(t) <= LONG else {"<" + t[:15], ">" + t[-15:]}, free - 1
            if len(t) in (LONG - 1, LONG):
                forms = forms | {"<" + t[:15], ">" + t[-15:]}
        keys = [f"{k} {f}" for k in keys for f in forms]
    return set(keys)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _keys_of_last(values: pd.Series) -> pd.Series:
    return values.map(lambda v: list(_last_keys(v)))


@F.pandas_udf(T.BooleanType())
def _softly_alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_soft(x, y) for x, y in zip(a, b)], dtype="bool")


def long_runs(recs: DataFrame, passes: list[list[str]], window: int, names: DataFrame) -> DataFrame:
    """``a, b`` of the runs that agree in all parts but the last of a pass and are longer than the window: all pairs that are the same product, by keys of the last part."""

    def place(i: int, order: list[str]) -> Column:
        key = F.concat_ws("\x01", F.lit(str(i)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order[:-1]))
        stated = sum((F.col(c).isNotNull().cast("int") for c in order[:-1] if c != "pack"), F.lit(0))
        return F.struct(key.alias("run"), F.lit(order[-1]).alias("role"), F.col(order[-1]).cast("string").alias("last"), stated.alias("stated"))

    rows = recs.select("rec", F.explode(F.array(*(place(i, o) for i, o in enumerate(passes)))).alias("x")).select("rec", "x.*").filter("stated >= 3")
    runs = rows.groupBy("run").agg(F.count("*").alias("n")).filter(F.col("n") > window)
    members = materialize(rows.join(runs.select("run"), "run", "left_semi"), "runs")
    there = members.filter(F.col("last").isNotNull())
    absent = members.filter(F.col("last").isNull() & (F.col("stated") >= 4)).select("run", F.col("rec").alias("a")).join(there.select("run", F.col("rec").alias("b")), "run").select("a", "b")
    spelled = there.filter(F.col("role").isin("brand", "model")).select("run", "rec", "last", F.explode(_keys_of_last("last")).alias("key"))
    named = there.filter("role = 'kind'").select("run", "rec").join(names, "rec").select("run", "rec", F.col("article").alias("last"), F.explode(_spelling_keys(F.col("article"), 1)).alias("key"))

    def alike(keyed: DataFrame, ordered: Column, test) -> DataFrame:
        one, two = (keyed.select("run", "key", F.col("rec").alias(c), F.col("last").alias(f"last_{c}")) for c in "ab")
        met = one.join(two, ["run", "key"]).filter(ordered).select("a", "b", "last_a", "last_b").distinct()
        return met.filter(test("last_a", "last_b")).select("a", "b").distinct()

    return absent.unionByName(alike(spelled, F.expr("last_a < last_b"), _softly_alike)).unionByName(alike(named, F.expr("a < b"), _letters_alike))


# correlation clustering -------------------------------------------------


def pivot_clusters(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """``rec, root`` for the ends of ``edges`` (``a, b``): heavier records are pivots first, neighbours join the first pivot they touch."""
    w = weights.select(F.col("rec"), F.struct((-F.col("n")).alias("n"), F.xxhash64("rec").alias("h"), F.col("rec").alias("rec")).alias("r"))
    both = edges.filter(F.col("a") != F.col("b")).select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.filter(F.col("a") != F.col("b")).select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct()
    open_ = both.join(w.select(F.col("rec").alias("u"), F.col("r").alias("ru")), "u").join(w.select(F.col("rec").alias("v"), F.col("r").alias("rv")), "v")
    open_ = materialize(open_, "edges")
    done: DataFrame | None = None
    while not open_.isEmpty():
        first = open_.groupBy("u").agg(F.min("rv").alias("least"), F.first("ru").alias("ru"))
        pivots = materialize(first.filter(F.col("ru") < F.col("least")).select(F.col("u").alias("p")), "pivots")
        joined = open_.join(pivots, open_.v == pivots.p).groupBy("u").agg(F.min(F.struct("rv", "v")).alias("x")).select(F.col("u").alias("rec"), F.col("x.v").alias("root"))
        step = materialize(joined.unionByName(pivots.select(F.col("p").alias("rec"), F.col("p").alias("root"))), "assigned")
        done = step if done is None else done.unionByName(step)
        rest = open_.join(step.select(F.col("rec").alias("u")), "u", "left_anti").join(step.select(F.col("rec").alias("v")), "v", "left_anti")
        open_ = materialize(rest, "edges")
    if done is None:
        return edges.sparkSession.createDataFrame([], T.StructType([T.StructField("rec", T.StringType()), T.StructField("root", T.StringType())]))
    return done.filter(F.col("rec") != F.col("root"))


# groups and pairs -------------------------------------------------------


def group_products(listings: DataFrame, window: int = WINDOW) -> DataFrame:
    """``id, product``: every listing with the product it offers."""
    parsed = materialize(parse(listings), "parsed")
    placed, recs = contract(materialize(resolve(parsed, *learn(parsed)), "resolved"))
    merged = pivot_clusters(materialize(neighbours(recs, PASSES, window, names=article_names(placed)), "pairs"), recs)
    total = recs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lookup = merged.join(recs.select("rec", "n"), "rec")
    grouped = join_lookup(placed.select("id", "rec"), lookup, ["rec"], "n", total, "left")
    return grouped.select("id", F.coalesce("root", "rec").alias("product")).distinct()


def pairs(groups: DataFrame, per_task: int = 1000) -> DataFrame:
    """``id_a, id_b``: the pairs of listings of each product.

    The result is quadratic in a product's listings by definition.  A product
    of n listings is cut into n / ``per_task`` parts, and every two parts, or a
    part with itself, meet in a task of their own.
    """
    groups = materialize(groups.select("id", F.unhex(F.md5("product")).alias("product")), "groups")
    sizes = groups.groupBy("product").agg(F.count("*").alias("n")).filter(F.col("n") > 1).withColumn("parts", F.ceil(F.col("n") / per_task).cast("int"))
    members = join_lookup(groups, sizes, ["product"], "n", groups.count())
    members = materialize(members.select("id", "product", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")), "members")
    left = members.select(F.col("id").alias("a"), "product", F.col("part").alias("one"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("two"))
    right = members.select(F.col("id").alias("b"), "product", F.col("part").alias("two"), F.explode(F.sequence(F.lit(0), F.col("part"))).alias("one"))
    met = left.join(right, ["product", "one", "two"]).filter((F.col("one") < F.col("two")) | (F.col("a") < F.col("b")))
    return met.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
