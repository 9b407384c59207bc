"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions.text import trim_to_word, words
from tamiz.llm import canonical, frequency, leaks, mixing, products, repetition
from tamiz.session import materialize, scratch_path
from tamiz.sources.tables import table

# p1 ---------------------------------------------------------------------


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "suggest_terms").select(F.lit("suggest_term").alias("field"), trim_to_word(F.col("term")).alias("term"), F.col("doc_id").alias("rid"))
    titles = table(spark, d, "catalog_docs").select(F.lit("title").alias("field"), F.explode_outer(words(F.col("title"))).alias("term"), F.col("id").alias("rid")).filter(F.col("term").isNotNull())
    return terms.filter(F.col("term") != "").unionByName(titles)


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    return frequency.mark(materialize(frequency.statistics(frequency.build_index(_tokens(spark, d))), "terms"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_terms(spark, d).filter(F.col("finding").isNotNull()).select(F.col("field").alias("field_name"), "term", "finding")


_P1 = r"""
WITH t AS (
  SELECT 'suggest_term' AS field, regexp_replace(lower(term), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') AS term, doc_id AS rid FROM suggest_terms WHERE term IS NOT NULL
  UNION ALL
  SELECT 'title', unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')), id FROM catalog_docs WHERE title IS NOT NULL),
s AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT rid) AS records FROM t WHERE term <> '' GROUP BY field, term),
n AS (SELECT field, count(DISTINCT rid) AS n FROM t WHERE term <> '' GROUP BY field)
SELECT field, term, occurrences, records, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.2 * n THEN 'common' END AS finding FROM s JOIN n USING (field)
"""

# p3 ---------------------------------------------------------------------

MAX_BATCHES = 4


def _ledger(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Keyed records, and the ledger after the loads came in as a few batches."""
    rows = materialize(canonical.keyed(table(spark, d, "catalog_docs")), "keys")
    ledger = canonical.open_ledger(spark, scratch_path(spark, "ledger"))
    lo, hi = rows.agg(F.min("load_id"), F.max("load_id")).first()
    if lo is not None:
        step = max(1, -(-(hi - lo + 1) // MAX_BATCHES))
        for start in range(lo, hi + 1, step):
            canonical.add_batch(ledger, rows.filter(F.col("load_id").between(start, start + step - 1)), "loads", start)
    canonical.add_batch(ledger, rows.filter(F.col("load_id").isNull()), "no load", 0)
    return rows, ledger.read()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.copies(*_ledger(spark, d))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d)[1].select("keep_id", "n_records")


_P3 = r"""
SELECT id, concat(trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g')), chr(10),
  array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(description, '[;|•\r\n]|//'), lambda x: trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g'))), lambda x: x <> '')), ';')) AS k
FROM catalog_docs WHERE regexp_matches(title, '[\p{L}\p{N}]') AND regexp_matches(description, '[\p{L}\p{N}]')
"""

# p6 ---------------------------------------------------------------------


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return products.group_products(table(spark, d, "item_listings"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return products.pairs(p6_groups(spark, d))


# p7 ---------------------------------------------------------------------


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.withColumn("share", F.col("n_stretches") / F.col("item_stretches"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).filter(F.col("distance") == 0).select("doc_id", "item_id")


_P7 = r"""
WITH w AS (SELECT 'd' AS o, doc_id AS id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS w FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') FROM eval_items),
g AS (SELECT DISTINCT o, id, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT o, id, w, unnest(range(1, len(w) - 8)) AS i FROM w WHERE len(w) >= 10))
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.g = i.g AND d.o = 'd' AND i.o = 'i'
"""

# p8 ---------------------------------------------------------------------


def _mixture(spark: SparkSession, d: str) -> DataFrame:
    texts = materialize(mixing.sized_texts(table(spark, d, "documents"), table(spark, d, "mix_targets")), "sized")
    return mixing.mix(texts)[0]


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.sorted_mixture(_mixture(spark, d))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(_mixture(spark, d), table(spark, d, "mix_targets"))


# p9 ---------------------------------------------------------------------


def p9_method(spark: SparkSession, d: str) -> DataFrame:
    """The corpus comes from one site, so it is one host; a line that two of its documents hold is removed."""
    return repetition.line_filter(table(spark, d, "documents"), None, limit=1)


def p9_share(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repeated_share(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_share(spark, d).filter((F.col("n_words") > 0) & (F.col("n_repeated") * 10 >= F.col("n_words") * 3)).select("doc_id").distinct()


_P9 = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
g AS (SELECT r, i, row_number() OVER (PARTITION BY r, array_to_string(w[i:i + 4], ' ') ORDER BY i) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
c AS (SELECT DISTINCT r, i + unnest(range(0, 5)) AS p FROM g WHERE k > 1),
n AS (SELECT r, count(*) AS n FROM c GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_repeated FROM w LEFT JOIN n USING (r)
"""


_P9_METHOD = r"""
WITH l AS (SELECT doc_id, '' AS host, trim(regexp_replace(lower(unnest(regexp_split_to_array(text, '\r\n|[\n\x{0b}\x{0c}\r\x{85}\x{2028}\x{2029}]'))), '[^\p{L}\p{N}]+', ' ', 'g')) AS line FROM documents),
h AS (SELECT host, line FROM l WHERE line <> '' GROUP BY host, line HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT l.*, h.line IS NOT NULL AS gone FROM l LEFT JOIN h USING (host, line) WHERE l.line <> '')
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(sum(length(line)) FILTER (WHERE NOT gone), 0) / sum(length(line)) AS kept_share,
  coalesce(sum(length(line)) FILTER (WHERE NOT gone), 0) / sum(length(line)) < 0.5 AS rejected
FROM m GROUP BY doc_id
"""


def p9_counts(spark: SparkSession, d: str) -> DataFrame:
    return p9_share(spark, d).drop("share")


QUERIES = {
    "p1_found": p1_found, "p1_terms": p1_terms, "p3_found": p3_found, "p3_records": p3_records,
    "p6_found": p6_found, "p6_groups": p6_groups,
    "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_mix": p8_mix, "p8_report": p8_report,
    "p9_method": p9_method, "p9_found": p9_found, "p9_counts": p9_counts,
}


def oracles() -> dict[str, str]:
    return {
        "p1_terms": _P1,
        "p1_found": f"SELECT field AS field_name, term, finding FROM ({_P1}) WHERE finding IS NOT NULL",
        "p3_records": f"SELECT min(id) AS keep_id, count(*) AS n_records FROM ({_P3}) GROUP BY k",
        "p3_found": f"WITH x AS ({_P3}), g AS (SELECT k, min(id) AS keep_id FROM x GROUP BY k) SELECT DISTINCT keep_id, id AS copy_id FROM x JOIN g USING (k) WHERE id <> keep_id",
        "p7_found": _P7,
        "p9_counts": _P9,
        "p9_method": _P9_METHOD,
        "p9_found": f"SELECT DISTINCT doc_id FROM ({_P9}) WHERE n_words > 0 AND n_repeated * 10 >= n_words * 3",
    }
