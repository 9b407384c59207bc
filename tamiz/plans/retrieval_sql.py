"""The retrieval queries in SQL, to compare results with."""

from __future__ import annotations

from tamiz.functions.text import TOKEN, TOKEN_TRIM
from tamiz.plans.stem_sql import spanish_stems

_TOKEN, _TRIM = TOKEN.replace("'", "''"), TOKEN_TRIM

_PART = "SELECT p_partkey AS id, p_name AS title, p_type AS description, p_retailprice AS price, p_type AS category, p_brand AS brand, CAST(p_size AS DOUBLE) AS size, CASE WHEN p_size % 3 <> 0 THEN p_size * 1.5 END AS weight, p_size % 5 AS north FROM part"
_TEXT = r"SELECT doc_id AS id, regexp_extract(text, '^[^\r\n]*') AS title, text AS description, CAST(n_chars AS DOUBLE) AS price, lang AS category, CAST(NULL AS VARCHAR) AS brand, CAST(NULL AS DOUBLE) AS size, CAST(NULL AS DOUBLE) AS weight, 0 AS north FROM documents"


def terms_of(column: str) -> str:
    """List of lower-case terms of a text."""
    return f"list_filter(list_transform(regexp_extract_all({column}, '{_TOKEN}'), lambda x: lower(regexp_replace(x, '{_TRIM}', '', 'g'))), lambda x: x <> '')"


def _index(docs: str, stems: bool = False) -> str:
    stemmed = f"""raw AS (SELECT id, field, len(w) AS dl, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM lists),
stems AS ({spanish_stems("SELECT DISTINCT term FROM raw")}),
tok AS (SELECT id, field, dl, stem AS term, pos FROM raw JOIN stems USING (term)),"""
    plain = "tok AS (SELECT id, field, len(w) AS dl, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM lists),"
    return f"""docs AS ({docs}),
lists AS (SELECT id, 'title' AS field, {terms_of("title")} AS w FROM docs WHERE title IS NOT NULL UNION ALL SELECT id, 'description', {terms_of("description")} FROM docs WHERE description IS NOT NULL),
{stemmed if stems else plain}
post AS (SELECT term, id, field, CAST(count(*) AS INTEGER) AS tf, any_value(dl) AS dl, min(pos) < 3 AS head FROM tok GROUP BY term, id, field),
vocab AS (SELECT term, count(DISTINCT id) AS df FROM post GROUP BY term),
st AS (SELECT field, sum(tf) / (SELECT count(*) FROM docs) AS avgdl FROM post GROUP BY field)"""


def search(docs: str, tokens: list[str], typo: bool, where: str = "TRUE", stems: bool = False) -> str:
    """``WITH`` clauses that end in ``res(id, score)``, all matches."""
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(tokens))
    n, typo_sql = len(tokens), "TRUE" if typo else "FALSE"
    return f"""WITH {_index(docs, stems)},
q(qpos, q) AS (VALUES {values}),
m AS (SELECT qpos, q, term, starts_with(term, q) AS p, levenshtein(term, q) AS d FROM vocab, q),
h AS (SELECT qpos, bool_or(p) AS has FROM m GROUP BY qpos),
x AS (SELECT m.qpos, m.term, p OR ({typo_sql} AND NOT has AND strlen(q) > 4 AND d <= CASE WHEN strlen(q) <= 6 THEN 1 ELSE 2 END) AS e, p,
        {typo_sql} AND NOT p AND strlen(q) >= 3 AND d <= CASE WHEN strlen(q) <= 4 THEN 1 ELSE 2 END AS f, coalesce(v.df, 1) AS df
      FROM m JOIN h USING (qpos) LEFT JOIN vocab v ON v.term = m.q),
pt AS (SELECT id, field, qpos, bool_or(e) AS e, sum(tf) FILTER (WHERE p) AS ptf, sum(tf) FILTER (WHERE f) AS ftf, bool_or(p AND head AND field = 'title') AS head, any_value(dl) AS dl, any_value(df) AS df
       FROM post JOIN x USING (term) WHERE e OR p OR f GROUP BY id, field, qpos),
wt AS (SELECT pt.*, CASE WHEN pt.field = 'title' THEN 2.0 ELSE 1.0 END * greatest(0, ln(1 + ((SELECT count(*) FROM docs) - df + 0.5) / (df + 0.5))) AS w, 1.2 * (0.25 + 0.75 * dl / greatest(avgdl, 1)) AS k FROM pt JOIN st USING (field)),
pd AS (SELECT id, count(DISTINCT qpos) FILTER (WHERE e) AS matched, count(DISTINCT qpos) FILTER (WHERE head) AS heads,
         coalesce(sum(w * coalesce(ptf, ftf) * 2.2 / (coalesce(ptf, ftf) + k)), 0) AS plain, coalesce(sum(w * ptf * 2.2 / (ptf + k)), 0) AS loose FROM wt GROUP BY id),
sd AS (SELECT id, CASE WHEN matched = {n} THEN plain * CASE WHEN heads = {n} THEN 1.5 ELSE 1 END ELSE 0 END AS a, loose * matched AS o FROM pd JOIN docs USING (id) WHERE matched > 0 AND ({where})),
res AS (SELECT id, CASE WHEN (SELECT bool_or(a > 0) FROM sd) THEN a WHEN {n} > 1 THEN o ELSE 0 END AS score FROM sd
        WHERE CASE WHEN (SELECT bool_or(a > 0) FROM sd) THEN a WHEN {n} > 1 THEN o ELSE 0 END > 0)
"""


def _all(docs: str, tokens: list[str], typo: bool = False, where: str = "TRUE") -> str:
    return search(docs, tokens, typo, where) + "SELECT id, round(score, 6) AS score FROM res"


_BATCH = f"""WITH {_index(_PART)},
qs AS (SELECT DISTINCT p_name AS query FROM part),
ql AS (SELECT query, {terms_of("query")} AS w FROM qs),
q AS (SELECT query, len(w) AS n, unnest(w) AS q, generate_subscripts(w, 1) - 1 AS qpos FROM ql),
x AS (SELECT d.q, vocab.term, coalesce(v.df, 1) AS df FROM (SELECT DISTINCT q FROM q) d JOIN vocab ON starts_with(vocab.term, d.q) LEFT JOIN vocab v ON v.term = d.q),
pt AS (SELECT query, n, id, field, qpos, sum(tf) AS ptf, bool_or(head AND field = 'title') AS head, any_value(dl) AS dl, any_value(df) AS df FROM post JOIN x USING (term) JOIN q USING (q) GROUP BY query, n, id, field, qpos),
wt AS (SELECT pt.*, CASE WHEN pt.field = 'title' THEN 2.0 ELSE 1.0 END * greatest(0, ln(1 + ((SELECT count(*) FROM docs) - df + 0.5) / (df + 0.5))) AS w, 1.2 * (0.25 + 0.75 * dl / greatest(avgdl, 1)) AS k FROM pt JOIN st USING (field)),
pd AS (SELECT query, n, id, count(DISTINCT qpos) AS matched, count(DISTINCT qpos) FILTER (WHERE head) AS heads, sum(w * ptf * 2.2 / (ptf + k)) AS plain FROM wt GROUP BY query, n, id),
sd AS (SELECT query, id, plain * CASE WHEN heads = n THEN 1.5 ELSE 1 END AS score FROM pd WHERE matched = n AND plain > 0),
r AS (SELECT query, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY round(sd.score, 9) DESC, id) AS INTEGER) AS rank FROM sd)
SELECT query, id, score, rank FROM r WHERE rank <= 3"""

_BATCH_TYPOS = f"""WITH {_index(_TEXT)},
qs AS (SELECT DISTINCT title AS query FROM catalog_docs WHERE title IS NOT NULL),
ql AS (SELECT query, {terms_of("query")} AS w FROM qs),
q AS (SELECT query, len(w) AS n, unnest(w) AS q, generate_subscripts(w, 1) - 1 AS qpos FROM ql),
m AS (SELECT d.q, term, starts_with(term, d.q) AS p, CASE WHEN abs(length(term) - length(d.q)) <= 2 THEN levenshtein(term, d.q) ELSE 99 END AS d FROM (SELECT DISTINCT q FROM q) d, vocab),
h AS (SELECT q, bool_or(p) AS has FROM m GROUP BY q),
x AS (SELECT m.q, m.term, p OR (NOT has AND strlen(q) > 4 AND d <= CASE WHEN strlen(q) <= 6 THEN 1 ELSE 2 END) AS e, p, NOT p AND strlen(q) >= 3 AND d <= CASE WHEN strlen(q) <= 4 THEN 1 ELSE 2 END AS f, coalesce(v.df, 1) AS df
      FROM (SELECT * FROM m WHERE p OR d <= 2) m JOIN h USING (q) LEFT JOIN vocab v ON v.term = m.q),
pt AS (SELECT query, n, id, field, qpos, bool_or(e) AS e, sum(tf) FILTER (WHERE p) AS ptf, sum(tf) FILTER (WHERE f) AS ftf, bool_or(p AND head AND field = 'title') AS head, any_value(dl) AS dl, any_value(df) AS df
       FROM post JOIN x USING (term) JOIN q USING (q) WHERE e OR p OR f GROUP BY query, n, id, field, qpos),
wt AS (SELECT pt.*, CASE WHEN pt.field = 'title' THEN 2.0 ELSE 1.0 END * greatest(0, ln(1 + ((SELECT count(*) FROM docs) - df + 0.5) / (df + 0.5))) AS w, 1.2 * (0.25 + 0.75 * dl / greatest(avgdl, 1)) AS k FROM pt JOIN st USING (field)),
pd AS (SELECT query, n, id, count(DISTINCT qpos) FILTER (WHERE e) AS matched, count(DISTINCT qpos) FILTER (WHERE head) AS heads,
         coalesce(sum(w * coalesce(ptf, ftf) * 2.2 / (coalesce(ptf, ftf) + k)), 0) AS plain, coalesce(sum(w * ptf * 2.2 / (ptf + k)), 0) AS loose FROM wt GROUP BY query, n, id),
sd AS (SELECT query, n, id, CASE WHEN matched = n THEN plain * CASE WHEN heads = n THEN 1.5 ELSE 1 END ELSE 0 END AS a, loose * matched AS o FROM pd WHERE matched > 0),
md AS (SELECT query, bool_or(a > 0) AS every FROM sd GROUP BY query),
rs AS (SELECT query, id, CASE WHEN every THEN a WHEN n > 1 THEN o ELSE 0 END AS score, CASE WHEN every THEN 'and' ELSE 'or_fallback' END AS mode FROM sd JOIN md USING (query)),
r AS (SELECT query, id, round(score, 6) AS score, mode, CAST(row_number() OVER (PARTITION BY query ORDER BY round(rs.score, 9) DESC, id) AS INTEGER) AS rank FROM rs WHERE rs.score > 0)
SELECT query, id, score, mode, rank FROM r WHERE rank <= 3"""


def jump_hash(ids: str, shards: int) -> str:
    """``id, shard_id`` of a query that gives ``id``."""
    return f"""SELECT id, CAST(b AS INTEGER) AS shard_id FROM (
  WITH RECURSIVE jump(id, k, b, j) AS (
    SELECT id, (CAST(id AS HUGEINT) + 18446744073709551616) % 18446744073709551616, CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM ({ids})
    UNION ALL
    SELECT id, n, j, CAST(floor((j + 1) * (CAST(2147483648 AS DOUBLE) / (CAST(n // 8589934592 AS DOUBLE) + 1))) AS BIGINT)
    FROM (SELECT id, (k * 2862933555777941757 + 1) % 18446744073709551616 AS n, j FROM jump WHERE j < {shards}))
  SELECT id, b, j FROM jump) WHERE j >= {shards}"""


_OPLOG = "SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'index' END AS op, user_id AS id, event_type AS title, value AS price FROM events"
_STRIP = "CASE WHEN starts_with({c}, site_id) AND regexp_full_match(substr({c}, length(site_id) + 1), '[0-9]+') THEN TRY_CAST(substr({c}, length(site_id) + 1) AS BIGINT) END"
_MAPPED = f"SELECT *, {_STRIP.format(c='id')} AS num, {_STRIP.format(c='category_id')} AS cat FROM item_listings"


def oracles() -> dict[str, str]:
    part = f"WITH {_index(_PART)} "
    text = f"WITH {_index(_TEXT)} "
    sugg = f"""SELECT term, count(*) AS df FROM (SELECT DISTINCT id, field, unnest(w) AS term FROM (SELECT p_partkey AS id, 'title' AS field, {terms_of("p_name")} AS w FROM part UNION ALL SELECT p_partkey, 'category', {terms_of("p_type")} FROM part)) GROUP BY term"""
    words = f"SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest(w) AS term FROM (SELECT doc_id AS id, {terms_of('text')} AS w FROM documents)) GROUP BY term"
    return {
        "tokenize_terms": f"SELECT id, unnest(w) AS term, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos FROM (SELECT doc_id AS id, {terms_of('text')} AS w FROM documents WHERE text IS NOT NULL)",
        "term_df": text + "SELECT term, df FROM vocab",
        "field_stats": text + "SELECT field, (SELECT count(*) FROM docs) AS n_docs, round(avgdl, 6) AS avgdl FROM st",
        "keyword_terms": "SELECT category AS term, count(*) AS n FROM catalog_docs WHERE length(category) > 0 GROUP BY category",
        "postings": text + "SELECT term, id, field, tf, CAST(dl AS INTEGER) AS dl, head FROM post",
        "bm25_and_topk": search(_PART, ["red", "widget"], False) + "SELECT id, round(score, 6) AS score FROM res ORDER BY round(res.score, 9) DESC, id LIMIT 20",
        "bm25_prefix": _all(_PART, ["wid"]),
        "bm25_fuzzy": _all(_PART, ["widgat"], True),
        "bm25_or_fallback": _all(_PART, ["red", "zzzzz", "widget"]),
        "bm25_documents": _all(_TEXT, ["garantía", "envío"]),
        "title_position_boost": _all(_TEXT, ["el", "cable"]),
        "empty_query_scan": "SELECT p_partkey AS id, CAST(1.0 AS DOUBLE) AS score FROM part WHERE p_retailprice >= 950",
        "filter_eq": "SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#1'",
        "filter_in": "SELECT p_partkey AS id FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'none')",
        "filter_range": "SELECT p_partkey AS id FROM part WHERE p_size BETWEEN 10 AND 20",
        "filter_combo": _all(_PART, ["widget"], False, "brand = 'Brand#1' AND price <= 1500"),
        "filter_unknown_field": "SELECT p_partkey AS id FROM part WHERE FALSE",
        "facet_single": search(_PART, ["widget"], False) + "SELECT 'category' AS field, category AS value, count(*) AS count FROM res JOIN docs USING (id) WHERE category IS NOT NULL GROUP BY category",
        "facet_multi": "SELECT 'category' AS field, p_type AS value, count(*) AS count FROM part WHERE p_type IS NOT NULL GROUP BY p_type UNION ALL SELECT 'brand', p_brand, count(*) FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand",
        "sort_price_page": "SELECT p_partkey AS id, p_retailprice AS sort_value FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 15",
        "sort_missing_attr": "SELECT p_partkey AS id, CAST(CASE WHEN p_size % 3 <> 0 THEN p_size * 1.5 END AS DOUBLE) AS sort_value FROM part ORDER BY sort_value NULLS FIRST, p_partkey LIMIT 1000",
        "hydrate_hits": search(_PART, ["blue", "ring"], False) + "SELECT id, round(res.score, 6) AS score, title, price, category FROM res JOIN docs USING (id) ORDER BY round(res.score, 9) DESC, id LIMIT 15",
        "search_batch": _BATCH,
        "suggest_build": f"SELECT term, df, round(df / max(df) OVER (), 6) AS score FROM ({sugg}) WHERE df >= 2",
        "suggest_prefix": f"SELECT term, round(score, 6) AS score FROM (SELECT term, df / max(df) OVER () AS score FROM ({words}) WHERE df >= 2) WHERE starts_with(term, 'co') ORDER BY score DESC, term LIMIT 10",
        "suggest_sharded_merge": """WITH r AS (SELECT DISTINCT shard_id, doc_id, field_name, lower(term) AS term FROM suggest_terms WHERE term IS NOT NULL),
            c AS (SELECT shard_id, term, count(*) AS df FROM r GROUP BY shard_id, term HAVING count(*) >= 2),
            s AS (SELECT shard_id, term, df / max(df) OVER (PARTITION BY shard_id) AS score FROM c),
            t AS (SELECT * FROM (SELECT term, score, row_number() OVER (PARTITION BY shard_id ORDER BY score DESC, term) AS rn FROM s WHERE starts_with(term, 'c')) WHERE rn <= 20)
            SELECT term, round(max(score), 6) AS score FROM t GROUP BY term ORDER BY max(score) DESC, term LIMIT 20""",
        "catalogue_map_ok": f"""SELECT num AS id, title, CAST(cat AS VARCHAR) AS category,
            CAST(len(list_distinct(list_concat(list_transform(list_filter(coalesce(attributes, []), lambda a: a.value_name IS NOT NULL AND a.id IS NOT NULL), lambda a: lower(a.id)),
              CASE WHEN coalesce(condition, '') <> '' THEN ['condition'] ELSE [] END, CASE WHEN coalesce(thumbnail, '') <> '' THEN ['thumbnail'] ELSE [] END, CASE WHEN coalesce(status, '') <> '' THEN ['status'] ELSE [] END))) AS INTEGER) AS n_attributes,
            nullif(condition, '') AS condition FROM ({_MAPPED}) WHERE num IS NOT NULL AND cat IS NOT NULL""",
        "catalogue_map_errors": f"SELECT CASE WHEN num IS NULL THEN concat('invalid id: ', coalesce(id, 'null')) ELSE concat('invalid category_id: ', coalesce(category_id, 'null')) END AS error, count(*) AS n FROM ({_MAPPED}) WHERE num IS NULL OR cat IS NULL GROUP BY error",
        "oplog_fold": f"SELECT id, seq, title, price FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM ({_OPLOG})) WHERE rn = 1 AND op = 'index'",
        "live_after_deletes": """SELECT DISTINCT id FROM catalog_docs WHERE id NOT IN (
            SELECT id FROM (SELECT entry.id AS id, lower(regexp_replace(entry.op, '[^A-Za-z]', '', 'g')) AS op, row_number() OVER (PARTITION BY entry.id ORDER BY wal_gen DESC, seq DESC) AS rn FROM wal_records WHERE entry IS NOT NULL AND entry.id IS NOT NULL)
            WHERE rn = 1 AND op = 'delete')""",
        "jump_hash_stats": f"SELECT shard_id, count(*) AS live_docs FROM ({jump_hash('SELECT p_partkey AS id FROM part', 4)}) GROUP BY ROLLUP (shard_id)",
        "shard_rows": jump_hash("SELECT p_partkey AS id FROM part", 4),
        "stem_es": spanish_stems(f"SELECT DISTINCT unnest(w) AS term FROM (SELECT {terms_of('text')} AS w FROM documents)"),
        "bm25_stemmed": search(_TEXT, ["garant", "del", "envi"], False, stems=True) + "SELECT id, round(score, 6) AS score FROM res",
        "bm25_stemmed_typos": search(_TEXT, ["garrant"], True, stems=True) + "SELECT id, round(score, 6) AS score FROM res",
        "best_candidates": search(_PART, ["widget"], False) + "SELECT id, round(score, 6) AS score FROM res ORDER BY round(res.score, 9) DESC, id LIMIT 50",
        "total_hits": search(_PART, ["widget"], False, "price >= 905") + "SELECT count(*) AS total_hits FROM res",
        "search_facets": search(_PART, ["blue"], False) + "SELECT field, value, count(*) AS count FROM (SELECT unnest(['brand', 'category']) AS field, unnest([brand, category]) AS value FROM res JOIN docs USING (id)) WHERE value IS NOT NULL GROUP BY field, value",
        "multi_get": "SELECT p_partkey AS id, p_name AS title, p_retailprice AS price FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)",
        "point_get": "SELECT p_partkey AS id, p_name AS title, p_retailprice AS price FROM part WHERE p_partkey IN (7, 11, -1)",
        "sort_attr_descending": search(_PART, ["widget"], False) + "SELECT id, weight AS sort_value FROM res JOIN docs USING (id) ORDER BY weight DESC NULLS LAST, id LIMIT 40 OFFSET 5",
        "search_batch_typos": _BATCH_TYPOS,
        "suggest_attributes": f"SELECT term, df, round(df / max(df) OVER (), 6) AS score FROM (SELECT term, count(*) AS df FROM (SELECT DISTINCT p_partkey, unnest({terms_of('p_brand')}) AS term FROM part) GROUP BY term)",
        "availability_text": "SELECT p_partkey AS id FROM part WHERE p_size <= 25 OR p_size + 0.5 >= 40",
        "zone_gate": search(_PART, ["red"], False) + "SELECT id, round(res.score, 6) AS score FROM res JOIN docs USING (id) WHERE north >= 3 ORDER BY round(res.score, 9) DESC, id LIMIT 25 OFFSET 5",
        "rerank_remote": search(_PART, ["red"], False) + "SELECT id, round(price, 6) AS score FROM (SELECT id, price FROM res JOIN docs USING (id) ORDER BY round(res.score, 9) DESC, id LIMIT 200) ORDER BY price DESC, id LIMIT 20",
        "rerank_fallback": search(_PART, ["red"], False) + "SELECT id, round(score, 6) AS score, FALSE AS reranked FROM res ORDER BY round(res.score, 9) DESC, id LIMIT 20",
        "cached_page": search(_PART, ["blue"], False) + "SELECT id, round(score, 6) AS score, TRUE AS cache_hit FROM res ORDER BY round(res.score, 9) DESC, id LIMIT 10 OFFSET 10",
        "availability_static": "SELECT p_partkey AS id FROM part WHERE p_size % 5 >= 2",
        "availability_allow_list": "SELECT p_partkey AS id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)",
        "rerank_expr": search(_PART, ["red"], False) + "SELECT id, round(s, 6) AS score FROM (SELECT id, p + price / 10000 AS s FROM (SELECT id, price, res.score AS p FROM res JOIN docs USING (id) ORDER BY round(res.score, 9) DESC, id LIMIT 200)) ORDER BY round(s, 9) DESC, id LIMIT 20",
    }
