"""Queries of the data-maintenance operators: profiles, wide tables, change feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.operators import changefeed, profile, wide
from tamiz.session import materialize, scratch_path
from tamiz.sources.tables import table


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# p2 ---------------------------------------------------------------------


def _rules(docs: DataFrame, items: DataFrame):
    return (
        (docs, "catalog_docs", "price", profile.valid_price(F.col("price"))),
        (items, "item_listings", "condition", F.col("condition").isin(profile.CONDITIONS)),
        (items, "item_listings", "status", F.col("status").isin(profile.STATUSES)),
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    docs, items = table(spark, d, "catalog_docs").select("id", "price", "load_id"), table(spark, d, "item_listings").select("id", "condition", "status", "load_id")
    parts = [profile.violations(df, t, c, ok) for df, t, c, ok in _rules(docs, items)]
    parts += [profile.null_share_changes(docs, "catalog_docs", ["price"]), profile.null_share_changes(items, "item_listings", ["condition", "status"])]
    parts += [profile.median_shift(docs, "catalog_docs", "price"), *(profile.value_shift(items, "item_listings", c) for c in ("condition", "status"))]
    return _union(parts)


def p2_method(spark: SparkSession, d: str) -> DataFrame:
    counts = _union([profile.mask_counts(table(spark, d, t), t) for t in ("catalog_docs", "item_listings")])
    return profile.mask_findings(materialize(counts, "masks"))


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    docs, items = table(spark, d, "catalog_docs"), table(spark, d, "item_listings")
    rules = {t: {} for t in ("catalog_docs", "item_listings")}
    for _, t, c, ok in _rules(docs, items):
        rules[t][c] = F.coalesce(ok, F.lit(False))
    return _union([profile.column_profile(df, t, rules[t]) for df, t in ((docs, "catalog_docs"), (items, "item_listings"))])


# p4 ---------------------------------------------------------------------


def _gathered(spark: SparkSession, d: str, all_entities: bool = False) -> tuple[DataFrame, DataFrame]:
    defs, items, docs = (table(spark, d, t) for t in ("attr_defs", "item_attrs", "catalog_docs"))
    rows = wide.item_rows(items).unionByName(wide.document_rows(docs))
    return wide.pivot(rows, defs, wide.entities(items, docs) if all_entities else None), defs


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return wide.unpivot(_gathered(spark, d)[0])


def p4_wide(spark: SparkSession, d: str) -> DataFrame:
    return wide.project(*_gathered(spark, d, all_entities=True))


# p5 ---------------------------------------------------------------------

MAX_COMMITS = 8


def _current(spark: SparkSession, d: str) -> DataFrame:
    """The feed applied in a few commits, one a range of generations."""
    feed = table(spark, d, "wal_records")
    changes = changefeed.normalize(feed, F.col("entry.id"), F.col("entry.op"), {"wal_gen": F.col("wal_gen"), "seq": F.col("seq")}, F.col("entry.doc"))
    lo, hi = feed.agg(F.min("wal_gen"), F.max("wal_gen")).first()
    state = changefeed.open_table(spark, scratch_path(spark, "state"), changes)
    if lo is not None:
        step = max(1, -(-(hi - lo + 1) // MAX_COMMITS))
        for start in range(lo, hi + 1, step):
            state.commit(changes.filter(F.col("place.wal_gen").between(start, start + step - 1)), "feed", start)
    return changefeed.live(state.read())


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _current(spark, d).select(F.col("key").alias("doc_id"), "wal_gen", "seq")


def p5_state(spark: SparkSession, d: str) -> DataFrame:
    return _current(spark, d).select(F.col("key").alias("doc_id"), "wal_gen", "seq", "content.title", "content.price", "content.category")


_LATEST = """
SELECT * FROM (
  SELECT entry.id AS doc_id, wal_gen, seq, lower(regexp_replace(entry.op, '[^A-Za-z]', '', 'g')) AS op, entry.doc AS doc,
         row_number() OVER (PARTITION BY entry.id ORDER BY wal_gen DESC, seq DESC) AS rn
  FROM wal_records WHERE entry IS NOT NULL)
WHERE rn = 1 AND op = 'index'
"""

_CELLS_PROFILE = """
SELECT '{t}' AS table_name, '{c}' AS column_name, load_id, count(*) AS n_rows, 1 - count({c}) / count(*) AS null_share,
       count(DISTINCT {c}) AS n_distinct, {v} AS n_violations
FROM {t} GROUP BY load_id
"""


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    """The profile without the range, whose text form differs between engines, for the columns with rules."""
    return p2_profile(spark, d).filter(F.concat_ws(".", "table_name", "column_name").isin("catalog_docs.title", "catalog_docs.category", "catalog_docs.price", "item_listings.condition", "item_listings.status", "item_listings.title")).drop("min_value", "max_value")


TEXTS = {"catalog_docs": ["title", "category"], "item_listings": ["title", "condition", "status", "category_id", "thumbnail"]}


def p2_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Ranges by load of the text columns, and of the prices as numbers."""
    found = p2_profile(spark, d)
    named = F.concat_ws(".", "table_name", "column_name")
    texts = found.filter(named.isin([f"{t}.{c}" for t, cs in TEXTS.items() for c in cs])).select("table_name", "column_name", "load_id", "n_rows", "min_value", "max_value", F.lit(None).cast("double").alias("least"), F.lit(None).cast("double").alias("most"))
    none = F.lit(None).cast("string")
    return texts.unionByName(found.filter("column_name = 'price'").select("table_name", "column_name", "load_id", "n_rows", none.alias("min_value"), none.alias("max_value"), F.col("min_value").cast("double").alias("least"), F.col("max_value").cast("double").alias("most")))


def _sql_p2_ranges() -> str:
    one = "SELECT '{t}' AS table_name, '{c}' AS column_name, load_id, count(*) AS n_rows, {lo} AS min_value, {hi} AS max_value, {least} AS least, {most} AS most FROM {t} GROUP BY load_id"
    rows = [one.format(t=t, c=c, lo=f"min({c})", hi=f"max({c})", least="CAST(NULL AS DOUBLE)", most="CAST(NULL AS DOUBLE)") for t, cs in TEXTS.items() for c in cs]
    return " UNION ALL ".join([*rows, *(one.format(t=t, c="price", lo="NULL", hi="NULL", least="min(price)", most="max(price)") for t in TEXTS)])


# The attributes of attr_defs by type.
COLUMNS = {
    "VARCHAR": ["BRAND", "MODEL", "MATERIAL", "COLOR", "COMPATIBLE_WITH"],
    "BIGINT": ["WEIGHT", "LENGTH", "CAPACITY", "STORAGE", "POWER", "SHOE_SIZE", "WARRANTY", "PACK_UNITS"],
    "BOOLEAN": ["WIRELESS", "WATERPROOF"],
}


def p4_columns(spark: SparkSession, d: str) -> DataFrame:
    """The wide table with its lists as text and its failures counted."""
    wide_ = p4_wide(spark, d)
    lists = [c for c, kind in wide_.dtypes if kind == "array<string>"]
    failed = F.aggregate("cast_failures", F.lit(0).cast("bigint"), lambda n, x: n + x["n"]).alias("n_failures")
    return wide_.select("origin", "entity_id", *(F.array_join(c, ",").alias(c) if c in lists else c for c in wide_.columns[2:-1]), F.size("cast_failures").alias("n_failed_cells"), failed)


def _sql_p2_shares() -> str:
    price = "count(*) FILTER (WHERE price IS NOT NULL AND NOT (isfinite(price) AND price > 0 AND price <= 5000000 AND abs(price * 100 - round(price * 100)) <= 0.0001))"
    isin = lambda c, vs: f"count(*) FILTER (WHERE {c} IS NOT NULL AND {c} NOT IN ({', '.join(repr(v) for v in vs)}))"
    rows = [("catalog_docs", "title", "0"), ("catalog_docs", "category", "0"), ("catalog_docs", "price", price), ("item_listings", "condition", isin("condition", profile.CONDITIONS)), ("item_listings", "status", isin("status", profile.STATUSES)), ("item_listings", "title", "0")]
    return " UNION ALL ".join(_CELLS_PROFILE.format(t=t, c=c, v=f"CAST({v} AS BIGINT)") for t, c, v in rows)


def _sql_p2_found() -> str:
    ok = "(isfinite(price) AND price > 0 AND price <= 5000000 AND abs(price * 100 - round(price * 100)) <= 0.0001)"
    parts = [f"SELECT DISTINCT 'catalog_docs' AS table_name, 'price' AS column_name, load_id, CAST(id AS VARCHAR) AS record_id, 'pattern' AS finding FROM catalog_docs WHERE price IS NOT NULL AND NOT {ok}"]
    for c, vs in (("condition", profile.CONDITIONS), ("status", profile.STATUSES)):
        parts.append(f"SELECT DISTINCT 'item_listings', '{c}', load_id, id, 'pattern' FROM item_listings WHERE {c} IS NOT NULL AND {c} NOT IN ({', '.join(repr(v) for v in vs)})")
    for t, c in (("catalog_docs", "price"), ("item_listings", "condition"), ("item_listings", "status")):
        parts.append(f"SELECT '{t}', '{c}', load_id, '', 'null_share' FROM (SELECT load_id, s, lag(s) OVER (ORDER BY load_id) AS b FROM (SELECT load_id, 1 - count({c}) / count(*) AS s FROM {t} GROUP BY load_id)) WHERE abs(s - b) > 0.08")
    parts.append(f"SELECT 'catalog_docs', 'price', load_id, '', 'shift' FROM (SELECT load_id, m, lag(m) OVER (ORDER BY load_id) AS b FROM (SELECT load_id, median(price) FILTER (WHERE {ok}) AS m FROM catalog_docs GROUP BY load_id)) WHERE m / b > 1.5 OR b / m > 1.5")
    for c in ("condition", "status"):
        parts.append(f"""SELECT 'item_listings', '{c}', load_id, '', 'shift' FROM (
          SELECT l.load_id, sum(abs(coalesce(s.share, 0) - coalesce(b.share, 0))) / 2 AS dist
          FROM (SELECT load_id, lag(load_id) OVER (ORDER BY load_id) AS prev FROM (SELECT DISTINCT load_id FROM item_listings)) l
          CROSS JOIN (SELECT DISTINCT {c} AS v FROM item_listings WHERE {c} IS NOT NULL) x
          LEFT JOIN (SELECT load_id, v, n / sum(n) OVER (PARTITION BY load_id) AS share FROM (SELECT load_id, {c} AS v, count(*) AS n FROM item_listings WHERE {c} IS NOT NULL GROUP BY load_id, {c})) s ON s.load_id = l.load_id AND s.v = x.v
          LEFT JOIN (SELECT load_id, v, n / sum(n) OVER (PARTITION BY load_id) AS share FROM (SELECT load_id, {c} AS v, count(*) AS n FROM item_listings WHERE {c} IS NOT NULL GROUP BY load_id, {c})) b ON b.load_id = l.prev AND b.v = x.v
          WHERE l.prev IS NOT NULL GROUP BY l.load_id) WHERE dist > 0.2""")
    return " UNION ALL ".join(parts)


def _sql_p4_cells() -> str:
    """``WITH`` clauses that end in ``c``: every row of a defined attribute with its cell."""
    blanks, no_value = r"[\s\x{a0}\x{2000}-\x{200b}\x{202f}\x{3000}\x{feff}]+", ", ".join(f"'{v}'" for v in wide.NO_VALUE)
    units = ", ".join(f"('{u}', '{b}', {f})" for u, (b, f) in wide.UNITS.items())
    squeeze = lambda c: f"trim(regexp_replace({c}, '{blanks}', ' ', 'g'))"
    fold = lambda c: f"strip_accents(lower({c}))"
    text = lambda c: f"CASE WHEN {fold(squeeze(c))} NOT IN ({no_value}) THEN {squeeze(c)} END"
    key = lambda c: f"upper(regexp_replace({c}, '[\\s\\x{{a0}}_-]', '', 'g'))"
    name = lambda c: f"regexp_replace({fold(c)}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
    number = r"^x?\s*([0-9]+(?:[.,][0-9]+)?)\s*([a-z]*)\.?$"
    flags = lambda vs: ", ".join(f"'{v}'" for v in vs)
    return f"""WITH r AS (
  SELECT 'item' AS origin, item_id AS entity_id, id AS ak, name AS an, value_name AS s, CAST(NULL AS DOUBLE) AS n, CAST(NULL AS BOOLEAN) AS b, CAST(NULL AS VARCHAR[]) AS a, updated_at AS upd, row_id AS tie FROM item_attrs
  UNION ALL SELECT 'document', CAST(id AS VARCHAR), k, NULL, v.s, v.n, v.b, v.a, loaded_at, 0 FROM (SELECT id, loaded_at, unnest(map_keys(attributes)) AS k, unnest(map_values(attributes)) AS v FROM catalog_docs)),
u(spelled, base, factor) AS (VALUES {units}),
j AS (SELECT r.*, d.id AS attr_id, d.value_type, d.unit, {text('r.s')} AS t FROM r JOIN attr_defs d ON CASE WHEN coalesce({key('r.ak')}, '') <> '' THEN {key('r.ak')} = {key('d.id')} ELSE {name('r.an')} = {name('d.name')} END),
m AS (SELECT j.*, {fold('t')} AS f, TRY_CAST(replace(regexp_extract({fold('t')}, '{number}', 1), ',', '.') AS DECIMAL(18, 6)) AS digits, regexp_extract({fold('t')}, '{number}', 2) AS spelled FROM j),
c AS (SELECT m.*, CASE value_type
    WHEN 'number' THEN CAST(CAST(coalesce(CASE WHEN NOT (starts_with(f, 'x') AND unit <> 'units') THEN CASE WHEN m.spelled = '' THEN round(digits) WHEN u.base = unit THEN round(digits * u.factor) END END, round(n)) AS BIGINT) AS VARCHAR)
    WHEN 'flag' THEN coalesce(CAST(b AS VARCHAR), CASE WHEN f IN ({flags(wide.TRUE)}) THEN 'true' WHEN f IN ({flags(wide.FALSE)}) THEN 'false' END)
    WHEN 'list' THEN nullif(array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce(regexp_split_to_array(t, '[,;/|]'), a), lambda x: lower({squeeze('x')})), lambda x: {fold('x')} NOT IN ({no_value})))), ','), '')
    ELSE t END AS cell FROM m LEFT JOIN u ON u.spelled = m.spelled),
f AS (SELECT origin, entity_id, attr_id, cell AS cell_value FROM (
  SELECT *, row_number() OVER (PARTITION BY origin, entity_id, attr_id ORDER BY upd DESC, tie DESC, cell DESC) AS rn FROM c WHERE cell IS NOT NULL AND entity_id IS NOT NULL) WHERE rn = 1),
bad AS (SELECT origin, entity_id, count(DISTINCT attr_id) AS cells, count(*) AS n FROM c WHERE entity_id IS NOT NULL AND cell IS NULL
  AND (t IS NOT NULL OR (n IS NOT NULL AND NOT isnan(n) AND abs(n) < 9e15) OR b IS NOT NULL OR {text("array_to_string(a, ', ')")} IS NOT NULL) GROUP BY origin, entity_id)
"""


def _sql_p4_found() -> str:
    return _sql_p4_cells() + "SELECT origin, entity_id, attr_id, cell_value FROM f"


def _sql_p4_columns() -> str:
    cells = ", ".join(f"CAST(max(cell_value) FILTER (WHERE attr_id = '{c}') AS {kind}) AS {c.lower()}" for kind, cs in COLUMNS.items() for c in cs)
    return _sql_p4_cells() + f""", e AS (SELECT DISTINCT 'item' AS origin, item_id AS entity_id FROM item_attrs WHERE item_id IS NOT NULL UNION ALL SELECT DISTINCT 'document', CAST(id AS VARCHAR) FROM catalog_docs WHERE id IS NOT NULL)
SELECT e.origin, e.entity_id, {cells}, CAST(coalesce(any_value(bad.cells), 0) AS INTEGER) AS n_failed_cells, CAST(coalesce(any_value(bad.n), 0) AS BIGINT) AS n_failures
FROM e LEFT JOIN f ON f.origin = e.origin AND f.entity_id = e.entity_id LEFT JOIN bad ON bad.origin = e.origin AND bad.entity_id = e.entity_id GROUP BY e.origin, e.entity_id"""


QUERIES = {"p2_method": p2_method, "p2_found": p2_found, "p2_shares": p2_shares, "p2_ranges": p2_ranges, "p2_profile": p2_profile, "p4_found": p4_found, "p4_wide": p4_wide, "p4_columns": p4_columns, "p5_found": p5_found, "p5_state": p5_state}


def oracles() -> dict[str, str]:
    return {
        "p2_found": _sql_p2_found(),
        "p2_shares": _sql_p2_shares(),
        "p2_ranges": _sql_p2_ranges(),
        "p4_found": _sql_p4_found(),
        "p4_columns": _sql_p4_columns(),
        "p5_found": f"SELECT doc_id, wal_gen, seq FROM ({_LATEST})",
        "p5_state": f"SELECT doc_id, wal_gen, seq, doc.title AS title, doc.price AS price, doc.category AS category FROM ({_LATEST})",
    }
