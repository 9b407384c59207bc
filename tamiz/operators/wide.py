"""Attribute-value rows into one typed row per entity.

Rows of ``origin, entity_id, attr_key, attr_name, s, n, b, a, at, tie`` are
resolved to the attributes of a definition table, read as the attribute's type,
reduced to the latest readable value of each cell, gathered into one map per
entity and projected into typed columns.  Values that can't be read stay, as
the last such text of the cell and their number, in ``cast_failures``.

The number of definitions is the number of columns of the result, so it is
bounded by ``MAX_COLUMNS``; the definitions are the only thing broadcast.
Cells are reduced before entities are gathered, so an entity with a third of
all rows costs one row a cell and task.

Defined results: rows without entity are ignored; unknown attributes don't come
out; null, blank texts and texts that only say there is no value are neither
values nor failures; ties of time and ``tie`` go to the greater value; an
entity with no readable value keeps a row with nulls; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.functions.text import BLANKS, NOT_WORD, fold, squeeze

MAX_COLUMNS = 2000

# Texts that only say there is no value (folded, without outer blanks).
NO_VALUE = ["", "-", "--", "---", "?", ".", "...", "n/a", "na", "n.a.", "n/d", "nd", "s/d", "sd", "null", "none", "nan", "nil", "sin datos", "sin dato", "no aplica", "sem dados", "nao se aplica", "no data", "not applicable"]
TRUE = ["si", "sim", "yes", "true", "verdadero", "verdadeiro", "1", "s", "y"]
FALSE = ["no", "nao", "false", "falso", "0", "n"]
# Spelled unit -> (base unit, how many base units it is).
UNITS = {
    "g": ("g", "1"), "gr": ("g", "1"), "grs": ("g", "1"), "gramo": ("g", "1"), "gramos": ("g", "1"), "grama": ("g", "1"), "gramas": ("g", "1"), "gram": ("g", "1"), "grams": ("g", "1"),
    "kg": ("g", "1000"), "kgs": ("g", "1000"), "kilo": ("g", "1000"), "kilos": ("g", "1000"), "kilogramo": ("g", "1000"), "kilogramos": ("g", "1000"), "mg": ("g", "0.001"),
    "mm": ("mm", "1"), "milimetro": ("mm", "1"), "milimetros": ("mm", "1"), "cm": ("mm", "10"), "cms": ("mm", "10"), "centimetro": ("mm", "10"), "centimetros": ("mm", "10"),
    "m": ("mm", "1000"), "mt": ("mm", "1000"), "mts": ("mm", "1000"), "metro": ("mm", "1000"), "metros": ("mm", "1000"),
    "ml": ("ml", "1"), "mililitro": ("ml", "1"), "mililitros": ("ml", "1"), "cc": ("ml", "1"), "cl": ("ml", "10"), "l": ("ml", "1000"), "lt": ("ml", "1000"), "lts": ("ml", "1000"), "litro": ("ml", "1000"), "litros": ("ml", "1000"), "liter": ("ml", "1000"), "liters": ("ml", "1000"),
    "gb": ("gb", "1"), "giga": ("gb", "1"), "gigas": ("gb", "1"), "gigabyte": ("gb", "1"), "gigabytes": ("gb", "1"), "tb": ("gb", "1024"), "tera": ("gb", "1024"), "teras": ("gb", "1024"),
    "w": ("w", "1"), "watt": ("w", "1"), "watts": ("w", "1"), "vatio": ("w", "1"), "vatios": ("w", "1"), "kw": ("w", "1000"), "kilowatt": ("w", "1000"), "kilowatts": ("w", "1000"),
    "mes": ("months", "1"), "meses": ("months", "1"), "month": ("months", "1"), "months": ("months", "1"), "ano": ("months", "12"), "anos": ("months", "12"), "year": ("months", "12"), "years": ("months", "12"),
    "u": ("units", "1"), "un": ("units", "1"), "und": ("units", "1"), "uni": ("units", "1"), "unid": ("units", "1"), "unidad": ("units", "1"), "unidades": ("units", "1"), "unidade": ("units", "1"), "pza": ("units", "1"), "pzas": ("units", "1"), "pieza": ("units", "1"), "piezas": ("units", "1"), "pcs": ("units", "1"), "unit": ("units", "1"), "units": ("units", "1"),
}


def attribute_key(col: Column) -> Column:
    """Case, blanks, hyphens and underscores don't count."""
    return F.upper(F.regexp_replace(F.regexp_replace(col, BLANKS, ""), "[-_]", ""))


def name_key(col: Column) -> Column:
    """Case, accents and punctuation don't count."""
    return F.regexp_replace(fold(col), NOT_WORD, "")


def _null_if_none(text: Column) -> Column:
    plain = squeeze(text)
    return F.when(~fold(plain).isin(NO_VALUE), plain)


def read_number(text: Column, unit: Column) -> Column:
    """Whole number in the base unit; null if the text isn't one."""
    t = fold(squeeze(text))
    pattern = r"^x?\s*([0-9]+(?:[.,][0-9]+)?)\s*([a-z]*)\.?$"
    digits = F.translate(F.regexp_extract(t, pattern, 1), ",", ".").try_cast("decimal(24,6)")
    spelled = F.regexp_extract(t, pattern, 2)
    bases = F.create_map(*(F.lit(x) for k, (base, _) in UNITS.items() for x in (k, base)))
    factors = F.create_map(*(F.lit(x) for k, (_, f) in UNITS.items() for x in (k, f)))
    times = F.when(spelled == "", F.lit("1")).when(F.try_element_at(bases, spelled) == unit, F.try_element_at(factors, spelled)).cast("decimal(10,3)")
    crossed = t.startswith("x") & (unit != "units")
    return F.when(~crossed, F.round(digits * times).try_cast("bigint"))


def read_flag(text: Column) -> Column:
    t = fold(squeeze(text))
    return F.when(t.isin(TRUE), F.lit("true")).when(t.isin(FALSE), F.lit("false"))


def read_list(items: Column) -> Column:
    """Distinct elements in lower case, sorted, joined by a comma; null if none is left."""
    clean = F.filter(F.transform(items, lambda x: F.lower(squeeze(x))), lambda x: x.isNotNull() & ~fold(x).isin(NO_VALUE))
    return F.when(F.size(clean) > 0, F.array_join(F.array_sort(F.array_distinct(clean)), ","))


def resolve(rows: DataFrame, defs: DataFrame) -> DataFrame:
    """Rows with the ``attr_id``, ``value_type`` and ``unit`` of their definition; others are dropped."""
    columns = defs.select("id", "name", "value_type", "unit").filter(F.col("id").isNotNull()).distinct()
    found = columns.limit(MAX_COLUMNS + 1).count()
    if found > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} attribute definitions")
    keyed = columns.select(F.concat(F.lit("i"), attribute_key(F.col("id"))).alias("_k"), F.struct("id", "value_type", "unit").alias("_def")).unionByName(
        columns.filter(F.col("name").isNotNull()).select(F.concat(F.lit("n"), name_key(F.col("name"))).alias("_k"), F.struct("id", "value_type", "unit").alias("_def"))
    )
    keyed = keyed.groupBy("_k").agg(F.min("_def").alias("_def"))
    without = F.coalesce(attribute_key(F.col("attr_key")), F.lit("")) == ""
    key = F.when(~without, F.concat(F.lit("i"), attribute_key(F.col("attr_key")))).otherwise(F.concat(F.lit("n"), name_key(F.col("attr_name"))))
    return rows.withColumn("_k", key).join(F.broadcast(keyed), "_k").select(
        "origin", "entity_id", F.col("_def.id").alias("attr_id"), F.col("_def.value_type").alias("value_type"), F.col("_def.unit").alias("unit"), "s", "n", "b", "a", "at", "tie"
    )


def read_cells(resolved: DataFrame) -> DataFrame:
    """``cell`` is the value as text if it can be read as the type, ``failed`` the text that can't be."""
    s, n, b, a = (F.col(c) for c in "snba")
    text = _null_if_none(s)
    whole = F.when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) < 9e15), F.when(n == F.floor(n), n.cast("decimal(20,0)").cast("string")).otherwise(n.cast("string")))
    joined = F.array_join(F.filter(a, lambda x: x.isNotNull()), ", ")
    any_text = F.coalesce(text, whole, b.cast("string"), _null_if_none(joined))
    number = F.coalesce(read_number(F.coalesce(text, _null_if_none(joined)), F.col("unit")), F.when(~F.isnan(n) & (F.abs(n) < 9e15), F.round(n).cast("bigint"))).cast("string")
    items = F.coalesce(F.split(text, r"[,;/|]"), a, F.array(whole), F.array(b.cast("string")))
    cell = (
        F.when(F.col("value_type") == "number", number)
        .when(F.col("value_type") == "flag", F.coalesce(b.cast("string"), read_flag(any_text)))
        .when(F.col("value_type") == "list", read_list(items))
        .otherwise(any_text)
    )
    return resolved.select("origin", "entity_id", "attr_id", "at", "tie", cell.alias("cell"), F.when(cell.isNull(), any_text).alias("failed"))


def gather(cells: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """One row per entity with ``cells`` as a map and ``cast_failures``; ``entities`` are kept without cells too."""
    if entities is not None:
        cells = cells.unionByName(entities.select("origin", "entity_id"), allowMissingColumns=True)
    place = F.struct(F.col("at"), F.col("tie"))
    one = cells.filter(F.col("entity_id").isNotNull()).groupBy("origin", "entity_id", "attr_id").agg(
        F.max(F.when(F.col("cell").isNotNull(), F.struct(place.alias("place"), F.col("cell")))).alias("good"),
        F.max(F.when(F.col("failed").isNotNull(), F.struct(place.alias("place"), F.col("failed")))).alias("bad"),
        F.count("failed").alias("n_bad"),
    )
    return one.groupBy("origin", "entity_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("good").isNotNull(), F.struct(F.col("attr_id"), F.col("good.cell").alias("cell"))))).alias("cells"),
        F.array_sort(F.collect_list(F.when(F.col("n_bad") > 0, F.struct("attr_id", F.col("bad.failed").alias("last_value"), F.col("n_bad").alias("n"))))).alias("cast_failures"),
    )


def project(gathered: DataFrame, defs: DataFrame) -> DataFrame:
    """One typed column per definition, named as its id in lower case."""
    out = []
    for r in sorted(defs.select("id", "value_type").filter(F.col("id").isNotNull()).distinct().limit(MAX_COLUMNS + 1).collect()):
        value = F.try_element_at(F.col("cells"), F.lit(r.id))
        typed = {"number": value.cast("bigint"), "flag": value.cast("boolean"), "list": F.split(value, ",")}.get(r.value_type, value)
        out.append(typed.alias(r.id.lower()))
    return gathered.select("origin", "entity_id", *out, "cast_failures")


def item_rows(item_attrs: DataFrame) -> DataFrame:
    none = F.lit(None)
    return item_attrs.select(F.lit("item").alias("origin"), F.col("item_id").alias("entity_id"), F.col("id").alias("attr_key"), F.col("name").alias("attr_name"), F.col("value_name").alias("s"), none.cast("double").alias("n"), none.cast("boolean").alias("b"), none.cast("array<string>").alias("a"), F.col("updated_at").alias("at"), F.col("row_id").alias("tie"))


def document_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("id").cast("string").alias("entity_id"), "loaded_at", F.explode("attributes").alias("k", "v")).select(F.lit("document").alias("origin"), "entity_id", F.col("k").alias("attr_key"), F.lit(None).cast("string").alias("attr_name"), "v.s", "v.n", "v.b", "v.a", F.col("loaded_at").alias("at"), F.lit(0).cast("bigint").alias("tie"))


def entities(item_attrs: DataFrame, docs: DataFrame) -> DataFrame:
    """``origin, entity_id`` of every row, also of those without any attribute."""
    return item_attrs.select(F.lit("item").alias("origin"), F.col("item_id").alias("entity_id")).unionByName(docs.select(F.lit("document").alias("origin"), F.col("id").cast("string").alias("entity_id"))).distinct()


def pivot(rows: DataFrame, defs: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Entities as a map of cells; see :func:`project` for the typed columns."""
    return gather(read_cells(resolve(rows, defs)), entities)


def unpivot(gathered: DataFrame) -> DataFrame:
    """One row for each filled cell."""
    return gathered.select("origin", "entity_id", F.explode("cells").alias("attr_id", "cell_value"))
