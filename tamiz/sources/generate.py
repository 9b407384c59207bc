"""Seeded synthetic catalogues of any size (OP-15): every row depends on its number only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.schema import ATTRIBUTE

ADJECTIVES = ["liviano", "clásico", "portátil", "compacto", "resistente"]
NOUNS = ["teléfono", "auricular", "zapato", "monitor", "teclado", "mochila"]
BRANDS = ["Norte", "Alba", "Cumbre", "Ribera"]
COLORS = ["negro", "blanco", "azul", "rojo"]
CATEGORIES = ["electrónica", "hogar", "moda"]


def _pick(values: list[str], seed: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(len(values))) + 1).cast("int"))


def _unit(seed: int) -> Column:
    """Even in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / float(1 << 30)


def products(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """Documents with brand and color."""
    text = lambda c: F.struct(c.alias("s"), F.lit(None).cast("double").alias("n"), F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("array<string>").alias("a")).cast(ATTRIBUTE)
    title = F.concat_ws(" ", _pick(NOUNS, seed), _pick(ADJECTIVES, seed + 1), _pick(BRANDS, seed + 2), F.col("id").cast("string"))
    return spark.range(1, n + 1).select("id", title.alias("title"), F.concat(F.lit("Artículo "), _pick(ADJECTIVES, seed + 3)).alias("description"), F.round(5 + _unit(seed + 4) * 995, 2).alias("price"), _pick(CATEGORIES, seed + 5).alias("category"), F.create_map(F.lit("brand"), text(_pick(BRANDS, seed + 2)), F.lit("color"), text(_pick(COLORS, seed + 6))).alias("attributes"))


def items(spark: SparkSession, n: int, seed: int = 1, site: str = "QSA") -> DataFrame:
    """Catalogue items in the import format."""
    pair = lambda k, name, v: F.struct(F.lit(k).alias("id"), F.lit(name).alias("name"), v.alias("value_name"))
    title = F.concat_ws(" ", _pick(NOUNS, seed), _pick(BRANDS, seed + 2), _pick(COLORS, seed + 6))
    return spark.range(1, n + 1).select(
        F.concat(F.lit(site), (F.col("id") + 100_000_000).cast("string")).alias("id"), F.lit(site).alias("site_id"), title.alias("title"), F.round(5 + _unit(seed + 4) * 995, 2).alias("price"),
        F.concat(F.lit(site), (F.pmod(F.xxhash64(F.lit(seed + 5), "id"), F.lit(30)) + 1000).cast("string")).alias("category_id"), _pick(["new", "used"], seed + 7).alias("condition"),
        F.array(pair("BRAND", "Marca", _pick(BRANDS, seed + 2)), pair("COLOR", "Color", _pick(COLORS, seed + 6)), pair("MODEL", "Modelo", F.when(_unit(seed + 8) < 0.9, F.col("id").cast("string")))).alias("attributes"),
        F.lit("").alias("thumbnail"), _pick(["active", "paused"], seed + 9).alias("status"),
    )
