"""Document model and index schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import types as T

ATTRIBUTE = T.StructType([T.StructField("s", T.StringType()), T.StructField("n", T.DoubleType()), T.StructField("b", T.BooleanType()), T.StructField("a", T.ArrayType(T.StringType()))])
DOCUMENT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("category", T.StringType()),
    T.StructField("attributes", T.MapType(T.StringType(), ATTRIBUTE)),
])


class Language(str, Enum):
    ENGLISH = "en"
    SPANISH = "es"
    PORTUGUESE = "pt"


class FieldType(str, Enum):
    TEXT = "text"
    KEYWORD = "keyword"
    NUMERIC = "numeric"
    BOOLEAN = "boolean"


@dataclass(frozen=True)
class Analyzer:
    """``standard`` splits, lowers and, with a language, stems; ``keyword`` takes the whole text as one term.

    ``tokenizer`` takes a text column to an array of words, in place of the
    kind's own; ``filters`` take such an array to another, in turn, before
    stemming (stop words, synonyms).
    """

    kind: str = "standard"
    language: Language | None = None
    tokenizer: Callable[[Column], Column] | None = None
    filters: tuple[Callable[[Column], Column], ...] = ()


@dataclass(frozen=True)
class FieldConfig:
    name: str
    type: FieldType
    indexed: bool = False
    stored: bool = True
    filterable: bool = False
    aggregatable: bool = False
    boost: float = 1.0
    analyzer: Analyzer = Analyzer()


@dataclass(frozen=True)
class IndexSchema:
    fields: tuple[FieldConfig, ...] = field(default_factory=tuple)

    @staticmethod
    def default(language: Language | None = Language.SPANISH, attributes: tuple[FieldConfig, ...] = ()) -> IndexSchema:
        """Title (boost 2) and description as text, price, category, and any declared attributes."""
        text = Analyzer("standard", language)
        return IndexSchema((
            FieldConfig("title", FieldType.TEXT, indexed=True, boost=2.0, analyzer=text),
            FieldConfig("description", FieldType.TEXT, indexed=True, boost=1.0, analyzer=text),
            FieldConfig("price", FieldType.NUMERIC, filterable=True),
            FieldConfig("category", FieldType.KEYWORD, filterable=True, aggregatable=True),
            *attributes,
        ))

    @property
    def text_fields(self) -> list[FieldConfig]:
        """Only title and description hold text."""
        return [f for f in self.fields if f.type == FieldType.TEXT and f.indexed and f.name in ("title", "description")]

    @property
    def keyword_fields(self) -> list[FieldConfig]:
        return [f for f in self.fields if f.type == FieldType.KEYWORD and (f.filterable or f.aggregatable)]

    @property
    def numeric_fields(self) -> list[FieldConfig]:
        return [f for f in self.fields if f.type == FieldType.NUMERIC and f.filterable]

    @property
    def query_analyzer(self) -> Analyzer:
        """Of the first indexed text field; keyword if there is none."""
        return next((f.analyzer for f in self.fields if f.type == FieldType.TEXT and f.indexed), Analyzer("keyword"))
