"""What a caller asks for, and what comes back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame

from tamiz.functions.analysis import analyze
from tamiz.schema import IndexSchema, Language

MAX_QUERY_BYTES, MAX_LIMIT = 1024, 1000
MAX_PREFIX_BYTES, MAX_SUGGESTIONS, DEFAULT_SUGGESTIONS = 100, 20, 5


@dataclass(frozen=True)
class Eq:
    value: str


@dataclass(frozen=True)
class In:
    values: tuple[str, ...]


@dataclass(frozen=True)
class Range:
    gte: float | None = None
    lte: float | None = None


@dataclass(frozen=True)
class Sort:
    """Descending unless said otherwise."""

    field: str
    ascending: bool = False


@dataclass(frozen=True)
class SearchRequest:
    """``max_candidates`` keeps only so many best matches before facets and total (none: all); ``weigh_or`` multiplies the score of an OR match by its matched terms."""

    query: str = ""
    filters: dict[str, Eq | In | Range] = field(default_factory=dict)
    aggregations: tuple[str, ...] = ()
    sort: Sort | None = None
    offset: int = 0
    limit: int = 20
    typo_tolerance: bool = True
    language: str | None = None
    destination_zone: str | None = None
    include_docs: bool = False
    max_candidates: int | None = None
    weigh_or: bool = True

    def validated(self) -> SearchRequest:
        if len(self.query.encode()) > MAX_QUERY_BYTES:
            raise ValueError(f"the query is longer than {MAX_QUERY_BYTES} bytes")
        if not 0 <= self.limit <= MAX_LIMIT:
            raise ValueError(f"limit must be 0 to {MAX_LIMIT}")
        if self.offset < 0:
            raise ValueError("offset must not be negative")
        return self

    @staticmethod
    def from_json(d: dict[str, Any]) -> SearchRequest:
        """The JSON form: filters as ``{"eq": v}``, ``{"in": [..]}`` or ``{"gte": a, "lte": b}``; unknown keys are ignored."""

        def one(v: dict[str, Any]) -> Eq | In | Range:
            if "eq" in v:
                return Eq(v["eq"])
            return In(tuple(v["in"])) if "in" in v else Range(v.get("gte"), v.get("lte"))

        sort = d.get("sort")
        return SearchRequest(
            query=d.get("query", ""),
            filters={k: one(v) for k, v in d.get("filters", {}).items()},
            aggregations=tuple(d.get("aggregations", ())),
            sort=Sort(sort["field"], sort.get("order", "desc") == "asc") if sort else None,
            **{k: d[k] for k in ("offset", "limit", "typo_tolerance", "language", "destination_zone", "include_docs", "max_candidates", "weigh_or") if k in d},
        )


@dataclass
class SearchResult:
    """``hits`` are lazy; ``total`` and ``facets`` describe all matches, before paging and availability.

    ``release()`` frees what they share, once all that is wanted has been read.
    """

    hits: DataFrame
    facets: DataFrame
    total: DataFrame
    mode: str = "and"
    reranked: bool = False
    cache_hit: bool = False
    release: Callable[[], None] = lambda: None


# query understanding ------------------------------------------------------


@dataclass(frozen=True)
class ParsedQuery:
    original: str
    tokens: tuple[str, ...] = ()
    language: Language = Language.SPANISH
    boolean_mode: str = "and"
    transformations: tuple[str, ...] = ()


QueryAnalyzer = Callable[[ParsedQuery], ParsedQuery]


def tokens_of(schema: IndexSchema) -> QueryAnalyzer:
    """Terms by the analyzer of the first text field, in the query's language if one was set."""
    base = schema.query_analyzer

    def run(q: ParsedQuery) -> ParsedQuery:
        own = replace(base, language=q.language) if base.language and "language" in q.transformations else base
        return replace(q, tokens=tuple(analyze(q.original, own)), transformations=(*q.transformations, "tokens"))

    return run


def language_override(language: str | None) -> QueryAnalyzer:
    def run(q: ParsedQuery) -> ParsedQuery:
        return replace(q, language=Language(language), transformations=(*q.transformations, "language")) if language else q

    return run


@dataclass(frozen=True)
class Understanding:
    """An ordered list of analyzers."""

    steps: tuple[QueryAnalyzer, ...]

    @staticmethod
    def default(schema: IndexSchema, language: str | None = None) -> Understanding:
        return Understanding((language_override(language), tokens_of(schema)))

    def run(self, text: str) -> ParsedQuery:
        q = ParsedQuery(text)
        for step in self.steps:
            q = step(q)
        return q
