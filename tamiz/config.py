"""Settings as plain dataclasses, from a dict or a JSON or YAML file; unknown keys are ignored."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, get_type_hints

from tamiz.operators.index import Index
from tamiz.operators.ranking import AttributeAvailability, NoopAvailability, QueryCache, Searcher, make_ranker


@dataclass
class RankerConfig:
    kind: str = "noop"
    candidates: int = 200
    timeout_ms: int = 30


@dataclass
class AvailabilityConfig:
    strategy: str = "noop"
    stock_attribute_prefix: str = "stock_"
    default_available: bool = True
    min_stock: float = 1.0


@dataclass
class CacheConfig:
    enabled: bool = False
    ttl_seconds: float = 60.0
    max_entries: int = 10_000


@dataclass
class SuggestConfig:
    fields: list[str] = field(default_factory=lambda: ["title"])
    min_doc_frequency: int = 2
    max_terms: int = 50_000
    flush_seconds: int = 5


@dataclass
class StorageConfig:
    buffer_bytes: int = 64 << 20
    shards: int = 1


@dataclass
class Config:
    ranker: RankerConfig = field(default_factory=RankerConfig)
    availability: AvailabilityConfig = field(default_factory=AvailabilityConfig)
    query_cache: CacheConfig = field(default_factory=CacheConfig)
    suggest: SuggestConfig = field(default_factory=SuggestConfig)
    storage: StorageConfig = field(default_factory=StorageConfig)

    @staticmethod
    def from_dict(d: dict[str, Any]) -> Config:
        return _fill(Config, d)

    @staticmethod
    def load(path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith((".yaml", ".yml")):
            import yaml  # optional

            return Config.from_dict(yaml.safe_load(text) or {})
        return Config.from_dict(json.loads(text))

    def searcher(self, index: Index, **ranker_options) -> Searcher:
        availability = AttributeAvailability(self.availability.stock_attribute_prefix, self.availability.default_available, self.availability.min_stock) if self.availability.strategy == "static" else NoopAvailability()
        cache = QueryCache(self.query_cache.max_entries, self.query_cache.ttl_seconds) if self.query_cache.enabled else None
        return Searcher(index, make_ranker(self.ranker.kind, **ranker_options), availability, cache, self.ranker.candidates, self.ranker.timeout_ms / 1000)


def _fill(kind: type, d: dict[str, Any]):
    hints = get_type_hints(kind)
    return kind(**{f.name: _fill(hints[f.name], d[f.name]) if is_dataclass(hints[f.name]) else d[f.name] for f in fields(kind) if f.name in d})
