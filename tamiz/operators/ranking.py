"""After retrieval: re-ranking, availability, result cache (OP-92, 94 to 105, 122, 123)."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from dataclasses import dataclass, replace
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamiz.operators.filters import facets, ordered_facets
from tamiz.operators.index import Index
from tamiz.operators.search import even_score, hydrate, match, order_hits, release
from tamiz.plans.request import In, SearchRequest, SearchResult
from tamiz.session import materialize

POOL = 200


# rankers ------------------------------------------------------------------


class Ranker(Protocol):
    """Takes a query and candidates ``id, score, title, category, price, attributes``; returns ``id, score``, in its order or with ``rank``."""

    def rerank(self, query: str, candidates: pd.DataFrame) -> pd.DataFrame: ...


class NoopRanker:
    def rerank(self, query: str, candidates: pd.DataFrame) -> pd.DataFrame:
        return candidates[["id", "score"]]


@dataclass
class ExpressionRanker:
    """Scores by a column expression over the candidates; runs inside the plan."""

    expression: Column

    def apply(self, candidates: DataFrame) -> DataFrame:
        return candidates.withColumn("score", self.expression)


@dataclass
class FunctionRanker:
    """Any callable: a model, or a client of a remote service."""

    function: Callable[[str, pd.DataFrame], pd.DataFrame]

    def rerank(self, query: str, candidates: pd.DataFrame) -> pd.DataFrame:
        return self.function(query, candidates)


@dataclass
class BatchedRanker:
    """A remote service that takes ``batch`` candidates a call; calls run side by side, the answers are merged by score.

    Candidates a call doesn't answer for keep their place behind those it does.
    """

    function: Callable[[str, pd.DataFrame], pd.DataFrame]
    batch: int = 64
    calls: int = 4

    def rerank(self, query: str, candidates: pd.DataFrame) -> pd.DataFrame:
        parts = [candidates.iloc[i : i + self.batch] for i in range(0, len(candidates), self.batch)]
        with ThreadPoolExecutor(self.calls) as pool:
            answers = pd.concat([a[["id", "score"]] for a in pool.map(lambda p: self.function(query, p), parts)])
        answers = answers[answers["id"].isin(candidates["id"])].sort_values(["score", "id"], ascending=[False, True])
        left = candidates[~candidates["id"].isin(answers["id"])][["id", "score"]]
        return pd.concat([answers, left])


@dataclass
class ScoreRanker:
    """A guest function from scores to scores (all a sandboxed ranker sees), re-sorted by the new score."""

    function: Callable[[pd.Series], pd.Series]

    def rerank(self, query: str, candidates: pd.DataFrame) -> pd.DataFrame:
        out = candidates[["id"]].assign(score=self.function(candidates["score"]).astype(float).values)
        return out.sort_values(["score", "id"], ascending=[False, True])


class Breaker:
    """Opens after ``failures`` in a row, lets one call try again after ``seconds``; timeouts count as failures."""

    def __init__(self, ranker: Ranker, failures: int = 5, seconds: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.ranker, self.failures, self.seconds, self.clock = ranker, failures, seconds, clock
        self.count, self.opened = 0, 0.0

    def is_open(self) -> bool:
        return self.count >= self.failures and self.clock() - self.opened < self.seconds

    def succeeded(self) -> None:
        self.count = 0

    def failed(self) -> None:
        self.count += 1
        self.opened = self.clock()

    def rerank(self, query: str, candidates: pd.DataFrame) -> pd.DataFrame:
        if self.is_open():
            raise RuntimeError("the ranker's circuit is open")
        return self.ranker.rerank(query, candidates)


def make_ranker(kind: str = "noop", **options) -> Ranker:
    """``noop``, ``remote`` (a callable behind a breaker, in batches if ``batch`` is given), ``score`` (scores only)."""
    if kind == "noop":
        return NoopRanker()
    if kind == "remote":
        inner = BatchedRanker(options["function"], options["batch"]) if "batch" in options else FunctionRanker(options["function"])
        return Breaker(inner, options.get("failures", 5), options.get("seconds", 30.0))
    if kind == "score":
        return ScoreRanker(options["function"])
    raise ValueError(f"no such ranker: {kind}")


def rerank_or_keep(ranker: Ranker, query: str, candidates: pd.DataFrame, seconds: float) -> tuple[pd.DataFrame, bool]:
    """The ranker's list in its own order, or the candidates as they are if it fails or takes too long."""
    kept = candidates[["id", "score"]]
    if isinstance(ranker, NoopRanker) or not len(candidates):
        return kept, False
    pool = ThreadPoolExecutor(1)
    try:
        out = pool.submit(ranker.rerank, query, candidates).result(timeout=seconds)[["id", "score"]]
        if isinstance(ranker, Breaker):
            ranker.succeeded()
        return out, True
    except (Exception, FutureTimeout):  # noqa: BLE001 - a ranker may fail in any way
        if isinstance(ranker, Breaker):
            ranker.failed()
        return kept, False
    finally:
        pool.shutdown(wait=False)


# availability -------------------------------------------------------------


class NoopAvailability:
    multiplier = 1

    def apply(self, hits: DataFrame, documents: DataFrame, zone: str) -> DataFrame:
        return hits


@dataclass
class AttributeAvailability:
    """Keeps hits whose attribute ``prefix + zone`` is at least ``minimum``; what can't be read counts as ``default``."""

    prefix: str = "stock_"
    default: bool = True
    minimum: float = 1.0
    multiplier: int = 3

    def apply(self, hits: DataFrame, documents: DataFrame, zone: str) -> DataFrame:
        attr = F.try_element_at(documents["attributes"], F.lit(self.prefix + zone))
        stock = documents.select("id", F.coalesce(attr["n"], attr["s"].try_cast("double")).alias("_stock"))
        joined = hits.join(stock, "id", "left")
        return joined.filter(F.coalesce(F.col("_stock") >= self.minimum, F.lit(self.default))).drop("_stock")


@dataclass
class AllowListAvailability:
    """Keeps the ids that a provider names; if it fails, all are kept.  ``provider(zone)`` gives a table with ``id``."""

    provider: Callable[[str], DataFrame]
    multiplier: int = 3

    def apply(self, hits: DataFrame, documents: DataFrame, zone: str) -> DataFrame:
        try:
            allowed = self.provider(zone).select("id").distinct()
        except Exception:  # noqa: BLE001 - fail open
            return hits
        return hits.join(allowed, "id", "left_semi")


# cache --------------------------------------------------------------------


class QueryCache:
    """Result pools by request, for ``seconds``, at most ``entries`` (the least used go first)."""

    def __init__(self, entries: int = 10_000, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.entries, self.seconds, self.clock = entries, seconds, clock
        self._held: OrderedDict[tuple, tuple[float, object]] = OrderedDict()
        self.hits = self.misses = 0

    @staticmethod
    def key(r: SearchRequest) -> tuple:
        """Everything that changes the pool: not the page, not whether documents come along."""
        filters = tuple(sorted((k, ("in", tuple(sorted(f.values))) if isinstance(f, In) else (type(f).__name__, f)) for k, f in r.filters.items()))
        return r.query, tuple(map(repr, filters)), r.aggregations, r.sort, r.typo_tolerance, r.language, r.destination_zone, r.max_candidates, r.weigh_or

    def get(self, r: SearchRequest):
        k = self.key(r)
        held = self._held.get(k)
        if held and self.clock() - held[0] < self.seconds:
            self._held.move_to_end(k)
            self.hits += 1
            return held[1]
        self._held.pop(k, None)
        self.misses += 1
        return None

    def put(self, r: SearchRequest, value) -> None:
        self._held[self.key(r)] = (self.clock(), value)
        self._held.move_to_end(self.key(r))
        while len(self._held) > self.entries:
            self._held.popitem(last=False)

    def __len__(self) -> int:
        return len(self._held)


# the whole pipeline ---------------------------------------------------------


class Searcher:
    """Retrieval, then re-rank a bounded pool, availability, cache, page, hydrate."""

    def __init__(self, index: Index, ranker: Ranker | None = None, availability=None, cache: QueryCache | None = None, pool: int = POOL, seconds: float = 0.03):
        self.index, self.ranker, self.availability, self.cache, self.pool, self.seconds = index, ranker or NoopRanker(), availability or NoopAvailability(), cache, pool, seconds

    def search(self, request: SearchRequest) -> SearchResult:
        request = request.validated()
        held = self.cache.get(request) if self.cache is not None else None
        if held is not None:
            return self._page(replace(held, cache_hit=True), request)
        matched, mode = match(self.index, request)
        ordered = order_hits(self.index, matched, request)
        noop = isinstance(self.ranker, NoopRanker)
        if isinstance(self.ranker, ExpressionRanker):
            pool = hydrate(ordered.limit(self.pool * self.availability.multiplier), self.index.documents)
            ordered, reranked = self.ranker.apply(pool).select("id", "score").orderBy(F.desc(even_score()), "id"), True
        elif noop:
            reranked = False
        else:
            pool = hydrate(ordered.limit(self.pool * self.availability.multiplier), self.index.documents).orderBy(F.desc(even_score()), "id").toPandas()  # at most the pool
            ranked, reranked = rerank_or_keep(self.ranker, request.query, pool, self.seconds)
            rows = [(int(i), float(s), n) for n, (i, s) in enumerate(zip(ranked["id"], ranked["score"]))]
            schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("rank", T.LongType())])
            ordered = self.index.documents.sparkSession.createDataFrame(rows, schema).orderBy("rank")
        if request.destination_zone:
            ordered = self.availability.apply(ordered, self.index.documents, request.destination_zone)
            ordered = ordered.orderBy("rank") if "rank" in ordered.columns else order_hits(self.index, ordered.select("id", "score"), request)
        result = SearchResult(ordered, ordered_facets(facets(matched, self.index.columns, self.index.schema, request.aggregations)), matched.agg(F.count("*").alias("total_hits")), mode, reranked, release=lambda: release(matched))
        if self.cache is not None:
            spark = self.index.documents.sparkSession
            bounded = ordered.limit(max(self.pool * self.availability.multiplier, request.offset + request.limit))
            order = [c for c in ("sort_value", "rank") if c in bounded.columns]
            rows = bounded.select("id", "score", *order).collect()  # the pool, or what the page needs
            fixed = spark.createDataFrame([(r.id, float(r.score), n) for n, r in enumerate(rows)], "id long, score double, rank long").orderBy("rank")
            # facets aren't bounded by the page, so they go to a table and not to the driver
            counts = materialize(result.facets, "facets") if request.aggregations else result.facets
            total = spark.createDataFrame(result.total.collect(), result.total.schema)
            self.cache.put(request, SearchResult(fixed, ordered_facets(counts) if request.aggregations else counts, total, mode, reranked))
        return self._page(result, request)

    def _page(self, result: SearchResult, request: SearchRequest) -> SearchResult:
        page = result.hits.offset(request.offset).limit(request.limit)
        return replace(result, hits=hydrate(page, self.index.documents) if request.include_docs else page)
