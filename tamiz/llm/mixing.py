"""Mixing sources to target weights (problem 8).

Method: weighted fair queueing.  Each text of a source is put in a random but
reproducible order; its virtual finish time is the running sum of the source's
tokens divided by the source's weight.  All texts are range-sorted by virtual
finish time and cut where their running sum reaches the budget.  A source that
may repeat queues its texts again, in another order, once the first pass is
through; since a pass begins where the one before ended, no text comes a second
time before all of its source came once.

Running sums are taken over slices of the order, never over a whole source in
one task; the number of slices follows the number of texts.

Equal texts are one text, whatever their ids; it belongs to the source of its
smallest id among the target sources, so it isn't used more than
``max_repeats`` times in the mixture.
Sources are compared without case and outer blanks.

Without a budget, the mixture is as large as it can be with every source that
has texts at its share: the least of ``tokens * max_repeats / share``.  Shares
of sources without texts can't be reached; the others keep their proportion.

Defined results: of two texts under one id the one of the lesser source counts;
null, empty and blank texts and texts without a target source
aren't used; a target share of 0 or null, or repeats below 1, means no use;
targets named twice add up, with the smaller number of repeats.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tamiz.operators.skew import running_sum
from tamiz.session import materialize, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern of that vocabulary, which splits a text before byte pairs merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLICE_ROWS, MIN_SLICES = 50_000, 4096
MAX_SOURCES = 10_000
_HASH_BITS = 62


def token_counter(path: str = TOKENIZER):
    """A vectorised column function: tokens of a text by a byte-level BPE of ranks at ``path``."""

    @F.pandas_udf(T.LongType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(path).encode_ordinary
        for batch in texts:
            yield batch.map(lambda t: 0 if t is None else len(encode(t))).astype("int64")

    return count


_LOADED: dict[str, object] = {}


def _encoding(path: str):
    if path not in _LOADED:
        import tiktoken

        with open(os.path.realpath(path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def source_key(col):
    return F.trim(F.regexp_replace(F.lower(col), r"[\s\x{a0}]+", " "))


def sized_texts(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, weight, max_repeats, tokens``: one row a distinct text of a target source."""
    wanted = (
        targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
        .filter((F.col("target_share") > 0) & (F.col("max_repeats") >= 1) & F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.sum("target_share").alias("weight"), F.min("max_repeats").cast("int").alias("max_repeats"))
    )
    if wanted.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    usable = docs.filter(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\s\x{a0}]"))
    # texts are sized where they are read and don't move; at most MAX_SOURCES rows are broadcast
    named = spread(usable.select("doc_id", source_key(F.col("source")).alias("source"), "text")).join(F.broadcast(wanted), "source")
    sized = named.select(F.unhex(F.md5("text")).alias("_h"), F.struct("doc_id", "source", "weight", "max_repeats", token_counter(tokenizer)("text").alias("tokens")).alias("x"))
    first = sized.groupBy("_h").agg(F.min("x").alias("x")).select("x.*").filter(F.col("tokens") > 0)
    rest = ["source", "weight", "max_repeats", "tokens"]
    return first.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("x")).select("doc_id", "x.*")


def mix(texts: DataFrame, budget: int | None = None, seed: int = 7) -> tuple[DataFrame, int]:
    """The mixture ``doc_id, source, use, tokens, finish`` in order of virtual finish time, and its budget.

    ``texts`` is the result of :func:`sized_texts`, materialised.
    """
    totals = texts.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count("*").alias("n"), F.max("tokens").alias("longest"), F.first("weight").alias("weight"), F.first("max_repeats").alias("max_repeats"))
    parts = totals.collect()  # one row a source of the mixture
    weights = math.fsum(r.weight for r in parts) or 1.0
    if budget is None:
        budget = int(min((r.source_tokens * r.max_repeats * weights / r.weight for r in parts), default=0))
    # the virtual time by which the budget is spent even if sources run dry
    end = _spent(budget, parts)
    spark = texts.sparkSession
    # by then every text that was begun at the end of the budget is through, so no later one can be taken
    last = end + max((r.longest for r in parts), default=0) / min((r.weight for r in parts), default=1.0)
    passes = [(r.source, r.source_tokens, min(r.max_repeats, math.floor(last * r.weight / r.source_tokens) + 1)) for r in parts]
    n_uses = sum(r.n * p for r, (_, _, p) in zip(parts, passes))
    slices = 1 << max(MIN_SLICES.bit_length() - 1, math.ceil(math.log2(max(1, n_uses / SLICE_ROWS))))
    plan = F.broadcast(spark.createDataFrame(passes, "source string, source_tokens long, passes int"))
    uses = texts.join(plan, "source").withColumn("use", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "use"), 64 - _HASH_BITS)
    uses = uses.withColumn("place", place)
    sliced = running_sum(uses, ["source", "use"], [F.col("place"), F.col("doc_id")], F.shiftright("place", _HASH_BITS - (slices.bit_length() - 1)), "tokens", "upto")
    timed = materialize(sliced.select("doc_id", "source", "use", "tokens", (((F.col("use") - 1) * F.col("source_tokens") + F.col("upto")) / F.col("weight")).alias("finish")), "finish")
    timed = timed.filter(F.col("finish") <= last)
    width = max(end, 1.0) / slices
    order = [F.col("finish"), F.col("source"), F.col("doc_id"), F.col("use")]
    whole = running_sum(timed, [], order, F.floor(F.col("finish") / width), "tokens", "mixed")
    return whole.filter(F.col("mixed") <= budget).select("doc_id", "source", "use", "tokens", "finish"), budget


def _spent(budget: int, parts: list) -> float:
    """Virtual time at which the sources together have given ``budget``, each at its weight until its uses are spent."""
    time, given = 0.0, 0.0
    for r in sorted(parts, key=lambda r: r.source_tokens * r.max_repeats / r.weight):
        active = [x for x in parts if x.source_tokens * x.max_repeats / x.weight > time]
        rate = sum(x.weight for x in active)
        dry = r.source_tokens * r.max_repeats / r.weight
        if rate and given + (dry - time) * rate >= budget:
            return time + (budget - given) / rate
        given, time = given + (dry - time) * rate, dry
    return time


def sorted_mixture(mixture: DataFrame) -> DataFrame:
    """Globally range-sorted by virtual finish time, as it is to be written."""
    n = max(1, int(mixture.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["finish", "source", "doc_id", "use"]
    return mixture.repartitionByRange(n, *order).sortWithinPartitions(*order)


def report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: share asked for, share of the sources that have texts, share reached, tokens, uses."""
    reached = mixture.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_uses"), F.max("use").alias("most_uses"))
    asked = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    joined = asked.join(reached, "source", "left").na.fill(0, ["tokens", "n_uses", "most_uses"])
    every = W.partitionBy()  # one row a source of the mixture
    return joined.select("source", "target_share", "max_repeats", "tokens", "n_uses", "most_uses", (F.col("tokens") / F.greatest(F.sum("tokens").over(every), F.lit(1))).alias("actual_share"), F.when(F.col("tokens") > 0, F.col("target_share") / F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).over(every)).otherwise(0.0).alias("reachable_share"))
