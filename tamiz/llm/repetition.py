"""Repetition within a document (problem 9).

:func:`repeated_share` measures it: a word is repeated if it lies in a run of
``run`` words that already started at an earlier place of the same text.  One
pass over each text, linear in its words.

:func:`line_filter` is the corpus method: lines are normalised and hashed, the
distinct documents that hold a line are counted per host, lines above the limit
are removed, and documents left with too little are rejected.  It sees what
repeats across documents and can't see what repeats within one.

Defined results: null, empty and wordless texts have no words and the share 0;
texts below ``run`` words have no run; equal ids stay rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.functions.text import NOT_WORD
from tamiz.operators.skew import join_lookup
from tamiz.session import materialize, spread

RUN = 5
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def count_repeated(words: list[str], run: int = RUN) -> int:
    """Words that lie in a run that already started at an earlier place."""
    seen: set[tuple[str, ...]] = set()
    covered, upto = 0, 0
    for i, gram in enumerate(zip(*(words[k:] for k in range(run)))):
        if gram in seen:
            covered += i + run - max(upto, i)
            upto = i + run
        else:
            seen.add(gram)
    return covered


def repeated_share(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """``key, n_words, n_repeated, share`` of every document."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, r = [], []
            for t in b["_text"]:
                words = _WORD.findall(t.lower()) if t else []
                n.append(len(words))
                r.append(count_repeated(words, run))
            yield pd.DataFrame({key: b[key], "n_words": pd.Series(n, dtype="int64"), "n_repeated": pd.Series(r, dtype="int64")})

    kind = docs.schema[key].dataType.simpleString()
    measured = spread(docs.select(key, F.col(text).alias("_text"))).mapInPandas(measure, f"{key} {kind}, n_words bigint, n_repeated bigint")
    return measured.withColumn("share", F.when(F.col("n_words") > 0, F.col("n_repeated") / F.col("n_words")).otherwise(F.lit(0.0)))


def line_filter(docs: DataFrame, host: str | None, key: str = "doc_id", text: str = "text", limit: int = 3, keep_share: float = 0.5) -> DataFrame:
    """``key, n_lines, n_removed, kept_share, rejected``: lines in more than ``limit`` documents of a host are removed.

    Without ``host`` the whole corpus is one.  A document with less than ``keep_share`` of its line characters left is
    rejected; one without lines is not.
    """
    lines = (
        docs.select(key, (F.lit("") if host is None else F.coalesce(F.col(host).cast("string"), F.lit(""))).alias("_host"), F.explode_outer(F.split(F.col(text), r"\R")).alias("_line"))
        .withColumn("_line", F.trim(F.regexp_replace(F.lower("_line"), NOT_WORD, " ")))
        .filter(F.col("_line") != "")
        .select(key, "_host", F.unhex(F.md5("_line")).alias("_hash"), F.length("_line").alias("_size"))
    )
    # the first grouping combines map-side and spreads a hot line by document; the second gets one row a document and line
    # written, since it is read three times and its plan would be pruned and filtered into three
    per_doc = materialize(lines.groupBy("_host", "_hash", key).agg(F.count("*").alias("_n"), F.first("_size").alias("_size")), "lines")
    held = per_doc.groupBy("_host", "_hash").agg(F.count("*").alias("_docs")).filter(F.col("_docs") > limit)
    total = per_doc.count()  # a third of these may hold one line
    marked = join_lookup(per_doc, held, ["_host", "_hash"], "_docs", total, "left")
    sums = marked.groupBy(key).agg(
        F.sum("_n").alias("n_lines"),
        F.sum(F.when(F.col("_docs").isNotNull(), F.col("_n")).otherwise(0)).alias("n_removed"),
        F.sum(F.col("_n") * F.col("_size")).alias("_all"),
        F.sum(F.when(F.col("_docs").isNull(), F.col("_n") * F.col("_size")).otherwise(0)).alias("_kept"),
    )
    share = F.col("_kept") / F.col("_all")
    return sums.select(key, "n_lines", "n_removed", share.alias("kept_share"), (share < keep_share).alias("rejected"))
