"""Analyzers as column expressions (OP-35 to 39, 119, 120), and the same for a query on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tamiz.functions.stemmers import STEMMERS
from tamiz.functions.text import keyword_tokens, lower_tokens, tokenize, tokenize_python
from tamiz.schema import Analyzer


def term_array(col: Column, analyzer: Analyzer) -> Column:
    """Terms of a text, not yet stemmed."""
    if analyzer.tokenizer is not None:
        words = analyzer.tokenizer(col)
    else:
        words = keyword_tokens(col) if analyzer.kind == "keyword" else lower_tokens(tokenize(col))
    return reduce(lambda array, f: f(array), analyzer.filters, words)


def analyze(text: str, analyzer: Analyzer) -> list[str]:
    """The terms of one text, as the index holds them; own tokenizers and filters are columns, so those run as a plan."""
    if analyzer.tokenizer is not None or analyzer.filters:
        session = SparkSession.active()
        words = session.createDataFrame([(text,)], "t string").select(term_array(F.col("t"), analyzer)).first()[0] or []
    elif analyzer.kind == "keyword":
        words = [text] if text else []
    else:
        words = [t.lower() for t in tokenize_python(text)]
    stems = analyzer.language and analyzer.kind != "keyword"
    return [STEMMERS[analyzer.language.value](w) for w in words] if stems else list(words)
