"""Evaluation passages inside a corpus (problem 7).

Method: pigeonhole edit matching.  The passages to find are all stretches of
``window`` consecutive words of an item.  With a budget of ``edits`` word edits
a stretch is split into ``edits + 1`` pieces; a place of a document within the
budget must contain one of them unchanged.  The pieces of all items are looked
up in every document, and each hit is verified by the bit-parallel edit
distance (Myers) of its stretch against the words around the hit.

The items are the stated query set.  Their pieces go to all tasks in blocks of
about ``BLOCK_WORDS`` words, so what is sent is bounded however many items
there are (a single item isn't cut); every block meets all documents.

Defined results: texts are compared as words (letters and digits, lower case,
base letters); items of fewer than ``window`` words and null texts match
nothing; items of equal words come out together; a document row comes out once
per item whatever its repetitions; equal document ids are merged.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.session import spread

WINDOW = 10
BLOCK_WORDS = 500_000
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_MARK = regex.compile(r"\p{M}+")


def normal_words(text: str | None) -> list[str]:
    if not text:
        return []
    t = text.lower()
    if not t.isascii():
        t = _MARK.sub("", unicodedata.normalize("NFD", t))
    return _WORD.findall(t)


def myers_nearest(pattern: list[str], text: list[str]) -> int:
    """Least edit distance, in words, of ``pattern`` to any stretch of ``text``."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for w in text:
        eq = masks.get(w, 0)
        vert = eq | minus
        horiz = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horiz | plus))
        down = plus & horiz
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full  # no carry into the first row: a match may start anywhere
        plus = down | (full & ~(vert | up))
        minus = up & vert
        if score < best:
            best = score
    return best


def split_pieces(window: int, edits: int) -> list[tuple[int, int]]:
    """``edits + 1`` stretches, as even as can be, that cover the window."""
    n = edits + 1
    bounds = [window * k // n for k in range(n + 1)]
    return list(zip(bounds, bounds[1:]))


class Matcher:
    """Finds, in one document's words, the items of a block."""

    def __init__(self, items: list[list[str]], window: int = WINDOW, edits: int = 1):
        self.items, self.window, self.edits = items, window, edits
        self.pieces = split_pieces(window, edits)
        self.sizes = sorted({b - a for a, b in self.pieces})
        self.table: dict[tuple[str, ...], list[tuple[int, int, int]]] = {}
        for k, words in enumerate(items):
            for start in range(len(words) - window + 1):
                for a, b in self.pieces:
                    self.table.setdefault(tuple(words[start + a : start + b]), []).append((k, start, a))

    def find(self, words: list[str]) -> dict[int, tuple[int, int]]:
        """Item to (least distance, stretches of the item within the budget)."""
        hits: dict[tuple[int, int], set[int]] = {}
        for size in self.sizes:
            for p, gram in enumerate(zip(*(words[i:] for i in range(size)))):
                for k, start, a in self.table.get(gram, ()):
                    hits.setdefault((k, start), set()).add(p - a)  # where the stretch would begin
        found: dict[int, list[int]] = {}
        for (k, start), places in hits.items():
            pattern = self.items[k][start : start + self.window]
            best = self.window
            for at in places:
                lo, hi = max(0, at - self.edits), at + self.window + self.edits
                best = min(best, myers_nearest(pattern, words[lo:hi]))
                if best == 0:
                    break
            if best <= self.edits:
                entry = found.setdefault(k, [best, 0])
                entry[0] = min(entry[0], best)
                entry[1] += 1
        return {k: (d, n) for k, (d, n) in found.items()}


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, edits: int = 1, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id, distance, n_stretches, item_stretches`` of every document and item within the budget."""
    spark = docs.sparkSession
    sized = items.select("item_id", "text").filter(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    total = sized.agg(F.coalesce(F.sum(F.length("text") / 2 + 1), F.lit(0.0))).first()[0]
    blocks = max(1, int(-(-total // block_words)))
    key = docs.schema["doc_id"].dataType.simpleString()
    ikey = items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {key}, item_id {ikey}, distance int, n_stretches int, item_stretches int"
    parts = []
    for block in range(blocks):
        rows = sized.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # at most a block
        by_words: dict[tuple[str, ...], list] = {}
        for r in rows:
            words = tuple(normal_words(r.text))
            if len(words) >= window:
                by_words.setdefault(words, []).append(r.item_id)
        texts = [list(w) for w in by_words]
        if not texts and block:
            continue
        sent = spark.sparkContext.broadcast((texts, [sorted(set(v)) for v in by_words.values()]))
        parts.append(spread(docs.select("doc_id", "text").filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull())).mapInPandas(_searcher(sent, window, edits), schema))
    merged = reduce(DataFrame.unionByName, parts)
    return merged.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("n_stretches").alias("n_stretches"), F.first("item_stretches").alias("item_stretches"))


def _searcher(sent, window: int, edits: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, ids = sent.value
        matcher = Matcher(texts, window, edits)
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"]):
                for k, (distance, n) in matcher.find(normal_words(text)).items():
                    out += [(doc, i, distance, n, len(texts[k]) - window + 1) for i in ids[k]]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "distance", "n_stretches", "item_stretches"])

    return search
