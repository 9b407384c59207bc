"""Occurrences and record counts of every distinct term (problem 1).

Method: vertical layout.  The records that hold a term are a compressed bitmap,
cut into chunks of ``CHUNK`` record identifiers; beside each chunk runs the
counter of occurrences.  Map tasks pack the rows they read into containers (the
smallest of array, runs and bits), only containers move, and those of a chunk
are merged by union.  Document frequency is read from the cardinality of the
merged containers; that of a whole field from a bitmap over all its terms, which
the same pass builds.

A term with a third of all rows is spread over as many chunks as there are
record identifiers / ``CHUNK``; a chunk never holds more than ``CHUNK``
positions however often its records repeat.

Defined results: null and contentless terms are no terms; rows without record
identifier count as occurrences but in no record; negative identifiers are
identifiers like others; an empty table has no terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 32768
TASK_ROWS = 500_000
_ARRAY, _RUNS, _BITS = 0, 1, 2


def encode(positions: np.ndarray) -> bytes:
    """Sorted distinct positions below ``CHUNK`` as the smallest container: two-byte cardinality - 1, kind, payload."""
    p = np.asarray(positions, dtype=np.uint16)
    head = int(len(p) - 1).to_bytes(2, "little")
    breaks = np.flatnonzero(np.diff(p.astype(np.int32)) != 1)
    starts = np.concatenate(([0], breaks + 1))
    ends = np.concatenate((breaks, [len(p) - 1]))
    sizes = {_ARRAY: 2 * len(p), _RUNS: 4 * len(starts), _BITS: CHUNK // 8}
    kind = min(sizes, key=lambda k: (sizes[k], k))
    if kind == _ARRAY:
        body = p.astype("<u2").tobytes()
    elif kind == _RUNS:
        body = np.column_stack((p[starts], p[ends])).astype("<u2").tobytes()
    else:
        bits = np.zeros(CHUNK, dtype=np.uint8)
        bits[p] = 1
        body = np.packbits(bits, bitorder="little").tobytes()
    return head + bytes([kind]) + body


def decode(container: bytes) -> np.ndarray:
    kind, body = container[2], container[3:]
    if kind == _ARRAY:
        return np.frombuffer(body, dtype="<u2")
    if kind == _RUNS:
        pairs = np.frombuffer(body, dtype="<u2").reshape(-1, 2).astype(np.int64)
        return np.concatenate([np.arange(a, b + 1) for a, b in pairs]).astype(np.uint16)
    return np.flatnonzero(np.unpackbits(np.frombuffer(body, dtype=np.uint8), bitorder="little")).astype(np.uint16)


def union(containers: list[bytes]) -> bytes:
    """Of at least one container."""
    if len(containers) == 1:
        return bytes(containers[0])
    return encode(np.unique(np.concatenate([decode(bytes(c)) for c in containers])))


def cardinality(container: bytes) -> int:
    return int.from_bytes(container[:2], "little") + 1


@F.pandas_udf(T.BinaryType())
def _union(containers: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in containers:
        yield batch.map(lambda cs: union(list(cs)) if len(cs) else None)


@F.pandas_udf(T.LongType())
def _cardinality(containers: pd.Series) -> pd.Series:
    return containers.map(lambda c: 0 if c is None else cardinality(c))


_NO_CHUNK = np.iinfo(np.int64).min
_LAYOUT = pa.schema([("field", pa.string()), ("term", pa.string()), ("chunk", pa.int64()), ("occurrences", pa.int64()), ("container", pa.binary())])


def _groups(codes: np.ndarray, chunk: np.ndarray, pos: np.ndarray) -> Iterator[tuple[int, int, int, bytes | None]]:
    """Of rows of one task: a row of the group, its chunk, occurrences and container."""
    order = np.lexsort((pos, chunk, codes))
    codes, chunk, pos = codes[order], chunk[order], pos[order]
    new = np.r_[True, (codes[1:] != codes[:-1]) | (chunk[1:] != chunk[:-1])]
    starts = np.flatnonzero(new)
    counts = np.diff(np.r_[starts, len(codes)])
    distinct = np.r_[True, pos[1:] != pos[:-1]] | new
    kept = pos[distinct].astype("<u2")
    ends = np.cumsum(np.add.reduceat(distinct, starts))
    packed, lo = kept.tobytes(), 0
    for first, c, n, hi in zip(order[starts].tolist(), chunk[starts].tolist(), counts.tolist(), ends.tolist()):
        if c == _NO_CHUNK:
            yield first, c, n, None
        elif hi - lo <= 2:  # so few are shortest as an array
            yield first, c, n, (hi - lo - 1).to_bytes(2, "little") + bytes([_ARRAY]) + packed[2 * lo : 2 * hi]
        else:
            yield first, c, n, encode(kept[lo:hi])
        lo = hi


def _pack(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches)
    field, term = (table[c].combine_chunks().dictionary_encode() for c in ("field", "term"))
    chunk = table["chunk"].fill_null(_NO_CHUNK).to_numpy()
    pos = table["pos"].fill_null(0).to_numpy()
    fields, terms = field.indices.to_numpy(), term.indices.to_numpy()
    for codes, named in ((fields * np.int64(len(term.dictionary)) + terms, True), (fields.astype(np.int64), False)):
        rows, chunks, counts, containers = zip(*_groups(codes, chunk, pos))
        rows = np.array(rows)
        yield pa.RecordBatch.from_arrays(
            [
                field.dictionary.take(pa.array(fields[rows])),
                term.dictionary.take(pa.array(terms[rows])) if named else pa.nulls(len(rows), pa.string()),
                pa.array([None if c == _NO_CHUNK else c for c in chunks], pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array(containers, pa.binary()),
            ],
            schema=_LAYOUT,
        )


def containers(tokens: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """``field, term, chunk, occurrences, container`` of the rows of each task, before any of them moves.

    A task packs ``rows`` rows at a time.  Rows with term null are of all terms
    of a field together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from _pack(held)
                held, n = [], 0
        if n:
            yield from _pack(held)

    placed = tokens.filter(F.col("term").isNotNull()).select(F.col("field").cast("string"), F.col("term").cast("string"), F.floor(F.col("rid") / CHUNK).cast("long").alias("chunk"), F.pmod("rid", F.lit(CHUNK)).cast("int").alias("pos"))
    return placed.mapInArrow(run, "field string, term string, chunk long, occurrences long, container binary")


def unite(parts: DataFrame) -> DataFrame:
    """One row of each field, term and chunk: bitmaps by union, counters by sum."""
    both = parts.groupBy("field", "term", "chunk").agg(F.sum("occurrences").alias("occurrences"), F.collect_list("container").alias("cs"))
    return both.select("field", "term", "chunk", "occurrences", _union("cs").alias("container"))


def build_index(tokens: DataFrame) -> DataFrame:
    """From ``field, term, rid`` the rows ``field, term, chunk, occurrences, container``."""
    return unite(containers(tokens))


def merge_indexes(one: DataFrame, two: DataFrame) -> DataFrame:
    """Union of two indexes, as of two loads."""
    return unite(one.unionByName(two))


def statistics(index: DataFrame) -> DataFrame:
    """``field, term, occurrences, records``; term null: of all terms of the field together."""
    return index.withColumn("card", _cardinality("container")).groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("card").alias("records"))


def records_of_fields(stats: DataFrame) -> DataFrame:
    """``field, field_records``: the records of a field that hold a term, as the cardinality of one bitmap over all its terms."""
    return stats.filter(F.col("term").isNull()).select("field", F.col("records").alias("field_records"))


def mark(stats: DataFrame, rare: int = 2, common: float = 0.2) -> DataFrame:
    """``finding``: rare in at most ``rare`` records, common in more than the share ``common`` of the field's records, else null.

    ``stats`` is read twice; write it first.
    """
    # one row a field: a fixed small number, broadcast
    joined = stats.filter(F.col("term").isNotNull()).join(F.broadcast(records_of_fields(stats)), "field", "left")
    finding = F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * F.col("field_records"), "common")
    return joined.select("field", "term", "occurrences", "records", finding.alias("finding"))
