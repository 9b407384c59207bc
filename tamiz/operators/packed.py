"""Many queries over packed blocks of documents.

A block holds the postings of up to ``BLOCK`` documents, a chunk up to
``CHUNK`` queries with the expansions of their terms; both are one compressed
binary, so that each pair of them is scored in the memory of one task, and of
its pairs of query and document only the best leave it.

Sums of all documents are made in single precision, for a lower bound of the
k-th best score; what may reach it, by the error of those sums, is scored again
in double precision.  Nothing is left out that could be among the best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.functions.analysis import term_array
from tamiz.functions.stemmers import STEMMERS
from tamiz.schema import IndexSchema
from tamiz.session import materialize

BLOCK, CHUNK = 16_384, 131_072
LEAST_BLOCK = 2_048  # smaller blocks don't pay for more tasks
BLOCK_TERMS = 8_000_000  # a block of long texts ends before it has BLOCK documents
DENSE, DENSE_BYTES = 12, 200_000_000  # a term in one document of 12 is added as a whole vector, as long as those vectors fit
GROUP = 64
SHARED = 4  # so many dense terms of a query are summed once for its neighbours
FLUSH = 200_000
HEAD = 3
RESULT = "qid long, id long, score double, mode string"


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers in their least width, compressed."""
    out = BytesIO()
    least = lambda a: a.astype(np.min_scalar_type(int(a.max()))) if a.size and a.dtype.kind in "iu" and a.min() >= 0 else a
    np.savez(out, **{k: least(a) for k, a in arrays.items()})
    raw = out.getbuffer()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> dict[str, np.ndarray]:
    with np.load(BytesIO(pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True))) as arrays:
        return dict(arrays)


def _from_words(name: str, words: list[str]) -> dict[str, np.ndarray]:
    encoded = [w.encode() for w in words]
    return {f"{name}_bytes": np.frombuffer(b"".join(encoded), np.uint8), f"{name}_sizes": np.fromiter(map(len, encoded), np.int64, len(encoded))}


def _to_words(name: str, arrays: dict[str, np.ndarray]) -> list[str]:
    data, ends = arrays[f"{name}_bytes"].tobytes(), np.cumsum(arrays[f"{name}_sizes"], dtype=np.int64)
    return [data[a:b].decode() for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]


@dataclass
class Packed:
    """``blocks(packed)`` and ``vocabulary(term, df)``; ``lengths``: average length by field."""

    blocks: DataFrame
    vocabulary: DataFrame
    n_docs: int
    lengths: tuple[float, ...]


def pack(docs: DataFrame, schema: IndexSchema) -> Packed:
    """Documents are shuffled by id, so that rows of the same id meet, and analyzed once; no posting is shuffled."""
    fields = schema.text_fields
    n = docs.count()
    parts = max(-(-n // BLOCK), min(docs.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_BLOCK)), 1)
    terms = docs.select("id", *(f.name for f in fields)).repartition(parts, "id").sortWithinPartitions("id").select("id", *(term_array(F.col(f.name), f.analyzer).alias(f"_{i}") for i, f in enumerate(fields)))
    stems = [STEMMERS[f.analyzer.language.value] if f.analyzer.language and f.analyzer.kind != "keyword" else None for f in fields]
    titles = [i for i, f in enumerate(fields) if f.name == "title"]
    blocks = materialize(terms.mapInArrow(_packer(stems, titles), "packed binary, words binary, n long, lengths array<long>"), "blocks")
    vocabulary = materialize(blocks.select("words").mapInArrow(_words, "term string, n long").groupBy("term").agg(F.sum("n").alias("df")), "vocabulary")
    sums = blocks.agg(*(F.sum(F.element_at("lengths", i + 1)) for i in range(len(fields)))).first() if fields else ()
    return Packed(blocks.select("packed"), vocabulary, n, tuple((x or 0) / max(n, 1) for x in sums))


def _packer(stems: list[Callable[[str], str] | None], titles: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = rows = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, LEAST_BLOCK)
                at += part.num_rows
                if rows >= 2 * BLOCK or size > BLOCK_TERMS:  # rows come in order of ids: those of one id stay together
                    last = held[-1].column(0)[-1].as_py()
                    cut = next((i for i, x in enumerate(part.column(0).to_pylist()) if x != last), part.num_rows)
                    held.append(part.slice(0, cut))
                    if cut < part.num_rows:
                        yield _block(held, stems, titles)
                        held, size, rows = [], 0, 0
                    part = part.slice(cut)
                held.append(part)
                rows += part.num_rows
                size += sum(len(c.flatten()) for c in part.columns[1:])
                held = [x for x in held if x.num_rows]
        if held:
            yield _block(held, stems, titles)

    return run


def _block(held: list[pa.RecordBatch], stems: list[Callable[[str], str] | None], titles: list[int]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    n_fields = table.num_columns - 1
    ids, doc_of_row = _numbered(table.column(0).combine_chunks())
    n_docs = len(ids)
    words: dict[str, int] = {}
    keys, fields, positions, sizes = [], [], [], []
    for f in range(n_fields):
        column = table.column(f + 1).combine_chunks()
        length = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        coded = column.flatten().dictionary_encode()
        stem = stems[f] or (lambda w: w)
        local = np.fromiter((-1 if w is None else words.setdefault(stem(w), len(words)) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        codes = coded.indices
        term = np.append(local, -1)[codes.fill_null(len(local)).to_numpy(zero_copy_only=False)]
        pos = (np.arange(len(term)) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32)
        ok = term >= 0
        keys.append((term * n_docs + np.repeat(doc_of_row, length))[ok])
        fields.append(np.full(len(keys[-1]), f, np.int8))
        positions.append(pos[ok])
        sizes.append(np.repeat(length.astype(np.int32), length)[ok])
    both, field = np.concatenate([np.empty(0, np.int64), *keys]), np.concatenate([np.empty(0, np.int8), *fields])
    entries, at = np.unique(both, return_inverse=True)  # one of each term and document
    tf = np.stack([np.bincount(at[field == f], minlength=len(entries)) for f in range(n_fields)]) if n_fields else np.empty((0, len(entries)), np.int64)
    dl = np.stack([_longest(at[field == f], sizes[f], len(entries)) for f in range(n_fields)]) if n_fields else tf
    head = np.zeros(len(entries), np.int64)
    for f in titles:
        head[at[field == f][positions[f] < HEAD]] = 1
    term, doc = entries // max(n_docs, 1), entries % max(n_docs, 1)
    starts = np.searchsorted(term, np.arange(len(words) + 1))
    by_doc = len(ids) == len(doc_of_row)
    if by_doc:  # a field of a document has one length
        dl = np.stack([_longest(doc, x, n_docs) for x in dl]) if n_fields else dl
    null = np.array([i for i, x in enumerate(ids) if x is None], np.int64)
    vocabulary = _from_words("term", list(words))
    packed = _pack(ids=np.array([x or 0 for x in ids], np.int64), null=null, by_doc=np.array([by_doc]), doc=doc, tf=tf, dl=dl, head=head, starts=starts, **vocabulary)
    lengths = tf.sum(axis=1).tolist()
    return pa.record_batch([pa.array([packed], pa.binary()), pa.array([_pack(n=np.diff(starts), **vocabulary)], pa.binary()), pa.array([table.num_rows], pa.int64()), pa.array([lengths], pa.list_(pa.int64()))], names=["packed", "words", "n", "lengths"])


def _longest(at: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.maximum.at(out, at, sizes)
    return out


def _numbered(ids: pa.Array) -> tuple[list[int | None], np.ndarray]:
    """Distinct ids, null among them, and the number of each row's."""
    coded = ids.dictionary_encode(null_encoding="encode")
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed in batch.column(0):
            x = _unpack(packed.as_py())
            yield pa.record_batch([pa.array(_to_words("term", x), pa.string()), pa.array(x["n"].astype(np.int64))], names=["term", "n"])


def chunks(terms: DataFrame, matches: DataFrame, n_queries: int) -> DataFrame:
    """``packed``: the queries of ``terms(qid, q)``, one row a position, in chunks beside what ``matches`` says of their terms."""
    parts = max(1, -(-n_queries // CHUNK))
    placed = terms.filter(F.col("qid").isNotNull()).select("qid", "q", F.pmod(F.xxhash64("qid"), F.lit(parts)).alias("chunk"))
    needed = placed.select("chunk", "q").distinct().join(matches, "q").select(F.col("chunk").alias("at"), F.col("q").alias("word"), "term", "e", "p", "f", "df")
    return materialize(placed.groupBy("chunk").cogroup(needed.groupBy("at")).applyInArrow(_chunk, "packed binary"), "chunks")


def _chunk(asked: pa.Table, matched: pa.Table) -> pa.Table:
    words: dict[str, int] = {}

    def coded(table: pa.Table, name: str) -> np.ndarray:
        column = table.column(name).combine_chunks().dictionary_encode()
        return np.fromiter((words.setdefault(w, len(words)) for w in column.dictionary.to_pylist()), np.int64, len(column.dictionary))[column.indices.to_numpy(zero_copy_only=False)]

    qids, query = np.unique(asked.column("qid").to_numpy(), return_inverse=True)
    q = coded(asked, "q")
    pairs, times = np.unique(query * (len(words) + 1) + q, return_counts=True)
    query, q = pairs // (len(words) + 1), pairs % (len(words) + 1)
    mq, term = coded(matched, "word"), coded(matched, "term")
    flags = [matched.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in "epf"] if matched.num_rows else [np.empty(0, np.int64)] * 3
    order = np.argsort(mq, kind="stable")
    packed = _pack(qids=qids, starts=np.searchsorted(query, np.arange(len(qids) + 1)), q=q, times=times, mq=mq[order], term=term[order], df=matched.column("df").to_numpy()[order].astype(np.int64), **{c: x[order] for c, x in zip("epf", flags)}, **_from_words("word", list(words)))
    return pa.table({"packed": pa.array([packed], pa.binary())})


@dataclass(frozen=True)
class Scoring:
    """``boosts`` and ``lengths`` by field; ``idf`` of document counts; BM25's ``k1`` and ``b``."""

    n_docs: int
    boosts: tuple[float, ...]
    lengths: tuple[float, ...]
    k1: float
    b: float
    title_boost: float
    k: int


def best(packed: Packed, asked: DataFrame, how: Scoring) -> DataFrame:
    """``qid, id, score, mode``: of each block the ``k`` best of a query, those that hold all its terms, else those that hold any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _scored(_unpack(batch.column(0)[i].as_py()), _unpack(batch.column(1)[i].as_py()), how)

    return packed.blocks.select(F.col("packed").alias("block")).crossJoin(asked.select(F.col("packed").alias("queries"))).mapInArrow(run, RESULT)


@dataclass
class _Terms:
    """Documents of a block by distinct query term, one term after the other; ``part`` and ``loose``: its score with and without typing errors."""

    starts: np.ndarray
    key: np.ndarray
    doc: np.ndarray
    e: np.ndarray
    head: np.ndarray
    part: np.ndarray
    loose: np.ndarray


def _terms(block: dict[str, np.ndarray], queries: dict[str, np.ndarray], how: Scoring) -> _Terms:
    n_docs, n_fields = len(block["ids"]), len(how.boosts)
    known = {w: i for i, w in enumerate(_to_words("term", block))}
    words = _to_words("word", queries)
    here = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))[queries["term"].astype(np.int64)] if len(words) else np.empty(0, np.int64)
    ok = here >= 0
    here, mq = here[ok], queries["mq"].astype(np.int64)[ok]
    e, p, f = (queries[c].astype(bool)[ok] for c in "epf")
    starts = block["starts"].astype(np.int64)
    size = starts[here + 1] - starts[here]
    entry = np.repeat(starts[here] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    key, at = np.unique(np.repeat(mq, size) * n_docs + block["doc"].astype(np.int64)[entry], return_inverse=True)  # one of each query term and document
    e, p, f = (np.repeat(x, size) for x in (e, p, f))
    count = lambda weights: np.bincount(at, weights=weights, minlength=len(key))
    weight = np.ones(len(words))
    weight[mq] = np.maximum(0.0, np.log(1 + (how.n_docs - queries["df"].astype(float)[ok] + 0.5) / (queries["df"].astype(float)[ok] + 0.5)))
    doc, weight = key % n_docs, weight[key // n_docs]
    part, loose = np.zeros(len(key)), np.zeros(len(key))
    for i in range(n_fields):
        tf = block["tf"][i][entry].astype(float)
        exact, near = count(tf * p), count(tf * f)
        dl = (block["dl"][i][doc] if block["by_doc"][0] else _longest(at, block["dl"][i][entry], len(key))).astype(float)
        value = lambda tf: how.boosts[i] * (weight * tf * (how.k1 + 1) / (tf + how.k1 * (1 - how.b + how.b * dl / max(how.lengths[i], 1.0))))  # noqa: B023, E731
        part += value(np.where(exact > 0, exact, near))
        loose += value(exact)
    head = count(p & block["head"].astype(bool)[entry]) > 0
    return _Terms(np.searchsorted(key // n_docs, np.arange(len(words) + 1)), key, doc, count(e) > 0, head, part, loose)


def _scored(block: dict[str, np.ndarray], queries: dict[str, np.ndarray], how: Scoring) -> Iterator[pa.RecordBatch]:
    n_docs, n_queries = len(block["ids"]), len(queries["qids"])
    t = _terms(block, queries, how)
    starts, asked, times = (queries[x].astype(np.int64) for x in ("starts", "q", "times"))
    n_tokens = np.add.reduceat(times, starts[:-1])
    single, hit = t.loose.astype(np.float32), t.e.astype(np.float32)
    groups = -(-n_docs // GROUP)
    width = groups * GROUP
    bounds, uses = list(zip(t.starts[:-1].tolist(), t.starts[1:].tolist())), np.bincount(asked, minlength=len(t.starts) - 1)
    common = [q for q in np.argsort(-uses, kind="stable").tolist() if bounds[q][1] - bounds[q][0] > n_docs // DENSE and uses[q] > 1][: max(1, DENSE_BYTES // (8 * width))]
    dense: dict[int, np.ndarray] = {}
    for q in common:
        a, b = bounds[q]
        dense[q] = whole = np.zeros((2, width), np.float32)
        whole[0][t.doc[a:b]], whole[1][t.doc[a:b]] = single[a:b], hit[a:b]
    sparse: dict[int, tuple] = {}
    # dense terms first, the most used before the others; queries in their order, so that neighbours share sums
    rank = np.full(len(uses), len(common))
    rank[common] = np.arange(len(common))
    query = np.repeat(np.arange(n_queries), np.diff(starts))
    order = np.lexsort((asked, rank[asked], query))
    asked, times = asked[order], times[order]
    n_dense = np.bincount(query, weights=rank[asked] < len(common), minlength=n_queries).astype(np.int64)
    firsts = [np.where(n_dense > j, rank[asked[np.minimum(starts[:-1] + j, len(asked) - 1)]], -1) for j in range(SHARED)]
    mixed = np.add.reduceat((asked * 31 + times) * np.int64(-7046029254386353131), starts[:-1])
    turn = np.lexsort((mixed, *firsts[::-1])).tolist()
    lists, begin, n_dense, all_tokens = list(zip(asked.tolist(), times.tolist())), starts.tolist(), n_dense.tolist(), n_tokens.tolist()

    nothing, product = np.zeros((2, width), np.float32), np.zeros(width, np.float32)
    sums, levels = np.zeros((2, width), np.float32), [np.zeros((2, width), np.float32) for _ in range(SHARED)]
    grouped = product.reshape(GROUP, groups)
    path: list[tuple[int, int]] = []
    before, again = [], []
    found: list[tuple[int, np.ndarray, bool]] = []
    size, unboosted = 0, min(how.boosts) <= 0  # a field without weight: to hold all terms may score nothing
    for i in turn:
        own = lists[begin[i] : begin[i + 1]]
        if own == before:
            found += [(i, chosen, every) for chosen, every in again]
            size += sum(len(chosen) for chosen, _ in again)
        else:
            before, again = own, []
            shared, j = min(n_dense[i], SHARED), 0
            while j < shared and j < len(path) and path[j] == own[j]:
                j += 1
            del path[j:]
            for q, many in own[j:shared]:
                np.add(levels[j - 1] if j else nothing, dense[q], out=levels[j])
                for _ in range(many - 1):
                    np.add(levels[j], dense[q], out=levels[j])
                path.append((q, many))
                j += 1
            now = levels[shared - 1] if shared else nothing
            if len(own) > shared:
                np.copyto(sums, now)
                now = sums
                score, matched = sums
                for q, many in own[shared:]:
                    whole = dense.get(q)
                    if whole is not None:
                        for _ in range(many):
                            np.add(sums, whole, out=sums)
                        continue
                    kept = sparse.get(q)
                    if kept is None:
                        a, b = bounds[q]
                        kept = sparse[q] = (t.doc[a:b], single[a:b], hit[a:b]) if b > a else ()
                    if kept:
                        score[kept[0]] += kept[1] if many == 1 else kept[1] * np.float32(many)
                        matched[kept[0]] += kept[2] if many == 1 else kept[2] * np.float32(many)
            score, matched = now
            n = all_tokens[i]
            every = matched.max() >= n
            if every:
                again.append((np.flatnonzero(matched >= n), True))
            if n > 1 and (not every or unboosted):
                np.multiply(score, matched, out=product)
                tops = np.maximum.reduce(grouped, axis=0)
                least = float(np.partition(tops, groups - how.k)[groups - how.k]) if groups > how.k else 0.0
                least = least * (1 - 1e-5 - 5e-7 * n) - 4e-9  # what single precision and rounded scores may hide
                if least > 0:
                    some = np.flatnonzero(tops >= least)
                    row, column = np.nonzero(grouped[:, some] >= least)
                    chosen = row * groups + some[column]
                else:
                    chosen = np.flatnonzero(product > 0)
                if len(chosen):
                    again.append((chosen, False))
            found += [(i, chosen, every) for chosen, every in again]
            size += sum(len(chosen) for chosen, _ in again)
        if size >= FLUSH:
            yield _exact(found, block, queries, t, n_tokens, how)
            found, size = [], 0
    if found:
        yield _exact(found, block, queries, t, n_tokens, how)


def _exact(found: list[tuple[int, np.ndarray, bool]], block: dict[str, np.ndarray], queries: dict[str, np.ndarray], t: _Terms, n_tokens: np.ndarray, how: Scoring) -> pa.RecordBatch:
    """The ``k`` best of each query's chosen documents, scored in double precision; ties by id."""
    n_docs = len(block["ids"])
    each = np.array([len(x) for _, x, _ in found])
    query, doc, every = np.repeat([i for i, _, _ in found], each), np.concatenate([x for _, x, _ in found]), np.repeat([x for _, _, x in found], each)
    begin = queries["starts"].astype(np.int64)
    size = begin[query + 1] - begin[query]
    at = np.repeat(np.arange(len(query)), size)
    position = np.repeat(begin[query] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    wanted = queries["q"].astype(np.int64)[position] * n_docs + doc[at]
    where = np.minimum(np.searchsorted(t.key, wanted), len(t.key) - 1)
    held = t.key[where] == wanted
    at, where, times = at[held], where[held], queries["times"].astype(float)[position[held]]
    total = lambda x: np.bincount(at, weights=x[where] * times, minlength=len(query))
    tokens = n_tokens[query]
    plain = total(t.part)
    score = np.where(every, np.where(total(t.head) == tokens, plain * how.title_boost, plain), total(t.loose) * total(t.e))
    ids = block["ids"].astype(np.int64)
    is_null = np.zeros(n_docs, bool)
    is_null[block["null"].astype(np.int64)] = True
    order = np.lexsort((ids[doc], ~is_null[doc], -np.round(score, 9), ~every, query))
    order = order[score[order] > 0]
    list_of = query * 2 + every
    first = np.r_[True, list_of[order][1:] != list_of[order][:-1]] if len(order) else np.empty(0, bool)
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    order = order[rank < how.k]
    mode = pa.DictionaryArray.from_arrays(pa.array(np.where(every[order], 0, 1).astype(np.int8)), ["and", "or_fallback"]).cast(pa.string())
    return pa.record_batch([pa.array(queries["qids"].astype(np.int64)[query[order]]), pa.array(ids[doc[order]], mask=is_null[doc[order]]), pa.array(score[order]), mode], names=["qid", "id", "score", "mode"])
