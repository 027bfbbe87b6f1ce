"""Exact BM25 top-k over an inverted index in shards, by block-max WAND with global statistics.

A shard's documents fall into blocks, and so do posting lists: of each term and block the index has the postings and, once idf and the average
length are known, their greatest score. A query has a cursor, a heap of its k best scores and the least of them as threshold. The pivot is the
first block from the cursor on whose bound reaches the threshold; blocks before it are passed over, the pivot's documents are
scored, the threshold rises, and the cursor moves on. The cursors of many queries move along the blocks side by side, so that a block is scored for all that
have it as pivot by a few array operations. A bound is the maxima of a query's frequent terms and the most that its rare terms give one document of the block.
A few shards are searched first; what a query's k-th best document there has is its threshold for the other shards from the start.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release

_WORD = re.compile(r"[^\W_]+")
_CACHE_WORDS = 300_000
#: Bytes of text and documents in a shard, documents in a block of it, queries that go to the shards together, parts that results are merged in.
SHARD_BYTES, SHARD_DOCS, BLOCK_DOCS, QUERY_BLOCK, MERGE_PARTS = 32 << 20, 1 << 16, 64, 4096, 1024
#: Cells (query and document), terms of queries, and postings that a step of a search holds at most (or one query's, if it has more).
CELLS, ENTRIES, POSTINGS = 1 << 22, 1 << 21, 1 << 19
#: Terms of over this share of a shard's documents have a score for each document of a block instead of postings.
DENSE_SHARE = 1 / 10
#: One shard of so many is searched before the others, at least as many as run at once, but none if that is over half of them.
FIRST_SHARDS = 16
_TERM_CHUNK = 1 << 16


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.5
    b: float = 0.75

    def idf(self, n: int, df: np.ndarray) -> np.ndarray:
        return np.log(1 + (n - df + 0.5) / (df + 0.5))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(self) < _CACHE_WORDS:
            self[word] = value
        return value


_hashes = _Hashes()


def terms(text: str | None) -> np.ndarray:
    """A term is the 64-bit hash of a word, a run of letters and digits in lower case."""
    words = _WORD.findall(text.lower()) if text else []
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


_INDEX = "shard long, n_docs long, n_terms long, doc_ids binary, lengths binary, terms binary, starts binary, docs binary, tf binary"
_INDEX_NAMES = [c.split()[0] for c in _INDEX.split(", ")]


def _shards(batches: Iterator[pa.RecordBatch], most: int, most_docs: int) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId() << 32, 0
    ids, lengths, keys, counts, size = [], [], [], [], 0

    def done():
        term, tf = np.concatenate(keys), np.concatenate(counts)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), [len(k) for k in keys])
        order = np.argsort(term, kind="stable")
        distinct, starts = np.unique(term[order], return_index=True)
        arrays = (np.array(ids, np.int64), np.array(lengths, np.int32), distinct, np.append(starts, len(order)).astype(np.int64), doc[order], tf[order].astype(np.int32))
        row = [pa.array([part + made]), pa.array([len(ids)]), pa.array([int(sum(lengths))]), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)]
        return pa.RecordBatch.from_arrays(row, _INDEX_NAMES)

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            text = text.as_py()
            t = terms(text)
            k, n = np.unique(t, return_counts=True)
            ids.append(doc_id)
            lengths.append(len(t))
            keys.append(k)
            counts.append(n)
            size += len(text or "")
            if size >= most or len(ids) >= most_docs:
                yield done()
                made, size = made + 1, 0
                ids, lengths, keys, counts = [], [], [], []
                release()
    if ids:
        yield done()


def index(docs: DataFrame, shard_bytes: int | None = None, shard_docs: int | None = None) -> DataFrame:
    """documents -> a row for each shard of the inverted index. Rows without doc_id are left out; empty texts count as documents."""
    most, most_docs = shard_bytes or SHARD_BYTES, shard_docs or SHARD_DOCS
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _shards(it, most, most_docs), _INDEX)


class _Shard:
    def __init__(self, row: dict):
        kinds = {"doc_ids": np.int64, "lengths": np.int32, "terms": np.uint64, "starts": np.int64, "docs": np.int32, "tf": np.int32}
        for name, kind in kinds.items():
            setattr(self, name, np.frombuffer(row[name], kind))

    def places(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted term in the shard's terms, -1 if it has none."""
        if not len(self.terms):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        return np.where(self.terms[at] == wanted, at, -1)


def _frequencies(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    """How many of a shard's documents have each wanted term, in chunks of terms, summed over the shards of a task."""
    total = np.zeros(len(wanted.value), np.int64)
    for b in batches:
        for row in b.to_pylist():
            shard = _Shard({n: row.get(n, b"") for n in _INDEX_NAMES})
            at = shard.places(wanted.value)
            total += np.where(at >= 0, np.diff(shard.starts)[at] if len(shard.terms) else 0, 0)
    chunks = range(0, len(total), _TERM_CHUNK)
    yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array([total[c : c + _TERM_CHUNK].tobytes() for c in chunks], pa.binary())], ["chunk", "df"])


def _summed(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in group.column("df").to_pylist())
    return pa.table({"chunk": group.column("chunk")[:1], "df": pa.array([total.tobytes()], pa.binary())})


@dataclass
class _Queries:
    """A block of queries: the distinct terms of all, and for each query the numbers of its own."""

    ids: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    numbers: np.ndarray
    idf: np.ndarray | None = None
    average: float = 1.0


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for counts[0] numbers, then from starts[1], and so on."""
    ends = np.cumsum(counts)
    out = np.repeat(starts - ends + counts, counts)
    out += np.arange(len(out), dtype=out.dtype)
    return out


class _Blocks:
    """The posting lists of a shard's terms that queries ask for.

    That of a frequent term has a score for each document (dense: by block, term and document; frequent: each term's number there or -1) and a greatest
    score for each block. Those of other terms are postings: of each term the first one, and of these documents and scores.
    """

    def __init__(self, shard: _Shard, place: np.ndarray, idf: np.ndarray, norm: np.ndarray, how: Bm25, size: int):
        n = -(-len(norm) // size)
        df = np.where(place >= 0, np.diff(shard.starts)[place] if len(shard.terms) else 0, 0)
        often = np.flatnonzero(df > DENSE_SHARE * len(norm))
        self.frequent = np.full(len(place), -1)
        self.frequent[often] = np.arange(len(often))
        self.dense = np.zeros((n, len(often), size))
        for r, t in enumerate(often.tolist()):
            at = slice(shard.starts[place[t]], shard.starts[place[t] + 1])
            docs, tf = shard.docs[at], shard.tf[at]
            self.dense[docs // size, r, docs % size] = idf[t] * tf * (how.k1 + 1) / (tf + norm[docs])
        self.dense_maxima = self.dense.max(axis=2, initial=0.0).T
        have = np.flatnonzero((df > 0) & (self.frequent < 0))
        counts = df[have].astype(np.int64)
        at = _spread(shard.starts[place[have]] if len(have) else counts, counts)
        docs, tf = shard.docs[at], shard.tf[at]
        term = np.repeat(have, counts)
        self.score = idf[term] * tf * (how.k1 + 1) / (tf + norm[docs])
        self.docs = docs
        self.counts = np.where(self.frequent < 0, df, 0).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts


def search(row: dict, q: _Queries, k: int, how: Bm25, counted: dict | None = None, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best documents of one shard for each query: (query number, doc_id, score). counted, if given, gets the blocks scored and passed over.

    least: a score for each query; of documents with less some may be left out.
    """
    shard, size = _Shard(row), BLOCK_DOCS
    blocks = -(-len(shard.doc_ids) // size)
    norm = how.k1 * (1 - how.b + how.b * shard.lengths / q.average)
    lists = _Blocks(shard, shard.places(q.terms), q.idf, norm, how, size)
    found = []
    begin, most = 0, max(1, CELLS // max(1, blocks * size, lists.dense.shape[1]))
    while begin < len(q.ids):
        end = min(len(q.ids), begin + most, max(begin + 1, int(np.searchsorted(q.starts, q.starts[begin] + ENTRIES, "right")) - 1))
        found.append(_wand(shard, lists, q, range(begin, end), blocks, k, counted, least))
        begin = end
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _wand(shard: _Shard, lists: _Blocks, q: _Queries, numbers: range, blocks: int, k: int, counted: dict | None, given: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(numbers)
    own = q.numbers[q.starts[numbers.start] : q.starts[numbers.stop]]
    of = np.repeat(np.arange(n), np.diff(q.starts[numbers.start : numbers.stop + 1]))
    has = np.zeros((n, lists.dense.shape[1]))
    often = lists.frequent[own] >= 0
    has[of[often], lists.frequent[own[often]]] = 1
    rare = _rare(lists, own, of, n, blocks)
    bound = (has @ lists.dense_maxima + rare.max(axis=2)).T.copy()
    best, who = np.zeros((n, k)), np.full((n, k), -1)  # each query's heap, and the least score that may enter it
    # bounds are sums in another order, and scores are rounded
    least = np.full(n, 1e-9) if given is None else np.maximum(given[numbers.start : numbers.stop] - 1e-6, 1e-9)
    scored = 0
    # all cursors move on together: the pivot of a query is the next block whose bound reaches its least score
    for pivot in range(blocks):
        active = np.flatnonzero(bound[pivot] >= least)
        scored += len(active)
        if len(active):
            full = (has @ lists.dense[pivot])[active] if 2 * len(active) > n else has[active] @ lists.dense[pivot]
            full += rare[active, pivot]
            _score(shard, full, active, pivot, best, who, least)
    if counted is not None:
        counted["scored"] = counted.get("scored", 0) + scored
        counted["passed"] = counted.get("passed", 0) + int((bound > 0).sum()) - scored
    number, place = np.nonzero(who >= 0)
    return numbers.start + number, shard.doc_ids[who[number, place]], best[number, place]


def _rare(lists: _Blocks, own: np.ndarray, of: np.ndarray, n: int, blocks: int) -> np.ndarray:
    """What each document gets from each query's terms that aren't frequent, by query, block and document. own, of: the queries' terms, and whose they are, in order."""
    width = blocks * BLOCK_DOCS
    out, counts = np.zeros((n, width)), lists.counts[own]
    before = np.concatenate([[0], np.cumsum(np.bincount(of, counts, n)).astype(np.int64)])  # postings before each query's
    begin = 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(before, before[begin] + POSTINGS, "right")) - 1)
        a, b = np.searchsorted(of, (begin, end))
        postings = _spread(lists.starts[own[a:b]], counts[a:b])
        cell = np.repeat((of[a:b] - begin) * width, counts[a:b])
        cell += lists.docs[postings]
        out[begin:end] = np.bincount(cell, lists.score[postings], (end - begin) * width).reshape(end - begin, width)
        begin = end
    return out.reshape(n, blocks, BLOCK_DOCS)


def _score(shard, full, active, pivot, best, who, least) -> None:
    """Puts the pivot's documents, whose scores are full, into the heaps of their queries."""
    size, k = BLOCK_DOCS, best.shape[1]
    near = np.flatnonzero(full.max(axis=1) >= least[active])
    active, full = active[near], np.round(full[near], 6)
    # only queries with a document that may enter; of equal scores the lesser doc_id is better
    enters = np.flatnonzero(full.max(axis=1) >= np.maximum(best[active, k - 1], 1e-9)) if len(near) else near
    if not len(enters):
        return
    a, doc = active[enters], pivot * size + np.arange(size)
    score, docs = np.concatenate([best[a], full[enters]], axis=1), np.concatenate([who[a], np.broadcast_to(doc, (len(a), size))], axis=1)
    docs[score <= 0] = -1
    ids = np.where(docs >= 0, shard.doc_ids[np.clip(docs, 0, len(shard.doc_ids) - 1)], np.iinfo(np.int64).max)
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    best[a], who[a] = np.take_along_axis(score, order, 1), np.take_along_axis(docs, order, 1)
    least[a] = np.maximum(best[a, k - 1] - 1e-6, least[a])


_FOUND = "part int, query binary, doc binary, score binary"


def _searched(batches: Iterator[pa.RecordBatch], sent, k: int, how: Bm25, least=None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            query, doc, score = search(row, sent.value, k, how, None, least.value if least else None)
            release()
            parts = query % MERGE_PARTS
            order = np.argsort(parts, kind="stable")
            query, doc, score, parts = query[order].astype(np.int64), doc[order], score[order], parts[order]
            cut = np.flatnonzero(np.diff(parts)) + 1
            split = [np.split(x, cut) if len(query) else [] for x in (parts, query, doc, score)]
            yield pa.RecordBatch.from_arrays([pa.array([int(p[0]) for p in split[0]], pa.int32()), *(pa.array([x.tobytes() for x in s], pa.binary()) for s in split[1:])], ["part", "query", "doc", "score"])


def _merged(group: pa.Table, sent, k: int) -> pa.Table:
    query, doc, score = (np.concatenate([np.frombuffer(x, t) for x in group.column(c).to_pylist()]) for c, t in (("query", np.int64), ("doc", np.int64), ("score", np.float64)))
    order = np.lexsort((doc, -score, query))
    query, doc, score = query[order], doc[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], np.diff(query) != 0]))
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query)))) + 1
    keep = rank <= k
    return pa.table({"query_id": sent.value.ids[query[keep]], "rank": rank[keep].astype(np.int32), "doc_id": doc[keep], "score": score[keep]})


def _thresholds(group: pa.Table, k: int) -> pa.Table:
    """The k-th best score of each query that has so many, by its number."""
    query, score = (np.concatenate([np.frombuffer(x, t) for x in group.column(c).to_pylist()]) for c, t in (("query", np.int64), ("score", np.float64)))
    order = np.lexsort((-score, query))
    query, score = query[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], np.diff(query) != 0]))
    last = first[np.diff(np.append(first, len(query))) >= k] + k - 1
    return pa.table({"query": query[last], "score": score[last]})


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, how: Bm25 = Bm25()) -> DataFrame:
    """The k best documents (doc_id, text) for each query (doc_id, text): (query_id, rank, doc_id, score).

    Scores sum over a query's distinct terms and are rounded to 6 places; equal scores rank by doc_id; documents of score 0
    are no results, so empty queries and empty tables give none. Statistics are those of all documents. The index is built once;
    queries go to it in blocks of QUERY_BLOCK, which bounds what is broadcast. Each shard gives its own exact best, as far as they reach what a query has in the first shards, and
    their union has the exact best of all. Queries that share an id are answered each. A shard closes by bytes or by documents,
    whichever comes first, so that any number of empty texts is no large shard.
    """
    spark = docs.sparkSession
    shards = materialise(index(docs), "bm25-index")
    total = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n, average = total[0] or 0, (total[1] or 0) / (total[0] or 1) or 1.0
    asked = materialise(queries.where("doc_id is not null").select("doc_id", "text").mapInArrow(_query_terms, "query_id long, digest long, terms binary"), "bm25-queries")
    blocks = -(-asked.count() // QUERY_BLOCK)
    first = _first_shards(shards)
    results = []
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("query_id", "digest"), F.lit(blocks)) == block).orderBy("query_id", "digest").collect()
        lists = [np.frombuffer(r["terms"], np.uint64) for r in own]
        if sum(map(len, lists)):
            distinct, numbers = np.unique(np.concatenate(lists), return_inverse=True)
            ids = np.array([r["query_id"] for r in own], np.int64)
            results.append(_answered(shards, first, n, _Queries(ids, distinct, np.cumsum([0, *map(len, lists)]), numbers, None, average), k, how))
    if not results:
        return spark.createDataFrame([], _RESULT)
    return reduce(DataFrame.union, results)


_RESULT = "query_id long, rank int, doc_id long, score double"


def _first_shards(shards: DataFrame) -> list[int]:
    """The shards that are searched before the others, evenly from all; none if that is over half of them."""
    numbers = sorted(r["shard"] for r in shards.select("shard").collect())
    some = max(shards.sparkSession.sparkContext.defaultParallelism, -(-len(numbers) // FIRST_SHARDS))
    return [] if 2 * some > len(numbers) else [numbers[i * len(numbers) // some] for i in range(some)]


def _answered(shards: DataFrame, first: list[int], n: int, q: _Queries, k: int, how: Bm25) -> DataFrame:
    """One block of queries: its terms' global document frequencies, then its results, of the first shards before the others."""
    context = shards.sparkSession.sparkContext
    wanted = context.broadcast(q.terms)
    counted = shards.select("terms", "starts").mapInArrow(lambda it: _frequencies(it, wanted), "chunk int, df binary")
    summed = counted.groupBy("chunk").applyInArrow(_summed, "chunk int, df binary").orderBy("chunk").collect()
    q.idf = how.idf(n, np.concatenate([np.frombuffer(r["df"], np.int64) for r in summed]))
    sent = context.broadcast(q)
    if not first:
        found = shards.mapInArrow(lambda it: _searched(it, sent, k, how), _FOUND)
    else:
        own = F.col("shard").isin(first)
        early = materialise(shards.where(own).mapInArrow(lambda it: _searched(it, sent, k, how), _FOUND), "bm25-first")
        known = early.groupBy("part").applyInArrow(lambda group: _thresholds(group, k), "query long, score double").toArrow()
        # of any documents the k-th best score is at most that of all: what has less isn't among the k best
        least = np.zeros(len(q.ids))
        least[known.column("query").to_numpy()] = known.column("score").to_numpy()
        told = context.broadcast(least)
        found = early.union(shards.where(~own).mapInArrow(lambda it: _searched(it, sent, k, how, told), _FOUND))
    return found.groupBy("part").applyInArrow(lambda group: _merged(group, sent, k), _RESULT)


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    for b in batches:
        lists = [np.unique(terms(t.as_py())).tobytes() for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([zlib.crc32(x) for x in lists], pa.int64()), pa.array(lists, pa.binary())], ["query_id", "digest", "terms"])
