"""Removal of repeated word windows, by suffix trees over groups of suffixes that share a prefix.

A suffix of interest starts a window of `length` words, and of a suffix only these count. Windows that occur in one document only are leaves at the
root and go no further. Of those that are left, the ones in a row are a run; of equal runs only the document of least doc_id has to ask for its
windows, as in the others all of them go. Batches of documents number the distinct windows of such runs and hold the least doc_id of each. Prefixes
split them into groups that fit in a task: a prefix is one word, or where more than `most` windows start with it two, four and so on
up to the whole window. In a group, windows are sorted word by word; the common prefixes of neighbours give the tree, whose
internal nodes at the depth of `length` words are the repeats, and the least doc_id below each decides which windows go. A window that by
itself is more than a group needs no tree: it is one node, whose least doc_id is an aggregate. No group grows with the number of copies
in a batch, as a batch sends each distinct window once and applies the answers to all its documents.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialise, release
from .components import looked_up

#: Words of a removable window.
WINDOW = 13
#: Bytes of text in a batch (a document counts for ROW_BYTES more); windows in a bucket of hashes; windows in a group.
BATCH_BYTES, ROW_BYTES, BUCKET_ENTRIES, GROUP_WINDOWS = 8 << 20, 64, 2_000_000, 500_000
_CACHE_WORDS = 100_000
_COUNTED = 1 << 20
_ODD = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROWS = "batch long, bucket int, kind int, n long, data binary"
_KINDS = {"batch": pa.int64(), "bucket": pa.int32(), "kind": pa.int32(), "n": pa.int64(), "data": pa.binary()}
#: Kinds of rows: documents, marks of repeated windows, runs of them, windows, their places, answers.
DOCUMENTS, MARKS, RUNS, WINDOWS, PLACES, ANSWERS = range(6)


class _Hashes(dict):
    """Word -> 64-bit hash; what comes first is kept."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(self) < _CACHE_WORDS:
            self[word] = value
        return value


_hashes = _Hashes()


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive words."""
    n = len(h) - k + 1
    x = np.zeros(n, np.uint64)
    for j in range(k):
        x += (h[j : j + n] ^ (h[j : j + n] >> np.uint64(31))) * _ODD[j]
    x ^= x >> np.uint64(29)
    x *= _ODD[63]
    return x ^ (x >> np.uint64(32))


def _leading(codes: np.ndarray, bits: int) -> np.ndarray:
    return (codes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(codes), np.int64)


def _documents(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _texts(table: pa.Table) -> list[bytes | None]:
    return table.column("text").cast(pa.large_binary()).to_pylist()


def _words(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; see _unpack()."""
    head, body = ",".join(f"{a.dtype.str}:{len(a)}" for a in arrays).encode(), b"".join(a.tobytes() for a in arrays)
    return struct.pack("<qi", len(body), len(head)) + head + pa.Codec("zstd").compress(body, asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    size, n = struct.unpack_from("<qi", data)
    body, at, out = pa.Codec("zstd").decompress(data[12 + n :], size, asbytes=True) if size else b"", 0, []
    for kind, count in (x.split(":") for x in data[12 : 12 + n].decode().split(",")):
        out.append(np.frombuffer(body, kind, int(count), at))
        at += out[-1].nbytes
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences, which compress better; np.cumsum() undoes it."""
    return np.diff(x, prepend=x.dtype.type(0))


def _table(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * len(_KINDS)
    return pa.table({n: pa.array(c, k) for (n, k), c in zip(_KINDS.items(), columns, strict=True)})


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS.values(), strict=True)], list(_KINDS))


def _of_kind(group: pa.Table, kind: int) -> list[dict]:
    return group.filter(pa.compute.equal(group.column("kind"), kind)).to_pylist()


# -- batches of documents
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

    def done():
        nonlocal made, held, size
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for b in held:
                out.write_batch(b)
        row = (part + made, 0, DOCUMENTS, size, sink.getvalue().to_pybytes())
        made, held, size = made + 1, [], 0
        return _batch_of([row])

    for b in batches:
        sizes = b.column("text").cast(pa.large_binary())
        start = 0
        for i, t in enumerate(sizes):
            size += len(t.as_py() or b"") + ROW_BYTES
            if size >= BATCH_BYTES:
                held.append(b.slice(start, i + 1 - start))
                yield done()
                start = i + 1
        if start < len(b):
            held.append(b.slice(start))
    if held:
        yield done()


# -- windows of one document only are left out
class _Windows:
    """The windows of a batch's documents that have a doc_id: keys are their distinct hashes in order, at the key of each, by document."""

    def __init__(self, docs: pa.Table, length: int, keep_words: bool):
        self.ids = docs.column("doc_id").to_pylist()
        self.words, found, self.sizes = [], [], np.zeros(len(self.ids), np.int64)
        for row, (doc_id, text) in enumerate(zip(self.ids, _texts(docs), strict=True)):
            words = _words(text)
            if doc_id is not None and len(words) >= length:
                found.append(_grams(_hashed(words), length))
                self.sizes[row] = len(found[-1])
            if keep_words:
                self.words.append(words)
        flat = np.concatenate([np.zeros(0, np.uint64), *found])
        self.keys, self.at = np.unique(flat, return_inverse=True)
        self.row = np.repeat(np.arange(len(self.ids)), self.sizes)
        first, last = np.full(len(self.keys), len(self.ids)), np.full(len(self.keys), -1)
        np.minimum.at(first, self.at, self.row)
        np.maximum.at(last, self.at, self.row)
        self.shared = first != last  # by two documents of the batch


def _requests(batches: Iterator[pa.RecordBatch], length: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The keys of each batch by bucket, 32 bits of each behind those that choose the bucket: equal ones of different windows only mark too many."""
    for b in batches:
        for batch, data in zip(b.column("batch").to_pylist(), b.column("data"), strict=True):
            keys = _Windows(_documents(data.as_py()), length, False).keys
            low, (buckets, starts) = ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32), np.unique(_leading(keys, bits), return_index=True)
            rows = [(batch, k, MARKS, len(part), part.tobytes()) for k, part in zip(buckets.tolist(), np.split(low, starts[1:]), strict=True)] if len(keys) else []
            if rows:
                yield _batch_of(rows)
            release()


def _repeated(group: pa.Table) -> pa.Table:
    """Which of a bucket's windows several batches have: for each batch, a bit for each of its keys."""
    parts = [np.frombuffer(x.as_py(), np.uint32) for x in group.column("data")]
    flat = np.sort(np.concatenate(parts))
    twice = np.unique(flat[1:][flat[1:] == flat[:-1]])
    out = []
    for batch, bucket, part in zip(group.column("batch").to_pylist(), group.column("bucket").to_pylist(), parts, strict=True):
        if len(twice):
            marked = twice[np.minimum(np.searchsorted(twice, part), len(twice) - 1)] == part
            if marked.any():
                out.append((batch, bucket, MARKS, int(marked.sum()), np.packbits(marked).tobytes()))
    return _table(out)


# -- windows, each once for a batch
def _numbered(words: np.ndarray, places: np.ndarray, keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the window at each place, first place of each number), in the order of first places. Equal keys tell equal windows, and words make sure."""
    _, first, number = np.unique(keys, return_index=True, return_inverse=True)
    if any((words[places + j] != words[places[first][number] + j]).any() for j in range(length)):
        _, first, number = np.unique(words[places[:, None] + np.arange(length)], axis=0, return_index=True, return_inverse=True)
        number = number.reshape(-1)
    order = np.argsort(first)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[number], places[first[order]]


def _runs(group: pa.Table, length: int, bits: int) -> pa.Table:
    """Of one batch: its distinct runs of windows that another document has, with words and least doc_id, and where its documents have them."""
    import xxhash

    stored = _of_kind(group, DOCUMENTS)
    if not stored:
        return _table([])
    w = _Windows(_documents(stored[0]["data"]), length, True)
    marked = w.shared.copy()
    for r in _of_kind(group, MARKS):
        begin = np.searchsorted(w.keys, np.uint64(r["bucket"] << (64 - bits)) if bits else np.uint64(0))
        bit = np.unpackbits(np.frombuffer(r["data"], np.uint8)).astype(bool)[: len(w.keys) - begin]
        marked[begin : begin + len(bit)] |= bit
    hit = marked[w.at]
    if not hit.any():
        return _table([])
    start = np.arange(len(hit)) - np.repeat(np.cumsum(w.sizes) - w.sizes, w.sizes)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)) | np.concatenate([[False], (np.diff(w.row) != 0) & hit[1:] & hit[:-1], [False]]))
    index: dict[bytes, int] = {}
    known: dict[bytes, int] = {}
    number, sizes, least, places = [], [], [], []
    for a, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if hit[a]:
            row, first = int(w.row[a]), int(start[a])
            words, doc_id = w.words[row][first : first + e - a + length - 1], w.ids[row]
            k = known.setdefault(xxhash.xxh3_128_digest(b" ".join(words)), len(sizes))
            if k == len(sizes):
                number.extend([index.setdefault(x, len(index)) for x in words])
                sizes.append(len(words))
                least.append(doc_id)
            elif doc_id < least[k]:
                least[k] = doc_id
            places.append((row, first, k))
    row, first, run = (np.array(x, np.int32) for x in zip(*places, strict=True))
    arrays = (np.frombuffer(b" ".join(index), np.uint8), np.array(number, np.int32), np.array(sizes, np.int32), np.array(least, np.int64), np.frombuffer(b"".join(known), np.uint8))
    return _table([(stored[0]["batch"], 0, RUNS, len(sizes), _pack(*arrays, _steps(row), _steps(first), _steps(run)))])


def _run_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, batch, number, least): each run by 128 bits of hash."""
    for b in batches:
        for batch, data in zip(b.column("batch").to_pylist(), b.column("data"), strict=True):
            _, _, sizes, least, keys, *_ = _unpack(data.as_py())
            runs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(sizes), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([runs, pa.array([batch] * len(sizes), pa.int64()), pa.array(range(len(sizes)), pa.int32()), pa.array(least)], ["run", "batch", "number", "least"])


def _windowed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Of each batch: the distinct windows of runs that no lesser doc_id has whole, and where its documents have which runs and windows. lower: runs that one has."""
    for b in batches:
        for batch, data, lower in zip(b.column("batch").to_pylist(), b.column("data"), b.column("lower").to_pylist(), strict=True):
            texts, number, sizes, least, _, row, first, run = _unpack(data.as_py())
            low = least.copy()
            for x in lower or ():
                low[x["number"]] = x["low"]
            held = low == least
            word, own = np.repeat(held, sizes), np.repeat(np.arange(len(sizes)), sizes)
            number, own = number[word], own[word]
            places = np.flatnonzero(own[: len(own) - length + 1] == own[length - 1 :]) if len(own) else np.zeros(0, np.int64)
            rows = []
            window, where = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if len(places):
                words = texts.tobytes().split(b" ")
                window, where = _numbered(number, places, _grams(_hashed(words)[number], length)[places], length)
                lowest = np.full(len(where), np.iinfo(np.int64).max)
                np.minimum.at(lowest, window, least[own[places]])
                # only the words of first places, and only the texts of these
                change = np.zeros(len(number) + 1, np.int32)
                np.add.at(change, where, 1)
                np.add.at(change, where + length, -1)
                needed = np.cumsum(change)[:-1] > 0
                used, at = np.unique(number[needed], return_inverse=True)
                moved = (np.cumsum(needed) - 1)[where].astype(np.int32)
                kept = np.frombuffer(b" ".join([words[k] for k in used.tolist()]), np.uint8)
                rows.append((batch, 0, WINDOWS, len(where), _pack(kept, at.astype(np.int32), _steps(moved), lowest)))
            else:
                lowest = np.zeros(0, np.int64)
            rows.append((batch, 0, PLACES, len(row), _pack(row, first, run, sizes - np.int32(length - 1), low, held, _steps(window.astype(np.int32)), lowest)))
            yield _batch_of(rows)
        release()


class _Suffixes:
    """The distinct windows of a batch."""

    def __init__(self, data: bytes):
        texts, self.number, steps, self.least = _unpack(data)
        self.texts, self.first = texts.tobytes().split(b" "), np.cumsum(steps)
        self.hashes = _hashed(self.texts)[self.number]

    def prefixes(self, k: int) -> np.ndarray:
        return _grams(self.hashes, k)[self.first]

    def codes(self, long: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each window's shortest prefix that isn't too long, and whether it has none."""
        code, open_ = np.zeros(len(self.first), np.uint64), np.ones(len(self.first), bool)
        for k in sorted(long):
            own = self.prefixes(k)
            code[open_] = own[open_]
            open_ &= _among(own, long[k])
        return code, open_


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


# -- prefixes
def _counts(batches: Iterator[pa.RecordBatch], k: int, long) -> Iterator[pa.RecordBatch]:
    """(prefix, n): windows by their prefixes of k words, if all shorter prefixes are too frequent; summed over a task's batches as long as they are few."""
    held, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = lambda: pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(counts)], ["prefix", "n"])
    for b in batches:
        for data in b.column("data"):
            s = _Suffixes(data.as_py())
            own = s.prefixes(k)[s.codes(long.value)[1]]
            every, weight = np.concatenate([held, own]), np.concatenate([counts, np.ones(len(own), np.int64)])
            held, at = np.unique(every, return_inverse=True)
            counts = np.bincount(at, weight, len(held)).astype(np.int64)
            if len(held) > _COUNTED:
                yield out()
                held, counts = held[:0], counts[:0]
    if len(held):
        yield out()


def long_prefixes(windows: DataFrame, length: int, most: int) -> dict[int, np.ndarray]:
    """For prefixes of 1, 2, 4, ... words up to a window: those with more than `most` windows, by hash. There are fewer than windows / most of each length."""
    context, long, k = windows.sparkSession.sparkContext, {}, 1
    while True:
        sent = context.broadcast(dict(long))
        counted = windows.select("data").mapInArrow(lambda it, k=k, sent=sent: _counts(it, k, sent), "prefix long, n long")
        found = counted.groupBy("prefix").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("prefix").toArrow()
        long[k] = np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64))
        if k == length or not len(long[k]):
            return long
        k = min(2 * k, length)


def _dealt(batches: Iterator[pa.RecordBatch], length: int, bits: int, long) -> Iterator[pa.RecordBatch]:
    """A batch's windows by group, as numbers of the words they use."""
    for b in batches:
        for batch, data in zip(b.column("batch").to_pylist(), b.column("data"), strict=True):
            s = _Suffixes(data.as_py())
            code, alone = s.codes(long.value)
            mine = np.flatnonzero(~alone)
            group = _leading(code[mine], bits)
            order = np.argsort(group, kind="stable")
            mine, (groups, starts) = mine[order], np.unique(group[order], return_index=True)
            rows = []
            for g, part in zip(groups.tolist(), np.split(mine, starts[1:]), strict=True) if len(mine) else ():
                used, at = np.unique(s.number[s.first[part][:, None] + np.arange(length)], return_inverse=True)
                kind = np.uint16 if len(used) <= 1 << 16 else np.int32
                texts = np.frombuffer(b" ".join([s.texts[k] for k in used.tolist()]), np.uint8)
                rows.append((batch, g, WINDOWS, len(part), _pack(texts, at.reshape(-1).astype(kind), s.least[part], _steps(part.astype(np.int32)))))
            if rows:
                yield _batch_of(rows)
        release()


def _alone(batches: Iterator[pa.RecordBatch], length: int, long) -> Iterator[pa.RecordBatch]:
    """(batch, window, least, words) of windows that by themselves are more than a group."""
    for b in batches:
        for batch, data in zip(b.column("batch").to_pylist(), b.column("data"), strict=True):
            s = _Suffixes(data.as_py())
            found = np.flatnonzero(s.codes(long.value)[1])
            words = [b" ".join([s.texts[k] for k in s.number[a : a + length].tolist()]) for a in s.first[found].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([batch] * len(found), pa.int64()), pa.array(found, pa.int32()), pa.array(s.least[found]), pa.array(words, pa.binary())], ["batch", "window", "least", "words"])


def _lone_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if len(b):
            yield _batch_of([(batch, 0, ANSWERS, 1, _pack(np.array([k], np.int32), np.array([low], np.int64))) for batch, k, low in zip(*(c.to_pylist() for c in b.columns), strict=True)])


# -- trees
def suffix_tree(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rows: a suffix each, as numbers of its first words -> (order, depth): the suffixes sorted word by word, and for each but the first
    the depth of the node that parts it from the one before, in words. A row of equal depths or more is what lies below an internal node."""
    n, length = rows.shape
    bits = max(1, int(rows.max(initial=0)).bit_length())
    per = max(1, 63 // bits)
    keys = []
    for a in range(0, length, per):
        key = np.zeros(n, np.int64)
        for j in range(a, min(a + per, length)):
            key = key << bits | rows[:, j]
        keys.append(key)
    order = np.lexsort(keys[::-1])
    differ = rows[order[1:]] != rows[order[:-1]]
    return order, np.where(differ.any(axis=1), differ.argmax(axis=1), length)


def deep_nodes(depth: np.ndarray, least: int) -> np.ndarray:
    """First suffix (in sorted order) below each node of at least that depth; suffixes without such a node are nodes by themselves."""
    return np.flatnonzero(np.concatenate([[True], depth < least]))


def _tree(group: pa.Table, length: int) -> pa.Table:
    """The answers of one group: for each batch, windows that a lesser doc_id has elsewhere, and which."""
    rows = group.to_pylist()
    numbers: dict[bytes, int] = {}
    windows, own, indexes = [], [], []
    for r in rows:
        texts, at, least, steps = _unpack(r["data"])
        words = texts.tobytes().split(b" ")
        number = np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int32, len(words))
        windows.append(number[at].reshape(-1, length))
        own.append(least)
        indexes.append(np.cumsum(steps))
    order, depth = suffix_tree(np.concatenate(windows))
    starts = deep_nodes(depth, length)
    mine = np.concatenate(own)
    lowest = np.empty(len(mine), np.int64)
    lowest[order] = np.repeat(np.minimum.reduceat(mine[order], starts), np.diff(np.append(starts, len(order))))
    out = []
    for r, low, least, index in zip(rows, np.split(lowest, np.cumsum([len(x) for x in own])[:-1]), own, indexes, strict=True):
        changed = np.flatnonzero(low < least)
        if len(changed):
            out.append((r["batch"], r["bucket"], ANSWERS, len(changed), _pack(_steps(index[changed].astype(np.int32)), low[changed])))
    return _table(out)


# -- what stays
def _removed(group: pa.Table, length: int, ids: list) -> dict[int, np.ndarray]:
    """Row of a batch -> starts of its repeated windows."""
    stored = _of_kind(group, PLACES)
    if not stored:
        return {}
    row, first, run, sizes, low, held, window, lowest = _unpack(stored[0]["data"])
    row, first, run, window, lowest = np.cumsum(row), np.cumsum(first), np.cumsum(run), np.cumsum(window), lowest.copy()
    for r in _of_kind(group, ANSWERS):
        steps, found = _unpack(r["data"])
        lowest[np.cumsum(steps)] = found
    # the least doc_id of each window of each run: for held runs their windows', for others the run's
    each = np.repeat(low, sizes)
    each[np.repeat(held, sizes)] = lowest[window]
    begin, n = (np.cumsum(sizes) - sizes)[run], sizes[run]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    doc_id = np.array([np.iinfo(np.int64).min if d is None else d for d in ids], np.int64)
    row, start = np.repeat(row, n), np.repeat(first, n) + within
    gone = each[np.repeat(begin, n) + within] < doc_id[row]
    row, start = row[gone], start[gone]
    cut = np.flatnonzero(np.diff(row)) + 1
    return {int(r[0]): x for r, x in zip(np.split(row, cut), np.split(start, cut), strict=True) if len(r)}


def _kept(group: pa.Table, length: int, whole: bool, schema: pa.Schema) -> pa.Table:
    stored = _of_kind(group, DOCUMENTS)
    if not stored:
        return schema.empty_table()
    docs = _documents(stored[0]["data"])
    removed = _removed(group, length, docs.column("doc_id").to_pylist())
    texts, n_words, n_removed, spans = [], [], [], []
    for row, text in enumerate(_texts(docs)):
        words, starts, gone = _words(text), removed.get(row), []
        n_words.append(len(words))
        if starts is None:
            texts.append(text if whole else b" ".join(words))
            n_removed.append(0)
        else:
            change = np.zeros(len(words) + 1, np.int32)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + length, -1)
            stays = np.cumsum(change)[:-1] <= 0
            edge = np.flatnonzero(np.diff(np.concatenate([[True], stays, [True]])))
            gone = edge.tolist()
            texts.append(b" ".join(compress(words, stays.tolist())))
            n_removed.append(int(len(words) - stays.sum()))
        spans.append(gone)
    text = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
    if whole:
        return pa.Table.from_arrays([text if n == "text" else docs.column(n) for n in docs.schema.names], names=docs.schema.names)
    columns = [docs.column("doc_id"), text, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.int32()))]
    return pa.Table.from_arrays(columns, names=["doc_id", "text", "n_words", "n_removed", "removed"])


def _settled(table: pa.Table) -> pa.Table:
    release()
    return table


def without_repeats(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """documents -> (doc_id, text, n_words, n_removed, removed), a row for each row: what stays of each text, its words joined by
    single spaces, and removed, the first word and the word after the last of each removed stretch, flat.

    A word goes if it lies in a window of `length` words whose sequence also starts in a document with a smaller doc_id;
    windows are those of the given texts, and a repeat within one document only stays. Words are separated by ASCII white space
    and not changed. Null texts have no words and become empty. Rows without doc_id lose nothing and make nothing go.
    Repeated rows have equal doc_ids, so neither makes the other go. Empty table: no rows.
    """
    return _without(docs.select(F.col("doc_id").cast("long"), "text"), length, False)


def drop_repeats(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """The rows of documents, all columns, with text less what without_repeats() removes. A text that loses nothing stays as it
    is, white space and null included; one that loses all becomes empty."""
    return _without(docs, length, True)


def _bits(entries: float, most: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1.0, entries / most)))))


def _windows(batches: DataFrame, length: int) -> DataFrame:
    """Each batch's windows that have to be asked for, and the places of all repeated ones."""
    size = batches.agg(F.sum("n")).first()[0] or 0
    bits = max(6, _bits(size / 6, BUCKET_ENTRIES))  # a word and its space take 6 bytes or so
    asked = batches.select("batch", "data").mapInArrow(lambda it: _requests(it, length, bits), _ROWS)
    marks = asked.groupBy("bucket").applyInArrow(_repeated, _ROWS)
    runs = materialise(batches.union(marks).groupBy("batch").applyInArrow(lambda t: _settled(_runs(t, length, bits)), _ROWS), "substring-runs")
    keys = runs.mapInArrow(_run_keys, "run binary, batch long, number int, least long")
    lowest = materialise(keys.groupBy("run").agg(F.min("least").alias("low"), F.count("*").alias("n")).where("n > 1"), "substring-lowest")
    lower = looked_up(keys, lowest, "run").where("low < least").groupBy("batch").agg(F.collect_list(F.struct("number", "low")).alias("lower"))
    asked = runs.select("batch", "data").join(lower, "batch", "left")
    return materialise(asked.mapInArrow(lambda it: _windowed(it, length), _ROWS), "substring-windows")


def _groups(windows: DataFrame, length: int, most: int, long) -> DataFrame:
    """The windows in groups: hashes of prefixes with at most `most` windows each fall into ranges of a quarter of that on average, so that a few share one."""
    bits = _bits(4.0 * (windows.agg(F.sum("n")).first()[0] or 0), most)
    return windows.mapInArrow(lambda it: _dealt(it, length, bits, long), _ROWS)


def _without(docs: DataFrame, length: int, whole: bool, most: int = GROUP_WINDOWS) -> DataFrame:
    batches = materialise(docs.mapInArrow(_packed, _ROWS), "substring-batches")
    found = _windows(batches, length)
    windows = found.where(F.col("kind") == WINDOWS)
    prefixes = long_prefixes(windows, length, most)
    long = docs.sparkSession.sparkContext.broadcast(prefixes)
    answers = _groups(windows, length, most, long).groupBy("bucket").applyInArrow(lambda t: _settled(_tree(t, length)), _ROWS)
    if len(prefixes.get(length, ())):
        lone = materialise(windows.mapInArrow(lambda it: _alone(it, length, long), "batch long, window int, least long, words binary"), "substring-alone")
        lowest = lone.groupBy("words").agg(F.min("least").alias("low"))
        answers = answers.union(lone.join(lowest, "words").select("batch", "window", "low").mapInArrow(_lone_answers, _ROWS))
    kept = found.where(F.col("kind") == PLACES).union(materialise(answers, "substring-answers"))
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.IntegerType()))]
    schema = docs.schema if whole else T.StructType(fields)
    arrow = to_arrow_schema(schema)
    return batches.union(kept).groupBy("batch").applyInArrow(lambda t: _settled(_kept(t, length, whole, arrow)), schema)
