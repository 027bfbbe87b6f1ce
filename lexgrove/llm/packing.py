"""Tokenization into pieces of bounded length, and vector best-fit packing of the pieces into sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release, tokenizer_path

#: id that ends a document
END = 2
#: The vocabulary's one special string and its id; it is found in texts, as the tokenizer file has it.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Texts longer than this many characters are encoded in parts, cut where the vocabulary's pattern always starts a new token.
PART_CHARS = 1 << 20
_RANK_BITS = 50


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most. attention: sum over its pieces of length squared."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024

    def demand(self, length: int) -> np.ndarray:
        return np.array([length, 1, length * length], np.int64)

    def all(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], np.int64)


@dataclass
class Rule:
    """How a bin is chosen among those that hold a piece under every constraint.

    norm: least weighted norm of what is left afterwards. dot: largest weighted dot product of demand and residual capacity.
    """

    kind: str = "norm"
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)


@dataclass
class _Bins:
    """Ranges of bins with equal residual capacities."""

    left: list[np.ndarray] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    count: list[int] = field(default_factory=list)


def pack(histogram: dict[int, int], capacity: Capacity = Capacity(), rule: Rule = Rule()) -> tuple[np.ndarray, int]:
    """Best fit, longest first, over classes of equal pieces. histogram: length -> pieces of it.

    Returns runs (length, first rank, bins, first bin, offset), sorted, and the number of bins: the pieces of a length, ranked
    from 0, go one to each bin of its runs. All work is on ranges of equal bins, so its size depends on the number of
    different lengths (the token capacity at most), never on the number of pieces.
    """
    weights, whole = np.array(rule.weights), capacity.all()
    bins, runs, total = _Bins(), [], 0
    for length in sorted(histogram, reverse=True):
        need, rest, rank = capacity.demand(length), histogram[length], 0
        if (need > whole).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity of a sequence")
        while rest:
            left = np.array(bins.left, np.int64).reshape(-1, 3)
            fits = np.flatnonzero((left >= need).all(axis=1))
            if len(fits):
                if rule.kind == "dot":
                    score = -((left[fits] / whole) * (need / whole) * weights).sum(axis=1)
                else:
                    score = ((((left[fits] - need) / whole) ** 2) * weights).sum(axis=1)
                k = int(fits[np.argmin(score)])
                n = min(rest, bins.count[k])
                runs.append((length, rank, n, bins.first[k], capacity.tokens - int(left[k, 0])))
                if n == bins.count[k]:
                    bins.left[k] = left[k] - need
                else:
                    bins.left.append(left[k] - need)
                    bins.first.append(bins.first[k])
                    bins.count.append(n)
                    bins.first[k] += n
                    bins.count[k] -= n
                rest, rank = rest - n, rank + n
                continue
            each = int((whole // need).min())
            n = max(1, rest // each)
            bins.left.append(whole.copy())
            bins.first.append(total)
            bins.count.append(n)
            total += n
        full = [i for i, x in enumerate(bins.left) if x[0] <= 0 or x[1] <= 0 or x[2] <= 0]
        for i in reversed(full):
            del bins.left[i], bins.first[i], bins.count[i]
    return np.array(sorted(runs), np.int64).reshape(-1, 5), total


@cache
def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _parts(text: str) -> Iterator[str]:
    """A text in parts: a space after other than white space and before a letter always starts a token."""
    import re

    at, cut = 0, re.compile(r"\S(?= [^\W\d_])")
    while len(text) - at > PART_CHARS and (m := cut.search(text, at + PART_CHARS)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def encode(text: str | None, path: str) -> np.ndarray:
    """The ids of byte_bpe_50k.json's tokenizer for a text, with END behind; path is that of the same vocabulary as ranks."""
    encoding, out = _encoding(path), []
    for i, plain in enumerate((text or "").split(SPECIAL)):
        if i:
            out.append(np.array([SPECIAL_ID], "<u4"))
        out += [np.array(encoding.encode_ordinary(part), "<u4") for part in _parts(plain)]
    return np.concatenate([*out, np.array([END], "<u4")])


def _pieces(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    part, seen = TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
    for batch in batches:
        docs, rows = [], []
        for d, text in zip(batch.column(0), batch.column(1), strict=True):
            ids = encode(text.as_py(), path)
            cuts = [0, *range(len(ids) % limit or limit, len(ids) + 1, limit)] if len(ids) > limit else [0, len(ids)]
            for k in range(len(cuts) - 1):
                a, b = cuts[k], cuts[k + 1]
                docs.append(d)
                rows.append((k, a, b - a, zlib.crc32(ids[a:b].tobytes()), seen[b - a]))
                seen[b - a] += 1
        k, a, n, crc, rank = np.array(rows, np.int64).reshape(-1, 5).T
        columns = [pa.array([d.as_py() for d in docs], batch.column(0).type), pa.array(k.astype(np.int32)), *map(pa.array, (a, n, crc)), pa.array(np.full(len(k), part, np.int64)), pa.array(rank)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])
        del docs, rows, columns
        release()


def pieces(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """documents -> (doc_id, piece, start, length, ids_crc32, part, rank); rank counts the pieces of a length within a part.

    The ids are those of the tokenizer file; they are made by the faster of the two libraries that hold this vocabulary.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part long, rank long"
    return docs.select("doc_id", "text").mapInArrow(lambda it: _pieces(it, path, limit), schema)


def _placed(batches: Iterator[pa.RecordBatch], runs) -> Iterator[pa.RecordBatch]:
    r = runs.value
    keys = (r[:, 0] << _RANK_BITS) + r[:, 1]
    for b in batches:
        length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
        at = np.searchsorted(keys, (length << _RANK_BITS) + rank, "right") - 1
        columns = [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(r[at, 3] + rank - r[at, 1]), pa.array(r[at, 4])]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def best_fit(docs: DataFrame, capacity: Capacity = Capacity(), rule: Rule = Rule(), directory: str | None = None) -> DataFrame:
    """documents -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece.

    A document is its ids and END; one over the token capacity is cut, its first piece being the shorter one. Null and empty
    texts are the one id END. Repeated rows are packed each. Empty table: no rows. Only the histogram of lengths, at most one
    count for each length up to the token capacity, goes to the driver, and only the runs of pack() are broadcast; each piece
    finds its place from its rank among the pieces of its length, which counts within written parts and a running sum over
    parts give, so that no task gathers the pieces of a frequent length.
    """
    spark = docs.sparkSession
    cut = materialise(pieces(docs, tokenizer_path("byte_bpe_50k.tiktoken", directory), capacity.tokens), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(pack(histogram, capacity, rule)[0])
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("part", "base")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(lambda it: _placed(it, runs), schema)
