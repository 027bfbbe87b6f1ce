"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tokenizer_path

#: Entries that a worker keeps; what comes first stays, as frequent words come early.
CACHE_ENTRIES = 400_000


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: its own where it has one, else 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class MergeCounter:
    """Counts for one vocabulary file of the merge-table kind with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        byte = _byte_symbols()
        self.inner = [vocab[c] for c in byte]
        self.final = [vocab[c + suffix] for c in byte]
        self.pairs = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.pairs.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        added = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, added)))
        import regex

        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.by_word: dict[str, int] = {}
        self.by_chunk: dict[str, int] = {}

    def word(self, word: bytes) -> int:
        """Tokens of one word: initial symbols minus merges. The heap holds (rank, place) of adjacent pairs, lowest first."""
        n = len(word)
        if n < 2:
            return n
        symbols = [self.inner[b] for b in word[:-1]]
        symbols.append(self.final[word[-1]])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        heap = [(p, i) for i in range(n - 1) if (p := pairs.get(symbols[i] << 20 | symbols[i + 1])) is not None]
        heapq.heapify(heap)
        count = n
        while heap:
            p, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n or pairs.get(symbols[i] << 20 | symbols[j]) != p:
                continue
            symbols[i], symbols[j] = p & 0xFFFFF, -1
            after[i] = k = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if (q := pairs.get(symbols[i] << 20 | symbols[k])) is not None:
                    heapq.heappush(heap, (q, i))
            h = before[i]
            if h >= 0 and (q := pairs.get(symbols[h] << 20 | symbols[i])) is not None:
                heapq.heappush(heap, (q, h))
        return count

    def chunk(self, chunk: str) -> int:
        """Tokens of a text without white space."""
        total = 0
        # lower() of a whole string has one rule that looks around, that of the final sigma; the tokenizer has none
        for w in self.words.findall(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()):
            n = self.by_word.get(w)
            if n is None:
                n = self.word(w.encode())
                if len(self.by_word) < CACHE_ENTRIES and len(w) < 64:
                    self.by_word[w] = n
            total += n
        return total

    def plain(self, text: str) -> int:
        total, known = 0, self.by_chunk
        # \x1c to \x1f separate for split(), but are not white space for the tokenizer
        chunks = re.split(r"[\t-\r \x85\xa0  -     　]+", text) if _ODD.search(text) else text.split()
        for c in chunks:
            n = known.get(c)
            if n is None:
                n = self.chunk(c)
                if len(known) < CACHE_ENTRIES and len(c) < 64:
                    known[c] = n
            total += n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "<|" not in text:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


_ODD = re.compile("[\x1c-\x1f]")


@cache
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def counts(docs: DataFrame, limit: int = 2048, directory: str | None = None) -> DataFrame:
    """documents -> (doc_id, n_bytes, n_tokens, over_limit), a row for each row.

    Tokens as word_bpe_49k.json gives them, its special strings in a text counting as one each. Null and empty texts: 0 and
    0. Nothing is shuffled; a worker keeps the counts of frequent words, within a bound.
    """
    path = tokenizer_path("word_bpe_49k.json", directory)

    @F.arrow_udf("long")
    def tokens(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = counter(path).count
        for batch in texts:
            yield pa.array([count(t.as_py()) for t in batch], pa.int64())

    text = docs["text"]
    out = docs.select(docs["doc_id"], F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
