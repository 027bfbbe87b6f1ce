"""Periodic runs of words, after Kolpakov and Kucherov: LZ factors from a suffix automaton, Main's runs across factors, the others as copies."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, release


@dataclass(frozen=True)
class Least:
    """What counts as a run: at least so many words, and at least so many times its period (3 or more)."""

    words: int = 24
    times: int = 3

    def holds(self, length: int, period: int) -> bool:
        return length >= self.words and length >= self.times * period


RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"
_MULTIPLIER, _MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words, equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def candidates(ids: np.ndarray, least: Least = Least()) -> list[tuple[int, int]]:
    """Stretches [start, end) such that each run lies within one of them. Most documents have none.

    With w = words // 3: a run of period q has at least 3 q and 3 w words, so each of its windows of w words stands in it a second time, q to
    the left or to the right. So only consecutive windows that recur, at a distance of a third of the stretch at most, can make up a run. Windows
    are compared by 64-bit hashes: a collision makes a stretch longer, and loses nothing.
    """
    w = max(1, least.words // 3)
    n, at_least = len(ids) - w + 1, max(1, least.words - w + 1)
    if n < at_least:
        return []
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _MIXER
    mixed ^= mixed >> np.uint64(29)
    windows = np.zeros(n, np.uint64)
    for k in range(w):
        windows = windows * _MULTIPLIER + mixed[k : k + n]
    order = np.argsort(windows, kind="stable")
    gap = np.where(np.diff(windows[order]) == 0, np.diff(order), n + w)
    nearest = np.full(n, n + w)
    nearest[order[1:]] = gap
    nearest[order[:-1]] = np.minimum(nearest[order[:-1]], gap)

    found, open_ = [], [(0, n)]
    while open_:
        a, b = open_.pop()
        ok = np.concatenate([[False], nearest[a:b] * least.times <= b - a + w - 1, [False]])
        edges = np.flatnonzero(ok[1:] != ok[:-1])
        for s, e in zip(edges[::2], edges[1::2], strict=True):
            if e - s >= at_least:
                (found if (s, e) == (0, b - a) else open_).append((a + int(s), a + int(e)))
    return sorted((a, b + w - 1) for a, b in found)


def automaton(s: list[int]) -> tuple[list[int], list[dict[int, int] | None]]:
    """Suffix automaton of s: for each state the end of its first occurrence, and its transitions.

    State i <= len(s) is that of the prefix of i letters. Its transition by s[i], to state i + 1, isn't stored: it never changes.
    """
    n = len(s)
    length, link, first = list(range(n + 1)), [-1] + [0] * n, [-1, *range(n)]
    more: list[dict[int, int] | None] = [None] * (n + 1)
    for i, c in enumerate(s):
        new, p, q = i + 1, link[i], -1
        while p >= 0:
            if p <= n and s[p] == c:
                q = p + 1
                break
            out = more[p]
            if out is None:
                more[p] = {c: new}
            elif c in out:
                q = out[c]
                break
            else:
                out[c] = new
            p = link[p]
        if q < 0:
            continue
        if length[p] + 1 == length[q]:
            link[new] = q
            continue
        copy, out = len(length), dict(more[q] or ())
        if q <= n:
            out[s[q]] = q + 1
        length.append(length[p] + 1)
        link.append(link[q])
        first.append(first[q])
        more.append(out)
        link[q] = link[new] = copy
        while p >= 0 and not (p <= n and s[p] == c):
            out = more[p]
            if out is None or out.get(c) != q:
                break
            out[c] = copy
            p = link[p]
    return first, more


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """LZ factors (start, length, source): each is a new letter (source -1), or the longest piece that also starts further left, at source."""
    first, more = automaton(s)
    n, at, out = len(s), 0, []
    while at < n:
        state, k = 0, 0
        while at + k < n:
            c = s[at + k]
            follow = state + 1 if state <= n and state < at + k and s[state] == c else (more[state] or {}).get(c, -1)
            if follow < 0 or first[follow] - k >= at:
                break
            state, k = follow, k + 1
        out.append((at, max(k, 1), first[state] - k + 1 if k else -1))
        at += max(k, 1)
    return out


def matches(s: list[int]) -> list[int]:
    """For each place the length of what matches the beginning of s there (the Z function)."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def across(s: list[int], at: int, before: int, after: int, least: Least) -> Iterator[tuple[int, int, int]]:
    """Runs (start, end, period) that touch the boundary at and end in the factor of `after` letters there; the factor before it has `before`.

    Such a run starts less than (before + after) / 2 to the left of the factor before: had it a whole period there, that factor would be longer.
    Of its periods one stands wholly to the right of the boundary or wholly to the left of it, whence its ends follow by longest matches (Main).
    """
    t = min(at, before + (before + after) // 2 + 1)
    if t + after < least.words:
        return
    u, back = s[at : at + after], s[at - t : at][::-1]
    most, n = (t + after) // least.times, len(s)
    ahead, behind = matches(u), matches(back)
    upto = matches([*back, -1, *s[at - t : at + after][::-1]])
    across_ = matches([*u, -1, *s[at - t : at + after]]) if after else []
    for p in range(1, most + 1):
        ends = []
        if p <= after:
            ends.append((at - upto[t + 1 + after - p], at + p + (ahead[p] if p < after else 0)))
        if p <= t:
            ends.append((at - p - (behind[p] if p < t else 0), at + (min(after, across_[after + 1 + t - p]) if after else 0)))
        for start, end in ends:
            if least.holds(end - start, p) and not (end < n and s[end] == s[end - p]) and not (start and s[start - 1] == s[start - 1 + p]):
                yield start, end, p


def runs(ids: list[int], least: Least = Least()) -> list[tuple[int, int, int]]:
    """All runs (start, length, smallest period), sorted: stretches of a period that no neighbour extends, as long as `least` says."""
    smallest: dict[tuple[int, int], int] = {}
    placed: list[tuple[int, int]] = []

    def add(start: int, end: int, p: int) -> None:
        known = smallest.get((start, end))
        if known is None:
            insort(placed, (start, end))
        if known is None or p < known:
            smallest[start, end] = p

    before = 0
    for at, length, source in [*factors(ids), (len(ids), 0, -1)]:
        for run in across(ids, at, before, length, least):
            add(*run)
        if length > least.words and source >= 0:  # what lies inside the factor was found in its source
            k, shift = bisect_right(placed, (source, len(ids))), at - source
            while k < len(placed) and placed[k][0] < source + length:
                start, end = placed[k]
                if end < source + length:
                    add(start + shift, end + shift, smallest[start, end])
                k += 1
        before = length
    return [(s, e - s, smallest[s, e]) for s, e in placed]


def runs_of(words: list[bytes], least: Least = Least()) -> list[tuple[int, int, int]]:
    ids = numbered(words)
    return [(a + s, n, p) for a, b in candidates(ids, least) for s, n, p in runs(ids[a:b].tolist(), least)]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not found:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return b" ".join([words[k] for k in np.flatnonzero(keep)])


def _batches(batches: Iterator[pa.RecordBatch], least: Least, runs_name: str) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for b in batches:
        at = b.schema.names.index("text")
        all_, texts = [], []
        for t in b.column(at).cast(pa.binary()):
            words = (t.as_py() or b"").split()
            found = runs_of(words, least)
            all_.append([{"start": s, "length": n, "period": p} for s, n, p in found])
            texts.append(collapsed(words, found))
        columns = [pa.array(texts, pa.binary()).cast(pa.string()) if k == at else b.column(k) for k in range(b.num_columns)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(all_, kind)], [*b.schema.names, runs_name])
    release()


def collapse_runs(docs: DataFrame, least: Least = Least(), name: str = "runs") -> DataFrame:
    """documents -> the same rows and columns; text without the words that any run holds after its first period, joined by single spaces; runs: all runs.

    Runs are array<struct<start, length, period>> in words, by start and period. If there is such a column, the new one gets a name with _ appended (common.fresh).
    Null, empty and white-space texts: an empty text without runs. Repeated rows get equal results; an empty table gives an empty table. No
    row depends on another, nothing is shuffled. A task holds one batch of texts, and an automaton of a few hundred bytes for each word of one
    stretch of one text that repeats itself; texts of prose need none.
    """
    name = fresh(docs, name)
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(lambda it: _batches(it, least, name), f"{schema}, `{name}` {RUN}")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a period written into each tenth document (by crc32 of the decimal doc_id), as the query asks; other texts stay. Without doc_id: stays."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, words).alias("_w"))
    n, g = F.size("_w"), F.floor(F.col("_h") / 10)
    rows = rows.withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + g % 8)))
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    cycled = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_w", place(i).cast("int")))
    return rows.select("doc_id", F.when(n > 0, F.array_join(cycled, " ")).otherwise(F.col("text")).alias("text"))
