"""Encoding to and decoding from the pieces of a sentencepiece model, by a streaming Viterbi search."""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tokenizer_path

SPACE = "▁"
CACHE_ENTRIES = 300_000
RUN_ENTRIES, PREFIX_ENTRIES = 200_000, 250_000
#: Characters of a run whose survivors are looked for on demand, and which is kept, at most.
RUN_LENGTH = 64
_SHORT = (2, 1)
#: Finer ways to cut a text first. A way is used if no piece of the model crosses one of its cuts; the last always holds.
_CUTS = [rf"{SPACE}*[^\W\d_²]+|{SPACE}*(?:[^\w{SPACE}]|[\d_²])+|{SPACE}+", rf"{SPACE}*[^{SPACE}]+|{SPACE}+"]


class _Known(dict):
    """Runs -> their ids; those of a run not met before are searched for, and kept while there is room."""

    def __init__(self, search: Callable[[str], bytes]):
        self.search = search

    def __missing__(self, run: str) -> bytes:
        ids = self.search(run)
        if len(self) < RUN_ENTRIES and len(run) < RUN_LENGTH:
            self[run] = ids
        return ids


class Pieces:
    """A model file: its pieces, what joins them, and the search."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.score: list[float] = []
        self.bytes_of: list[bytes] = []
        self.byte_id = [0] * 256
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            self.score.append(model.get_score(i))
            self.bytes_of.append(b"" if model.is_control(i) else piece.replace(SPACE, " ").encode())
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
        self.unknown = model.unk_id()
        self.fallback = all(self.byte_id)
        self.longest = max(map(len, self.ids))
        # in a merge model, scores fall with the merge's rank, all distinct steps; a unigram model has log probabilities
        self.merges = self._is_merge_model()
        self.cut = re.compile(next(c for c in _CUTS if c is _CUTS[-1] or all(re.fullmatch(c, p) for p in self.ids)))
        self.known = _Known(self._ids_of)
        self.raw: dict[str, bytes] = {}
        self.by_prefix: dict[str, str | None] = {}
        self.pair_ok: dict[int, bool] = {}  # number of the left piece * 2^32 + that of the right one
        self.halves_of: dict[str, tuple[str, str] | None] = {}
        by_end: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 2:
                by_end.setdefault(p[-3:], set()).add(len(p))
        #: Last three characters -> lengths of the pieces that end so, longest first, and those of shorter pieces.
        self.lengths = {end: (*sorted(n, reverse=True), 2, 1) for end, n in by_end.items()}

    def _is_merge_model(self) -> bool:
        scores = [self.score[i] for i in self.ids.values()]
        return all(s == int(s) for s in scores)

    # -- which pieces may follow each other in a merge model
    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Merging of adjacent symbols, best score first, leftmost among equals: the result, and the halves last joined."""
        symbols: list[str] = list(text)
        n, ids, score, halves = len(symbols), self.ids, self.score, None
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-score[i], k, symbols[k] + symbols[k + 1]) for k in range(n - 1) if (i := ids.get(symbols[k] + symbols[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, joined = heapq.heappop(heap)
            b = after[a]
            if not symbols[a] or b >= n or symbols[a] + symbols[b] != joined:
                continue
            halves = symbols[a], symbols[b]
            symbols[a], symbols[b] = joined, ""
            after[a] = c = after[b]
            if c < n:
                before[c] = a
            for x, y in ((before[a], a), (a, c)):
                if x >= 0 and y < n and (i := ids.get(symbols[x] + symbols[y])) is not None:
                    heapq.heappush(heap, (-score[i], x, symbols[x] + symbols[y]))
        return [s for s in symbols if s], halves

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """What merging last joins to make a piece; None if merging doesn't make it, or not in the order of the scores."""
        if piece not in self.halves_of:
            made, halves = self.merged(piece)
            if made != [piece] or any(len(h) > 1 and (self._rank(h) >= self._rank(piece) or not self._halves(h)) for h in halves):
                halves = None
            self.halves_of[piece] = halves
        return self.halves_of[piece]

    def _rank(self, piece: str) -> float:
        return -self.score[self.ids[piece]] if len(piece) > 1 else -1.0

    def _makes(self, left: str, piece: str) -> bool:
        """Whether merging the two pieces' text gives the two pieces.

        Undo the later merge of the two symbols at the joint, again and again; if the symbols then at the joint are
        themselves a piece that comes before the merge undone, merging would have joined them.
        """
        if len(left) > 1 and not self._halves(left) or len(piece) > 1 and not self._halves(piece):
            return self.merged(left + piece)[0] == [left, piece]
        ids, score, halves = self.ids, self.score, self.halves_of
        a, b, ra, rb, bound, strict = left, piece, self._rank(left), self._rank(piece), float("inf"), False
        while True:
            i = ids.get(a + b)
            if i is not None and (-score[i] < bound or not strict and -score[i] == bound):
                return False
            if ra > rb:
                bound, strict, a = ra, True, halves[a][1]
                ra = -score[ids[a]] if len(a) > 1 else -1.0
            elif len(b) > 1:
                bound, strict, b = rb, False, halves[b][0]
                rb = -score[ids[b]] if len(b) > 1 else -1.0
            else:
                return True

    def _follows(self, left: str | None, piece: str) -> bool:
        if left is None:
            return len(piece) == 1 or self._halves(piece) is not None or self.merged(piece)[0] == [piece]
        a, b = self.ids.get(left), self.ids.get(piece)
        if a is None or b is None:  # a character without a number
            return self._makes(left, piece)
        ok = self.pair_ok.get(a << 32 | b)
        if ok is None:
            ok = self._makes(left, piece)
            if len(self.pair_ok) < CACHE_ENTRIES:
                self.pair_ok[a << 32 | b] = ok
        return ok

    # -- the search
    def stream(self, parts: Iterable[str]) -> Iterator[str]:
        """The pieces of a text that comes in parts, committed as soon as they are certain.

        Each boundary has one surviving last piece. In a unigram model it is that of the best summed score. In a merge
        model a row of pieces is the result of merging exactly if each two neighbours are what merging makes of their text,
        so a boundary's survivor is the piece that may follow the survivor at its start. Boundaries within the longest piece
        of the end are open; when the backpointer paths from all of them meet in one boundary, the pieces up to it are
        given out and their window is let go.
        """
        longest, text, last, total, check = self.longest, "", [None], [0.0], 4 * self.longest  # last[k] ends at k of the window
        for part in parts:
            text += part
            while len(last) <= len(text):
                self._extend(text, last, total, min(check, len(text)))
                if len(last) > check:
                    meet = self._meeting(last, len(last) - 1)
                    if meet:
                        out = self._path(last, meet)
                        yield from out
                        self._left = out[-1]
                        text, last, total = text[meet:], [None, *last[meet + 1 :]], [0.0, *(t - total[meet] for t in total[meet + 1 :])]
                    check = len(last) + 2 * longest
        yield from self._path(last, len(text))
        self._left = None

    def _extend(self, text: str, last: list, total: list, end: int) -> None:
        """Survivors of the boundaries up to `end`."""
        ids, lengths = self.ids, self.lengths.get
        if not self.merges:
            for i in range(len(last), end + 1):
                top, best = -1e30, None
                for j in range(max(0, i - self.longest), i):
                    k = ids.get(text[j:i])
                    s = total[j] + (self.score[k] if k is not None else -1e6 if i - j == 1 else -1e30)
                    if s > top:
                        top, best = s, text[j:i]
                last.append(best)
                total.append(top)
            return
        fresh = self._left is None  # then a boundary's survivor depends on the text before it alone
        memo = self.by_prefix
        for i in range(len(last), end + 1):
            if fresh and i < 16:
                piece = memo.get(text[:i], 0)
                if piece != 0:
                    last.append(piece)
                    continue
            for n in lengths(text[i - 3 : i], _SHORT) if i > 2 else _SHORT:
                j = i - n
                if j < 0:
                    continue
                piece = text[j:i]
                if n > 1 and piece not in ids:
                    continue
                left = last[j] if j else self._left
                if left is None:
                    if j == 0 and self._follows(None, piece):
                        break
                    continue
                if self._follows(left, piece):
                    break
            else:
                piece = None
            if fresh and i < 16 and len(memo) < PREFIX_ENTRIES:
                memo[text[:i]] = piece
            last.append(piece)

    def _survivor(self, run: str, i: int, last: list) -> str | None:
        """The same survivor of boundary i of a short run, in a merge model: only boundaries that a piece tried for a later one starts at are looked at."""
        head = run[:i]
        piece = self.by_prefix.get(head, 0)
        if piece == 0:
            ids, pair_ok = self.ids.get, self.pair_ok.get
            for n in self.lengths.get(run[i - 3 : i], _SHORT) if i > 2 else _SHORT:
                j = i - n
                if j < 0:
                    continue
                piece = run[j:i]
                b = ids(piece)
                if n > 1 and b is None:
                    continue
                if j == 0:
                    if self._follows(None, piece):
                        break
                    continue
                left = last[j]
                if left == 0:
                    left = self._survivor(run, j, last)
                if left is None:
                    continue
                a = ids(left)
                ok = None if a is None or b is None else pair_ok(a << 32 | b)
                if ok or ok is None and self._follows(left, piece):
                    break
            else:
                piece = None
            if len(self.by_prefix) < PREFIX_ENTRIES:
                self.by_prefix[head] = piece
        last[i] = piece
        return piece

    _left: str | None = None

    def _meeting(self, last: list, end: int) -> int:
        """The last boundary that lies on the paths from all boundaries a later piece can start at."""
        live = {b for b in range(max(1, end - self.longest + 1), end + 1) if last[b] is not None}
        while len(live) > 1:
            b = max(live)
            live.discard(b)
            live.add(b - len(last[b]))
            if 0 in live:
                return 0
        return live.pop() if live else 0

    def _path(self, last: list, end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def _numbers(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        return [self.byte_id[b] for b in piece.encode()] if self.fallback else [self.unknown]

    def _raw(self, piece: str) -> bytes:
        value = np.array(self._numbers(piece), "<u4").tobytes()
        if piece in self.ids:
            self.raw[piece] = value
        return value

    def _ids_of(self, run: str) -> bytes:
        """The ids of a run: a short one's path is followed back from its end, a longer one streams."""
        raw, end = self.raw, len(run)
        if not self.merges or end >= RUN_LENGTH:
            return b"".join([raw[p] if p in raw else self._raw(p) for p in self.stream((run,))])
        last, path = [0] * (end + 1), []
        while end > 0:
            piece = last[end] or self._survivor(run, end, last)
            path.append(raw[piece] if piece in raw else self._raw(piece))
            end -= len(piece)
        return b"".join(path[::-1])

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, each as four bytes, little-endian. Cuts that no piece crosses part it first."""
        if not text:
            return b""
        return b"".join(map(self.known.__getitem__, self.cut.findall(SPACE + text.replace(" ", SPACE))))

    def decode(self, ids: bytes | None) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))
        return raw[raw[:1] == b" " :].decode("utf-8", "replace")


@cache
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, directory: str | None = None) -> DataFrame:
    """documents -> (doc_id, ids binary: unsigned 32-bit little-endian), a row for each row. Null and empty texts: no ids."""
    path = tokenizer_path("piece_bpe_32k.model", directory)

    @F.arrow_udf("binary")
    def ids(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = pieces_of(path)
        for batch in texts:
            yield pa.array([model.encode(t.as_py()) for t in batch], pa.binary())

    return docs.select(docs["doc_id"], ids(docs["text"]).alias("ids"))


def decode(encoded: DataFrame, directory: str | None = None) -> DataFrame:
    """(doc_id, ids) -> (doc_id, ids, text). Decoding gives the encoded text back, but for U+2581, which comes back as a space."""
    path = tokenizer_path("piece_bpe_32k.model", directory)

    @F.arrow_udf("string")
    def text(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = pieces_of(path)
        for batch in ids:
            yield pa.array([model.decode(b.as_py()) for b in batch], pa.string())

    return encoded.select("doc_id", "ids", text("ids").alias("text"))
