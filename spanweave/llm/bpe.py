"""Byte-level BPE encoding and decoding with a rank file, on padded numpy matrices."""

from __future__ import annotations

import base64
import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .hashing import mix

#: Pieces longer than this are merged by a queue: a matrix row would cost its length for
#: each of its merges.
LONG = 512
#: Distinct words and pieces whose ids a worker remembers; when full it starts anew.
REMEMBERED = 300_000
#: Rows and characters that are worked on at once.
ROWS, CHARS = 500, 1_500_000
#: Widths of the matrices, in bytes.
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 32, 64, 128, 256, LONG)
_NO_RANK = np.int32(2**31 - 1)
_TWO_SPACES = re.compile(r"\s\s")


class PairTable:
    """(left id, right id) -> merged id in an open-addressing hash table.

    Every split of a token into two tokens is an entry, as a merge is decided by the
    joined bytes and not by the way they came about.
    """

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NO_RANK, np.int32)
        self.probes = 1
        key, value = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = key[free]  # of several with one slot, the last stays
            self.values[slot[free]] = value[free]
            lost = self.keys[slot] != key
            key, value, slot = key[lost], value[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)
            self.probes += bool(len(key))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.values[slot], _NO_RANK)
        todo = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] != -1))
        for _ in range(self.probes):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[todo]]
            hit = held == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (held != -1)]
        return out


class Vocabulary:
    """The ranks of a file of lines ``base64 rank``, and the pattern that cuts text."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.pattern = regex.compile(pattern)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairTable(self.ranks)
        self.known: dict[str, bytes] = {}

    def _merge_rows(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Pieces of about one length: a row each, padded with -1; each round merges the
        leftmost pair of least rank of every row, and finished rows leave the matrix."""
        width = max(map(len, pieces))
        ids = np.full((len(pieces), width), -1, np.int32)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        inside = np.arange(width) < length[:, None]
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        out: list[np.ndarray] = [None] * len(pieces)
        row = np.arange(len(pieces))
        rank = np.full((len(pieces), width), _NO_RANK, np.int32)
        pair = inside[:, 1:]
        rank[:, :-1][pair] = self.pairs(ids[:, :-1][pair], ids[:, 1:][pair])
        while len(row):
            at = rank.argmin(1)
            best = rank[np.arange(len(row)), at]
            done = best == _NO_RANK
            for i in np.flatnonzero(done):
                out[row[i]] = ids[i, : length[i]].copy()
            ids, rank, length, row, at, best = (x[~done] for x in (ids, rank, length, row, at, best))
            if not len(row):
                break
            line = np.arange(len(row))
            ids[line, at] = best
            # close the gap at at + 1
            width = int(length.max())
            column = np.arange(width)[None, :]
            source = np.minimum(column + (column > at[:, None]), ids.shape[1] - 1)
            ids, rank = np.take_along_axis(ids, source, 1), np.take_along_axis(rank, source, 1)
            length = length - 1
            ids[column >= length[:, None]] = -1
            rank[column >= length[:, None] - 1] = _NO_RANK
            for shift in (-1, 0):  # the two pairs that the merged id is in
                p = at + shift
                ok = np.flatnonzero((p >= 0) & (p + 1 < length))
                rank[ok, p[ok]] = self.pairs(ids[ok, p[ok]], ids[ok, p[ok] + 1])
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same order of merges, kept by a queue of (rank, place)."""
        n = len(piece)
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pairs(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        current = first + [int(_NO_RANK)]
        queue = [(r, i) for i, r in enumerate(first) if r != _NO_RANK]
        heapq.heapify(queue)
        tokens, ranks = self.tokens, self.ranks
        while queue:
            rank, i = heapq.heappop(queue)
            if current[i] != rank:
                continue
            j = after[i]
            ids[i], current[j], after[i] = rank, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left < 0:
                    continue
                right = after[left]
                current[left] = ranks.get(tokens[ids[left]] + tokens[ids[right]], int(_NO_RANK)) if right < n else int(_NO_RANK)
                if current[left] != _NO_RANK:
                    heapq.heappush(queue, (current[left], left))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return np.array(out, np.int32)

    def _learn(self, pieces: list[str]) -> None:
        """Work out the ids of pieces not known yet, by classes of length."""
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                self.known[piece] = whole.to_bytes(4, "little")
            elif len(raw) > LONG:
                self.known[piece] = self._merge_long(raw).astype("<u4").tobytes()
            else:
                size = WIDTHS[bisect_left(WIDTHS, len(raw))]
                by_length.setdefault(size, []).append((piece, raw))
        for size, bucket in by_length.items():
            rows = max(1, 200_000 // size)
            for i in range(0, len(bucket), rows):
                run = bucket[i : i + rows]
                for (piece, _), ids in zip(run, self._merge_rows([raw for _, raw in run])):
                    self.known[piece] = ids.astype("<u4").tobytes()

    def _cut(self, text: str) -> list[str]:
        """Parts of a text that the pattern treats independently.

        No match goes on from a character that is no white space into a space, and a single
        space begins a match together with what follows. So where no two white-space
        characters meet, a cut before every space changes nothing.
        """
        if _TWO_SPACES.search(text):
            return [text]
        first, *rest = text.split(" ")
        return [first, *[" " + word for word in rest]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four little-endian bytes each."""
        cut = [self._cut(text) for text in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = {part for parts in cut for part in parts if part not in self.known}
        pieces = {part: self.pattern.findall(part) for part in new}
        self._learn(list({piece for found in pieces.values() for piece in found if piece not in self.known}))
        known = self.known.__getitem__
        self.known |= {part: b"".join(map(known, found)) for part, found in pieces.items()}
        out = [b"".join(map(known, parts)) for parts in cut]
        for part in new:
            if len(part) > LONG:
                self.known.pop(part, None)
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One per worker process."""
    return Vocabulary(path, pattern)


def _runs(texts: list, chars: int = CHARS) -> Iterator[list[str]]:
    run, size = [], 0
    for text in texts:
        run.append(text or "")
        size += len(run[-1])
        if size > chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def _mapped(df: DataFrame, steps: list, without: str | None = None) -> DataFrame:
    """``df`` with binary columns added by steps (source, target, each(list) -> list), all in
    one Python worker, and without the column ``without``."""
    targets = [target for _, target, _ in steps]
    given = [f for f in df.schema.fields if f.name not in targets]
    kept = [f.name for f in given if f.name != without]

    def run(chunks):
        for chunk in chunks:
            for at in range(0, chunk.num_rows, ROWS):
                part = chunk.slice(at, ROWS)
                held = {f.name: part.column(f.name) for f in given}
                for source, target, each in steps:
                    held[target] = pa.array(each(held[source].to_pylist()), pa.binary())
                yield pa.RecordBatch.from_pydict({name: held[name] for name in [*kept, *targets]})
        for _, _, each in steps:
            each.forget()  # the worker idles on while other stages run

    schema = df.select(*kept).schema
    for target in targets:
        schema = schema.add(target, "binary")
    return df.select(*[f.name for f in given]).mapInArrow(run, schema)


class _Coder:
    """A step of ``_mapped`` by the vocabulary of its worker process."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def forget(self) -> None:
        vocabulary(self.path, self.pattern).known.clear()


class _Encoder(_Coder):
    def __call__(self, texts: list) -> list[bytes]:
        words = vocabulary(self.path, self.pattern)
        return [ids for run in _runs(texts) for ids in words.encode(run)]


class _Decoder(_Coder):
    def __call__(self, rows: list) -> list[bytes]:
        words = vocabulary(self.path, self.pattern)
        return [words.decode(row or b"") for row in rows]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a binary column ``ids``: the token ids of the whole text as little-endian
    unsigned 32-bit integers, equal to those of the tiktoken library for the same ranks and
    pattern, without special tokens.

    A null or empty text has no ids. An existing column of that name is replaced; all other
    columns and all rows, repeated ones too, pass unchanged; an empty table stays empty.
    A task remembers the ids of up to REMEMBERED distinct pieces.
    """
    return _mapped(df, [(text, ids, _Encoder(path, pattern))])


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", raw: str = "decoded") -> DataFrame:
    """``df`` with a binary column ``raw``: the bytes that ``ids`` stand for; null ids give
    no bytes. An id outside the vocabulary is an error."""
    return _mapped(df, [(ids, raw, _Decoder(path, pattern))])


def encode_and_decode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with columns ids and decoded in place of ``text``: ``encode`` and ``decode`` in
    one pass, so that a task needs one Python worker and one vocabulary."""
    return _mapped(df, [(text, "ids", _Encoder(path, pattern)), ("ids", "decoded", _Decoder(path, pattern))], without=text)
