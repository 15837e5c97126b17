"""Vectorised 64-bit hashes of words and word shingles, shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values; each salt gives another one."""
    x = x + np.uint64((int(salt) * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 1)
_BYTE_LOWER = _BYTE[_LOWER]
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        step = np.ones(size, np.uint64)
        step[1:] = _BASE
        _powers = np.cumprod(step)
        step[1:] = inverse
        _inverses = np.cumprod(step)
    return _powers[:n], _inverses[:n]


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a few texts.

    ``start``/``end``: byte spans in ``data``; ``first``: for each text the number of
    words before it (one entry more than texts).
    """

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = _SPACE[self.data]
        edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1))
        self.start, self.end = edge[0::2], edge[1::2]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)])

    def hashes(self, lower: bool = True, codes: np.ndarray | None = None) -> np.ndarray:
        """A hash of each word, A-Z lower-cased on demand; ``codes``: other bytes to hash."""
        data = self.data if codes is None else codes
        up, down = _power_tables(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[:-1], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))


def batches(texts: list, chars: int = 400_000) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about so many characters (null: empty), with the first one's position."""
    at, size, run = 0, 0, []
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        run.append(raw)
        size += len(raw)
        if size >= chars:
            yield at, run
            at, size, run = i + 1, 0, []
    if run:
        yield at, run


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``words`` words; a shorter
    text has one hash of all its words, a text without words none."""
    found = Words(texts)
    each = found.hashes()
    scale = mix(np.arange(words, dtype=np.uint64), 2) | np.uint64(1)
    whole = np.zeros(max(0, len(each) - words + 1), np.uint64)
    for j in range(words):
        whole += each[j : j + len(whole)] * scale[j]
    whole = mix(whole, words)
    out = []
    for a, b in zip(found.first[:-1], found.first[1:]):
        if b - a >= words:
            s = np.sort(whole[a : b - words + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(mix(np.array([(each[a:b] * scale[: b - a]).sum(dtype=np.uint64)]), b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
