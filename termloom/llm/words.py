"""Words of texts as 64-bit hashes, for the operators on word sequences."""

from __future__ import annotations

import re

import numpy as np

_BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once; a longer word makes a step of its own.
STEP_BYTES = 500_000
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_SPACE = re.compile(rb"[\x20\x09-\x0D]")

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, up to n."""
    global _powers
    if len(_powers[0]) <= n:
        bases = _BASE, pow(_BASE, -1, 1 << 64)
        _powers = tuple(np.r_[np.uint64(1), np.cumprod(np.full(n, b, np.uint64))] for b in bases)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def forget_powers() -> None:
    global _powers
    _powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


class Content:
    """Hashes of any parts of some bytes, alike wherever a part stands."""

    def __init__(self, data: bytes | np.ndarray, n: int):
        power, self.inverse = powers(n)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(LETTERS[np.frombuffer(data, np.uint8, n)] * power[:-1], out=self.total[1:])

    def parts(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        content = (self.total[stop] - self.total[start]) * self.inverse[start]
        return mix(content + (stop - start).astype(np.uint64))


def _hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``data``, and where each starts."""
    space = _SPACES[np.frombuffer(data, np.uint8)]
    word = ~space
    start = np.flatnonzero(word & np.r_[True, space[:-1]])
    stop = np.flatnonzero(word & np.r_[space[1:], True]) + 1
    return Content(data, len(data)).parts(start, stop), start


def word_hashes(text: str | bytes) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+``."""
    return hashes_of([text.encode() if isinstance(text, str) else text])[0]


def hashes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in a row, and how many words each text has."""
    data = b"\n".join(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    parts, counts, at = [], np.zeros(len(texts), np.int64), 0
    while at < len(data):
        stop = len(data)
        if stop - at > STEP_BYTES:
            border = _SPACE.search(data, at + STEP_BYTES)
            stop = border.start() if border else stop
        found, starts = _hashes(data[at:stop])
        parts.append(found)
        counts += np.bincount(np.searchsorted(ends, starts + at, "right"), minlength=len(texts))
        at = stop
    return np.concatenate(parts or [np.empty(0, np.uint64)]), counts


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` items from each place on, by doubling: a window of
    2 n is made of two of n, one of any size of two that overlap."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    length = 1
    while length * 2 <= size:
        h = pair(h[:-length], h[length:])
        length *= 2
    if length < size:
        h = pair(h[:n], h[size - length : size - length + n])
    return h


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + right)
