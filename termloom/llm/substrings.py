"""Passages of words that an earlier document has, found length by length.

Windows of a short length that two documents share are extended to about twice that
length, and only where both halves are shared; so on until the wanted length, or until
no candidate is left. At the first length one window in each group is enough: every
window of the second length stands for the smallest of the short ones in it, which is the
same wherever that window occurs, and about a quarter of the short windows remain.

Windows are compared by 64-bit hashes. A window is removed only if its hash and that of a
short window in it both occur in another document, so among 10 ** 12 candidates about
one in 10 ** 7 is expected to be taken wrongly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange
from .common import enter, on_leaving, ship_code
from .exchange import Gathered
from .words import forget_powers, hashes_of, window_hashes

WINDOW_WORDS = 13

on_leaving("substrings", forget_powers)


def lengths(size: int) -> list[int]:
    """The window lengths, each at most twice the one before, ending with ``size``."""
    out = [size]
    while out[0] > 8:
        out.insert(0, -(-out[0] // 2))
    return out


class _Words:
    """Word hashes of some documents in a row; documents without an id take no part."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.h, counts = hashes_of([t if i is not None else b"" for i, t in zip(ids, texts, strict=True)])
        self.ids = np.repeat(np.array([0 if i is None else i for i in ids], np.int64), counts)
        self.ends = np.repeat(np.cumsum(counts), counts)
        self.starts = np.cumsum(counts) - counts

    def whole(self, size: int) -> np.ndarray:
        """Which windows of ``size`` lie in one document."""
        n = max(0, len(self.h) - size + 1)
        return np.arange(n) + size <= self.ends[:n]

    def smallest(self, short: int, size: int) -> np.ndarray:
        """The smallest hash of the ``short`` windows in each window of ``size``."""
        return exchange.rolling(window_hashes(self.h, short), size - short + 1, np.minimum)


def _candidates(words: _Words, steps: list[int], level: int, known: np.ndarray, bits: int) -> np.ndarray:
    """Which windows of ``steps[level]`` may be shared, by what is shared one level below."""
    size, short = steps[level], steps[level - 1]
    good = words.whole(size)
    if level == 1:
        return good & exchange.has(known, exchange.coarse(words.smallest(short, size), bits))
    shared = exchange.has(known, exchange.coarse(window_hashes(words.h, short), bits))
    n = len(good)
    return good & shared[:n] & shared[size - short : size - short + n]


def _shared(docs: DataFrame, size: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """The blocks, and for each block its windows of ``size`` that several ids have."""
    rows = exchange.in_blocks(docs)
    steps = lengths(size)

    def first(block: pa.Table) -> pa.Table:
        enter("substrings")
        out = Gathered()
        for ids, texts in exchange.slices(block):
            words = _Words(ids, texts)
            if len(steps) == 1:
                keys, good = window_hashes(words.h, size), words.whole(size)
            else:
                keys, good = exchange.coarse(words.smallest(steps[0], steps[1]), bits), words.whole(steps[1])
            out.add(keys[good], words.ids[: len(good)][good])
        return exchange.packed(block.column("block")[0].as_py(), out, bits, len(steps) == 1)

    found = exchange.first_pass(rows, first, bits)

    def longer(level: int):
        last = level == len(steps) - 1

        def emit(block: pa.Table, known: pa.Table) -> pa.Table:
            enter("substrings")
            out = Gathered()
            keys, _ = exchange.answers(known, bits)
            if not len(keys) or not block.num_rows:
                return exchange.NOTHING
            for ids, texts in exchange.slices(block):
                words = _Words(ids, texts)
                good = _candidates(words, steps, level, keys, bits)
                found = window_hashes(words.h, steps[level])[good]
                out.add(found if last else exchange.coarse(found, bits), words.ids[: len(good)][good])
            return exchange.packed(block.column("block")[0].as_py(), out, bits, last)

        return emit

    for level in range(1, len(steps)):
        found = exchange.next_pass(rows, found, longer(level), bits)
    return rows, found


def _removed(words: _Words, size: int, keys: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which words a window covers that starts in a document with a smaller id too."""
    h = window_hashes(words.h, size)
    mark = np.zeros(len(words.h) + 1, np.int64)
    if len(keys) and len(h):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = np.flatnonzero((keys[at] == h) & words.whole(size) & (least[at] < words.ids[: len(h)]))
        np.add.at(mark, hit, 1)
        np.add.at(mark, hit + size, -1)
    return np.cumsum(mark[:-1]) > 0


def _kept(docs: DataFrame, size: int, finish, schema: str) -> DataFrame:
    ship_code(docs.sparkSession)
    bits = exchange.bucket_bits(docs)
    rows, found = _shared(docs, size, bits)

    def apply(block: pa.Table, known: pa.Table) -> pa.Table:
        enter("substrings")
        keys, least = exchange.answers(known, bits)
        parts = []
        for ids, texts in exchange.slices(block):
            words = _Words(ids, texts)
            gone = _removed(words, size, keys, least)
            parts.append(finish(ids, texts, _by_document(words, gone, ids)))
        return pa.concat_tables(parts) if parts else finish([], [], iter(()))

    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(apply, schema)


def _by_document(words: _Words, gone: np.ndarray, ids: list) -> Iterator[np.ndarray]:
    ends = np.r_[words.starts[1:], len(gone)]
    for start, end in zip(words.starts.tolist(), ends.tolist(), strict=True):
        yield gone[start:end]


def _without(text: bytes, gone: np.ndarray) -> tuple[int, bytes]:
    found = text.split()
    if not gone.any():
        return len(found), b" ".join(found)
    return len(found), b" ".join([w for w, g in zip(found, gone.tolist(), strict=True) if not g])


def digests(docs: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` for every row; null and empty texts
    have no words, a row with a null id keeps all of its words and removes none from
    others, rows with one id never remove words from each other."""

    def finish(ids, texts, gone) -> pa.Table:
        counts, removed, sums = [], [], []
        for text, g in zip(texts, gone, strict=True):
            n, kept = _without(text, g)
            counts.append(n)
            removed.append(int(g.sum()))
            sums.append(hashlib.sha256(kept).hexdigest())
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sums, pa.string())})

    return _kept(docs, size, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """``(doc_id, text)`` with the kept words of every row, joined by a space."""

    def finish(ids, texts, gone) -> pa.Table:
        kept = [_without(t, g)[1].decode(errors="replace") for t, g in zip(texts, gone, strict=True)]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(kept, pa.string())})

    return _kept(docs, size, finish, "doc_id long, text string")
