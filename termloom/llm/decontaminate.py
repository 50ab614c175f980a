"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

An item of m bytes that lies in a document with at most k edits shares at least
m + 1 - q - q * k of its q-grams with it, and those lie on diagonals (place in the
document less place in the item) at most k apart. So shared q-grams are counted in
bands of 2 (k + 1) diagonals that overlap by half; a band that reaches the bound is
aligned, inside the band only, and reported if the edits are within the budget.

Repeated q-grams are not paired place by place: equal ones at most q bytes apart make a run,
in items those that share a band, and a run of a document with a run of an item adds to a range of bands at once, by
two entries of a difference array, no less than their pairs would. What that counts too
much the alignment turns down; equal regions are aligned once.

Bytes are compared with A-Z lowered and line breaks and tabs as spaces. An item too short for
the lemma has a smaller budget, down to exact containment; one shorter than a q-gram has to
stand between word borders; an empty item matches nothing. Time for a text grows with its
length times the items that share its q-grams; an alignment takes the item's length
times its budget, so items of a megabyte are found fast only without edits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import enter, on_leaving, ship_code, whole_text

Q = 12
#: Edits allowed, as a share of an item's bytes.
EDIT_RATE = 0.06
#: The benchmark is taken in blocks of so many bytes of text; each is broadcast.
BLOCK_BYTES = 4_000_000
#: Bytes of text that are looked up at once, which bounds the memory of a task.
SLICE_BYTES = 4_000_000

_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b"\n\t\r" else b for b in range(256))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def fold(text: bytes) -> bytes:
    return text.translate(_FOLD)


def qgram_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of the q bytes from each place on."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    first = np.ndarray((n,), "<u8", data, 0, (1,))
    last = np.ndarray((n,), "<u8", data, Q - 8, (1,))
    return first * _M1 + (last ^ (last >> np.uint64(29))) * _M2


def budget(m: int) -> int:
    """The most edits for which the lemma still asks for a shared q-gram."""
    return max(0, min(int(EDIT_RATE * m), (m - Q) // Q))


def is_word(data: bytes, at: int) -> bool:
    """Whether a letter, a digit or part of a character beyond ASCII stands there."""
    return 0 <= at < len(data) and (data[at] >= 128 or chr(data[at]).isalnum())


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in items]
        self.texts = [fold(t) for _, t in items]
        self.short = ahocorasick.Automaton()
        for at, t in enumerate(self.texts):
            if 0 < len(t) < Q:
                key = t.decode("latin-1")
                self.short.add_word(key, (len(t), [*self.short.get(key, (0, []))[1], at]))
        self.short.make_automaton()
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.budgets = np.array([budget(m) for m in sizes], np.int64)
        self.least = np.maximum(1, sizes + 1 - Q - Q * self.budgets)
        grams = [qgram_hashes(t) for t in self.texts]
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams] or [np.empty(0, np.int64)])
        every = np.concatenate(grams or [np.empty(0, np.uint64)])
        order = np.lexsort((place, owner, every))
        every, owner, place = every[order], owner[order], place[order]
        same = (every[1:] == every[:-1]) & (owner[1:] == owner[:-1])
        new = np.flatnonzero(np.r_[np.ones(min(1, len(every)), bool), ~same | (place[1:] - place[:-1] > self.budgets[owner[1:]] + 1)])
        last = np.r_[new[1:], len(every)][: len(new)] - 1
        self.owner, self.from_, self.to, self.size = owner[new], place[new], place[last], last - new + 1
        self.keys, self.first, self.count = np.unique(every[new], return_index=True, return_counts=True)
        bits = max(20, int(len(self.keys)).bit_length() + 4)
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[self.keys >> self.shift] = True

    def bands(self, data: bytes, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, first band, last band) that may reach the item's bound.
        ``starts``: where each document starts in ``data``, and the end."""
        if not len(self.keys):
            return
        h = qgram_hashes(data)
        at = np.flatnonzero(self.filter[h >> self.shift])
        row = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        good = self.keys[row] == h[at]
        at, row = at[good], row[good]
        doc = np.searchsorted(starts, at, "right") - 1
        good = at + Q <= starts[doc + 1]
        at, row, doc = at[good], row[good], doc[good]
        if not len(at):
            return
        order = np.lexsort((at, row, doc))
        at, row, doc = at[order], row[order], doc[order]
        new = np.flatnonzero(np.r_[True, (at[1:] - at[:-1] > Q) | (row[1:] != row[:-1]) | (doc[1:] != doc[:-1])])
        end = np.r_[new[1:], len(at)] - 1
        n = self.count[row[new]]
        take = np.repeat(self.first[row[new]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        from_, to, long = np.repeat(at[new], n), np.repeat(at[end], n), np.repeat(end - new + 1, n)
        item, doc = self.owner[take], np.repeat(doc[new], n)
        width = self.budgets[item] + 1
        lowest = (from_ - self.to[take] + (1 << 40)) // width - 1
        highest = (to - self.from_[take] + (1 << 40)) // width
        pairs = np.minimum(self.size[take], np.minimum(self.size[take], 2 * width) * long)
        place = np.concatenate([lowest, highest + 1])
        change = np.concatenate([pairs, -pairs])
        item, doc = np.tile(item, 2), np.tile(doc, 2)
        order = np.lexsort((place, item, doc))
        place, change, item, doc = place[order], change[order], item[order], doc[order]
        last = np.r_[(place[1:] != place[:-1]) | (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]), True]
        counts = np.cumsum(change)[last]  # each pair of runs adds and takes away, so groups end at 0
        place, item, doc = place[last], item[last], doc[last]
        for k in np.flatnonzero(counts >= self.least[item]).tolist():
            yield int(doc[k]), int(item[k]), int(place[k]), int(place[k + 1]) - 1

    def find(self, data: bytes, starts: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        """(document, item) -> (edits, end in the document) of its best region."""
        data = fold(data)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        of, seen = None, {}
        for doc, item, first, last in self.bands(data, starts):
            if of != (doc, item):
                of, seen = (doc, item), {}
            start, stop, text, k = int(starts[doc]), int(starts[doc + 1]), self.texts[item], int(self.budgets[item])
            for band in range(first, last + 1):
                if best.get(of, (1,))[0] == 0:
                    break
                lo = band * (k + 1) - (1 << 40)
                left, right = lo - k, lo + 3 * k + 2 + len(text)
                region = data[left:right] if start <= left and right <= stop else None
                if region is None or region not in seen:  # an equal region before has no more edits
                    found = self.align(data, start, stop, text, lo, lo + 2 * (k + 1), k)
                    if found:
                        best[of] = min(best.get(of, found), found)
                    if region is not None:
                        seen[region] = None
        self._find_short(data, starts, best)
        return best

    def _find_short(self, data: bytes, starts: np.ndarray, best: dict[tuple[int, int], tuple[int, int]]) -> None:
        if not len(self.short):
            return
        for end, (size, items) in self.short.iter(data.decode("latin-1")):
            at = end + 1 - size
            doc = int(np.searchsorted(starts, at, "right")) - 1
            start, stop = int(starts[doc]), int(starts[doc + 1])
            inside = end < stop and not (at > start and is_word(data, at) and is_word(data, at - 1))
            if inside and not (end + 1 < stop and is_word(data, end) and is_word(data, end + 1)):
                for item in items:
                    best.setdefault((doc, item), (0, end + 1 - start))

    @staticmethod
    def align(data: bytes, start: int, stop: int, item: bytes, lo: int, hi: int, k: int) -> tuple[int, int] | None:
        """The fewest edits that turn the item into some part of data[start:stop], along
        diagonals lo - k to hi + k only, and where that part ends; None beyond k."""
        lo, hi, m = lo - k, hi + k, len(item)
        place = data.find(item, max(start, lo), min(stop, hi + m))
        if place >= 0:
            return 0, place + m - start
        if k == 0:
            return None
        left, right = max(start, lo), min(stop, hi + m)
        text = np.full(hi - lo + m + 1, 256, np.int16)
        if right > left:
            text[left - lo : right - lo] = np.frombuffer(data, np.uint8, right - left, left)
        width = hi - lo + 1
        steps = np.arange(width)
        far = m + width
        cost = np.zeros(width, np.int64)
        cost[(steps + lo < start) | (steps + lo > stop)] = far
        for i, letter in enumerate(item):
            pay = cost + (text[i : i + width] != letter)
            pay[:-1] = np.minimum(pay[:-1], cost[1:] + 1)
            cost = np.minimum.accumulate(pay - steps) + steps
            if cost.min() > k:
                return None
        ends = steps + lo + m
        cost[(ends > stop) | (ends < start)] = far
        at = int(cost.argmin())
        return (int(cost[at]), int(ends[at]) - start) if cost[at] <= k else None


def _buffers(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    if pa.types.is_large_string(column.type) or pa.types.is_string(column.type):
        wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
        offsets = np.frombuffer(column.buffers()[1], wide, len(column) + 1, column.offset * wide().itemsize)
        return offsets.astype(np.int64), memoryview(column.buffers()[2] or b"")
    raise TypeError(column.type)


def search(column: pa.Array, index: Index) -> dict[tuple[int, int], tuple[int, int]]:
    """(row, item) -> (edits, end) over a column of texts without nulls, in slices of
    whole documents."""
    offsets, data = _buffers(column)
    out, row = {}, 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        part = bytes(data[offsets[row] : offsets[stop]])
        found = index.find(part, offsets[row : stop + 1] - offsets[row])
        out.update({(row + d, i): v for (d, i), v in found.items()})
        row = stop
    return out


_indexes: dict[str, Index] = {}
on_leaving("decontaminate", _indexes.clear)


def _index(block) -> Index:
    """One index per worker process and broadcast block."""
    if block.id not in _indexes:
        _indexes.clear()
        _indexes[block.id] = Index(block.value)
    return _indexes[block.id]


class _Block:
    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def blocks(benchmark: DataFrame) -> list[_Block]:
    """The benchmark's texts in broadcast blocks of bounded size; rows with null id or
    text are no items. An item longer than a block has one of its own."""
    context = benchmark.sparkSession.sparkContext
    out, block, size = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).dropna().dropDuplicates()
    for r in rows.toLocalIterator():
        text = r["t"].encode()
        if block and size + len(text) > BLOCK_BYTES:
            out.append(block)
            block, size = [], 0
        block.append((r["i"], text))
        size += len(text)
    out.append(block)
    return [_Block(context.broadcast(sorted(b))) for b in out]


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, edits, end_byte)``: one row for each document row and item
    that it holds, with the fewest edits and where in the text that region ends.

    Null and empty texts hold nothing, an empty benchmark matches nothing, repeated rows
    are reported each. No shuffle: every task looks its rows up in each block.
    """
    ship_code(docs.sparkSession)
    kept = docs.select("doc_id", whole_text().alias("text"))
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, item_id long, edits int, end_byte long"

    def scan(block: _Block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            enter("decontaminate")
            index = _index(block)
            for batch in batches:
                found = sorted(search(batch.column(1), index).items())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([d for (d, _), _ in found], pa.int64())),
                        pa.array([index.ids[i] for (_, i), _ in found], pa.int64()),
                        pa.array([e for _, (e, _) in found], pa.int32()),
                        pa.array([p for _, (_, p) in found], pa.int64()),
                    ],
                    ["doc_id", "item_id", "edits", "end_byte"],
                )

        return kept.mapInArrow(run, schema)

    first, *rest = map(scan, blocks(benchmark))
    for part in rest:
        first = first.unionByName(part)
    return first


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns stay as they are."""
    ship_code(docs.sparkSession)
    names = docs.columns
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), whole_text().alias("_text"))
    schema = out.schema

    def keep(block: _Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            enter("decontaminate")
            index = _index(block)
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for doc, _ in search(batch.column(1), index):
                    good[doc] = False
                yield batch.filter(pa.array(good))

        return run

    for block in blocks(benchmark):
        out = out.mapInArrow(keep(block), schema)
    return out.select("_doc.*")
