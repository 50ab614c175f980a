"""Repeated byte strings, by suffix arrays built with linear grouping.

``suffix_array`` groups suffixes by the longest Lyndon word they start with. Groups are
processed in descending order: each suffix of a group looks up the nearest suffix before
it in a smaller group (its previous-smaller pointer), whose Lyndon word the group's word
extends; suffixes that are extended, by the number of times, split off into
groups of their own right above. Afterwards, one scan over the array under construction
emits each group's suffixes in order along the same pointers. No ranks are renamed.

A suffix array of a whole corpus fits no machine, so only what can be repeated is sorted,
and in independent parts. Each window of 50 bytes stands under the smallest hash of the
25-byte strings in it (its anchor), so equal windows have equal anchors. Adjacent windows
under one anchor form a fragment. Anchors that one document alone has are dropped, equal
fragments are stored once with the smallest id. Where an anchor has several distinct
fragments, a hash of each window picks out those that may stand in more than one of them;
adjacent ones make shorter fragments, and the distinct ones of these make one text, whose
suffix array brings equal windows together: each gets the smallest id of its run. An anchor
with one distinct fragment, before or after, needs no sorting.

Fragments are told apart by 64-bit hashes of their whole content, looked up together with
their anchors' being shared; among 10 ** 12 fragments about one in 10 ** 7 is expected
to be mistaken.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import drop_table, enter, materialize, on_leaving, ship_code
from .exchange import Gathered
from .words import Content, forget_powers, mix, pair

SIZE = 50
SHORT = 25
#: Bytes of fragments whose windows are hashed at once.
PART_BYTES = 500_000
_FOUND = "block long, bucket long, anchors binary, prints binary, least binary, texts array<binary>"
_FOUND_TYPES = pa.schema(
    [("block", pa.int64()), ("bucket", pa.int64()), ("anchors", pa.binary()), ("prints", pa.binary()), ("least", pa.binary()), ("texts", pa.list_(pa.binary()))]
)
_REPLY = "block long, open boolean, prints binary, offsets binary, least binary"
_REPLY_TYPES = pa.schema([("block", pa.int64()), ("open", pa.bool_()), ("prints", pa.binary()), ("offsets", pa.binary()), ("least", pa.binary())])
#: In the offsets of an open reply: the fragment is to be sorted; the block is to send its text.
SORT, SEND = -1, -2



def suffix_array(text: Sequence[int]) -> list[int]:
    return _sorted_suffixes(text).tolist()


def _numbers() -> array:
    return array("i")


def _sorted_suffixes(text: Sequence[int]) -> array:
    """Places are kept in four bytes each, as an anchor's fragments are sorted in one task."""
    n = len(text)
    by_letter: dict[int, array] = defaultdict(_numbers)
    for i, letter in enumerate(text):
        by_letter[letter].append(i)
    members = [by_letter[letter] for letter in sorted(by_letter)]
    group = array("i", [0]) * n
    for g, places in enumerate(members):
        for i in places:
            group[i] = g
    size = [len(places) for places in members]
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    before = array("i", [-1]) * n
    done = bytearray(n)
    current = len(members) - 1
    while current >= 0:
        places = members[current]
        if len(places) != size[current]:
            places = array("i", [i for i in places if group[i] == current])
            members[current] = places
        for i in places:
            done[i] = 1
        if len(places) == 1:
            j = places[0] - 1
            while j >= 0 and done[j]:
                j = before[j]
            before[places[0]] = j
            if j >= 0 and size[group[j]] > 1:
                _split(group[j], array("i", [j]), members, group, size, below, above)
        else:
            times: dict[int, int] = defaultdict(int)
            for i in places:
                j = i - 1
                while j >= 0 and done[j]:
                    j = before[j]
                before[i] = j
                if j >= 0:
                    times[j] += 1
            by_times: dict[int, dict[int, array]] = defaultdict(lambda: defaultdict(_numbers))
            for j, t in times.items():
                by_times[t][group[j]].append(j)
            for t in sorted(by_times, reverse=True):
                for g, extended in by_times[t].items():
                    if len(extended) < size[g]:
                        _split(g, array("i", sorted(extended)), members, group, size, below, above)
        current = below[current]
    lowest = next((g for g in range(len(members)) if below[g] < 0), -1)
    start, at, g = [0] * len(members), 0, lowest
    while g >= 0:
        start[g] = at
        at += size[g]
        g = above[g]
    out = array("i", [-1]) * n
    placed = bytearray(n)
    for k in range(-1, n):
        i = (out[k] if k >= 0 else n) - 1
        while i >= 0 and not placed[i]:
            placed[i] = 1
            g = group[i]
            out[start[g]] = i
            start[g] += 1
            i = before[i]
    return out


def _split(g, extended, members, group, size, below, above) -> None:
    new = len(members)
    members.append(extended)
    size.append(len(extended))
    size[g] -= len(extended)
    for j in extended:
        group[j] = new
    higher = above[g]
    below.append(g)
    above.append(higher)
    above[g] = new
    if higher >= 0:
        below[higher] = new


def smallest_ids(fragments: list[bytes], ids: list[int], size: int = SIZE) -> list[array]:
    """For each of distinct fragments, its windows' smallest ids. Equal windows follow each
    other in the suffix array of all fragments, joined with a separator below every byte."""
    letters = array("H")
    owner = array("i")  # the fragment of the window that starts here; -1 where none does
    starts: list[int] = []
    for k, fragment in enumerate(fragments):
        starts.append(len(letters))
        letters.extend([b + 1 for b in fragment])
        letters.append(0)
        owner.extend([k] * (len(fragment) - size + 1))
        owner.extend([-1] * size)
    data = b"\0".join(fragments)
    least = [array("q", [0]) * (len(f) - size + 1) for f in fragments]
    run: list[int] = []
    last = None
    order = _sorted_suffixes(letters)
    order.append(-1)
    for i in order:
        if i >= 0 and owner[i] < 0:
            continue
        window = data[i : i + size] if i >= 0 else None
        if window != last:
            smallest = min((ids[owner[j]] for j in run), default=0)
            for j in run:
                least[owner[j]][j - starts[owner[j]]] = smallest
            run, last = [], window
        run.append(i)
    return least


def contested(families: list[int], fragments: list[bytes], size: int = SIZE) -> list[list[tuple[int, int]]]:
    """For each fragment, the runs (first, last) of windows whose hash another fragment of
    its family has too; a window that is in two fragments is always in such a run."""
    lengths = np.array([len(f) for f in fragments], np.int64)
    data = b"".join(fragments) + bytes(8)
    n = len(data) - 8
    owner = np.repeat(np.arange(len(lengths)), lengths)
    half = _byte_hashes(data, n, 32)
    step = size - 32
    keys = pair(pair(half[:-step], half[step:]), np.array(families, np.uint64)[owner[: n - size + 1]])
    whole = np.flatnonzero(np.arange(len(keys)) + size <= np.cumsum(lengths)[owner[: len(keys)]])
    order = whole[np.argsort(keys[whole], kind="stable")]
    new = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
    holders = owner[order]
    several = np.minimum.reduceat(holders, new) != np.maximum.reduceat(holders, new)
    marked = np.zeros(len(keys) + 1, bool)
    marked[order] = np.repeat(several, np.diff(np.r_[new, len(order)]))
    joined = marked[1:] & marked[:-1]
    joined[:-1] &= owner[1 : len(keys)] == owner[: len(keys) - 1]
    firsts = np.flatnonzero(marked[:-1] & ~np.r_[False, joined[:-1]])
    lasts = np.flatnonzero(marked[:-1] & ~joined)
    out: list[list[tuple[int, int]]] = [[] for _ in fragments]
    starts = np.cumsum(lengths) - lengths
    for k, a, b in zip(owner[firsts].tolist(), (firsts - starts[owner[firsts]]).tolist(), (lasts - starts[owner[firsts]]).tolist(), strict=True):
        out[k].append((a, b))
    return out


def smallest_runs(families: list[int], fragments: list[bytes], ids: list[int], size: int = SIZE) -> list[list[tuple[int, int]]]:
    """For each of fragments that are distinct in their family, its windows' smallest ids
    in the family as runs: (first window, id)."""
    least = [array("q", [i]) * (len(f) - size + 1) for f, i in zip(fragments, ids, strict=True)]
    places: dict[int, dict[bytes, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
    for k, runs in enumerate(contested(families, fragments, size)):
        for a, b in runs:
            places[families[k]][fragments[k][a : b + size]].append((k, a))
    for shorter in places.values():
        texts = list(shorter)
        firsts = [min(ids[k] for k, _ in shorter[t]) for t in texts]
        found = smallest_ids(texts, firsts, size) if len(texts) > 1 else [array("q", firsts) * (len(texts[0]) - size + 1)]
        for text, row in zip(texts, found, strict=True):
            for k, a in shorter[text]:
                least[k][a : a + len(row)] = row
    return [[(k, x) for k, x in enumerate(row) if not k or row[k - 1] != x] for row in least]


on_leaving("suffixes", forget_powers)


def _byte_hashes(data: bytes, n: int, short: int) -> np.ndarray:
    """A 64-bit hash of the ``short`` bytes (8 to 32) from each place on."""
    h = np.ndarray((max(0, n - 7),), "<u8", data, 0, (1,))
    length = 8
    while length < short:
        step = min(length, short - length)
        h = pair(h[: len(h) - step], h[step:])
        length += step
    return mix(h) if length == 8 else h


class _Fragments:
    """Anchors, places and prints of all fragments of some documents in a row."""

    def __init__(self, ids: list, texts: list[bytes], size: int, short: int):
        used = [t if i is not None else b"" for i, t in zip(ids, texts, strict=True)]
        self.data = b"".join(used) + bytes(8)
        counts = np.array([len(t) for t in used], np.int64)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        n = int(counts.sum())
        windows = max(0, n - size + 1)
        self.first = self.last = np.empty(0, np.int64)
        self.anchors = self.prints = np.empty(0, np.uint64)
        self.ids = np.empty(0, np.int64)
        if not windows:
            return
        anchors = exchange.rolling(_byte_hashes(self.data, n, short), size - short + 1, np.minimum)
        doc = np.repeat(np.arange(len(counts)), counts)[:windows]
        whole = np.arange(windows) + size <= self.ends[doc]
        new = np.r_[True, (anchors[1:] != anchors[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], windows] - 1
        good = whole[first]
        self.first, self.last = first[good], last[good]
        self.anchors = mix(anchors[self.first])  # smallest hashes are small; ranges of them need even ones
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)[doc[self.first]]
        self.prints = Content(self.data, n).parts(self.first, self.last + size)

    def text(self, k: int, size: int) -> bytes:
        return self.data[self.first[k] : self.last[k] + size]


class _Distinct:
    """Distinct prints with their anchors and smallest ids."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, prints: np.ndarray, anchors: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((prints, anchors, ids))
        if len(self.parts) > 8:
            self.parts = [self.merged()]

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
        prints, anchors, ids = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        if not len(prints):
            return prints, anchors, ids
        order = np.argsort(prints, kind="stable")
        ranked = prints[order]
        new = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        return ranked[new], anchors[order[new]], np.minimum.reduceat(ids[order], new)


def _found(block: int, bits: int, prints, anchors, least, texts: list | None = None) -> pa.Table:
    order = np.argsort(anchors, kind="stable")
    prints, anchors, least = prints[order], anchors[order], least[order]
    buckets = (anchors >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]) if len(anchors) else np.empty(0, np.int64)
    rows = list(zip(first.tolist(), [*first[1:].tolist(), len(anchors)], strict=False))
    sent = [[texts[k] for k in order[a:b].tolist()] if texts else [] for a, b in rows]
    return pa.table(
        [
            pa.array([block] * len(rows), pa.int64()),
            pa.array(buckets[first], pa.int64()),
            *[pa.array([x[a:b].tobytes() for a, b in rows], pa.binary()) for x in (anchors, prints)],
            pa.array([exchange.pack_ids(least[a:b]) for a, b in rows], pa.binary()),
            pa.array(sent, pa.list_(pa.binary())),
        ],
        schema=_FOUND_TYPES,
    )


def _joined(table: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns of 64-bit numbers, each with all rows' numbers one after the other."""
    sizes = [len(x) // 8 for x in table.column("prints").to_pylist()]
    return [
        np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint64)
        if c in ("anchors", "prints")
        else np.concatenate([exchange.unpack_ids(x, n) for x, n in zip(table.column(c).to_pylist(), sizes, strict=True)])
        for c in names
    ]


def _reply(rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    """Rows (block, prints, offsets, smallest ids); fragments that are still to be sorted
    stand in rows of their own."""
    apart = [(b, bool(is_open), p[k], o[k], x[k]) for b, p, o, x in rows for is_open in (0, 1) if (k := (o < 0) == is_open).any()]
    return pa.table(
        [
            pa.array([r[0] for r in apart], pa.int64()),
            pa.array([r[1] for r in apart], pa.bool_()),
            pa.array([r[2].tobytes() for r in apart], pa.binary()),
            *[pa.array([exchange.pack_ids(r[k]) for r in apart], pa.binary()) for k in (3, 4)],
        ],
        schema=_REPLY_TYPES,
    )


def _smallest_by_print(range_: pa.Table) -> pa.Table:
    """Answers each block with the smallest id of each of its fragments; those of an
    anchor with several are marked for sorting, and one block is to send each text."""
    enter("suffixes")
    prints, anchors, least = _joined(range_, "prints", "anchors", "least")
    sizes = np.array([len(x) // 8 for x in range_.column("prints").to_pylist()])
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((row, prints, anchors))
    new_anchor = np.r_[True, anchors[order][1:] != anchors[order][:-1]]
    new_print = new_anchor | np.r_[True, prints[order][1:] != prints[order][:-1]]
    first = np.flatnonzero(new_print)
    number = np.cumsum(new_print) - 1
    smallest = np.minimum.reduceat(least[order], first)[number]
    kinds = np.add.reduceat(new_print.astype(np.int64), np.flatnonzero(new_anchor))[np.cumsum(new_anchor) - 1]
    offsets = np.where(kinds > 1, np.where(new_print, SEND, SORT), 0)
    back = np.argsort(row[order], kind="stable")
    place = order[back]
    cut = np.cumsum(sizes) - sizes
    blocks = range_.column("block").to_pylist()
    return _reply(
        [(b, prints[place[c : c + n]], offsets[back[c : c + n]], smallest[back[c : c + n]]) for b, c, n in zip(blocks, cut.tolist(), sizes.tolist(), strict=True)]
    )


def _smallest_by_window(range_: pa.Table) -> pa.Table:
    """Sorts the suffixes of each anchor's fragments, some anchors at a time, and answers
    each block with the smallest ids of its fragments' windows."""
    enter("suffixes")
    sent: dict[int, tuple[int, bytes, int]] = {}
    held = []
    for block, a, p, x, texts in zip(*[range_.column(c) for c in ("block", "anchors", "prints", "least", "texts")], strict=True):
        prints = np.frombuffer(p.as_py(), np.uint64)
        held.append((block.as_py(), prints))
        for anchor, print_, least, text in zip(np.frombuffer(a.as_py(), np.uint64).tolist(), prints.tolist(), exchange.unpack_ids(x.as_py(), len(prints)).tolist(), texts.as_py(), strict=True):
            if text is not None:
                sent[print_] = (anchor, text, least)
    order = sorted(sent, key=lambda k: sent[k][0])
    counts, offsets, ids = [], [], []
    for part in _parts([sent[k] for k in order]):
        for runs in smallest_runs(*map(list, zip(*part, strict=True))):
            counts.append(len(runs))
            offsets += [o for o, _ in runs]
            ids += [i for _, i in runs]
    place = np.argsort(np.array(order, np.uint64))
    known = np.array(order, np.uint64)[place]
    sizes = np.array(counts, np.int64)
    starts, sizes = (np.cumsum(sizes) - sizes)[place], sizes[place]
    every_offset, every_id = np.array(offsets, np.int64), np.array(ids, np.int64)
    rows = []
    for block, prints in held:
        at = np.searchsorted(known, prints)
        n = sizes[at]
        take = np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        rows.append((block, np.repeat(prints, n), every_offset[take], every_id[take]))
    return _reply(rows)


def _parts(fragments: list[tuple[int, bytes, int]]) -> Iterator[list[tuple[int, bytes, int]]]:
    """Fragments, sorted by anchor, in parts of whole anchors and about PART_BYTES."""
    part, size = [], 0
    for f in fragments:
        if size > PART_BYTES and f[0] != part[-1][0]:
            yield part
            part, size = [], 0
        part.append(f)
        size += len(f[1])
    if part:
        yield part


def _shared_fragments(rows: DataFrame, bits: int) -> DataFrame:
    """For each block, (print, first window, smallest id) of its shared fragments. Each
    round of questions and answers is written, so that only its own shuffles are on disk."""

    def anchors(block: pa.Table) -> pa.Table:
        enter("suffixes")
        out = Gathered()
        for ids, texts in exchange.slices(block):
            f = _Fragments(ids, texts, SIZE, SHORT)
            out.add(exchange.coarse(f.anchors, bits), f.ids)
        return exchange.packed(block.column("block")[0].as_py(), out, bits, False)

    def fragments(block: pa.Table, known: pa.Table) -> pa.Table:
        enter("suffixes")
        keys, _ = exchange.answers(known, bits)
        if not len(keys):
            return _FOUND_TYPES.empty_table()
        out = _Distinct()
        for ids, texts in exchange.slices(block):
            f = _Fragments(ids, texts, SIZE, SHORT)
            good = exchange.has(keys, exchange.coarse(f.anchors, bits))
            out.add(f.prints[good], f.anchors[good], f.ids[good])
        return _found(block.column("block")[0].as_py(), bits, *out.merged())

    def texts_asked(block: pa.Table, reply: pa.Table) -> pa.Table:
        enter("suffixes")
        if not reply.num_rows:
            return _FOUND_TYPES.empty_table()
        prints, offsets, least = _joined(reply, "prints", "offsets", "least")
        wanted = np.argsort(prints)
        prints, send, least = prints[wanted], offsets[wanted] == SEND, least[wanted]
        anchors = np.zeros(len(prints), np.uint64)
        found: list[bytes | None] = [None] * len(prints)
        seen = np.zeros(len(prints), bool)
        for ids, texts in exchange.slices(block):
            f = _Fragments(ids, texts, SIZE, SHORT)
            for k in np.flatnonzero(exchange.has(prints, f.prints)).tolist():
                at = int(np.searchsorted(prints, f.prints[k]))
                if not seen[at]:
                    seen[at] = True
                    anchors[at] = f.anchors[k]
                    found[at] = f.text(k, SIZE) if send[at] else None
        return _found(block.column("block")[0].as_py(), bits, prints, anchors, least, found)

    by_block = rows.groupBy("block")
    shared = materialize(exchange.first_pass(rows, anchors, bits), "suffixes-anchors")
    asked = by_block.cogroup(shared.groupBy("block")).applyInArrow(fragments, _FOUND)
    reply = materialize(asked.groupBy("bucket").applyInArrow(_smallest_by_print, _REPLY), "suffixes-prints")
    drop_table(shared)
    sent = by_block.cogroup(reply.where("open").groupBy("block")).applyInArrow(texts_asked, _FOUND)
    windows = materialize(sent.groupBy("bucket").applyInArrow(_smallest_by_window, _REPLY), "suffixes-windows")
    return reply.where("not open").unionByName(windows)


def _removed(f: _Fragments, prints: np.ndarray, offsets: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which bytes a window covers that starts in a document with a smaller id too."""
    n = int(f.ends[-1]) if len(f.ends) else 0
    mark = np.zeros(n + 1, np.int64)
    if len(prints) and len(f.prints):
        lo, hi = np.searchsorted(prints, f.prints, "left"), np.searchsorted(prints, f.prints, "right")
        count = hi - lo
        k = np.repeat(np.arange(len(count)), count)
        entry = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        start = f.first[k] + offsets[entry]
        following = np.minimum(entry + 1, len(prints) - 1)
        stop = np.where((entry + 1 < hi[k]), f.first[k] + offsets[following] - 1, f.last[k])
        gone = least[entry] < f.ids[k]
        np.add.at(mark, start[gone], 1)
        np.add.at(mark, stop[gone] + SIZE, -1)
    return np.cumsum(mark[:-1]) > 0


def _apply(docs: DataFrame, finish, schema, carry: list | None = None) -> DataFrame:
    ship_code(docs.sparkSession)
    found = _shared_fragments(exchange.in_blocks(docs), exchange.bucket_bits(docs))
    rows = exchange.in_blocks(docs, carry)

    def apply(block: pa.Table, reply: pa.Table) -> pa.Table:
        enter("suffixes")
        if reply.num_rows:
            prints, offsets, least = _joined(reply, "prints", "offsets", "least")
            order = np.lexsort((offsets, prints))
            prints, offsets, least = prints[order], offsets[order], least[order]
        else:
            prints, offsets, least = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        marks: list[np.ndarray] = []
        for ids, texts in exchange.slices(block):
            f = _Fragments(ids, texts, SIZE, SHORT)
            gone = _removed(f, prints, offsets, least)
            for i, start, end, text in zip(ids, f.starts.tolist(), f.ends.tolist(), texts, strict=True):
                marks.append(gone[start:end] if i is not None else np.zeros(len(text), bool))
        return finish(block, marks)

    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(apply, schema)


def _without(text: bytes, gone: np.ndarray) -> bytes:
    return np.frombuffer(text, np.uint8)[~gone].tobytes() if gone.any() else text


def digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row; null texts
    are empty, a row with a null id keeps all of its bytes and removes none from others,
    rows with one id never remove bytes from each other."""

    def finish(block: pa.Table, marks: list[np.ndarray]) -> pa.Table:
        texts = block.column("text").to_pylist()
        return pa.table(
            {
                "doc_id": block.column("doc_id"),
                "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "n_removed": pa.array([int(g.sum()) for g in marks], pa.int64()),
                "n_spans": pa.array([int(np.count_nonzero(g[1:] & ~g[:-1]) + (len(g) > 0 and g[0])) for g in marks], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(_without(t, g)).hexdigest() for t, g in zip(texts, marks, strict=True)], pa.string()),
            }
        )

    return _apply(docs, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; a character that is cut in
    part goes. Other columns and null texts stay as they are."""
    others = [c for c in docs.columns if c != "text"]
    whole = F.struct(F.col("text").isNull().alias("was_null"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("columns"))
    schema = docs.select(whole.alias("_doc")).schema.add("_kept", "string")

    def finish(block: pa.Table, marks: list[np.ndarray]) -> pa.Table:
        texts = block.column("text").to_pylist()
        kept = [_without(t, g).decode(errors="ignore") for t, g in zip(texts, marks, strict=True)]
        fields = [block.schema.field("_doc"), pa.field("_kept", pa.string())]
        return pa.table([block.column("_doc"), pa.array(kept, pa.string())], schema=pa.schema(fields))

    out = _apply(docs, finish, schema, [whole.alias("_doc")])
    text = F.when(~F.col("_doc.was_null"), F.col("_kept"))
    return out.select(*[text.alias(c) if c == "text" else F.col(f"_doc.columns.`{c}`").alias(c) for c in docs.columns])
