"""Near-duplicates by MinHash and banded alignment.

A sketch is the smallest of a document's occurrence-labelled shingles of five words under
one hash function; two documents share it the more likely the fewer edits lie between
them. A short text has all its windows of three words instead. Documents that share a sketch
are candidates, and all pairs of a bucket count. To keep large groups of copies linear, the
documents first meet a few leaders of their bucket, and what is in one component by that
is not compared again; a document that fits a leader stays, so that it meets those that do
not. Of the pairs that are still apart, lengths and a signature of the occurrence-labelled
words choose those that are compared. A bucket of more than a block is dealt by bands of length,
of which a document is in two. Documents of very many unlike ones in a band (a passage
in common) meet by their rarest words instead: with the words in one order, rare ones first, any
two similar texts have one of the first 0.2 n + 1 in common, so no link is lost. Where even a
rare word is crowded, they go by pairs of the signature's bytes, one of which any two that are
compared have in common. A comparison is an alignment along the
diagonals within the edit budget; a pair is a link if 1 - edits / words of the longer one
is at least the threshold. Classes are the connected components of the links.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, drop_table, enter, materialize, on_leaving, ship_code, whole_text
from .words import STEP_BYTES, forget_powers, hashes_of, mix, window_hashes

SHINGLE_WORDS = 5
SKETCHES = 24
#: Texts up to SHORT_WORDS have all their windows as keys, from LONG_WORDS on sketches; as
#: LONG_WORDS - 1 is 0.8 of SHORT_WORDS, any two that may be similar have a kind in common.
SHORT_WORDS = 30
LONG_WORDS = 25
THRESHOLD = 0.8
#: Edits that are looked for along diagonals.
FEW = 12
#: Leaders of a bucket and length in each round; all pairs that are then still apart follow.
LEADERS = (1, 8)
#: Documents of a bucket that are paired in one group, and that are compared with a leader in one.
BLOCK = 256
MEMBERS = 2048
#: Buckets with more documents beside their largest component go by rare words, and rare words
#: with more by pairs of the signature's bytes.
CROWD = 4096
#: Counters that tell rare words from frequent ones, and how many of them make a row. Words that
#: share a counter only seem more frequent; any order that is the same for all texts is right.
SLOTS = 1 << 18
SLOTS_A_ROW = 1 << 12
#: Rows of ids that are sent to every task, some 60 MB at the most; more are met by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of a signature, and how many of those that either has set must be equal. Links have
#: two thirds of their labelled words in common, 3.5 standard deviations above.
BINS = 96
AGREE = 0.5
#: Places of two bytes of a signature: each with the next, around, and two more. Signatures that
#: agree as said share one with a byte that is set. If not, no agreeing byte stands beside an
#: agreeing one or one that neither has, so each has two differing neighbours, and as those are
#: no more, both kinds take turns all around; but then the first byte agrees with the third, or
#: the second with the fourth.
TWOS = [*((i, (i + 1) % BINS) for i in range(BINS)), (0, 2), (1, 3)]
#: Parts whose words are counted, which bounds the edits of two texts from below.
TALLY = 256
#: Comes before the key of any bucket.
NO_KEY = -(1 << 63)

on_leaving("near", forget_powers)

_SEEDS = np.array([[xxhash.xxh3_64_intdigest(bytes([i, j])) | j for i in range(SKETCHES)] for j in range(2)], np.uint64)[:, :, None]


def sketch(h: np.ndarray) -> np.ndarray:
    """The bucket keys of a document's word hashes; none below four words.

    Up to SHORT_WORDS, every window of three words, with which no pair is missed: at most
    n // 5 edits leave one of the longer text's n // 5 + 1 equal parts whole, and
    that has three words from n = 6 on; at n = 5 it has two. Texts on both sides of LONG_WORDS
    have either kind.
    """
    n = len(h)
    out = [h[:0]]
    if 4 <= n <= 5:
        out.append(mix(window_hashes(h, 2)))
    if 5 <= n <= SHORT_WORDS:
        out.append(window_hashes(h, 3))
    if n >= LONG_WORDS:
        out.append(min_hashes(window_hashes(h, SHINGLE_WORDS)))
    return np.unique(np.concatenate(out))


def labelled(x: np.ndarray) -> np.ndarray:
    """The items as sets that tell occurrences apart: the second of an item differs from
    its first, in text order."""
    order = np.argsort(x, kind="stable")
    ranked = x[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    if new.all():
        return x
    at = np.arange(len(x))
    nth = np.empty(len(x), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return x + nth * np.uint64(0xA0761D6478BD642F)


def min_hashes(grams: np.ndarray) -> np.ndarray:
    """The smallest of the occurrence-labelled shingles under each hash function."""
    grams = labelled(grams)
    out = np.empty(SKETCHES, np.uint64)
    step = max(1, 2_000_000 // len(grams))  # bounds the matrix for long documents
    for s in range(0, SKETCHES, step):
        out[s : s + step] = ((grams ^ _SEEDS[0, s : s + step]) * _SEEDS[1, s : s + step]).min(axis=1)
    return mix(out + np.arange(SKETCHES, dtype=np.uint64))


def signature(h: np.ndarray) -> bytes:
    """The labelled words dealt into BINS parts by a hash; of each part one byte of the
    smallest, 0 where there is none."""
    out = np.zeros(BINS, np.uint8)
    x = np.sort(mix(labelled(h) * np.uint64(0x9FB21C651E98DF25)))[::-1]
    part = ((x >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    out[part.astype(np.int64)] = (x & np.uint64(0xFFFF)) % np.uint64(255) + np.uint64(1)  # the last, smallest one stays
    return out.tobytes()


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether signatures, row by row, allow for a link."""
    out = np.empty(len(x), bool)
    for s in range(0, len(x), 20_000):
        a, b = x[s : s + 20_000], y[s : s + 20_000]
        either = (a | b) != 0
        out[s : s + 20_000] = ((a == b) & either).sum(axis=1) >= AGREE * either.sum(axis=1)
    return out


def tally(h: np.ndarray) -> bytes:
    """How many words a hash deals into each of TALLY parts, 255 at most."""
    part = mix(h * np.uint64(0x9FB21C651E98DF25)) % np.uint64(TALLY)
    return np.minimum(np.bincount(part.astype(np.int64), minlength=TALLY), 255).astype(np.uint8).tobytes()


def fits(x: np.ndarray, y: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """Whether tallies, row by row, allow for a link: words that the other text lacks each
    cost an edit, and parts hide some of these but make none."""
    out = np.empty(len(x), bool)
    for s in range(0, len(x), 20_000):
        apart = x[s : s + 20_000].astype(np.int16) - y[s : s + 20_000]
        more = np.maximum(apart, 0).sum(axis=1)
        k = ((1 - THRESHOLD) * longest[s : s + 20_000] + 1e-9).astype(np.int64)
        out[s : s + 20_000] = np.maximum(more, more - apart.sum(axis=1)) <= k
    return out


def share(of: np.ndarray, keys: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows x and y, pair by pair, have a key in common; ``keys[i]`` is one of row ``of[i]``."""
    _, number, times = np.unique(keys, return_inverse=True, return_counts=True)
    often = times > 1
    held = np.zeros((int(max(x.max(), y.max())) + 1, int(often.sum())), bool)
    ours = often[number] & (of < len(held))
    held[of[ours], (np.cumsum(often) - 1)[number[ours]]] = True
    held = np.packbits(held, axis=1)
    return np.concatenate([(held[x[s : s + 20_000]] & held[y[s : s + 20_000]]).any(axis=1) for s in range(0, len(x), 20_000)])


def edits_within(a: list, b: list, k: int) -> bool:
    """Whether at most k insertions, deletions and substitutions turn a into b; only the
    diagonals -k to k are visited. Few edits are looked for along the diagonals first,
    as that takes their square; more in the bits of a band."""
    if abs(len(a) - len(b)) > k:
        return False
    return _few_edits(a, b, min(k, FEW)) or (k > FEW and _band_edits(a, b, k))


def _few_edits(a: list, b: list, k: int) -> bool:
    """The furthest place reached on each diagonal with e edits gives that with e + 1."""
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return False
    start = 0
    while start < n and start < m and a[start] == b[start]:
        start += 1
    goal, reach = m - n, {0: start}
    for e in range(k + 1):
        if reach.get(goal, -1) >= n:
            return True
        if e == k:
            return False
        ahead = {}
        for d in range(max(-e - 1, -n, goal - (k - e)), min(e + 1, m, goal + (k - e)) + 1):
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1)
            i = min(i, n, m - d)
            if i < 0 or i + d < 0:
                continue
            while i < n and i + d < m and a[i] == b[i + d]:
                i += 1
            ahead[d] = i
        reach = ahead
    return False


def _band_edits(a: list, b: list, k: int) -> bool:
    """The edit distance matrix a column of b at a time, as bits: whether a cell is one
    more, or one less, than the cell above it. A column holds the 2 k + 1 rows around the
    main diagonal; the cost is followed along the lowest diagonal to the last row of a, and
    along that to the end. Needs k < len(a) and abs(len(a) - len(b)) <= k."""
    n, m, width = len(a), len(b), 2 * k + 1
    full, lowest = (1 << width) - 1, 1 << (width - 1)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    up, down = full ^ ((1 << k) - 1), 0
    cost, most = k, k + (m - (n - k))
    for j, x in enumerate(b):
        at = places.get(x, 0)
        same = (at >> (j - k) if j >= k else at << (k - j)) & full
        level = (((same & up) + up) ^ up) | same | down
        right = down | (full & ~(level | up))
        left = level & up
        if j < n - k:
            cost += not level & lowest
            if cost > most:
                return False
        else:
            row = lowest >> (j - (n - k) + 1)
            cost += bool(right & row) - bool(left & row)
        level = (level & full) >> 1
        up, down = (left | ~(level | right)) & full, level & right
    return cost <= k


def similar_words(a: list, b: list, threshold: float = THRESHOLD) -> bool:
    longest = max(len(a), len(b))
    k = int((1 - threshold) * longest + 1e-9)
    if abs(len(a) - len(b)) > k:
        return False
    if a == b:
        return True
    more = Counter(a)
    more.subtract(b)
    if max(sum(v for v in more.values() if v > 0), -sum(v for v in more.values() if v < 0)) > k:
        return False  # words that the other lacks each cost an edit
    return edits_within(a, b, k)


def similar(left: str, right: str, threshold: float = THRESHOLD) -> bool:
    return similar_words(left.encode().split(), right.encode().split(), threshold)


def _each(column: pa.Array) -> Iterator[np.ndarray]:
    """Each text's word hashes; texts are hashed some at a time."""
    held, size = [], 0
    for at, text in enumerate(column):
        held.append(text.as_py().encode())
        size += len(held[-1])
        if size > STEP_BYTES or at == len(column) - 1:
            hashes, counts = hashes_of(held)
            yield from np.split(hashes, np.cumsum(counts)[:-1])
            held, size = [], 0


def sketches(docs: DataFrame) -> DataFrame:
    """``(doc_id, print, n_words, sketches, signature)``; ``print`` is a 128-bit fingerprint
    of the word sequence, null without words."""
    ship_code(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near")
        for batch in batches:
            prints, counts, values, signatures = [], [], [], []
            for h in _each(batch.column(1)):
                prints.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                counts.append(len(h))
                values.append(sketch(h).view(np.int64))
                signatures.append(signature(h) if len(h) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints, pa.binary()), pa.array(counts, pa.int64()), pa.array(values, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
                ["doc_id", "print", "n_words", "sketches", "signature"],
            )

    return rows.mapInArrow(run, "doc_id long, print binary, n_words long, sketches array<long>, signature binary")


def _matrix(column: pa.Array | pa.ChunkedArray, width: int = BINS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def likely(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Those of pairs ``(doc_id, leader)`` whose signatures allow for a link."""
    both = pairs.join(signatures.select("doc_id", F.col("signature").alias("_x")), "doc_id").join(
        signatures.select(F.col("doc_id").alias("leader"), F.col("signature").alias("_y")), "leader"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near")
        for batch in batches:
            yield batch.filter(pa.array(alike(_matrix(batch.column(2)), _matrix(batch.column(3))))).select(["doc_id", "leader"])

    return both.select("doc_id", "leader", "_x", "_y").mapInArrow(run, "doc_id long, leader long").distinct()


def _few(rows: DataFrame) -> DataFrame:
    """Small numbers of a written table, to every task if there are at most BROADCAST_ROWS;
    more are met by a shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``(doc_id, leader, ok)`` of distinct pairs of ids, from a written table.

    A leader's text goes to each group of at most about MEMBERS documents that it meets, and
    a group is read as a stream, so neither a large group nor a frequent leader fills a task.
    An id with several texts is similar where any of them is; without any, it has no row.
    """
    most = pairs.groupBy("leader").count().agg(F.max("count")).first()[0] or 0
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(-(-most // MEMBERS) or 1)))
    few = F.broadcast if pairs.count() <= BROADCAST_ROWS else lambda x: x
    members = texts.join(few(dealt), "doc_id").select("leader", "part", "doc_id", "text")
    heads = dealt.select("leader", "part").distinct()
    ahead = texts.withColumnRenamed("doc_id", "leader").join(few(heads), "leader").select("leader", "part", F.lit(None).cast("bigint").alias("doc_id"), "text")
    rows = members.unionByName(ahead).repartition("leader", "part").sortWithinPartitions("leader", "part", F.asc_nulls_first("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near")
        of, heads = None, []
        for batch in batches:
            leaders, ids = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            ok = np.zeros(len(ids), bool)
            for at, (key, doc_id, text) in enumerate(zip(zip(leaders, batch.column(1).to_pylist(), strict=True), ids, batch.column(3), strict=True)):
                if key != of:
                    of, heads = key, []
                words = text.as_py().encode().split()
                if doc_id is None:
                    heads.append(words)
                else:
                    ok[at] = any(similar_words(words, h) for h in heads)
            out = pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(ok)], ["doc_id", "leader", "ok"])
            yield out.filter(pa.compute.is_valid(out.column(0)))

    checked = rows.mapInArrow(run, "doc_id long, leader long, ok boolean")
    return checked.groupBy("doc_id", "leader").agg(F.max("ok").alias("ok"))


def _apart(rows: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """The rows ``(key, doc_id, n_words, root)`` whose key has documents of several
    components; ``roots`` are the components by now."""
    if roots is not None:
        now = roots.select(F.col("node").alias("doc_id"), F.col("root").alias("_now"))
        rows = rows.join(now, "doc_id", "left").select("key", "doc_id", "n_words", F.coalesce("_now", "root").alias("root"))
    mixed = rows.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count("*").alias("n"))
    return materialize(rows.join(mixed.where("_low <> _high").select("key", "n"), "key"), "near-active")


def _band() -> F.Column:
    """A number of the length; two that may be similar have the same or the next one."""
    return F.floor(F.log("n_words") / F.log(F.lit(1 / THRESHOLD)))


def possible(words: np.ndarray, signatures: np.ndarray, roots: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Places of those pairs of left and right rows that may be links: of two components,
    with lengths that the edit budget can bridge and signatures that agree."""
    longest = np.maximum(words[left][:, None], words[right])
    k = ((1 - THRESHOLD) * longest + 1e-9).astype(np.int64)
    x, y = np.nonzero((roots[left][:, None] != roots[right]) & (np.abs(words[left][:, None] - words[right]) <= k))
    x, y = left[x], right[y]
    good = alike(signatures[x], signatures[y])
    return x[good], y[good]


def first_two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of the first of TWOS that signatures, row by row, share with a byte set."""
    i, j = np.array(TWOS).T
    same = a == b
    return (same[:, i] & same[:, j] & ((a[:, i] | a[:, j]) != 0)).argmax(axis=1)


def _pair_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each group ``(key, i, j)`` that may be links; rows come sorted by group. A pair
    with several buckets in common comes out of the one with the smallest key, ``base``; rows
    have the ``keys`` below that."""
    enter("near")
    held = None
    names = ["key", "i", "j"]

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        keys = [rows[c].to_numpy() for c in names]
        block, ids, words, roots = (rows[c].to_numpy() for c in ("block", "doc_id", "n_words", "root"))
        signatures, two = _matrix(rows["signature"]), rows["two"].to_numpy()
        own, base = rows["own"].to_numpy(), rows["base"].to_numpy()
        tallies, known = _matrix(rows["tally"].fill_null(bytes(TALLY)), TALLY), rows["tally"].is_valid().to_numpy()
        lists = rows["keys"].combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        buckets, ends = lists.flatten().to_numpy(), np.r_[0, np.cumsum(sizes)]
        new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        xs, ys = [], []
        for lo, hi in zip([0, *new], [*new, len(ids)], strict=True):
            r = roots[lo:hi]
            if (r == r[0]).all():
                continue
            at = np.arange(hi - lo)
            same = keys[1][lo] == keys[2][lo]
            first = block[lo:hi] == keys[1][lo]
            left, right = (at, at) if same else (at[first], at[~first])
            x, y = possible(words[lo:hi], signatures[lo:hi], r, left, right)
            once = (x < y if same else True) & (own[lo:hi][x] | own[lo:hi][y])  # two of one band meet in that
            x, y = x[once], y[once]
            if two[lo] >= 0 and len(x):  # a pair comes out where it first meets
                once = first_two(signatures[lo:hi][x], signatures[lo:hi][y]) == two[lo]
                x, y = x[once], y[once]
            if base[lo] != NO_KEY and len(x):
                once = ~share(np.repeat(at, sizes[lo:hi]), buckets[ends[lo] : ends[hi]], x, y)
                x, y = x[once], y[once]
            good = fits(tallies[lo:hi][x], tallies[lo:hi][y], np.maximum(words[lo:hi][x], words[lo:hi][y]))
            good |= ~(known[lo:hi][x] & known[lo:hi][y])
            x, y = x[good], y[good]
            xs.append(ids[lo:hi][x])
            ys.append(ids[lo:hi][y])
        x, y = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (xs, ys))
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["doc_id", "leader"])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        keys = [rows[c].to_numpy() for c in names]
        cut = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys])) if len(rows) else []
        cut = int(cut[-1]) + 1 if len(cut) else 0  # the last group may go on
        if cut:
            yield pairs(rows.slice(0, cut))
        held = rows.slice(cut)
    if held is not None and len(held):
        yield pairs(held)


def _dealt(rows: DataFrame) -> DataFrame:
    """Adds to the rows of buckets with several components which are ``free`` of being paired
    with each other, how many these are (``most``) and how many all others (``fewer``); the
    rest go. Free are the largest component or, where there are more, the documents that are
    not in their own band, since these meet in that."""
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum((~F.col("own")).cast("long")).alias("s")).groupBy("key")
    top = sizes.agg(F.max(F.struct("c", "root")).alias("t"), F.sum("c").alias("all"), F.sum("s").alias("strange"))
    top = top.where("all > t.c and all > strange").select(
        "key",
        F.when(F.col("t.c") >= F.col("strange"), F.col("t.root")).alias("_top"),
        F.greatest("t.c", "strange").alias("most"),
        (F.col("all") - F.greatest("t.c", "strange")).alias("fewer"),
    )
    return rows.join(top, "key").select(*rows.columns, F.coalesce(F.col("root") == F.col("_top"), ~F.col("own")).alias("free"), "most", "fewer")


def rarest(h: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """The labelled words by which a text meets all that are similar to it: it has all but
    int(0.2 n) of its n words in common with a similar one, and more with a longer one, so in
    any order one of the first int(0.2 n) + 1 of either is among these of the other."""
    x = labelled(h)
    order = np.lexsort((x, frequency[(x % np.uint64(SLOTS)).astype(np.int64)]))
    return x[order[: int((1 - THRESHOLD) * len(x) + 1e-9) + 1]]


def _frequencies(texts: DataFrame) -> np.ndarray:
    """How often the labelled words of each slot stand in the texts; SLOTS numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near")
        out = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for h in _each(batch.column(0)):
                np.add.at(out, (labelled(h) % np.uint64(SLOTS)).astype(np.int64), 1)
        if out.any():
            rows = [x.tobytes() for x in out.reshape(-1, SLOTS_A_ROW)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.binary())], ["row", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(SLOTS_A_ROW, np.int64)
        for x in rows["counts"]:
            total += np.frombuffer(x.as_py(), np.int64)
        return pa.table({"row": rows["row"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    parts = texts.select("text").mapInArrow(count, "row int, counts binary")
    out = np.zeros(SLOTS, np.int64).reshape(-1, SLOTS_A_ROW)
    for row, counts in parts.groupBy("row").applyInArrow(add, "row int, counts binary").collect():
        out[row] = np.frombuffer(counts, np.int64)
    return out.reshape(-1)


def _by_rare_words(crowd: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows ``(key, doc_id, n_words, root)`` whose keys are the rarest words of the documents
    ``(doc_id, root)``; an id with several texts has those of each. A text goes once,
    whatever the number of its buckets."""
    ids = materialize(crowd, "near-crowd")
    held = materialize(texts.join(_few(ids), "doc_id").select("text", "doc_id", "root"), "near-crowd-texts")
    drop_table(ids)
    frequency = _frequencies(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near")
        for batch in batches:
            keys = [], []
            for h in _each(batch.column(0)):
                keys[0].append(rarest(h, frequency))
                keys[1].append(len(h))
            each = np.repeat(np.arange(len(keys[1])), [len(k) for k in keys[0]])
            ids, roots = (batch.column(i).to_numpy()[each] for i in (1, 2))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys[0] or [np.empty(0, np.uint64)]).view(np.int64)), pa.array(ids), pa.array(np.array(keys[1], np.int64)[each]), pa.array(roots)],
                ["key", "doc_id", "n_words", "root"],
            )

    rows = materialize(held.mapInArrow(run, "key long, doc_id long, n_words long, root long").distinct(), "near-rare")
    drop_table(held)
    return rows


def _marks(rows: DataFrame, signatures: DataFrame, texts: DataFrame) -> DataFrame:
    """``(doc_id, signature, keys, tally)`` of the documents in ``rows``: ``keys`` are those of
    their buckets there; the tally is null for an id with several texts, any of which may be similar."""
    held = rows.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tally(h) for h in _each(batch.column(1))], pa.binary())], ["doc_id", "tally"])

    counted = texts.join(_few(rows.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "doc_id long, tally binary")
    counted = counted.groupBy("doc_id").agg(F.when(F.count("*") == 1, F.first("tally")).alias("tally"))
    return held.join(signatures, "doc_id").join(counted, "doc_id", "left").select("doc_id", "signature", "keys", "tally")


def _all_pairs(active: DataFrame, signatures: DataFrame, texts: DataFrame) -> DataFrame:
    """``(doc_id, leader)``: all pairs in a bucket that may be links. Most rows of a large
    bucket are of one component, which is not paired with itself: it goes in blocks, each
    of which meets the blocks of the others, and these meet each other. A bucket of more than
    a block is dealt by lengths first: a document stands in its own band and in the next, so any
    two of like length meet. Documents of such parts with more than CROWD of the others meet by
    their rarest words, and under words that are as crowded by TWOS of the signature; neither
    loses a link."""
    alone = [F.lit(-1).alias("two"), F.lit(True).alias("own")]
    every = _dealt(active.select("key", "doc_id", "n_words", "root", *alone, F.col("key").alias("base")))
    marks = materialize(_marks(every, signatures, texts), "near-marks")
    large = F.col("fewer") > min(BLOCK, CROWD)
    bands = F.array(*[F.struct((_band() + up).alias("band"), F.lit(not up).alias("own")) for up in (0, 1)])
    banded = every.where(large).select("key", "doc_id", "n_words", "root", "two", "base", F.explode(bands).alias("_b"))
    banded = banded.select(F.xxhash64("key", "_b.band").alias("key"), "doc_id", "n_words", "root", "two", "_b.own", "base")
    twice = materialize(banded, "near-bands")  # read twice
    banded = materialize(_dealt(twice), "near-banded")
    drop_table(twice)
    rows = every.where(~large).unionByName(banded.where(F.col("fewer") <= CROWD))
    crowd = banded.where(F.col("fewer") > CROWD)
    if not crowd.isEmpty():
        rare = _by_rare_words(crowd.select("doc_id", "root").distinct(), texts)
        rare = _dealt(rare.select("key", "doc_id", "n_words", "root", *alone, F.lit(NO_KEY).alias("base")))
        byte = lambda i: f"substring(signature, {i + 1}, 1)"
        twos = ", ".join(f"concat({byte(i)}, {byte(j)})" for i, j in TWOS)
        keys = F.expr(f"filter(transform(array({twos}), (x, j) -> if(x = X'0000', null, named_struct('key', xxhash64(key, j, x), 'two', j))), x -> x is not null)")
        crowd = rare.where(F.col("fewer") > CROWD)
        if not crowd.isEmpty():
            crowd = crowd.join(signatures, "doc_id").select(F.explode(keys).alias("_k"), "doc_id", "n_words", "root", "own", "base")
            crowd = crowd.select("_k.key", "doc_id", "n_words", "root", "_k.two", "own", "base")
            rows = rows.unionByName(_dealt(crowd))
        rows = rows.unionByName(rare.where(F.col("fewer") <= CROWD))
    rows = rows.join(marks, "doc_id")
    hashed, zero = F.xxhash64("doc_id"), F.lit(0).cast("bigint")
    of_most, of_fewer = F.ceil(F.col("most") / BLOCK), F.ceil(F.col("fewer") / BLOCK)
    free = F.col("free")
    below = F.transform(F.sequence(zero, of_most - 1), lambda x: -1 - x)  # numbers of the free ones' blocks
    rows = rows.withColumn("block", F.when(free, -1 - F.pmod(hashed, of_most)).otherwise(F.pmod(hashed, of_fewer)))
    rows = rows.withColumn("_o", F.explode(F.when(free, F.sequence(zero, of_fewer - 1)).otherwise(F.concat(F.sequence(zero, of_fewer - 1), below))))
    i = F.when(free, F.col("_o")).when(F.col("_o") < 0, F.col("block")).otherwise(F.least("block", "_o"))
    j = F.when(free, F.col("block")).when(F.col("_o") < 0, F.col("_o")).otherwise(F.greatest("block", "_o"))
    rows = rows.select("key", i.alias("i"), j.alias("j"), "block", "doc_id", "n_words", "root", "two", "own", "base", "signature", F.filter("keys", lambda k: k < F.col("base")).alias("keys"), "tally")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(_pair_off, "doc_id long, leader long")


def links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """All verified links ``(a, b)`` of ``search``."""
    return search(nodes, docs)[0]


def search(nodes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified links ``(a, b)`` between nodes ``(doc_id, n_words, sketches, signature)``, and
    fewer edges that make the same components: of what a step has joined, each node's with its root.

    Each pair of a bucket is compared, can't be a link by its lengths or (but for a chance
    of about 0.0003 at the threshold) by its signatures, or is in one component already.
    """
    signatures = nodes.select("doc_id", "signature")
    keyed = nodes.select(F.explode("sketches").alias("key"), "doc_id", "n_words", F.col("doc_id").alias("root"))
    active = _apart(keyed)
    wanted = materialize(active.select("doc_id").distinct(), "near-wanted")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    texts = materialize(rows.join(_few(wanted), "doc_id", "left_semi"), "near-texts")
    drop_table(wanted)
    done = nodes.sparkSession.createDataFrame([], "doc_id long, leader long, ok boolean")

    edges = done.select(F.col("doc_id").alias("a"), F.col("leader").alias("b"))

    def meet(pairs: DataFrame, signed: bool) -> tuple[DataFrame, DataFrame]:
        pairs = pairs.select(F.greatest("doc_id", "leader").alias("doc_id"), F.least("doc_id", "leader").alias("leader")).distinct()
        pairs = pairs if signed else likely(pairs, signatures)
        pairs = materialize(pairs.join(done, ["doc_id", "leader"], "left_anti"), "near-pairs")
        found = materialize(compare(pairs, texts), "near-found")
        drop_table(pairs)
        return done.unionByName(found), edges.unionByName(linked(found))

    def linked(found: DataFrame) -> DataFrame:
        return found.where("ok").select(F.col("doc_id").alias("a"), F.col("leader").alias("b"))

    for leaders in LEADERS:
        # two documents of like length have one of their two bands in common
        crowd = active.where(F.col("n") > (0 if leaders == 1 else 16 * leaders)).withColumn("_band", F.explode(F.array(_band(), _band() + 1)))
        if crowd.isEmpty():
            break
        part = F.pmod(F.hash("doc_id"), F.lit(leaders))
        lead = crowd.groupBy("key", "_band", part.alias("_part")).agg(F.min(F.struct("doc_id", "n_words", "root")).alias("l"))
        lead = lead.select("key", "_band", F.col("l.doc_id").alias("leader"), F.col("l.n_words").alias("_m"), F.col("l.root").alias("_root"))
        near = F.least("n_words", "_m") >= THRESHOLD * F.greatest("n_words", "_m") - 1e-9
        done, edges = meet(crowd.join(lead, ["key", "_band"]).where(near & (F.col("root") != F.col("_root"))).select("doc_id", "leader"), False)
        roots = components(edges)
        edges = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        before, active = active, _apart(active.drop("n"), roots)
        drop_table(before)
    if not active.isEmpty():
        done, edges = meet(_all_pairs(active, signatures, texts), True)
    drop_table(active)
    drop_table(texts)
    return linked(done).distinct(), edges


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest id of each node's connected component.

    Each round takes the smallest root among a node's neighbours and then that root's own
    root, so chains shrink by half or more; it ends when a round changes nothing.
    """
    edges = materialize(edges, "near-edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "near-roots")
    while True:
        seen = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        closer = roots.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "seen").alias("near"))
        jump = roots.select(F.col("node").alias("near"), F.col("root").alias("far"))
        after = closer.join(jump, "near").select("node", "old", F.least("near", "far").alias("root"))
        after = materialize(after, "near-roots")
        drop_table(roots)
        roots = after.select("node", "root")
        if after.where("old <> root").isEmpty():
            drop_table(edges)
            return roots


def classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, class_id)``, a row for each row of ``docs``; ``class_id`` is the
    smallest id among the documents of the class.

    Copies with the same words meet by fingerprint and enter the search once. A document
    without words is a class of its own; one of fewer than four words only joins exact
    copies, as an edit is more than its budget. Rows with one id and several texts count as one document that is similar
    where any of its texts is. A null id is never linked and its class is null.
    """
    known = materialize(sketches(docs), "near-sketches")
    nodes = materialize(
        known.where("print is not null and doc_id is not null").groupBy("print").agg(
            F.min("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("sketches").alias("sketches"), F.first("signature").alias("signature")
        ),
        "near-nodes",
    )
    same = nodes.select("print", F.col("doc_id").alias("first_id"))
    roots = components(search(nodes, docs)[1].unionByName(_repeated_ids(known)))
    placed = known.select("doc_id", "print").join(same, "print", "left").withColumn("first_id", F.coalesce("first_id", "doc_id"))
    return placed.join(roots.withColumnRenamed("node", "first_id"), "first_id", "left").select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "first_id")).alias("class_id")
    )


def _repeated_ids(known: DataFrame) -> DataFrame:
    """Links that keep an id with several texts in one class."""
    first = known.where("print is not null").groupBy("print").agg(F.min("doc_id").alias("b"))
    several = known.groupBy("doc_id").agg(F.count_distinct("print").alias("n")).where("n > 1").select("doc_id")
    return known.join(several, "doc_id").join(first, "print").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each class: the one with the smallest id. Rows with null ids stay.

    Of rows that repeat an id and its words one stays, the first by text and then by the
    other columns as JSON; rows that share an id but not the words stay each, as neither
    holds what the other says. An empty table gives an empty result; a text without words
    stays unless its id repeats."""
    placed = materialize(classes(docs), "near-classes")
    dropped = _few(materialize(placed.where("doc_id <> class_id").select(F.col("doc_id").alias("_id")).distinct(), "near-dropped"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("doc_id").cast("long").alias("_id"))
    kept = rows.join(dropped, "_id", "left_anti")
    repeated = placed.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id"))
    if not repeated.isEmpty():
        text = F.coalesce(F.col("_doc.text").cast("string"), F.lit(""))
        words = F.array_join(F.array_remove(F.split(text, SPACE), ""), " ")
        again = kept.join(repeated, "_id", "left_semi").withColumn("_words", F.xxhash64(words)).withColumn("_size", F.length(words))
        order = F.struct(text.alias("text"), F.to_json("_doc").alias("rest"))
        one = again.groupBy("_id", "_words", "_size").agg(F.min_by("_doc", order).alias("_doc")).select("_id", "_doc")
        kept = kept.join(repeated, "_id", "left_anti").select("_id", "_doc").unionByName(one)
    return kept.select("_doc.*")
