"""Prediction by partial matching over bytes, learnt from a corpus and spread out.

The model is a trie of byte contexts up to order 5 with the counts of the bytes that
followed. A byte's probability is taken from the longest context that was seen; if the
byte did not follow it, an escape (half a count for each different byte, method D) leads to the next shorter context, where the bytes already ruled out are excluded. Below
order 0 all symbols left are alike. A text ends with an end symbol.

Given the model, a byte's cost depends on it and the 5 bytes before, so the corpus is
scored in four steps, none of which holds the model or the corpus in one place:

1. rows are dealt into blocks by a hash; each block gives its distinct 6-byte strings
   and words with their counts in training texts, packed and cut into ranges (a shared table);
2. counts are summed by range, in chunks of blocks first, so a frequent context brings no
   more than its distinct strings a chunk. The contexts of orders 3 to 5 of a string end
   in the same three bytes and a range has all strings of such three, so their costs need
   this range alone. Orders 0 to 2 go to every task: at most 256 ** 3 counts, 12 bytes each,
   some hundred thousand in text;
3. each block gets the costs of its own strings back, in its own order;
4. texts are scored block by block, in slices of bounded size.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, enter, materialize, ship_code, whole_text

ORDER = 5
END, PAD = b"\xff", b"\xfe"  # no UTF-8 text holds these bytes
SYMBOLS = 255  # all bytes but the padding
SLICE_BYTES = 500_000
#: Blocks whose counts of a range are summed in one group.
CHUNK_BLOCKS = 2048
#: Kinds of packed rows: 6-byte strings, words, 3-byte strings.
GRAMS, WORDS, LOW = 0, 1, 2
PACKED = "block long, kind int, range int, chunk long, keys binary, numbers binary"
_PACKED = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("range", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("numbers", pa.binary())])

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MASK = [(1 << 8 * (k + 1)) - 1 for k in range(ORDER + 1)]


class ByteTrie:
    """The model in one process, for single texts and as the plain form of the rules."""

    def __init__(self):
        self.contexts: dict[bytes, Counter] = {}

    def learn(self, past: bytes, symbol: int) -> None:
        for k in range(ORDER + 1):
            self.contexts.setdefault(past[len(past) - k :], Counter())[symbol] += 1

    def cost(self, past: bytes, symbol: int) -> float:
        """log10 of the symbol's probability after ``past``."""
        out, excluded = 0.0, set()
        for k in range(ORDER, -1, -1):
            counts = self.contexts.get(past[len(past) - k :])
            if not counts:
                continue
            left = {s: n for s, n in counts.items() if s not in excluded}
            total = sum(left.values())
            if symbol in left:
                return out + math.log10((left[symbol] - 0.5) / total)
            if left:
                out += math.log10(0.5 * len(left) / total)
            excluded = set(counts)
        return out - math.log10(SYMBOLS - len(excluded))

    def score(self, text: bytes, learn: bool = False) -> float:
        """log10 probability of a text and its end; with ``learn``, adaptively: each
        byte is learnt after it was scored."""
        out, past = 0.0, PAD * ORDER
        for symbol in text.translate(_LOWER) + END:
            out += self.cost(past, symbol)
            if learn:
                self.learn(past, symbol)
            past = past[1:] + bytes([symbol])
        return out


def strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 6-byte strings that end at each byte of padded texts, as numbers, and where
    each text starts. A padding target has the number -1."""
    parts = [PAD * ORDER + t.translate(_LOWER) + END for t in texts]
    data = b"\0" * 7 + b"".join(parts)
    n = len(data) - 7
    numbers = np.ndarray((n,), ">u8", data, 0, (1,)).astype(np.int64) & _MASK[ORDER]
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(sizes) - sizes
    for k in range(ORDER):
        numbers[starts + k] = -1
    return numbers, starts


def _slices(column: pa.ChunkedArray) -> Iterator[tuple[int, list[bytes]]]:
    start, part, size = 0, [], 0
    for at, text in enumerate(column):
        text = text.as_py()
        if part and size + len(text) > SLICE_BYTES:
            yield start, part
            start, part, size = at, [], 0
        part.append(text)
        size += len(text)
    if part:
        yield start, part


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts] or [np.empty(0, np.int64)])
    counts = np.concatenate([c for _, c in parts] or [np.empty(0, np.int64)])
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[new], np.add.reduceat(counts, new)


def pack(x: np.ndarray) -> bytes:
    """Numbers from 0 on, in as many bytes each as the largest takes, plane by plane."""
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : blob[0]] = planes.T
    return out.view("<i8")[:, 0]


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=0))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob))


def pack_costs(costs: np.ndarray) -> bytes:
    """Few costs differ: the different ones, and which of them each is."""
    kinds, which = np.unique(costs, return_inverse=True)
    return len(kinds).to_bytes(8, "little") + kinds.tobytes() + pack(which)


def unpack_costs(blob: bytes) -> np.ndarray:
    end = 8 + 8 * int.from_bytes(blob[:8], "little")
    return np.frombuffer(blob[8:end], np.float64)[unpack(blob[end:])]


def pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def unpack_words(blob: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(blob).split(b"\n")


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKED, strict=True)] if rows else [[]] * len(_PACKED), schema=_PACKED)


def _cut(order: np.ndarray, ranges: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(range, places) of each range; ``order`` sorts by range first."""
    ranked = ranges[order]
    new = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(order) else np.empty(0, np.int64)
    for at, end in zip(new.tolist(), [*new[1:].tolist(), len(order)], strict=False):
        yield int(ranked[at]), order[at:end]


def gram_ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """The range of each string: a hash of the last three bytes of its context."""
    context = (keys >> 8 & 0xFFFFFF).astype(np.uint64)
    return (((context * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def block_counts(block: pa.Table, n_ranges: int) -> pa.Table:
    """Distinct strings and words of a block by range, with their counts in training texts,
    and the counts of its 3-byte strings there."""
    grams: list[tuple[np.ndarray, np.ndarray]] = []
    words: Counter = Counter()
    for held in (False, True):
        for _, texts in _slices(block.filter(pa.compute.equal(block.column("held_out"), held)).column("text")):
            numbers, _ = strings(texts)
            keys, counts = np.unique(numbers, return_counts=True)
            counts = counts[keys >= 0] * (not held)
            grams.append((keys[keys >= 0], counts))
            if len(grams) >= 12:
                grams = [_merge(grams)]
            for text in texts:
                found = text.translate(_LOWER).split()
                words.update(dict.fromkeys(found, 0) if held else found)
    keys, counts = _merge(grams)
    number = block.column("block")[0].as_py()
    chunk = number // CHUNK_BLOCKS
    ranges = gram_ranges(keys, n_ranges)
    rows = [(number, GRAMS, r, chunk, pack_sorted(keys[at]), pack(counts[at])) for r, at in _cut(np.argsort(ranges, kind="stable"), ranges)]
    names = list(words)
    numbers = np.fromiter(words.values(), np.int64, len(names))
    ranges = np.fromiter((zlib.crc32(w) % n_ranges for w in names), np.int64, len(names))
    rows += [(number, WORDS, r, chunk, pack_words([names[k] for k in at.tolist()]), pack(numbers[at])) for r, at in _cut(np.argsort(ranges, kind="stable"), ranges)]
    low, low_counts = _merge([(keys[counts > 0] & _MASK[2], counts[counts > 0])])
    return _rows([*rows, (number, LOW, 0, chunk, pack_sorted(low), pack(low_counts))])


def summed(group: pa.Table) -> pa.Table:
    """One row for the rows of a kind and range: distinct keys with their counts added."""
    kind, range_, chunk = (group.column(c)[0].as_py() for c in ("kind", "range", "chunk"))
    pairs = zip(group.column("keys"), group.column("numbers"), strict=True)
    if kind == GRAMS:
        keys, counts = _merge([(unpack_sorted(k.as_py()), unpack(c.as_py())) for k, c in pairs])
        return _rows([(0, kind, range_, chunk, pack_sorted(keys), pack(counts))])
    words: Counter = Counter()
    for k, c in pairs:
        for word, n in zip(unpack_words(k.as_py()), unpack(c.as_py()).tolist(), strict=True):
            words[word] += n
    return _rows([(0, kind, range_, chunk, pack_words(list(words)), pack(np.fromiter(words.values(), np.int64, len(words))))])


def answered(asked: pa.Table, known: pa.Table) -> pa.Table:
    """The costs of each block's strings and the counts of its words, of one kind and range."""
    if not asked.num_rows:  # none of the chunk's blocks has a string of this range
        return _rows([])
    keys, numbers = (known.column(c)[0].as_py() for c in ("keys", "numbers"))
    rows = []
    if known.column("kind")[0].as_py() == GRAMS:
        every, costs = unpack_sorted(keys), unpack_costs(numbers)
    else:
        count_of = dict(zip(unpack_words(keys), unpack(numbers).tolist(), strict=True))
    for block, kind, range_, chunk, mine in zip(*[asked.column(c).to_pylist() for c in ("block", "kind", "range", "chunk", "keys")], strict=True):
        if kind == GRAMS:
            reply = pack_costs(costs[np.searchsorted(every, unpack_sorted(mine))])
        else:
            words = unpack_words(mine)
            reply = pack(np.fromiter((count_of[w] for w in words), np.int64, len(words)))
        rows.append((block, kind, range_, chunk, mine, reply))
    return _rows(rows)


def low_orders(keys: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Orders 2 to 0 from the training counts of three-byte strings, in key order. What is
    kept by context has one place for each possible context."""
    keys = keys.astype(np.int64)
    one = np.zeros((256, 256), np.int64)
    np.add.at(one, (keys >> 8 & 255, keys & 255), counts)
    zero = one.sum(axis=0)
    return {
        "keys": keys,
        "counts": counts,
        "total_2": np.bincount(keys >> 8, counts, 1 << 16),
        "kinds_2": np.bincount(keys >> 8, minlength=1 << 16),
        "after_2": np.bincount(keys >> 8, one[keys >> 8 & 255, keys & 255], 1 << 16),
        "one": one,
        "total_1": one.sum(axis=1),
        "kinds_1": (one > 0).sum(axis=1),
        "after_1": (one > 0) @ zero,
        "zero": zero,
    }


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values by key, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def group_costs(grams: np.ndarray, n: np.ndarray, low: dict[str, np.ndarray]) -> np.ndarray:
    """log10 costs of strings, given all strings whose contexts end in the same three
    bytes as theirs, and the low orders."""
    keys, counts = grams[n > 0], n[n > 0]
    cost = np.zeros(len(grams))
    waiting = np.ones(len(grams), bool)
    out_total = np.zeros(len(grams))  # count, and number, of the symbols excluded
    out_kinds = np.zeros(len(grams))

    def level(count, total, kinds, after):
        """One order: the string's count, its context's total and number of symbols, and
        what these symbols count for one order below."""
        seen = (total > 0) & waiting
        hit = seen & (count > 0)
        t, u = total - out_total, kinds - out_kinds
        cost[hit] += np.log10((count[hit] - 0.5) / t[hit])
        miss = seen & ~hit
        paid = miss & (u > 0)
        cost[paid] += np.log10(0.5 * u[paid] / t[paid])
        waiting[hit] = False
        out_total[miss], out_kinds[miss] = after[miss], kinds[miss]

    for k in range(ORDER, 2, -1):
        if k > 3:
            below, below_counts = _merge([(keys & _MASK[k - 1], counts)])
        else:
            below, below_counts = low["keys"], low["counts"]
        contexts, first = np.unique(keys >> 8, return_index=True)
        if len(contexts):
            total = np.add.reduceat(counts, first)
            kinds = np.diff(np.r_[first, len(keys)])
            after = np.add.reduceat(_look_up(below, below_counts, keys & _MASK[k - 1]), first)
            wanted = grams & _MASK[k]
            at = np.minimum(np.searchsorted(contexts, wanted >> 8), len(contexts) - 1)
            known = contexts[at] == wanted >> 8
            level(_look_up(keys, counts, wanted), np.where(known, total[at], 0), kinds[at], after[at])
        keys, counts = below, below_counts
    two, one, symbol = grams >> 8 & 0xFFFF, grams >> 8 & 0xFF, grams & 0xFF
    level(_look_up(keys, counts, grams & _MASK[2]), low["total_2"][two], low["kinds_2"][two], low["after_2"][two])
    level(low["one"][one, symbol], low["total_1"][one], low["kinds_1"][one], low["after_1"][one])
    zero, full = low["zero"], np.ones(len(grams))
    level(zero[symbol], full * zero.sum(), full * (zero > 0).sum(), full * 0)
    cost[waiting] -= np.log10(SYMBOLS - out_kinds[waiting])
    return cost


def _score_block(docs: pa.Table, replies: pa.Table, totals: tuple[int, int, int]) -> pa.Table:
    train_tokens, kinds, train_docs = totals
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    known: dict[bytes, int] = {}
    for kind, keys_blob, reply in zip(replies.column("kind").to_pylist(), replies.column("keys"), replies.column("numbers"), strict=True):
        if kind == GRAMS:
            parts.append((unpack_sorted(keys_blob.as_py()), unpack_costs(reply.as_py())))
        else:
            known.update(x for x in zip(unpack_words(keys_blob.as_py()), unpack(reply.as_py()).tolist(), strict=True) if x[1])
    keys, values = (np.concatenate(c) for c in zip(*parts, strict=True))
    del parts
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    del order
    scale = train_tokens + 0.5 * (kinds + 1)
    n_tokens, n_known, base, score = [], [], [], []
    for _, texts in _slices(docs.column("text")):
        numbers, starts = strings(texts)
        cost = values[np.minimum(np.searchsorted(keys, numbers), len(keys) - 1)]
        cost[numbers < 0] = 0
        score.append(np.add.reduceat(cost, starts))
        for text in texts:
            found = text.translate(_LOWER).split()
            c = np.fromiter((known.get(w, 0) for w in found), np.float64, len(found))
            c = np.append(c, train_docs)
            n_tokens.append(len(c))
            n_known.append(int((c > 0).sum()))
            base.append(float(np.log10((c + 0.5) / scale).sum()))
    return pa.table(
        {
            "doc_id": docs.column("doc_id"),
            "held_out": docs.column("held_out"),
            "n_tokens": pa.array(n_tokens, pa.int64()),
            "n_known": pa.array(n_known, pa.int64()),
            "train_tokens": pa.array(np.full(len(n_tokens), train_tokens, np.int64)),
            "base_score": pa.array(base, pa.float64()),
            "score": pa.array(np.concatenate(score or [np.empty(0)]), pa.float64()),
        }
    )


def held_out_fold(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 5; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def score(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """Scores every row with a model of the rows that are not held out.

    Null texts are empty: one token, the end. Repeated rows are scored and, in training,
    counted each. Without any training row all symbols are alike. A row lies in the block
    of its (doc_id, text) hash, so a frequent id is spread by its texts.
    """
    spark = docs.sparkSession
    ship_code(spark)
    n = blocks(docs)
    text = whole_text()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.cast("binary").alias("text"),
        (held_out if held_out is not None else held_out_fold(F.col("doc_id"))).alias("held_out"),
        F.pmod(F.xxhash64("doc_id", text), F.lit(n)).cast("long").alias("block"),
    )

    def counts(block: pa.Table) -> pa.Table:
        enter("ppm")
        return block_counts(block, n)

    asked = materialize(rows.groupBy("block").applyInArrow(counts, PACKED), "ppm-asked")
    low_everywhere = spark.sparkContext.broadcast(_low_counts(asked))
    low_of: list[dict] = []

    def price(group: pa.Table) -> pa.Table:
        enter("ppm")
        sums = summed(group)
        if sums.column("kind")[0].as_py() != GRAMS:
            return sums
        if not low_of:
            low_of.append(low_orders(*low_everywhere.value))
        keys, counts = unpack_sorted(sums.column("keys")[0].as_py()), unpack(sums.column("numbers")[0].as_py())
        return sums.set_column(5, _PACKED.field(5), pa.array([pack_costs(group_costs(keys, counts, low_of[0]))], pa.binary()))

    ranged = asked.where(F.col("kind") != LOW)
    by_chunk = ranged.groupBy("kind", "range", "chunk")
    priced = materialize(by_chunk.applyInArrow(summed, PACKED).groupBy("kind", "range").applyInArrow(price, PACKED), "ppm-priced")
    train_docs = rows.where("held_out = false").count()
    tokens, kinds = _word_totals(priced)
    totals = (tokens + train_docs, kinds + (train_docs > 0), train_docs)
    chunks = F.explode(F.sequence(F.lit(0), F.lit((n - 1) // CHUNK_BLOCKS)).cast("array<long>"))
    known = priced.drop("chunk").withColumn("chunk", chunks).select(*asked.columns)
    replies = by_chunk.cogroup(known.groupBy("kind", "range", "chunk")).applyInArrow(answered, PACKED)

    def finish(texts: pa.Table, reply: pa.Table) -> pa.Table:
        enter("ppm")
        return _score_block(texts, reply, totals)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, schema)


def _low_counts(asked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Training counts of all 3-byte strings, at most 256 ** 3."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(unpack_sorted(k.as_py())), pa.array(unpack(c.as_py()))], ["p", "n"])

    found = asked.where(F.col("kind") == LOW).select("keys", "numbers").mapInArrow(each, "p long, n long")
    short = found.groupBy("p").agg(F.sum("n").alias("n")).toArrow()
    keys, counts = _merge([(short.column("p").to_numpy(), short.column("n").to_numpy())])
    return keys.astype(np.uint32), counts


def _word_totals(priced: DataFrame) -> tuple[int, int]:
    """Training words, and different ones."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [unpack(c.as_py()) for c in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([int(c.sum()) for c in counts], pa.int64()), pa.array([int((c > 0).sum()) for c in counts], pa.int64())], ["n", "v"])

    sums = priced.where(F.col("kind") == WORDS).select("numbers").mapInArrow(each, "n long, v long")
    row = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    return row["n"], row["v"]


def adaptive(docs: DataFrame) -> DataFrame:
    """``(doc_id, score)``: each text scored by a model that learns from it alone, byte
    by byte, so the score falls with a text's own repetition. Null texts are empty, repeated
    rows and null ids are scored each, an empty table gives an empty result. No shuffle; a
    text costs time and memory in proportion to its length, in pure Python."""
    ship_code(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [ByteTrie().score(t.as_py(), learn=True) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")
