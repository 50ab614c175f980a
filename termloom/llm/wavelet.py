"""Token ids in wavelet matrix files, one shard each.

A shard is one row of a Parquet table, in a file of its own, of SHARD_TOKENS ids or one
longer document: for each bit of an id,
from the highest, a plane of n bits; ids with a 0 come first on the next plane, in
order, then those with a 1. With the number of zeros of each plane and a count of ones before
every 512 bits, a token is read, counted up to a place (rank) or found by its number of
occurrence (select) in one step a plane, without decoding the rest. Documents are in
ascending id order over all shards. ``access``, ``count`` and ``locate`` answer tables of
questions from the files; only the shards that a question falls on are read for it.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import TextEncoder, Vocabulary, Words, byte_letters
from .common import blocks, enter, on_leaving, shared_dir, ship_code, whole_text

BLOCK_BITS = 512
#: Ids that are dealt into zeros and ones at once; what that takes stays in a processor's cache.
PART = 1 << 15
#: Ids after which a shard ends with the document; they and their planes fit in a task.
SHARD_TOKENS = 8_000_000
#: Shards that one task of a range of documents may write.
_SHARDS_A_TASK = 1 << 20
#: Bytes of texts whose words are found at once; a longer text is cut at white space.
STEP_BYTES = 16_000_000
SPACES = re.compile(rb"[\x20\x09-\x0D]")
SCHEMA = (
    "shard long, doc_ids array<long>, doc_tokens array<long>, n_tokens long, zeros array<long>, "
    "planes array<binary>, ranks array<binary>"
)


class WaveletMatrix:
    """Bit planes with rank and select. ``planes``: packed bits; ``ranks``: ones before
    each block of 512 bits; ``zeros``: zeros of each plane."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.zeros = n, zeros
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @staticmethod
    def build(ids: np.ndarray, bits: int) -> WaveletMatrix:
        zeros, planes, ranks = [], [], []
        after, high = np.empty_like(ids), np.empty_like(ids)
        for b in reversed(range(bits)):
            padded = np.zeros(-(-len(ids) // BLOCK_BITS) * BLOCK_BITS // 8, np.uint8)
            low = up = 0
            for at in range(0, len(ids), PART):
                part = ids[at : at + PART]
                ones = (part & ids.dtype.type(1 << b)) != 0
                packed = np.packbits(ones)
                padded[at // 8 : at // 8 + len(packed)] = packed
                first, second = np.compress(~ones, part), np.compress(ones, part)  # by places, faster than by a mask
                after[low : low + len(first)], high[up : up + len(second)] = first, second
                low, up = low + len(first), up + len(second)
            per_block = np.bitwise_count(padded.view("<u8")).reshape(-1, 8).sum(axis=1, dtype=np.int64)
            ranks.append(np.r_[0, np.cumsum(per_block)].astype("<u4").tobytes())
            planes.append(padded[: -(-len(ids) // 8)].tobytes())
            zeros.append(low)
            after[low:] = high[:up]
            ids, after = after, ids if b < bits - 1 else np.empty_like(ids)  # what was given stays
        return WaveletMatrix(len(ids), zeros, planes, ranks)

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up, undoing one partition a plane."""
        ids = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        before = np.empty_like(ids)
        for at in reversed(range(len(self.planes))):
            bit = ids.dtype.type(1 << (len(self.planes) - 1 - at))
            low, up = 0, self.zeros[at]
            for start in range(0, self.n, PART):
                part = before[start : start + PART]
                ones = np.unpackbits(self.planes[at][start // 8 : (start + PART) // 8], count=len(part)).view(bool)
                first, second = np.flatnonzero(~ones), np.flatnonzero(ones)
                part[first] = ids[low : low + len(first)]
                part[second] = ids[up : up + len(second)] | bit
                low, up = low + len(first), up + len(second)
            ids, before = before, ids
        return ids

    def _ones(self, plane: int, place: int) -> int:
        """Ones before ``place``."""
        block = place // BLOCK_BITS
        bits = np.unpackbits(self.planes[plane][block * BLOCK_BITS // 8 : -(-place // 8)], count=place - block * BLOCK_BITS)
        return int(self.ranks[plane][block]) + int(bits.sum())

    def access(self, place: int) -> int:
        value = 0
        for plane in range(len(self.planes)):
            one = self.planes[plane][place >> 3] >> (7 - (place & 7)) & 1
            ones = self._ones(plane, place)
            value = value << 1 | int(one)
            place = self.zeros[plane] + ones if one else place - ones
        return value

    def rank(self, token: int, place: int) -> int:
        """Occurrences of ``token`` before ``place``."""
        start, end = self._range(token, place)
        return end - start

    def _range(self, token: int, place: int) -> tuple[int, int]:
        start, end = 0, place
        for plane in range(len(self.planes)):
            a, b = self._ones(plane, start), self._ones(plane, end)
            if token >> (len(self.planes) - 1 - plane) & 1:
                start, end = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                start, end = start - a, end - b
        return start, end

    def select(self, token: int, number: int) -> int:
        """Place of the occurrence ``number`` (from 0) of ``token``; -1 beyond the last."""
        start, end = self._range(token, self.n)
        if not 0 <= number < end - start:
            return -1
        place = start + number
        for plane in reversed(range(len(self.planes))):
            one = token >> (len(self.planes) - 1 - plane) & 1
            wanted = place - self.zeros[plane] if one else place
            place = self._find(plane, wanted, bool(one))
        return place

    def _find(self, plane: int, number: int, one: bool) -> int:
        blocks = self.ranks[plane].astype(np.int64)
        counts = blocks if one else np.minimum(np.arange(len(blocks)) * BLOCK_BITS, self.n) - blocks
        block = int(np.searchsorted(counts, number, "right")) - 1
        at = block * BLOCK_BITS
        bits = np.unpackbits(self.planes[plane][at // 8 : (at + BLOCK_BITS) // 8], count=min(BLOCK_BITS, self.n - at))
        return at + int(np.flatnonzero(bits == one)[number - counts[block]])


class PackedWords(Words):
    """Words whose ids ``encode`` gives packed."""

    def __missing__(self, word: str | bytes) -> bytes:
        packed = self.encode(word)
        self.keep(word, packed, len(word) + len(packed))
        return packed


def _kinds() -> np.ndarray:
    """Of each byte: space, letter, number or other; those above 0x7F as letters."""
    out = np.full(256, OTHER, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = SPACE
    out[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = LETTER
    out[0x30:0x3A] = NUMBER
    return out


SPACE, LETTER, NUMBER, OTHER = range(4)
KINDS = _kinds()


class LibraryEncoder(TextEncoder):
    """As ``TextEncoder``, with the library's own merging of each word and ids of ``width`` bytes.

    Texts are cut into words some megabytes at a time: in UTF-8, words end where the kind of
    the bytes changes. Of a step each different word is looked up once. Texts with characters
    of which the bytes do not tell the kind go one by one.
    """

    BYTES = (10_000_000, 20_000_000)
    #: Bytes of the words of plain texts that a worker keeps.
    PIECE_BYTES = 110_000_000
    #: From U+023A on, some small letters lie beyond the characters that go at once.
    LAST = "\u0239"
    #: Bytes of plain texts, ASCII and letters from U+00C0 to U+01FF, and what is not plain all the
    #: same: added tokens, two signs, and U+0130, whose small form has two characters.
    PLAIN = bytes([*range(0x80, 0xC0), *range(0xC3, 0xC8), *range(0x80)])
    ODD = (b"<|", "\xd7".encode(), "\xf7".encode(), "\u0130".encode())

    def __init__(self, vocabulary: Vocabulary, width: int):
        super().__init__(vocabulary)
        self.letters = dict(enumerate(byte_letters()))
        self.packed = [i.to_bytes(width, "little") for i in range(len(vocabulary.content))]
        self.added = {text: self.packed[i] for text, i in vocabulary.added.items()}
        self.words = PackedWords(self.BYTES[1], self.encode_word)
        self.pieces = PackedWords(self.PIECE_BYTES, self.encode_piece)
        self.width = width
        self.tokenize = vocabulary.library.model.tokenize

    def encode_word(self, word: str) -> bytes:
        written = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(written)])

    def encode_piece(self, piece: bytes) -> bytes:
        return b"" if piece.isspace() else self.encode_word(piece.decode().lower())

    def encode_each(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """The packed ids of each text."""
        held, size = [], 0
        for text in texts:
            if held and size + len(text) > STEP_BYTES:
                yield from self._step(held)
                held, size = [], 0
            held.append(text)
            size += len(text)
        if held:
            yield from self._step(held)

    def _step(self, texts: list[bytes]) -> Iterator[bytes]:
        odd = {at for at, t in enumerate(texts) if any(x in t for x in self.ODD) or not t.isascii() and t.translate(None, self.PLAIN)}
        if len(texts) == 1 and len(texts[0]) > 2 * STEP_BYTES and not odd:
            cuts = [0]
            while border := SPACES.search(texts[0], cuts[-1] + STEP_BYTES):
                cuts.append(border.start())
            yield b"".join([p for a, b in zip(cuts, [*cuts[1:], None], strict=True) for p in self._plain_step([texts[0][a:b]])])
            return
        plain = self._plain_step([b"" if at in odd else t for at, t in enumerate(texts)])
        for at, packed in enumerate(plain):
            yield self.encode(texts[at].decode()) if at in odd else packed

    def _plain_step(self, texts: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
        kind = KINDS[data]
        edge = np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)]
        # an apostrophe alone takes some letters after it along
        at = np.flatnonzero(data == ord("'"))
        at = at[edge[at] & edge[at + 1] & (kind[at + 1] == LETTER)]
        first, second = data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
        two = (second == ord("e")) & ((first == ord("r")) | (first == ord("v"))) | (first == ord("l")) & (second == ord("l"))
        size = np.isin(first, np.frombuffer(b"stmd", np.uint8)) + 2 * two
        at, size = at[size > 0], size[size > 0]
        edge[at + 1] = False
        edge[at + 1 + size] = True
        starts = np.r_[np.flatnonzero(edge), len(data)].astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        of = words.indices.to_numpy()
        packed = list(map(self.pieces.__getitem__, words.dictionary.to_numpy(zero_copy_only=False)))
        ids = np.frombuffer(b"".join(packed), np.dtype(f"<u{self.width}"))
        each = np.fromiter(map(len, packed), np.int32, len(packed)) // np.int32(self.width)
        count = each[of]
        ends = np.zeros(len(starts), np.int32)
        np.cumsum(count, out=ends[1:])
        take = np.repeat((np.cumsum(each, dtype=np.int32) - each)[of] - ends[:-1], count)
        take += np.arange(len(take), dtype=np.int32)
        out = ids[take]
        firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cuts = ends[np.searchsorted(starts, firsts.astype(np.int32))].tolist()  # white space, without ids, stands across a border
        return [out[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


_encoders: dict[tuple[str, int], LibraryEncoder] = {}


def _encoder(path: str, width: int = 4) -> LibraryEncoder:
    if (path, width) not in _encoders:
        _encoders[path, width] = LibraryEncoder(Vocabulary(path), width)
    return _encoders[path, width]


on_leaving("wavelet", _encoders.clear)


def last_id(path: str) -> int:
    """The largest id of a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])


def write(docs: DataFrame, vocabulary: str, path: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes every row, adds ``end_id`` and writes one file a shard.

    Rows are dealt by ranges of (doc_id, hash of the text) and sorted by (doc_id, text),
    so a repeated id may span shards and ties have one order; a null id comes first, a null
    text is empty. A task holds the ids of one shard at a time. An empty table writes no
    shard. Other columns are not read.
    """
    ship_code(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    dealt = (
        rows.withColumn("h", F.xxhash64("text"))
        .repartitionByRange(blocks(docs), "doc_id", "h")
        .sortWithinPartitions("doc_id", "h", "text")
        .select("doc_id", "text", F.spark_partition_id().alias("task"))
    )

    bits = max(end_id, last_id(vocabulary)).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("wavelet")
        kind = np.dtype("<u2" if bits <= 16 else "<u4")
        encoder = _encoder(vocabulary, kind.itemsize)
        end = int(end_id).to_bytes(kind.itemsize, "little")
        shard, size = None, 0
        doc_ids: list[int | None] = []
        counts: list[int] = []
        parts: list[bytes] = []

        def made() -> pa.RecordBatch:
            m = WaveletMatrix.build(np.frombuffer(b"".join(parts), kind), bits)
            row = {
                "shard": shard, "doc_ids": doc_ids, "doc_tokens": counts, "n_tokens": m.n, "zeros": m.zeros,
                "planes": [p.tobytes() for p in m.planes], "ranks": [r.tobytes() for r in m.ranks],
            }
            return pa.RecordBatch.from_pylist([row], schema=_arrow_schema())

        for batch in batches:
            texts = (t.as_py() for t in batch.column(1).cast(pa.binary()))
            for doc_id, packed, task in zip(batch.column(0).to_pylist(), encoder.encode_each(texts), batch.column(2).to_pylist(), strict=True):
                if size >= shard_tokens:
                    yield made()
                    shard, size, doc_ids, counts, parts = shard + 1, 0, [], [], []
                if shard is None:
                    shard = task * _SHARDS_A_TASK
                doc_ids.append(doc_id)
                counts.append(len(packed) // kind.itemsize + 1)
                parts += packed, end
                size += counts[-1]
        if parts:
            yield made()

    dealt.mapInArrow(run, SCHEMA).write.option("compression", "zstd").option("maxRecordsPerFile", 1).parquet(path)


def _arrow_schema() -> pa.Schema:
    longs, blobs = pa.list_(pa.int64()), pa.list_(pa.binary())
    return pa.schema(
        [("shard", pa.int64()), ("doc_ids", longs), ("doc_tokens", longs), ("n_tokens", pa.int64()), ("zeros", longs), ("planes", blobs), ("ranks", blobs)]
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``first``, the ids of all shards before. Only shard sizes, one
    row a shard, go through the one-task window."""
    shards = spark.read.schema(SCHEMA).parquet(path)
    sizes = shards.select("shard", "n_tokens")
    first = sizes.select(
        "shard", (F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")).alias("first")
    )
    return shards.join(F.broadcast(first), "shard")


def documents(shards: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` decoded from the files, a shard at a time;
    no shard gives no row, an empty text its end id alone."""
    ship_code(shards.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("wavelet")
        for batch in batches:
            for row in batch.to_pylist():
                ids = _matrix(row).decode().astype("<u4")
                counts = np.array(row["doc_tokens"], np.int64)
                starts = np.cumsum(counts) - counts
                sums = [zlib.crc32(ids[s : s + n]) for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["first"]), pa.array(counts), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix(row["n_tokens"], row["zeros"], row["planes"], row["ranks"])


_MATRIX = ["shard", "first", "n_tokens", "zeros", "planes", "ranks"]


def access(shards: DataFrame, positions: DataFrame) -> DataFrame:
    """``(position, token)`` of the distinct ``position`` numbers, counted over all shards;
    null where there is none."""
    ship_code(shards.sparkSession)
    asked = positions.select(F.col("position").cast("long").alias("position")).distinct()
    spans = shards.select(F.col("shard").alias("_of"), F.col("first").alias("_from"), (F.col("first") + F.col("n_tokens")).alias("_to"))
    inside = (F.col("position") >= F.col("_from")) & (F.col("position") < F.col("_to"))
    dealt = asked.join(F.broadcast(spans), inside).select("_of", "position")  # one small row a shard

    def look(of: pa.Table, held: pa.Table) -> pa.Table:
        enter("wavelet")
        places = of.column("position").to_pylist() if of.num_rows else []
        row = held.to_pylist()[0]
        m = _matrix(row)
        tokens = [m.access(p - row["first"]) for p in places]
        return pa.table({"position": pa.array(places, pa.int64()), "token": pa.array(tokens, pa.int64())})

    wanted = shards.select(*_MATRIX).join(dealt.select(F.col("_of").alias("shard")).distinct(), "shard", "left_semi")
    found = dealt.groupBy("_of").cogroup(wanted.groupBy("shard")).applyInArrow(look, "position long, token long")
    return asked.join(found, "position", "left")


def counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """``(shard, first, token, n)``: how often each of some tokens stands in each shard."""
    ship_code(shards.sparkSession)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("wavelet")
        for batch in batches:
            for row in batch.to_pylist():
                m = _matrix(row)
                n = [m.rank(t, m.n) if t >> len(m.planes) == 0 else 0 for t in tokens]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(n), pa.int64()), pa.array([row["first"]] * len(n), pa.int64()), pa.array(tokens, pa.int64()), pa.array(n, pa.int64())],
                    ["shard", "first", "token", "n"],
                )

    return shards.select(*_MATRIX).mapInArrow(rank, "shard long, first long, token long, n long")


def count(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """``(token, n)`` over all shards."""
    return counts(shards, tokens).groupBy("token").agg(F.sum("n").alias("n"))


def locate(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """``(token, number, position)`` of every occurrence of some tokens, numbered from 0."""
    ship_code(shards.sparkSession)
    per_shard = counts(shards, tokens)
    before = F.sum("n").over(Window.partitionBy("token").orderBy("first")) - F.col("n")
    asked = per_shard.withColumn("before", before).where("n > 0").groupBy("shard").agg(F.collect_list(F.struct("token", "n", "before")).alias("asked"))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("wavelet")
        for batch in batches:
            for row in batch.to_pylist():
                m = _matrix(row)
                for a in row["asked"]:
                    places = [row["first"] + m.select(a["token"], k) for k in range(a["n"])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([a["token"]] * a["n"], pa.int64()), pa.array(range(a["before"], a["before"] + a["n"]), pa.int64()), pa.array(places, pa.int64())],
                        ["token", "number", "position"],
                    )

    held = shards.select(*_MATRIX).join(asked, "shard")
    return held.mapInArrow(select, "token long, number long, position long")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Writes the shards into the shared folder and reads every document back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write(docs, vocabulary, path, end_id)
    return documents(read(spark, path))
