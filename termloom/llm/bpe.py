"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

A word is written over an alphabet of 512 symbols: its bytes, the last one marked as
the word's end. An Aho-Corasick automaton over all vocabulary entries gives the
longest entry from each position. The encoder takes entries greedily; an entry may
follow another only if the two are compatible, that is, if merging the two joined
strings alone gives these very entries. Where none is, it tries the next shorter
prefix entry, and then goes back one entry. A position that failed is never tried
again, so the work is linear in the word, and the result equals that of merging.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Cache, enter, on_leaving, ship_code, whole_text

#: Bytes that a worker keeps of chunks, of words and of pairs.
CACHE_BYTES = (16_000_000, 64_000_000, 12_000_000)
#: Bytes of text that are encoded before they are handed on.
SLICE_BYTES = 2_000_000

END = "</w>"


def byte_letters() -> list[str]:
    """The printable letter that a byte-level vocabulary writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = [""] * 256, 256
    for b in plain:
        letters[b] = chr(b)
    for b in range(256):
        if not letters[b]:
            letters[b] = chr(spare)
            spare += 1
    return letters


class Vocabulary:
    """Entries, merges and pair compatibility of a BPE file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model = spec["model"]
        ids = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        size = max([*ids.values(), *self.added.values()]) + 1
        self.symbols: list[str | None] = [None] * size
        self.content: list[str] = [""] * size
        for text, i in [*ids.items(), *self.added.items()]:
            self.content[i] = text
        for b, letter in enumerate(letters):
            self.symbols[ids[letter]] = chr(b)
            self.symbols[ids[letter + END]] = chr(256 + b)
        self.made = [-1] * size
        self.parts: list[tuple[int, int]] = [(-1, -1)] * size
        self.rank: dict[tuple[int, int], int] = {}
        for at, (left, right) in enumerate(model["merges"]):
            a, b, whole = ids[left], ids[right], ids[left + right]
            self.rank[a, b] = at
            if self.made[whole] < 0:
                self.made[whole], self.parts[whole] = at, (a, b)
                self.symbols[whole] = self.symbols[a] + self.symbols[b]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.length = [len(s) if s else 0 for s in self.symbols]
        by_symbols = {s: i for i, s in enumerate(self.symbols) if s}
        for s, i in by_symbols.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.shorter = [-1] * size
        for s, i in by_symbols.items():
            self.shorter[i] = next((by_symbols[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in by_symbols), -1)
        self._pairs = Cache(CACHE_BYTES[2], 120)
        pieces = [f"{text} ".encode() for text in self.content]
        self.piece_blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_length = np.array([len(p) for p in pieces], np.int64)
        self.piece_offset = np.cumsum(self.piece_length) - self.piece_length

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined strings of two entries alone gives these two.

        The later made of the two is taken apart step by step; a merge across the
        border that comes before the one just undone would have been made instead.
        """
        key = left << 20 | right
        known = self._pairs.get(key)
        if known is not None:
            return known
        made, parts, rank = self.made, self.parts, self.rank
        limit, good = len(rank) + 1, True
        while True:
            crossing = rank.get((left, right))
            if crossing is not None and crossing < limit:
                good = False
                break
            if made[left] < 0 and made[right] < 0:
                break
            if made[left] > made[right]:
                limit, left = made[left], parts[left][1]
            else:
                limit, right = made[right] + 1, parts[right][0]
        self._pairs.keep(key, good, 0)
        return good

    def encode_word(self, word: bytes) -> list[int]:
        n = len(word)
        if not n:
            return []
        text = word[:-1].decode("latin-1") + chr(256 + word[-1])
        length, shorter, compatible, pairs = self.length, self.shorter, self.compatible, self._pairs
        longest = [-1] * n
        for end, entry in self.automaton.iter(text):
            longest[end + 1 - length[entry]] = entry  # matches come by their end, so the longest comes last
        out: list[int] = []
        at, entry, open_at = 0, longest[0], bytearray(b"\x01" * (n + 1))
        while at < n:
            end = at + length[entry]
            if open_at[end] and (not out or ((known := pairs.get(out[-1] << 20 | entry)) is None and compatible(out[-1], entry)) or known):
                out.append(entry)
                at = end
                entry = longest[at] if at < n else -1
            elif shorter[entry] >= 0:
                entry = shorter[entry]
            else:
                open_at[at] = 0
                entry = out.pop()
                at -= length[entry]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The entries' contents with a space between, as the file has no decoder."""
        if not len(ids):
            return b""
        lengths = self.piece_length[ids]
        ends = np.cumsum(lengths)
        take = np.repeat(self.piece_offset[ids] - (ends - lengths), lengths)
        take += np.arange(ends[-1])
        return self.piece_blob[take[:-1]].tobytes()


class Words(Cache):
    """Words -> their ids, little-endian."""

    def __init__(self, bound: int, encode):
        super().__init__(bound, 180)
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        self.keep(word, packed, len(word) + len(packed))
        return packed


class TextEncoder(Cache):
    """Chunks of text without spaces or line breaks -> their ids, little-endian.

    Normalisation, splitting and merging never look across white space, so a chunk's
    ids do not depend on its neighbours, and each worker encodes a chunk once. A text of
    characters up to LAST goes at once: there NFC changes nothing, and which characters
    are letters, numbers and spaces is known.
    """

    BYTES = CACHE_BYTES
    #: The split pattern of the vocabulary file.
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    LAST = "\u024f"
    #: The same for characters up to LAST.
    QUICK = re.compile(
        "'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+".format(L="A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", N="0-9\xb2\xb3\xb9\xbc-\xbe", S="\t-\r \x85\xa0")
    )

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(self.BYTES[0], 180)
        self.vocabulary = vocabulary
        self.words = Words(self.BYTES[1], self.encode_word)
        self.added = {text: struct.pack("<I", i) for text, i in vocabulary.added.items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.added, key=len, reverse=True))) + ")")
        self.unletter = {ord(c): b for b, c in enumerate(byte_letters())}

    def __missing__(self, chunk: str) -> bytes:
        parts = self.marks.split(chunk) if "<|" in chunk else [chunk]
        out = b"".join(self.added.get(p) or self._plain(p) for p in parts if p)
        self.keep(chunk, out, len(chunk) + len(out))
        return out

    def _plain(self, chunk: str) -> bytes:
        if max(chunk) <= self.LAST:
            words = self.QUICK.findall(chunk.lower())
        else:  # the library's own tables decide what a letter is
            library = self.vocabulary.library
            pieces = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(chunk))
            words = [bytes(p.translate(self.unletter), "latin-1").decode() for p, _ in pieces]
        return b"".join(map(self.words.__getitem__, words))

    def encode_word(self, word: str) -> list[int]:
        return self.vocabulary.encode_word(word.encode())

    def encode(self, text: str) -> bytes:
        if "<|" not in text and (text.isascii() or max(text) <= self.LAST):
            return b"".join(map(self.words.__getitem__, self.QUICK.findall(text.lower())))
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_encoders: dict[str, TextEncoder] = {}


def text_encoder(path: str) -> TextEncoder:
    """One encoder per worker process and file; its caches outlive the task."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(Vocabulary(path))
    return _encoders[path]


on_leaving("bpe", _encoders.clear)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of some rows at a time; a row's text is whole."""
    start, texts, size = 0, [], 0
    for at, text in enumerate(batch.column(1)):
        text = text.as_py()
        if texts and size + len(text) > SLICE_BYTES:
            yield batch.column(0).slice(start, len(texts)), texts
            start, texts, size = at, [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield batch.column(0).slice(start, len(texts)), texts


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>, decoded string)`` of every row; a null text is empty.

    No shuffle: each task streams over its rows, some megabytes at a time; a longer text is
    a step of its own. Repeated rows stay, a null id stays null, an empty table gives an
    empty result, other columns are not carried.
    """
    ship_code(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("bpe")
        encoder = text_encoder(vocabulary)
        for batch in batches:
            for doc_ids, texts in _slices(batch):
                packed = [encoder.encode(t) for t in texts]
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(packed), "<i4")))
                decoded = pa.array([encoder.vocabulary.decode(np.frombuffer(p, "<u4")).decode() for p in packed], pa.string())
                yield pa.RecordBatch.from_arrays([doc_ids, ids, decoded], ["doc_id", "ids", "decoded"])

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: the digests are taken in the
    task that encodes, so neither ids nor texts leave it."""
    ship_code(docs.sparkSession)
    kept = docs.select("doc_id", whole_text().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("bpe")
        encoder = text_encoder(vocabulary)
        for batch in batches:
            counts, id_digests, text_digests = [], [], []
            for text in batch.column(1):
                packed = encoder.encode(text.as_py())
                counts.append(len(packed) // 4)
                id_digests.append(hashlib.sha256(packed).hexdigest())
                text_digests.append(hashlib.sha256(encoder.vocabulary.decode(np.frombuffer(packed, "<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return kept.mapInArrow(run, schema)
