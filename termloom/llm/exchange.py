"""Fingerprints that blocks of documents have in common.

Documents are dealt into blocks by a hash. A block sends each of its fingerprints once,
sorted and cut into ranges, so a passage that a third of all documents hold weighs no
more than the number of blocks; a range of fingerprints is resolved in one task, and
each block gets back those of its own that other documents have too. The shuffle of the
texts is the same for each pass over the blocks, so Spark runs it once.

Fingerprints that only choose candidates travel coarse: of the bits below those that name
the range, 40 go. More ranges mean more bits, so false candidates stay as rare as the data grow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, whole_text

SLICE_BYTES = 500_000
#: Bits of a coarse fingerprint below those that name its range.
COARSE_BITS = 40
SCHEMA = "block long, bucket long, keys binary, least binary, several binary"
_TYPES = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("least", pa.binary()), ("several", pa.binary())])
NOTHING = _TYPES.empty_table()


def in_blocks(docs: DataFrame, carry: list | None = None) -> DataFrame:
    """``(doc_id, text binary, block)`` and ``carry``; a row's block is a hash of
    (doc_id, text)."""
    text = whole_text()
    n = blocks(docs)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.cast("binary").alias("text"),
        F.pmod(F.xxhash64("doc_id", text), F.lit(n)).cast("long").alias("block"),
        *(carry or []),
    )


def bucket_bits(docs: DataFrame) -> int:
    return max(1, blocks(docs) - 1).bit_length()


def coarse(keys: np.ndarray, bits: int) -> np.ndarray:
    """Keys without the bits that coarse fingerprints leave out."""
    spare = max(0, 64 - bits - COARSE_BITS)
    return keys >> np.uint64(spare) << np.uint64(spare)


def slices(table: pa.Table) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts) of some documents at a time."""
    ids, texts, size = [], [], 0
    for doc_id, text in zip(table.column("doc_id").to_pylist(), table.column("text"), strict=True):
        text = text.as_py()
        if texts and size + len(text) > SLICE_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(doc_id)
        texts.append(text)
        size += len(text)
    if texts:
        yield ids, texts


class Gathered:
    """Distinct keys with the smallest id, and whether several ids have them."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, keys: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append(reduce_keys(keys, ids, ids))
        self.pending += len(self.parts[-1][0])
        if len(self.parts) > 1 and self.pending > 2 * len(self.parts[0][0]) + 250_000:
            self.parts = [self.merged()]
            self.pending = 0

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        return reduce_keys(*(np.concatenate(c) for c in zip(*self.parts, strict=True)))


def reduce_keys(keys: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, least, most
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[new], np.minimum.reduceat(least[order], new), np.maximum.reduceat(most[order], new)


def pack_ids(ids: np.ndarray) -> bytes:
    """Four bytes an id where all fit, else eight."""
    if len(ids) and (ids.min() < -(2**31) or ids.max() >= 2**31):
        return ids.tobytes()
    return ids.astype(np.int32).tobytes()


def unpack_ids(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, np.int32 if len(blob) == 4 * n else np.int64).astype(np.int64)


def pack_keys(keys: np.ndarray, bits: int, whole: bool) -> bytes:
    """Keys of one range; the five bytes below the range's bits of coarse ones."""
    if whole:
        return keys.tobytes()
    low = (keys << np.uint64(bits)) >> np.uint64(64 - COARSE_BITS)
    return low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : COARSE_BITS // 8].tobytes()


def unpack_keys(blob: bytes, bucket: int, bits: int, whole: bool) -> np.ndarray:
    if whole:
        return np.frombuffer(blob, np.uint64)
    width = COARSE_BITS // 8
    low = np.zeros((len(blob) // width, 8), np.uint8)
    low[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return (low.view("<u8")[:, 0] << np.uint64(64 - COARSE_BITS)) >> np.uint64(bits) | np.uint64(bucket << (64 - bits))


def packed(block: int, gathered: Gathered, bits: int, with_ids: bool) -> pa.Table:
    """A row for each range of keys that the block has any of; coarse keys without ids."""
    keys, least, most = gathered.merged()
    buckets = (keys >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]) if len(keys) else np.empty(0, np.int64)
    ends = np.r_[first[1:], len(keys)].tolist()
    rows = list(zip(first.tolist(), ends, strict=False))
    return pa.table(
        [
            pa.array([block] * len(rows), pa.int64()),
            pa.array(buckets[first], pa.int64()),
            pa.array([pack_keys(keys[a:b], bits, with_ids) for a, b in rows], pa.binary()),
            pa.array([pack_ids(least[a:b]) if with_ids else b"" for a, b in rows], pa.binary()),
            pa.array([np.packbits(least[a:b] != most[a:b]).tobytes() for a, b in rows], pa.binary()),
        ],
        schema=_TYPES,
    )


def resolve(range_: pa.Table, bits: int) -> pa.Table:
    """For each block, its keys that two or more ids have, with the smallest id."""
    with_ids = bool(range_.column("least")[0].as_py())
    bucket = range_.column("bucket")[0].as_py()
    blobs = [unpack_keys(k, bucket, bits, with_ids) for k in range_.column("keys").to_pylist()]
    sizes = np.array([len(b) for b in blobs])
    keys = np.concatenate(blobs)
    several = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=n) for s, n in zip(range_.column("several").to_pylist(), sizes, strict=True)])
    least = np.concatenate([unpack_ids(x, n) for x, n in zip(range_.column("least").to_pylist(), sizes.tolist(), strict=True)]) if with_ids else None
    row = np.repeat(np.arange(len(blobs)), sizes)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    counts = np.diff(np.r_[new, len(ranked)])
    shared = np.repeat((counts > 1) | (np.maximum.reduceat(several[order], new) > 0), counts)
    kept = order[shared]
    if with_ids:
        smallest = np.repeat(np.minimum.reduceat(least[order], new), counts)[shared]
    back = np.lexsort((keys[kept], row[kept]))
    kept = kept[back]
    cut = np.searchsorted(row[kept], np.arange(len(blobs) + 1)).tolist()
    keys = keys[kept]
    least = smallest[back] if with_ids else None
    numbers = range_.column("block").to_pylist()
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
    return pa.table(
        [
            pa.array([numbers[i] for i, _, _ in rows], pa.int64()),
            pa.array([bucket] * len(rows), pa.int64()),
            pa.array([pack_keys(keys[a:b], bits, with_ids) for _, a, b in rows], pa.binary()),
            pa.array([pack_ids(least[a:b]) if with_ids else b"" for _, a, b in rows], pa.binary()),
            pa.array([b""] * len(rows), pa.binary()),
        ],
        schema=_TYPES,
    )


def answers(table: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of a block's answers, with the smallest ids (or none, for coarse keys).
    Spark gives the missing side of a group as a table without columns."""
    if not table.num_rows:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rows = sorted(zip(table.column("bucket").to_pylist(), table.column("keys").to_pylist(), table.column("least").to_pylist(), strict=True))
    if not rows[0][2]:
        return np.concatenate([unpack_keys(k, b, bits, False) for b, k, _ in rows]), np.empty(0, np.int64)
    keys = np.frombuffer(b"".join(k for _, k, _ in rows), np.uint64)
    return keys, np.concatenate([unpack_ids(x, len(k) // 8) for _, k, x in rows])


def has(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), bool)
    return keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted


def first_pass(rows: DataFrame, emit: Callable[[pa.Table], pa.Table], bits: int) -> DataFrame:
    return _resolved(rows.groupBy("block").applyInArrow(emit, SCHEMA), bits)


def next_pass(rows: DataFrame, known: DataFrame, emit: Callable[[pa.Table, pa.Table], pa.Table], bits: int) -> DataFrame:
    return _resolved(rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(emit, SCHEMA), bits)


def _resolved(found: DataFrame, bits: int) -> DataFrame:
    return found.groupBy("bucket").applyInArrow(lambda range_: resolve(range_, bits), SCHEMA)


def rolling(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over the ``width`` items from each place on, by doubling."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    done = 1
    while done * 2 <= width:
        x = f(x[: len(x) - done], x[done:])
        done *= 2
    if done < width:
        x = f(x[:n], x[width - done : width - done + n])
    return x
