"""Hashes that travel packed: many in a row, grouped by the bucket that will meet their equals.

A row of the shuffle holds the hashes that one block of documents sends to one bucket. Buckets and blocks are cut by size: a bucket's
hashes fit a task, and a block is large enough that such a row holds dozens of hashes even when there are very many buckets. Within a
bucket 40 bits tell hashes apart (2e6 hashes: one false meeting in 5e5 of them); that serves where a meeting is only a hint. Where it
decides, the full hash and a second, independent one travel: 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A block of documents has about this many bytes of text; the larger bound is reached at 100 TB.
LEAST_BLOCK, MOST_BLOCK = 4 << 20, 64 << 20
#: Bytes of text behind a shuffle partition.
TASK_BYTES = 8 << 20
MASK40 = np.uint64((1 << 40) - 1)


def layout(total_bytes: int) -> tuple[int, int]:
    """Number of blocks and of buckets for so much text."""
    block = min(max(LEAST_BLOCK, 8 * math.isqrt(total_bytes)), MOST_BLOCK)
    blocks = max(1, math.ceil(total_bytes / block))
    return blocks, max(1, min(math.ceil(total_bytes / LEAST_BLOCK), block // 1000))


def tasks(total_bytes: int, keys: int) -> int:
    """Number of shuffle partitions for so much text in so many blocks or buckets: it grows with the input, whatever the session says."""
    return max(1, min(keys, math.ceil(total_bytes / TASK_BYTES)))


def pack40(h: np.ndarray) -> bytes:
    """40-bit numbers: the low 32 bits of all, then the high 8 bits of all."""
    return h.astype("<u4").tobytes() + (h >> np.uint64(32)).astype("u1").tobytes()


def unpack40(data: bytes) -> np.ndarray:
    n = len(data) // 5
    return np.frombuffer(data, "<u4", n).astype(np.uint64) | (np.frombuffer(data, "u1", n, 4 * n).astype(np.uint64) << np.uint64(32))


def pack128(h: np.ndarray, other: np.ndarray) -> bytes:
    """Pairs of 64-bit hashes: all first ones, then all second ones."""
    return h.astype("<u8").tobytes() + other.astype("<u8").tobytes()


def unpack128(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(data, "<u8")
    return both[:len(both) // 2].astype(np.uint64), both[len(both) // 2:].astype(np.uint64)


def place_of(h: np.ndarray, other: np.ndarray, known: np.ndarray, known_other: np.ndarray) -> np.ndarray:
    """Where each pair stands among the known pairs, which are sorted; -1 if it is none of them."""
    at = np.searchsorted(known, h)
    out = np.full(len(h), -1)
    open_ = np.flatnonzero(at < len(known))
    while len(open_):  # more than once only where first hashes meet
        open_ = open_[known[at[open_]] == h[open_]]
        same = known_other[at[open_]] == other[open_]
        out[open_[same]] = at[open_[same]]
        open_ = open_[~same]
        at[open_] += 1
        open_ = open_[at[open_] < len(known)]
    return out


def split_hash(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each hash and the 40 bits that tell it apart there."""
    n = np.uint64(buckets)
    return (h % n).astype(np.int64), (h // n) & MASK40


def by_bucket(bucket: np.ndarray, buckets: int, *more: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Slices of arrays that are sorted by bucket, for the buckets that have something."""
    ends = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(ends)):
        yield int(b), slice(int(ends[b]), int(ends[b + 1]))


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of the runs of equal neighbours."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.diff(np.r_[starts, len(keys)])


def table(schema: pa.Schema, **columns) -> pa.Table:
    return pa.table({f.name: pa.array(columns[f.name], f.type) for f in schema}, schema=schema)


def contains(found: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``found`` are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(found), bool)
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    return known[at] == found
