"""Removal of passages that stand in an earlier document, found through difference-cover anchors.

A passage window has ``width`` words. Anchor windows have ``width - PERIOD + 1`` words and are hashed only at word positions that are,
modulo ``PERIOD``, in the difference cover: for any two positions some shift below the period puts both on the cover, so two equal
passage windows always share an anchor at the same offset. Three steps over blocks of documents:

1. each block sends its anchors to hash buckets, and buckets answer which anchors more than one document has;
2. each shared anchor extends to the passage windows around it; their 128-bit fingerprints (two hashes over independent hashes of
   the words) go to buckets with the block's smallest doc_id, and buckets answer with the smallest doc_id of all;
3. each document drops the words under windows whose smallest doc_id is below its own.

Scale: texts are shuffled once, by block; anchors (3 in 7 words, 5 bytes each) and windows around shared anchors (16 bytes each) once each. A passage
of a third of all documents is sent once per block, not per document, and no pair of documents is ever formed. Block and bucket
counts follow the input's bytes. All steps are part of one plan, so lost executors only recompute.

Edge cases: null or empty text has no words and gives the digest of the empty text; documents of fewer words than a window lose
nothing; rows that repeat a doc_id are equals, none is earlier; a null doc_id is neither earlier nor later than another; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.blobs import by_bucket, contains, layout, pack40, pack128, place_of, runs, split_hash, table, tasks, unpack40, unpack128
from hazeline.llm.common import WordHashes, windows, worker_store

#: Every residue is a difference of two members of the cover.
PERIOD, COVER = 7, (0, 1, 3)
ASKS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("several", pa.binary()),
                  ("docs", pa.binary()), ("counts", pa.binary())])
ANSWERS = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("hashes", pa.binary()), ("docs", pa.binary()),
                     ("counts", pa.binary())])
ASKS_SQL = "bucket long, block long, hashes binary, several binary, docs binary, counts binary"
ANSWERS_SQL = "block long, bucket long, hashes binary, docs binary, counts binary"
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                    ("kept_text", pa.string())])
RESULT_SQL = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
KEY_BITS = np.uint64(40)
#: Of the second fingerprint: the seed of its word hashes and its multiplier.
SECOND_SEED, SECOND_MULTIPLIER = 0x5EED, 0xD1342543DE82EF95


class Words:
    """Words of a block of documents, one after the other."""

    def __init__(self, docs: pa.Table):
        self.ids = docs.column("doc_id").to_pylist()
        self.words = [(text or b"").split() for text in docs.column("text").to_pylist()]
        self.counts = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.starts = np.cumsum(self.counts) - self.counts
        n = int(self.counts.sum())
        hashes, self.second = worker_store(("hash pairs",), lambda: (WordHashes(), WordHashes(seed=SECOND_SEED)))
        self.hashes = np.concatenate([hashes.of(w) for w in self.words]) if n else np.empty(0, np.uint64)
        self.doc = np.repeat(np.arange(len(self.words)), self.counts)
        self.order = np.array([-1 if i is None else i for i in self.ids], np.int64)
        self.known = np.array([i is not None for i in self.ids], bool)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of windows that stay in a document with an id, and their hashes."""
        h = windows(self.hashes, width)
        at = np.flatnonzero((self.doc[:len(h)] == self.doc[width - 1:]) & self.known[self.doc[:len(h)]]) if len(h) else np.empty(0, int)
        return at, h[at]

    def others(self, at: np.ndarray, width: int) -> np.ndarray:
        """Second hashes of the windows that start there; only the documents that have one are hashed again."""
        out = np.empty(len(at), np.uint64)
        docs = self.doc[at]
        for d, s in by_bucket(docs, len(self.words)):
            out[s] = windows(self.second.of(self.words[d]), width, SECOND_MULTIPLIER)[at[s] - self.starts[d]]
        return out

    def anchors(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        at, h = self.windows(width - PERIOD + 1)
        on = np.isin((at - self.starts[self.doc[at]]) % PERIOD, COVER)
        return at[on], h[on]


def _new(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys begin to differ from those before."""
    return np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)] if len(keys[0]) else np.empty(0, bool)


def _first_of_each(h: np.ndarray, other: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of hashes, the smallest document of each, whether it has several documents."""
    order = np.lexsort((docs, other, h))
    h, other, docs = h[order], other[order], docs[order]
    first = _new(h, other)
    last = np.r_[first[1:], True] if len(h) else first
    return h[first], other[first], docs[first], docs[first] != docs[last]


def _asks(block: int, h: np.ndarray, other: np.ndarray, docs: np.ndarray, several: np.ndarray, buckets: int, whole: bool) -> pa.Table:
    """``whole``: with both hashes and the documents; else with 40 bits of the first hash."""
    bucket, key = split_hash(h, buckets)
    order = np.lexsort((h, docs, bucket) if whole else (key, bucket))
    bucket, key, h, other, docs, several = bucket[order], key[order], h[order], other[order], docs[order], several[order]
    out = {f.name: [] for f in ASKS}
    for b, s in by_bucket(bucket, buckets):
        values, counts = runs(docs[s]) if whole else (docs[:0], docs[:0])
        packed = pack128(h[s], other[s]) if whole else pack40(key[s])
        for name, x in (("bucket", b), ("block", block), ("hashes", packed), ("several", np.packbits(several[s]).tobytes()),
                        ("docs", values.astype("<i8").tobytes()), ("counts", counts.astype("<u4").tobytes())):
            out[name].append(x)
    return table(ASKS, **out)


def _hashes_of(data: bytes, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    if whole:
        return unpack128(data)
    h = unpack40(data)
    return h, np.zeros(len(h), np.uint64)


def _docs_of(row_docs: bytes, row_counts: bytes) -> np.ndarray:
    return np.repeat(np.frombuffer(row_docs, "<i8"), np.frombuffer(row_counts, "<u4"))


def _answers(asks: pa.Table, whole: bool) -> pa.Table:
    """To each block: its hashes that another document has too, with the smallest document of all."""
    rows = asks.to_pylist()
    keys = [_hashes_of(r["hashes"], whole) for r in rows]
    sizes = np.array([len(k) for k, _ in keys])
    key, other, source = np.concatenate([k for k, _ in keys]), np.concatenate([o for _, o in keys]), np.repeat(np.arange(len(rows)), sizes)
    several = np.concatenate([np.unpackbits(np.frombuffer(r["several"], "u1"), count=n) for r, n in zip(rows, sizes)]).astype(bool)
    docs = np.concatenate([_docs_of(r["docs"], r["counts"]) for r in rows]) if whole else np.zeros(len(key), np.int64)
    order = np.lexsort((docs, other, key))
    first = _new(key[order], other[order])
    group = np.cumsum(first) - 1
    shared = (np.bincount(group) > 1) | (np.bincount(group, several[order]) > 0)
    smallest = docs[order][first]
    meant = shared[group]
    if whole:  # nothing to tell a block whose only document with it is the smallest
        meant &= several[order] | (docs[order] > smallest[group])
    order, least = order[meant], smallest[group[meant]]
    order2 = np.lexsort((least, source[order]))
    order, least = order[order2], least[order2]
    out = {f.name: [] for f in ANSWERS}
    for i, s in by_bucket(source[order], len(rows)):
        values, counts = runs(least[s]) if whole else (least[:0], least[:0])
        packed = pack128(key[order[s]], other[order[s]]) if whole else pack40(key[order[s]])
        for name, x in (("block", rows[i]["block"]), ("bucket", rows[i]["bucket"]), ("hashes", packed),
                        ("docs", values.astype("<i8").tobytes()), ("counts", counts.astype("<u4").tobytes())):
            out[name].append(x)
    return table(ANSWERS, **out)


def _told(answers: pa.Table) -> np.ndarray:
    """Sorted keys (bucket and 40 bits) of anchors that another document has, too."""
    rows = answers.to_pylist()
    if not rows:
        return np.empty(0, np.uint64)
    return np.sort(np.concatenate([(np.uint64(r["bucket"]) << KEY_BITS) | unpack40(r["hashes"]) for r in rows]))


def _earliest(answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted pairs of hashes and the smallest document of each."""
    rows = answers.to_pylist()
    if not rows:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    keys = [unpack128(r["hashes"]) for r in rows]
    h, other = np.concatenate([k for k, _ in keys]), np.concatenate([o for _, o in keys])
    docs = np.concatenate([_docs_of(r["docs"], r["counts"]) for r in rows])
    order = np.lexsort((other, h))
    return h[order], other[order], docs[order]


def _key(h: np.ndarray, buckets: int) -> np.ndarray:
    bucket, key = split_hash(h, buckets)
    return (bucket.astype(np.uint64) << KEY_BITS) | key


def drop_repeated_passages(docs: DataFrame, width: int = 13, with_text: bool = False) -> DataFrame:
    """Per document the words, the words removed, the digest of the kept words and on request the kept text."""
    if width < 2 * PERIOD - 1:
        raise ValueError(f"a window of {2 * PERIOD - 1} words at least leaves anchors of {PERIOD} words")
    total = docs.select(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks, buckets = layout(total)
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("binary").alias("text"))

    def anchors(key: tuple[pa.Scalar, ...], table_: pa.Table) -> pa.Table:
        words = Words(table_)
        at, h = words.anchors(width)
        return _asks(key[0].as_py(), *_first_of_each(h, np.zeros(len(h), np.uint64), words.order[words.doc[at]]), buckets, False)

    def shared_anchors(key: tuple[pa.Scalar, ...], table_: pa.Table) -> pa.Table:
        return _answers(table_, False)

    def passages(key: tuple[pa.Scalar, ...], table_: pa.Table, answers: pa.Table) -> pa.Table:
        words = Words(table_)
        at, h = words.anchors(width)
        at = at[contains(_key(h, buckets), _told(answers))]
        starts = np.unique((at[:, None] - np.arange(PERIOD)[None, :]).ravel())
        all_at, all_h = words.windows(width)
        meant = contains(all_at, starts)
        all_at, all_h = all_at[meant], all_h[meant]
        block = key[0].as_py()
        others = words.others(all_at, width)
        return _asks(block, *_first_of_each(all_h, others, words.order[words.doc[all_at]]), buckets, True)

    def earliest(key: tuple[pa.Scalar, ...], table_: pa.Table) -> pa.Table:
        return _answers(table_, True)

    def removal(key: tuple[pa.Scalar, ...], table_: pa.Table, answers: pa.Table) -> pa.Table:
        words = Words(table_)
        known, known_others, least = _earliest(answers)
        at, h = words.windows(width)
        hit = np.flatnonzero(contains(h, known))
        place = place_of(h[hit], words.others(at[hit], width), known, known_others)
        hit, place = hit[place >= 0], place[place >= 0]
        hit = hit[least[place] < words.order[words.doc[at[hit]]]]
        edge = np.zeros(len(words.hashes) + 1, np.int64)
        np.add.at(edge, at[hit], 1)
        np.add.at(edge, at[hit] + width, -1)
        gone = np.cumsum(edge)[:-1] > 0
        removed = np.bincount(words.doc[gone], minlength=len(words.ids))
        kept = []
        for own, start, n, less in zip(words.words, words.starts, words.counts, removed):
            kept.append(b" ".join([w for w, g in zip(own, gone[start:start + n]) if not g] if less else own))
        return table(RESULT, doc_id=words.ids, n_words=words.counts, n_removed=removed,
                     kept_sha256=[hashlib.sha256(k).hexdigest() for k in kept],
                     kept_text=[k.decode("utf-8", "replace") if with_text else None for k in kept])

    def to(rows: DataFrame, key: str) -> DataFrame:
        return rows.repartition(tasks(total, blocks if key == "block" else buckets), key)

    by_block = to(dealt, "block").groupBy("block")
    asked = to(by_block.applyInArrow(anchors, ASKS_SQL), "bucket")
    told = to(asked.groupBy("bucket").applyInArrow(shared_anchors, ANSWERS_SQL), "block")
    asked = to(by_block.cogroup(told.groupBy("block")).applyInArrow(passages, ASKS_SQL), "bucket")
    told = to(asked.groupBy("bucket").applyInArrow(earliest, ANSWERS_SQL), "block")
    return by_block.cogroup(told.groupBy("block")).applyInArrow(removal, RESULT_SQL)
