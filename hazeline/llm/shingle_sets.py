"""Word-shingle sets of documents, and what they share: the first half of the n-gram Jaccard join.

Documents with equal sets form a class. Each class's shingles go, packed, to hash buckets; a bucket counts in how many classes each
shingle stands and answers every class with its shared ones. A shingle of one class only can't be common to two sets, so it matters
by its number alone, and a class whose shared shingles are fewer than the least overlap can have no partner: it ends here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.blobs import by_bucket, layout, pack40, runs, split_hash, table, tasks, unpack40
from hazeline.llm.common import ASCII_LOWER, drop_stores, mix, rows_of, text_of, windows, word_hashes

SETS_SQL = "doc_id long, class long, n_shingles long"
SENT_SQL = "bucket long, source long, classes binary, counts binary, hashes binary"
SHARED = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("classes", pa.binary()), ("counts", pa.binary()),
                    ("hashes", pa.binary()), ("spread", pa.binary())])
SHARED_SQL = "block long, bucket long, classes binary, counts binary, hashes binary, spread binary"
KEY_BITS = np.uint64(40)
#: Text whose sets are only sized, made at once; sent ones are packed by blocks as large as may be.
SETS_BYTES = 1 << 20
#: A class's shared shingles in global order: fewest classes first, then by hash.
LIVE = pa.schema([("class", pa.int64()), ("n", pa.int64()), ("central", pa.int64()), ("shingles", pa.list_(pa.int64())),
                  ("spread", pa.list_(pa.int32()))])
LIVE_SQL = "class long, n long, central long, shingles array<long>, spread array<int>"

def sets_of(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document numbers and shingles of all distinct (document, shingle); per document the set's digest and size."""
    drop_stores()
    hashed = [word_hashes((t or b"").translate(ASCII_LOWER).split()) for t in texts]
    counts = np.fromiter(map(len, hashed), np.int64, len(hashed))
    doc = np.repeat(np.arange(len(hashed)), counts)
    h = np.concatenate(hashed) if len(doc) else np.empty(0, np.uint64)
    del hashed
    full = windows(h, width)
    inside = doc[:len(full)] == doc[width - 1:] if len(full) else np.empty(0, bool)
    parts, owners = [full[inside]], [doc[:len(full)][inside]]
    starts = np.cumsum(counts) - counts
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        parts.append(windows(h[starts[d]:starts[d] + counts[d]], int(counts[d])))
        owners.append(np.array([d]))
    h, doc = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        first = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
        h, doc = h[first], doc[first]
    sizes = np.bincount(doc, minlength=len(texts))
    digest = np.zeros(len(texts), np.uint64)
    if len(h):
        some = np.flatnonzero(sizes)
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mix(h ^ np.uint64(0xA0761D6478BD642F)), (np.cumsum(sizes) - sizes)[some])
            digest[some] = mix(sums ^ (sizes[some].astype(np.uint64) << np.uint64(40)))
    return doc, h, digest.view(np.int64), sizes


def document_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """Class and size of every document's set; the class of an empty set is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, SETS_BYTES):
            _, _, digest, sizes = sets_of([t.as_py() for t in batch.column("text")], width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(digest, mask=sizes == 0), pa.array(sizes, pa.int64())],
                names=["doc_id", "class", "n_shingles"])

    return text_of(docs).mapInArrow(run, SETS_SQL)


def live_classes(docs: DataFrame, classes: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """Classes (of ``classes``: class, n) whose shared shingles reach the least overlap, with those in global order.

    ``central`` grows with the number of classes that share a class's shingles.
    """
    total = docs.select(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks, buckets = layout(total)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = TaskContext.get().partitionId() << 32
        for batch in rows_of(batches):
            doc, h, digest, sizes = sets_of([t.as_py() for t in batch.column("text")], width)
            own, first = np.unique(digest, return_index=True)
            keep = np.zeros(len(digest), bool)
            keep[first] = True
            keep &= sizes > 0
            meant = keep[doc]
            bucket, key = split_hash(h[meant], buckets)
            owner = digest[doc[meant]]
            order = np.lexsort((owner, bucket))
            bucket, key, owner = bucket[order], key[order], owner[order]
            out = {"bucket": [], "source": [], "classes": [], "counts": [], "hashes": []}
            for b, s in by_bucket(bucket, buckets):
                values, counts = runs(owner[s])
                for name, x in (("bucket", b), ("source", source), ("classes", values.astype("<i8").tobytes()),
                                ("counts", counts.astype("<u4").tobytes()), ("hashes", pack40(key[s]))):
                    out[name].append(x)
            source += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[k], t) for k, t in (("bucket", pa.int64()), ("source", pa.int64()), ("classes", pa.binary()),
                                                  ("counts", pa.binary()), ("hashes", pa.binary()))], names=list(out))

    def share(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
        rows = sent.to_pylist()
        h = np.concatenate([unpack40(r["hashes"]) for r in rows])
        owner = np.concatenate([np.repeat(np.frombuffer(r["classes"], "<i8"), np.frombuffer(r["counts"], "<u4")) for r in rows])
        order = np.lexsort((owner, h))
        h, owner = h[order], owner[order]
        first = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]  # copies elsewhere send the same
        h, owner = h[first], owner[first]
        group = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1
        spread = np.bincount(group)[group]
        several = spread > 1
        h, owner, spread = h[several], owner[several], spread[several]
        block = owner % blocks
        order = np.lexsort((owner, block))
        h, owner, spread, block = h[order], owner[order], spread[order], block[order]
        out = {f.name: [] for f in SHARED}
        for b, s in by_bucket(block, blocks):
            values, counts = runs(owner[s])
            for name, x in (("block", b), ("bucket", key[0].as_py()), ("classes", values.astype("<i8").tobytes()),
                            ("counts", counts.astype("<u4").tobytes()), ("hashes", pack40(h[s])),
                            ("spread", spread[s].astype("<u4").tobytes())):
                out[name].append(x)
        return table(SHARED, **out)

    def gather(key: tuple[pa.Scalar, ...], known: pa.Table, shared: pa.Table) -> pa.Table:
        rows = shared.to_pylist()
        out = {f.name: [] for f in LIVE}
        if rows:
            h = np.concatenate([(np.uint64(r["bucket"]) << KEY_BITS) | unpack40(r["hashes"]) for r in rows])
            owner = np.concatenate([np.repeat(np.frombuffer(r["classes"], "<i8"), np.frombuffer(r["counts"], "<u4")) for r in rows])
            spread = np.concatenate([np.frombuffer(r["spread"], "<u4") for r in rows])
            order = np.lexsort((h, spread, owner))
            h, owner, spread = h[order].view(np.int64), owner[order], spread[order]
            size = dict(zip(known.column("class").to_pylist(), known.column("n").to_pylist()))
            values, counts = runs(owner)
            ends = np.cumsum(counts)
            for c, a, b in zip(values.tolist(), (ends - counts).tolist(), ends.tolist()):
                if 100 * (b - a) >= percent * size[c]:
                    for name, x in (("class", c), ("n", size[c]), ("shingles", h[a:b]), ("spread", spread[a:b].astype(np.int32)),
                                    ("central", int(1e6 * np.log(spread[a:b]).sum() / size[c]))):
                        out[name].append(x)
        return table(LIVE, **out)

    sent = text_of(docs).mapInArrow(send, SENT_SQL).repartition(tasks(total, buckets), "bucket")
    shared = sent.groupBy("bucket").applyInArrow(share, SHARED_SQL).repartition(tasks(total, blocks), "block")
    dealt = classes.select(F.pmod("class", F.lit(blocks)).alias("block"), "class", "n").repartition(tasks(total, blocks), "block")
    return dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(gather, LIVE_SQL)
