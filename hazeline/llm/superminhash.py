"""Near-duplicate groups by SuperMinHash: signatures, banding, verification on full sets, union-find.

A shingle's own random numbers deal it a random order of the signature's places: at step j it takes the j-th place of its order with the
value j plus a fraction. A place keeps the smallest value. So the values of one shingle exclude each other, which makes
the estimate vary less than independent minima do, and a text can stop as soon as all places hold values below the next step: a text
of many shingles needs few steps. Here all shingles of a batch of texts take each step together, and only those of texts with places still
open take the next.

Signatures are cut into bands; sets that agree in a band are candidates. With 32 bands of 4 values a pair at the threshold of 0.8 is
missed with probability (1 - 0.8^4)^32 = 5e-8. Candidates' sets are compared with each other as a whole first: a shingle of one set only is in
no intersection, so each set's shared shingles say how large a partner can be, and most sets that only resemble others allow none.
Every pair that could join two groups is confirmed on the sets. Pairs are not formed within a band's list: its most central member meets
the others first, and the linked ones become groups (union-find). Lists that still hold several groups are gone through in blocks: a
task holds a block's sets, or those of two blocks, lets one after the other meet the members of other groups, and returns only the links
that join groups, fewer than members.

Scale: texts are scanned once for signatures and once more for those whose set shares a band; a broadcast field of bits (32 MB at most)
keeps nearly all others out of that shuffle. Equal sets are one class, so copies never meet. Lists and joins hold 8-byte numbers; a hot
list is joined, never collected.

Edge cases: null or empty text has no shingles, links with nothing and is its own group; a text of fewer words than ``width`` is one
shingle; a group's id is its smallest doc_id (null if it has none) and the rows with that doc_id are kept; rows that repeat a doc_id
stand each for themselves; an empty table gives no rows; other columns are ignored. Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import mix, rows_of, text_of, written
from hazeline.llm.components import components
from hazeline.llm.shingle_sets import live_classes, sets_of

PLACES, BAND_ROWS = 128, 4
#: From this step on a shingle's order is kept as a whole; before, only its few exchanges are.
WHOLE_ORDER_FROM = 6
#: Text whose signatures are made at once: from step ``WHOLE_ORDER_FROM`` on each open shingle holds an order of all places.
SIGNED_BYTES = 1 << 20
#: Shingles of a block of a list: what one task holds of it, once or twice.
BLOCK_SHINGLES = 1 << 20
#: Bits of the sieve of texts for each chosen one, the bits of its pages, and how many there are at most.
SIEVE_BITS, PAGE_BITS, MOST_SIEVE_BITS = 16, 1 << 15, 1 << 28
#: Nodes of a task's union-find before it hands over what it has.
MOST_NODES = 1_000_000
FRACTION = np.uint64(32)
STEP = np.uint64(0x9E3779B97F4A7C15)
SETS_SQL = "doc_id long, class long, n_shingles long, text_hash long, bands binary"


def _draw(h: np.ndarray, step: int, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Fraction and exchanged place of each shingle at a step."""
    with np.errstate(over="ignore"):
        x = mix(h + np.uint64(step + 1) * STEP)
    left = np.uint64(places - step)
    return x >> FRACTION, (step + (((x & np.uint64(0xFFFFFFFF)) * left) >> FRACTION).astype(np.int64))


def signatures(doc: np.ndarray, h: np.ndarray, docs: int, places: int = PLACES) -> np.ndarray:
    """Signatures of ``docs`` sets, given as (document, shingle): per place the smallest step, in the high half, and fraction.

    Documents without a shingle keep the largest value everywhere.
    """
    out = np.full(docs * places, np.iinfo(np.uint64).max)
    grid = out.reshape(docs, places)
    exchanged: list[tuple[np.ndarray, np.ndarray]] = []  # per step: place k, and what has been put there
    order = None

    def at(place: np.ndarray) -> np.ndarray:
        """What stands at a place of each shingle's order after the exchanges so far."""
        value = place.copy()
        for k, put in exchanged:  # a later exchange of the same place overrides
            same = k == place
            value[same] = put[same]
        return value

    for step in range(places):
        if not len(doc):
            break
        fraction, k = _draw(h, step, places)
        if step < WHOLE_ORDER_FROM:
            taken, put = at(k), at(np.full(len(k), step))
            exchanged.append((k, put))
        else:
            if order is None:
                order = np.tile(np.arange(places, dtype=np.int16), (len(doc), 1))
                for s, (earlier, put) in enumerate(exchanged):
                    order[np.arange(len(doc)), earlier] = put
            rows = np.arange(len(doc))
            taken = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, step]
        np.minimum.at(out, doc * places + taken, (np.uint64(step) << FRACTION) | fraction)
        # A text whose places are all below the next step is done.
        open_docs = (grid.max(axis=1) >> FRACTION) > step
        go_on = open_docs[doc]
        doc, h = doc[go_on], h[go_on]
        exchanged = [(a[go_on], b[go_on]) for a, b in exchanged]
        order = order[go_on] if order is not None else None
    return grid


def band_keys(signature: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit number per band, different for each band."""
    bands = signature.reshape(len(signature), -1, rows)
    with np.errstate(over="ignore"):
        key = np.arange(1, bands.shape[1] + 1, dtype=np.uint64) * STEP + np.zeros((len(signature), 1), np.uint64)
        for r in range(rows):
            key = mix((key ^ bands[:, :, r]) * STEP)
    return key


def document_signatures(docs: DataFrame, width: int) -> DataFrame:
    """Class (null for an empty set), size and band keys of each document; in a batch only the first of a class has keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, SIGNED_BYTES):
            doc, h, digest, sizes = sets_of([t.as_py() for t in batch.column("text")], width)
            first = np.zeros(len(digest), bool)
            first[np.unique(digest, return_index=True)[1]] = True
            first &= sizes > 0
            number = np.cumsum(first) - 1
            meant = first[doc]
            keys = band_keys(signatures(number[doc[meant]], h[meant], int(first.sum())))
            bands = [keys[number[i]].tobytes() if f else None for i, f in enumerate(first)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(digest, mask=sizes == 0), pa.array(sizes, pa.int64()),
                 batch.column("text_hash"), pa.array(bands, pa.binary())], names=["doc_id", "class", "n_shingles", "text_hash", "bands"])

    return text_of(docs, F.xxhash64("text").alias("text_hash")).mapInArrow(run, SETS_SQL)


def band_entries(classes: DataFrame) -> DataFrame:
    """``key``, ``class``: a row for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(b.as_buffer(), np.int64) for b in batch.column("bands")]
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(np.repeat(batch.column("class").to_numpy(), [len(k) for k in keys]))],
                    names=["key", "class"])

    return classes.select("class", "bands").mapInArrow(run, "key long, class long")


def sieved(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text's hash may be in ``hashes`` (rep_hash): all that are, few others. The more bits are taken, the more others."""
    pages = max(1, min(SIEVE_BITS * hashes.count(), MOST_SIEVE_BITS) // PAGE_BITS)

    def place(h: F.Column) -> tuple[F.Column, F.Column]:
        return F.pmod(F.shiftright(h, 15), F.lit(pages)), h.bitwiseAND(F.lit(PAGE_BITS - 1))

    page, bit = place(F.col("rep_hash"))
    field = hashes.groupBy(page.alias("page")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    page, bit = place(F.xxhash64("text"))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return docs.join(F.broadcast(field), page == F.col("page")).where(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1).drop("page", "bits")


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One text of each class of ``chosen`` (rep: doc_id and text_hash, no two alike); rows that repeat it come along."""
    reps = chosen.select(F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"))
    # An inner join: the optimizer would move a semi-join below the sieve.
    return sieved(docs.select("doc_id", "text"), reps.select("rep_hash")).join(
        reps, (F.xxhash64("text") == F.col("rep_hash")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("doc_id", "text")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold. A shingle of one class only is in no intersection, so ``sets`` holds each
    class's full size and those of its shingles that other classes have."""
    own, other = (sets.select(F.col("class").alias(x), F.col("shingles").alias("of_" + x), F.col("n").alias("n_" + x)) for x in ("a", "b"))
    both = pairs.join(own, "a").join(other, "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def can_meet(a: str, b: str) -> F.Column:
    """Each set allows a partner of the other's size."""
    return (F.col(f"{a}.n") <= F.col(f"{b}.upto")) & (F.col(f"{b}.n") <= F.col(f"{a}.upto"))


def union_find(links: DataFrame) -> DataFrame:
    """Links (a, b) replaced by the trees of each task's own union-find: every node with its root, no cycle left within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while up.setdefault(top, top) != top:
                top = up[top]
            while up[x] != top:
                up[x], x = top, up[x]
            return top

        def trees() -> pa.RecordBatch:
            edges = [(root(x), x) for x in list(up)]
            edges = [(a, b) for a, b in edges if a != b]
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())],
                                              names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if len(up) > MOST_NODES:
                yield trees()
        yield trees()

    return links.mapInArrow(run, "a long, b long")


def links_in_list(rows: list[int], other: list[bool] | None, sets: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links (a, b) between classes of one list that join two of its groups: each row in turn, the most central first, meets those rows of
    other groups that it has not met. With ``other``, only rows of different sides meet."""
    n, upto, label, classes = (sets.column(c).to_numpy() for c in ("n", "upto", "label", "class"))
    lists = sets.column("shingles").combine_chunks()
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    vocabulary, codes = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    group = np.unique(label, return_inverse=True)[1]
    unmet, marked, out = np.ones(len(n), bool), np.zeros(len(vocabulary), bool), []
    side = np.array(other) if other is not None else None
    for r in rows:
        unmet[r] = False
        meant = unmet & (group != group[r]) & (n <= upto[r]) & (n[r] <= upto)
        if side is not None:
            meant &= side != side[r]
        if not meant.any():
            continue
        own = codes[ends[r]:ends[r + 1]]
        marked[own] = True
        common = np.r_[0, np.cumsum(marked[codes])][ends]
        marked[own] = False
        common = common[1:] - common[:-1]
        for x in np.flatnonzero(meant & (100 * common >= percent * (n + n[r] - common))).tolist():
            if group[x] != group[r]:
                out.append((int(classes[r]), int(classes[x])))
                group[group == group[x]] = group[r]
        if (group == group[0]).all():
            break
    return out


def links_within(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join groups within each list of ``open_`` (key, class, n, upto, central, label).

    A list is cut into blocks of about ``BLOCK_SHINGLES``; each task has one block, or two that meet, and returns at most one link per member.
    """
    parts = F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("long")
    sizes = open_.groupBy("key").agg(parts.alias("parts"))
    dealt = open_.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("class"), F.col("parts")))
    meeting = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(
        F.least("block", x).alias("low"), F.greatest("block", x).alias("high"))))
    dealt = dealt.withColumn("meeting", meeting).select("key", "meeting.*", "block", "class", "n", "upto", "central", "label")

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = np.argsort(-table.column("central").to_numpy(), kind="stable").tolist()
        other = [b == key[2].as_py() for b in table.column("block").to_pylist()] if key[1] != key[2] else None
        found = links_in_list(order, other, table, percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return dealt.join(sets.select("class", "shingles"), "class").groupBy("key", "low", "high").applyInArrow(meet, "a long, b long")


def links_between(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Labels (node, label) of all classes that links connect. ``entries``: key, class, n, upto, central (a written table)."""
    centre = entries.groupBy("key").agg(F.max(F.struct("central", "class", "n", "upto")).alias("c")).select("key", "c.*")
    met = entries.alias("x").join(centre.alias("c"), "key").where((F.col("x.class") != F.col("c.class")) & can_meet("x", "c"))
    pairs = met.select(F.col("c.class").alias("a"), F.col("x.class").alias("b")).distinct()
    links = written(union_find(confirmed(pairs, sets, percent)), "links")
    labels = components(links)
    # The centre has met all others of its list; lists whose members are all in one group are done.
    left = entries.join(centre.select("key", F.col("class").alias("met")), "key").where("class <> met").drop("met")
    left = left.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    lists = left.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    open_ = written(left.join(lists, "key", "left_semi"), "open-entries")
    return components(links.unionByName(union_find(links_within(open_, sets, percent))))


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """Per document: set size, group (its smallest doc_id) and whether it is the one of its group that is kept."""
    signed = written(document_signatures(docs, width), "signatures")
    some = signed.where("class IS NOT NULL")
    classes = written(some.groupBy("class").agg(
        F.first("n_shingles").alias("n"), F.min("doc_id").alias("copy_of"), F.min(F.struct("doc_id", "text_hash")).alias("rep"),
        F.first("bands", ignorenulls=True).alias("bands")), "classes")
    entries = band_entries(classes)
    lists = entries.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    shared = written(entries.join(lists, "key"), "shared-bands")
    candidates = classes.join(shared.select("class").distinct(), "class", "left_semi").select("class", "n", "rep")
    candidates = written(candidates, "candidates")
    # Of the candidates' sets only what several of them have can be common; who has too little of that has no partner.
    texts = written(texts_of(docs, candidates), "candidate-texts")
    live = written(live_classes(texts, candidates.select("class", "n"), width, percent), "shared-shingles")
    # With s shared shingles a set of n allows partners of m shingles where s / (n + m - s) can reach the threshold.
    upto = F.floor(F.size("shingles") * (100 + percent) / percent).cast("long") - F.col("n")
    at = shared.join(live.select("class", "n", upto.alias("upto"), "central"), "class").where(100 * F.col("upto") >= percent * F.col("n"))
    labels = links_between(written(at, "entries"), live.select("class", "n", "shingles"), percent)
    named = classes.select("class", "copy_of").join(labels.withColumnRenamed("node", "class"), "class", "left")
    named = named.withColumn("label", F.coalesce("label", "class"))
    smallest = named.groupBy("label").agg(F.min("copy_of").alias("component_id"))
    named = named.join(smallest, "label").select("class", "component_id")
    grouped = some.join(named, "class").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("class IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
