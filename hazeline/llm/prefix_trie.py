"""Trie of conversation prefixes: how many conversations begin alike, and how many tokens a shared prefix saves.

A turn's id is the 128-bit digest of its role and text; a conversation is the sequence of its turns' ids. Sequences are put into one
global order and dealt to range shards. A shard numbers its ids, fills padded matrices of turn ids (rows are conversations, columns
depths, short rows padded in front of all ids) and sorts their rows with a lexical sort. Two neighbouring rows differ at some
columns; the mask of these changes, OR-accumulated along the row, marks every depth at which the later row starts a new node. The runs
between starts are the nodes of a depth, and ``reduceat`` aggregates them, depth by depth. Matrices are cut into blocks of ``COLUMNS``
depths that hold the rows which reach that deep, so a long conversation does not pad the short ones.

A shard also gets the last sequence before it and the first one behind it. So it knows which nodes start in it, which rows end a leaf
and which prefixes are counted already: all sums of a node that spans shards (the root does, always) are plain sums over its shards.
Only such boundary nodes are recombined; all others leave their shard complete. Members that end at a boundary node are hashed in
order, as a stream of the shards' pieces.

Scale: one shuffle of texts is avoided, as only ids (16 bytes a turn) and word counts leave the scan. A conversation's ids are in one
task's memory. Copies of one conversation, however many, spread over shards: the order goes on by conv_id.

Edge cases: turns come in order of ``turn`` (null first), those of equal ``turn`` by their id, so rows that repeat a turn count as
turns of their own; a null role or text is empty; rows without a conv_id belong to no conversation; an empty table has no node; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import written

#: Depths of one padded matrix.
COLUMNS = 32
#: A shard has about this many turns; the larger bound is reached by the largest tables.
LEAST_SHARD, MOST_SHARD = 4096, 1 << 20
ID_BYTES = 16
NOTHING = hashlib.sha256(b"").hexdigest()
WORD = "[^\\x20\\x09-\\x0D]+"
SEQUENCES_SQL = "conv_id long, path binary, words binary"
NODES = pa.schema([
    ("key", pa.binary()), ("parent_key", pa.binary()), ("shard", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("ends", pa.string())])
NODES_SQL = ("key binary, parent_key binary, shard long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
             "n_leaves long, saved_tokens long, ends_sha256 string, ends string")
SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
RESULT = ("conv_id", "depth", "parent_conv_id", *SUMS, "ends_sha256")


def turn_ids(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``ids`` and ``words``: the turns of each conversation in order."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn"), F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("id"),
                 F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("turn"))
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return ordered.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.words").alias("words"))


def with_shared_starts(sequences: DataFrame, every: int, most: int) -> DataFrame:
    """Conversation c begins with the first h turns of conversation c - c % every, h being crc32(c) % (most + 1), and goes on with its
    own turns behind its first h."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    own = sequences.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % every})
    base = sequences.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("ids", 1, most).alias("base_ids"), F.slice("words", 1, most).alias("base_words"))
    joined = own.join(base, "base", "left")

    def rebuilt(name: str):
        begun = F.coalesce(F.slice("base_" + name, F.lit(1), F.col("h")), F.slice(name, 1, 0))
        return F.concat(begun, F.slice(name, F.col("h") + 1, F.size(name))).alias(name)

    return joined.select("conv_id", rebuilt("ids"), rebuilt("words"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = []
        for name, width in (("ids", ID_BYTES), ("words", 8)):
            lists = batch.column(name)
            values = lists.flatten()
            flat = b"".join(values.to_pylist()) if name == "ids" else values.to_numpy(zero_copy_only=False).astype("<i8").tobytes()
            ends = np.cumsum(np.r_[0, lists.value_lengths().to_numpy(zero_copy_only=False)]) * width
            columns.append(pa.array([flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], names=["conv_id", "path", "words"])


def range_shards(sequences: DataFrame) -> DataFrame:
    """Sequences in global order, each with the number of its shard, written once."""
    packed = written(sequences.mapInArrow(_packed, SEQUENCES_SQL), "sequences")
    turns = packed.select((F.sum(F.octet_length("path")) / ID_BYTES + F.count("*")).alias("n")).first().n or 0
    shards = max(1, math.ceil(turns / min(max(LEAST_SHARD, 8 * math.isqrt(int(turns))), MOST_SHARD)))
    dealt = packed.repartitionByRange(shards, "path", "conv_id").withColumn("shard", F.spark_partition_id().cast("long"))
    return written(dealt, "shards")


def edges(shards: DataFrame) -> DataFrame:
    """Per shard: the last sequence before it and the first one behind it (null at the ends). Only shard numbers reach the driver."""
    spark = shards.sparkSession
    own = written(shards.groupBy("shard").agg(F.min("path").alias("low"), F.max("path").alias("high")), "edges")
    numbers = sorted(r.shard for r in own.select("shard").collect())
    around = spark.createDataFrame(list(zip(numbers, [None, *numbers[:-1]], [*numbers[1:], None])), "shard long, past long, next long")
    return (around.join(own.select(F.col("shard").alias("past"), F.col("high").alias("before")), "past", "left")
            .join(own.select(F.col("shard").alias("next"), F.col("low").alias("after")), "next", "left").select("shard", "before", "after"))


def numbered(ids: bytes) -> np.ndarray:
    """Ids by their rank among the different ones."""
    high, low = np.frombuffer(ids, ">u8").astype(np.uint64).reshape(-1, 2).T
    order = np.lexsort((low, high))
    new = np.r_[True, (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])] if len(order) else np.empty(0, bool)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank


def padded(rank: np.ndarray, starts: np.ndarray, sizes: np.ndarray, depth: int) -> np.ndarray:
    """Matrix of the ids at ``depth`` and the depths behind it, -1 where a row has ended."""
    at = starts[:, None] + depth + np.arange(COLUMNS)
    inside = depth + np.arange(COLUMNS) < sizes[:, None]
    return np.where(inside, rank[np.where(inside, at, 0)], -1)


def in_order(rank: np.ndarray, starts: np.ndarray, sizes: np.ndarray, conv: np.ndarray) -> np.ndarray:
    """Rows by their ids, then by conversation: blocks of columns from the deepest to the first, each sorted stably."""
    order = np.argsort(conv, kind="stable")
    for depth in range((int(sizes.max()) - 1) // COLUMNS * COLUMNS if len(sizes) and sizes.max() else -1, -1, -COLUMNS):
        deep = sizes[order] > depth
        rows = order[deep]
        matrix = padded(rank, starts[rows], sizes[rows], depth)
        order = np.r_[order[~deep], rows[np.lexsort(matrix.T[::-1])]]
    return order


def common_starts(rank: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each row, the number of first ids that it shares with the row before it (0 for the first row)."""
    shared = np.zeros(len(sizes), np.int64)
    rows = np.arange(1, len(sizes))
    depth = 0
    while True:
        rows = rows[(shared[rows] == depth) & (sizes[rows] > depth) & (sizes[rows - 1] > depth)]
        if not len(rows):
            return shared
        here = padded(rank, starts[rows], sizes[rows], depth)
        changed = np.logical_or.accumulate((here != padded(rank, starts[rows - 1], sizes[rows - 1], depth)) | (here < 0), axis=1)
        shared[rows] += (~changed).sum(axis=1)
        depth += COLUMNS


def shared_ids(a: bytes, b: bytes) -> int:
    """Number of first ids that two sequences share."""
    n = min(len(a), len(b)) // ID_BYTES
    same = (np.frombuffer(a, np.uint8, n * ID_BYTES) == np.frombuffer(b, np.uint8, n * ID_BYTES)).reshape(n, ID_BYTES).all(axis=1)
    return n if same.all() else int(np.argmin(same))


def shard_nodes(shard: int, paths: list[bytes], words: list[bytes], conv: np.ndarray, before: bytes | None, after: bytes | None) -> pa.Table:
    """Nodes of one shard; those that go on in a neighbouring shard have a ``key`` and hold this shard's part of their sums."""
    sizes = np.fromiter(map(len, paths), np.int64, len(paths)) // ID_BYTES
    starts = np.cumsum(sizes) - sizes
    rank, flat = numbered(b"".join(paths)), np.frombuffer(b"".join(words), "<i8")
    upto = np.r_[0, np.cumsum(flat)]
    order = in_order(rank, starts, sizes, conv)
    sizes, starts, conv = sizes[order], starts[order], conv[order]
    last = len(order) - 1
    within = common_starts(rank, starts, sizes)
    shared = within.copy()  # with the row before it, be that in this shard or another
    shared[0] = -1 if before is None else shared_ids(before, paths[order[0]])
    behind = np.r_[within[1:], -1 if after is None else shared_ids(paths[order[last]], after)]
    leaf = behind < sizes
    counted = upto[starts + np.maximum(shared, 0)]  # words of the turns that this row shares with the row before it

    out = {name: [] for name in NODES.names}
    rows, parent_of = np.arange(len(order)), np.full(len(order), -1)
    parents: tuple[np.ndarray, list[bytes | None]] = (np.empty(0, np.int64), [])
    for depth in range(int(sizes.max()) + 1):
        rows = rows[sizes[rows] >= depth]
        new = within[rows] < depth
        new[0] |= depth == 0 or rows[0] == 0
        at = np.flatnonzero(new)
        n = np.diff(np.r_[at, len(rows)])
        low = np.minimum.reduceat(conv[rows], at)
        ending = sizes[rows] == depth
        saved = np.where(shared[rows] >= depth, counted[rows] - upto[starts[rows] + max(depth - 1, 0)], 0)
        sums = (n, np.add.reduceat(((shared[rows] <= depth) & ~ending).astype(np.int64), at),
                np.add.reduceat(leaf[rows].astype(np.int64), at), np.add.reduceat(saved, at))
        keys: list[bytes | None] = [None] * len(at)
        split = ([0] if rows[0] == 0 and shared[0] >= depth else []) + ([len(at) - 1] if rows[-1] == last and behind[last] >= depth else [])
        for k in split:
            keys[k] = xxhash.xxh3_128_digest(paths[order[rows[at[k]]]][:ID_BYTES * depth])
        ends = [""] * len(at)
        for k in np.flatnonzero(np.add.reduceat(ending.astype(np.int64), at)).tolist():
            mine = rows[at[k]:at[k] + n[k]]
            ends[k] = ",".join(map(str, conv[mine[sizes[mine] == depth]].tolist()))
        up = parent_of[rows[at]]
        out["key"] += keys
        out["parent_key"] += [parents[1][p] if p >= 0 else None for p in up.tolist()]
        out["parent_conv_id"] += [int(parents[0][p]) if p >= 0 and parents[1][p] is None else None for p in up.tolist()]
        out["conv_id"] += low.tolist()
        out["depth"] += [depth] * len(at)
        for name, values in zip(SUMS, sums):
            out[name] += values.tolist()
        out["ends"] += [e if k is not None else None for e, k in zip(ends, keys)]
        out["ends_sha256"] += [None if k is not None else hashlib.sha256(e.encode()).hexdigest() if e else NOTHING for e, k in zip(ends, keys)]
        parent_of[rows] = np.cumsum(new) - 1
        parents = (low, keys)
    out["shard"] = [shard] * len(out["key"])
    return pa.table({f.name: pa.array(out[f.name], f.type) for f in NODES}, schema=NODES)


def _of_group(key: tuple[pa.Scalar, ...], rows: pa.Table, around: pa.Table) -> pa.Table:
    if not rows.num_rows:
        return NODES.empty_table()
    edge = around.to_pylist()[0]
    return shard_nodes(key[0].as_py(), rows.column("path").to_pylist(), rows.column("words").to_pylist(),
                       rows.column("conv_id").to_numpy(), edge["before"], edge["after"])


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each key's pieces, which come in order: only the state of one digest is held."""
    key, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    for batch in batches:
        for k, piece in zip(batch.column("key"), batch.column("ends")):
            if k.as_py() != key:
                if state is not None:
                    yield done()
                key, state = k.as_py(), hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.as_buffer())
    if state is not None:
        yield done()


def recombined(parts: DataFrame) -> DataFrame:
    """Boundary nodes from their parts."""
    sums = parts.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.first("parent_key").alias("parent_key"),
                                    *[F.sum(c).alias(c) for c in SUMS])
    pieces = parts.where("ends <> ''").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard")
    digests = pieces.select("key", "ends").mapInArrow(_hash_pieces, "key binary, ends_sha256 string")
    return sums.join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))


def prefix_trie(conversations: DataFrame, every: int = 0, most: int = 0) -> DataFrame:
    """One row per node: its smallest member and depth, that of its parent, members, children, leaves below it, the tokens its subtree
    saves when every prefix is kept once, and the digest of the members that end there.

    With ``every`` and ``most`` conversations first take over the start of another one (``with_shared_starts``).
    """
    sequences = turn_ids(conversations)
    if every:
        sequences = with_shared_starts(written(sequences, "turn-ids"), every, most)
    shards = range_shards(sequences)
    nodes = written(shards.groupBy("shard").cogroup(edges(shards).groupBy("shard")).applyInArrow(_of_group, NODES_SQL), "nodes")
    boundary = written(recombined(nodes.where("key IS NOT NULL")), "boundary-nodes")
    whole = nodes.where("key IS NULL")
    parents = boundary.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    below = whole.where("parent_key IS NOT NULL").select("parent_key", *[c for c in RESULT if c != "parent_conv_id"]).unionByName(
        boundary.select("parent_key", *[c for c in RESULT if c != "parent_conv_id"]))
    below = below.join(parents, "parent_key", "left").withColumnRenamed("parent", "parent_conv_id")
    return whole.where("parent_key IS NULL").select(*RESULT).unionByName(below.select(*RESULT))
