"""Hard-negative mining with an inverted multi-index.

Vectors are scaled to integers and cut in two halves. Each half-space has a codebook, fitted on a bounded sample; a row's two nearest
codewords name its cell. The query q = (q1, q2) can score at most q1*c1 + |q1|*r1 + q2*c2 + |q2|*r2 in cell (c1, c2), where r1 and r2 are
the radii of the codewords: the farthest half of any row given to them. So each half has a list of bounds, sorted, and a heap walks
the cells by falling sums of the two (multi-sequence order). A cell is scored row by row, exactly; the walk ends when what is
asked for is certified: no cell left can hold a row that would enter.

An anchor asks twice: for its best rows of the same label (the positives), then, per positive, for the best rows of other labels within
the window that the positive's score spans. Each question runs in two rounds. In the first, the anchor searches the shard that holds
its own row; what it finds there bounds the answer from below. In the second, it is sent to those shards only whose cells can
still beat that bound. The answer is exact whatever the codebooks are; they only decide how much is skipped.

Scale: an anchor is never paired with rows in a table: a task holds one shard of the index (bounded in rows and bytes; a cell
with many rows is dealt over several shards) and one block of anchors (bounded, too), and returns at most the asked number of rows
per window. The driver sees the sample, the codebooks and one count per cell, whose number is bounded.

Edge cases: rows without a label or vector, or with a null or non-finite component, take no part; vectors of different lengths score as if
the shorter ones went on with zeros; scaled components beyond 2^25 count as 2^25, so scores fit 64 bits up to 8,192 components; rows that repeat a vec_id
stand each for themselves, but are no positive of an anchor of that vec_id; a row without a vec_id comes last among ties and is no
anchor; an empty table has no negatives; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeline.llm.common import written

#: The codebooks are fitted on at most this many rows, those of the smallest hashes.
SAMPLE_ROWS = 4096
FIT_ROUNDS = 8
#: Codewords of a half: about the fourth root of the rows, so that cells are about as many as rows in a cell.
LEAST_WORDS, MOST_WORDS = 4, 64
LEAST_SHARD, MOST_SHARD, SHARD_BYTES = 2048, 1 << 18, 64 << 20
#: Anchors of one task.
BLOCK_ANCHORS = 4096
LARGEST = 1 << 25
LEAST, MOST = -(1 << 62), 1 << 62

ROWS_SQL = "vec_id long, label long, vector binary, row long"
INDEX_SQL = "vec_id long, label long, vector binary, row long, cell int, far1 double, far2 double"
ASKED_SQL = ("shard long, block long, row long, vec_id long, label long, vector binary, low array<long>, high array<long>")
FOUND = pa.schema([("row", pa.int64()), ("window", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])
FOUND_SQL = "row long, window int, score long, vec_id long"


class Codebooks(NamedTuple):
    first: np.ndarray
    second: np.ndarray

    @property
    def cut(self) -> int:
        return self.first.shape[1]

    @property
    def dim(self) -> int:
        return self.first.shape[1] + self.second.shape[1]


class Index(NamedTuple):
    rows: DataFrame
    books: Codebooks
    #: Per cell that has rows: its number, first shard and number of shards.
    cells: np.ndarray
    #: Radius of each codeword, of both halves.
    radii: tuple[np.ndarray, np.ndarray]
    shards: int


def scaled_rows(table: DataFrame, scale: int, relabel_every: int, labels: int) -> DataFrame:
    """The rows that take part: ``vec_id``, ``label``, ``vector`` (packed integers) and ``row``, a number of its own for each row.

    Where ``relabel_every`` divides vec_id, the label becomes the next one of ``labels``.
    """
    moved = F.when(F.col("vec_id") % relabel_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")) if relabel_every else F.col("label")
    meant = table.where("label IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("vec_id").cast("long").alias("vec_id"), moved.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = []
            for v in batch.column("embedding"):
                x = v.values.to_numpy(zero_copy_only=False) if v.values.null_count == 0 else np.array([np.nan])
                vectors.append(np.clip(np.floor(scale * x), -LARGEST, LARGEST).astype("<i4").tobytes() if np.isfinite(x).all() else None)
            packed = pa.array(vectors, pa.binary())
            out = pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), packed], names=["vec_id", "label", "vector"])
            yield out.filter(packed.is_valid())

    packed = meant.mapInArrow(pack, "vec_id long, label long, vector binary")
    return written(packed.withColumn("row", F.monotonically_increasing_id()), "vectors")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Packed vectors as rows of float64, which holds them exactly; short ones end in zeros."""
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        x = np.frombuffer(v.as_buffer(), "<i4")
        out[i, :len(x)] = x
    return out


def nearest(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest codeword of each row, and the distance to it."""
    at = (((words**2).sum(axis=1)) - 2 * (x @ words.T)).argmin(axis=1)
    return at, np.sqrt(((x - words[at])**2).sum(axis=1))


def codebook(x: np.ndarray, size: int) -> np.ndarray:
    """Means of ``size`` groups of the sample; a group that loses its rows takes the row farthest from its codeword."""
    words = np.unique(x, axis=0)
    if not len(words):
        return np.zeros((1, x.shape[1]))
    words = words[np.linspace(0, len(words) - 1, min(size, len(words))).astype(int)]
    for _ in range(FIT_ROUNDS):
        at, far = nearest(x, words)
        counts = np.bincount(at, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, at, x)
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
        words[counts == 0] = x[np.argsort(-far, kind="stable")[:int((counts == 0).sum())]]
    return words


def build_index(rows: DataFrame) -> Index:
    """Every row with its cell and shard. ``rows`` is a written table."""
    n, longest = rows.select(F.count("*"), F.max(F.octet_length("vector"))).first()
    dim = max(1, (longest or 0) // 4)
    # About twice the sample passes the hash bound, whatever the number of rows; the smallest hashes of these are taken.
    drawn = F.shiftrightunsigned(F.xxhash64("vector", "vec_id"), 1)
    near = rows.withColumn("drawn", drawn).where(F.col("drawn") < min(2**63 - 1, 2**63 * 2 * SAMPLE_ROWS // max(n, 1)))
    sample = near.orderBy("drawn", "vector").select("vector").limit(SAMPLE_ROWS).collect()
    x, cut = matrix(pa.array([bytes(r.vector) for r in sample], pa.binary()), dim), (dim + 1) // 2
    words = min(max(round(n**0.25), LEAST_WORDS), MOST_WORDS)
    books = Codebooks(codebook(x[:, :cut], words), codebook(x[:, cut:], words))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vector"), dim)
            (i, far1), (j, far2) = nearest(x[:, :cut], books.first), nearest(x[:, cut:], books.second)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((i * len(books.second) + j).astype(np.int32)), pa.array(far1), pa.array(far2)],
                                             names=[*batch.schema.names, "cell", "far1", "far2"])

    placed = written(rows.mapInArrow(assign, INDEX_SQL), "cells")
    # One row per cell: at most MOST_WORDS * MOST_WORDS.
    found = sorted(placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far1").alias("far1"), F.max("far2").alias("far2")).collect())
    radii = np.zeros(len(books.first)), np.zeros(len(books.second))
    size = max(1, min(max(LEAST_SHARD, 8 * math.isqrt(n)), MOST_SHARD, SHARD_BYTES // (4 * dim)))
    cells, shard, filled = [], 0, 0
    for r in found:
        i, j = divmod(r.cell, len(books.second))
        radii[0][i], radii[1][j] = max(radii[0][i], r.far1), max(radii[1][j], r.far2)
        if filled + r.n > size and filled:
            shard, filled = shard + 1, 0
        parts = math.ceil(r.n / size)
        cells.append((r.cell, shard, parts))
        filled += r.n
        if parts > 1:
            shard, filled = shard + parts, 0
    places = placed.sparkSession.createDataFrame(cells, "cell int, shard long, parts long")
    dealt = placed.join(F.broadcast(places), "cell").withColumn("shard", F.col("shard") + F.pmod(F.xxhash64("row"), F.col("parts")))
    return Index(dealt.select("shard", "row", "vec_id", "label", "vector", "cell"), books, np.array(cells, np.int64).reshape(-1, 3), radii, shard + 1)


def cell_bounds(q: np.ndarray, books: Codebooks, cells: np.ndarray, radii: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Upper bounds of the scores of each q (a row) in each of the cells."""
    (a, b), (r1, r2) = (q[:, :books.cut], q[:, books.cut:]), radii
    one = a @ books.first.T + np.linalg.norm(a, axis=1)[:, None] * r1
    two = b @ books.second.T + np.linalg.norm(b, axis=1)[:, None] * r2
    return one[:, cells // len(books.second)] + two[:, cells % len(books.second)]


def slack(q: np.ndarray) -> np.ndarray:
    """What rounding can take from a bound of each q, many times over."""
    return 1 + 1e-9 * np.abs(q).sum(axis=-1) * LARGEST


class Cells:
    """The rows of one shard by cell, with the shard's own radii."""

    def __init__(self, table: pa.Table, books: Codebooks):
        cell = table.column("cell").to_numpy()
        vec_id = table.column("vec_id").to_pandas()
        # Rows of a cell by vec_id (null last), so that ties come in order.
        self.ids = vec_id.astype("Int64").fillna(MOST).to_numpy(np.int64)
        order = np.lexsort((self.ids, cell))
        self.ids, cell = self.ids[order], cell[order]
        self.label, self.row = table.column("label").to_numpy()[order], table.column("row").to_numpy()[order]
        self.x = matrix(table.column("vector").combine_chunks(), books.dim)[order]
        self.peak = float(np.abs(self.x).max(initial=0)) ** 2 * books.dim
        numbers, first = np.unique(cell, return_index=True)
        self.span = {c: slice(a, b) for c, a, b in zip(numbers.tolist(), first.tolist(), [*first[1:].tolist(), len(cell)])}
        i, j = numbers // len(books.second), numbers % len(books.second)
        self.one, self.two, self.width = np.unique(i), np.unique(j), len(books.second)
        self.words = books.first[self.one], books.second[self.two]
        self.radii = tuple(self._radii(cell, part, k) for k, part in enumerate((slice(0, books.cut), slice(books.cut, None))))
        # Scores are exact in float64 below 2^53, in 64-bit integers above.
        self.exact = self.x if 2 * self.peak < 2**53 else self.x.astype(np.int64)

    def _radii(self, cell: np.ndarray, part: slice, half: int) -> np.ndarray:
        own = (cell // self.width, cell % self.width)[half]
        at = np.searchsorted((self.one, self.two)[half], own)
        far = np.sqrt(((self.x[:, part] - self.words[half][at])**2).sum(axis=1))
        out = np.zeros(len(self.words[half]))
        np.maximum.at(out, at, far)
        return out

    def by_bound(self, q: np.ndarray, cut: int) -> Iterator[tuple[float, slice]]:
        """Bound and rows of each cell, by falling bounds: the next sums of two sorted lists come from a heap."""
        bounds = [part @ words.T + np.linalg.norm(part) * radii for part, words, radii in zip((q[:cut], q[cut:]), self.words, self.radii)]
        orders = [np.argsort(-b, kind="stable") for b in bounds]
        first, second = (b[o].tolist() for b, o in zip(bounds, orders))
        one, two = self.one[orders[0]].tolist(), self.two[orders[1]].tolist()
        heap = [(-(first[0] + second[0]), 0, 0)]
        while heap:
            total, i, j = heapq.heappop(heap)
            if j + 1 < len(second):
                heapq.heappush(heap, (-(first[i] + second[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(first):
                heapq.heappush(heap, (-(first[i + 1] + second[0]), i + 1, 0))
            rows = self.span.get(one[i] * self.width + two[j])
            if rows is not None:
                yield -total, rows


def best_in(cells: Cells, cut: int, q: np.ndarray, row: int, vec_id: int, label: int, same: bool, low: list[int], high: list[int], k: int):
    """(window, score, vec_id) of the first ``k`` rows of each window [low, high], of the same label or of the others."""
    low, high = np.array(low, np.int64), np.array(high, np.int64)
    needed, margin = low.copy(), float(slack(q))
    kept = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in low]
    exact = q if cells.exact.dtype == np.float64 else q.astype(np.int64)
    for bound, rows in cells.by_bound(q, cut):
        if bound + margin < needed.min():
            break
        scores = cells.exact[rows] @ exact
        hit = np.flatnonzero(scores >= needed.min())
        if not len(hit):
            continue
        labels, ids = cells.label[rows][hit], cells.ids[rows][hit]
        fit = (labels == label) & (cells.row[rows][hit] != row) & (ids != vec_id) if same else labels != label
        scores, ids = scores[hit][fit].astype(np.int64), ids[fit]
        for w in range(len(low)):
            inside = (scores >= needed[w]) & (scores <= high[w])
            if inside.any():
                s, i = np.r_[kept[w][0], scores[inside]], np.r_[kept[w][1], ids[inside]]
                order = np.lexsort((i, -s))[:k]
                kept[w] = s[order], i[order]
                if len(order) == k:  # an equal score of a smaller vec_id could still enter
                    needed[w] = max(needed[w], kept[w][0][-1])
    return [(w, s, i) for w, (scores, ids) in enumerate(kept) for s, i in zip(scores.tolist(), ids.tolist())]


def search(asked: DataFrame, index: Index, same: bool, k: int) -> DataFrame:
    """What each anchor of ``asked`` finds in the shards that it is sent to: at most ``k`` rows per window and shard."""
    books = index.books

    def meet(key: tuple[pa.Scalar, ...], anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in FOUND}
        if anchors.num_rows and rows.num_rows:
            cells, q = Cells(rows, books), matrix(anchors.column("vector").combine_chunks(), books.dim)
            for x, a in zip(q, anchors.drop_columns(["vector"]).to_pylist()):
                for w, score, vec_id in best_in(cells, books.cut, x, a["row"], a["vec_id"], a["label"], same, a["low"], a["high"], k):
                    for name, value in (("row", a["row"]), ("window", w), ("score", score), ("vec_id", vec_id if vec_id != MOST else None)):
                        out[name].append(value)
        return pa.table({f.name: pa.array(out[f.name], f.type) for f in FOUND}, schema=FOUND)

    # A shard is repeated for each block of anchors that is sent to it.
    pairs = asked.select("shard", "block").distinct().toDF("shard", "block")
    shards = index.rows.toDF(*index.rows.columns).join(pairs, "shard").groupBy("shard", "block")
    return asked.groupBy("shard", "block").cogroup(shards).applyInArrow(meet, FOUND_SQL)


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each anchor's window, with ``place`` from 1."""
    order = Window.partitionBy("row", "window").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def routed(anchors: DataFrame, index: Index, blocks: int, home: bool) -> DataFrame:
    """Anchors with the shards that they are sent to: the one of their own row, or all others that can hold a row scoring
    ``least`` or more."""
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    if home:
        return anchors.select(F.col("home").alias("shard"), *[c.split()[0] for c in ASKED_SQL.split(", ")[1:]])

    books, radii = index.books, index.radii
    cells, first_shard, shards_of = index.cells.T

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column("vector"), books.dim)
            open_ = cell_bounds(q, books, cells, radii) + slack(q)[:, None] >= batch.column("least").to_numpy()[:, None]
            who, at = np.nonzero(open_)
            shard, parts = first_shard[at], shards_of[at]
            who, at = np.repeat(who, parts), np.repeat(shard, parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            sent = np.unique(np.stack([who, at], axis=1), axis=0)
            sent = sent[sent[:, 1] != batch.column("home").to_numpy()[sent[:, 0]]]
            part = batch.take(pa.array(sent[:, 0]))
            names = [c.split()[0] for c in ASKED_SQL.split(", ")]
            for start in range(0, len(sent), 10_000):
                some = part.slice(start, 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(sent[start:start + 10_000, 1]), *(some.column(c) for c in names[1:])], names=names)

    return anchors.mapInArrow(route, ASKED_SQL)


def best(anchors: DataFrame, index: Index, blocks: int, same: bool, k: int) -> DataFrame:
    """``row``, ``window``, ``place``, ``score`` and ``vec_id``: the first ``k`` rows of each window of each anchor, over all shards."""
    near = written(search(routed(anchors, index, blocks, True), index, same, k), "near")
    # A window that is full already needs rows of its last score at least; the anchor needs what its least window needs.
    full = near.groupBy("row", "window").agg(F.count("*").alias("n"), F.min("score").alias("last")).where(F.col("n") >= k)
    wanted = anchors.select("row", F.posexplode("low").alias("window", "low")).join(full, ["row", "window"], "left")
    least = wanted.groupBy("row").agg(F.min(F.greatest("low", F.coalesce("last", "low"))).alias("least"))
    far = search(routed(anchors.join(least, "row"), index, blocks, False), index, same, k)
    return first_of(near.unionByName(far), k)


def hard_negatives(table: DataFrame, scale: int = 256, relabel_every: int = 0, labels: int = 10, anchor_every: int = 100,
                   positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """For each anchor (``anchor_every`` divides its vec_id) and each of its first ``positives`` rows of the same label: the first
    ``negatives`` rows of other labels whose score is within ``window`` percent of the positive's score."""
    rows = scaled_rows(table, scale, relabel_every, labels)
    index = build_index(rows)
    index = index._replace(rows=written(index.rows, "multi-index"))
    anchors = index.rows.where(F.col("vec_id") % anchor_every == 0).withColumnRenamed("shard", "home").drop("cell")
    blocks = max(1, math.ceil(anchors.count() / BLOCK_ANCHORS))
    everything = anchors.withColumns({"low": F.array(F.lit(LEAST)), "high": F.array(F.lit(MOST))})
    found = written(best(everything, index, blocks, True, positives), "positives")
    def whole(percent: int, sign: int) -> F.Column:
        """``percent`` of the score, rounded inwards: up for the lower end (sign -1), down for the upper one (sign 1)."""
        part = sign * percent * F.col("score")
        return sign * ((part - F.pmod(part, F.lit(100))) / 100).cast("long")

    spans = found.select("row", F.col("place").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
                         whole(window[0], -1).alias("low"), whole(window[1], 1).alias("high"))
    asked = spans.where("low <= high").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("positive", "low", "high"))).alias("w"))
    asked = asked.select("row", F.col("w.positive").alias("order"), F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    asking = written(anchors.join(asked, "row"), "windows")
    answers = best(asking.drop("order"), index, blocks, False, negatives)
    named = asking.select("row", F.col("vec_id").alias("anchor_id"), F.posexplode("order").alias("window", "positive"))
    return (answers.select("row", "window", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                           F.col("score").alias("negative_score"))
            .join(named, ["row", "window"]).join(spans.select("row", "positive", "positive_id", "positive_score"), ["row", "positive"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
