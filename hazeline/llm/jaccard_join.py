"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

The shingles that several classes share (see ``shingle_sets``) have one global order, rarest first. The order is cut into fragments
at pivots that spread the shingles evenly; a pair's overlap is counted in each fragment on its own and summed.

Which pairs are counted: two sets with overlap o have their first common shingle, in global order, at places that leave o shingles
behind them in both. So a set's shingle is an entry for partners up to the size its place allows, and pairs meet only at entries that
allow each other's size. All pairs of a group of near copies would still be too many, so

1. each shingle's entries meet the most central of them, the one that shares most with other classes (for copies of one text: that
   text), and the linked ones form components;
2. what is left are entries outside the component of their shingle's centre; they meet all other entries of the shingle that lie in
   other components. Two entries inside one component need no test.

No link between different sets is lost by this: a linked pair meets at its first common shingle, unless it is already connected.

Scale: texts are scanned, never shuffled; packed shingles are, once; entries and pairs exist only for classes whose shared shingles
reach the least overlap. Copies never meet: they are one class. Classes are told apart by 64 bits.

Edge cases: null or empty text has no shingles and links with nothing, its component is itself; a text of fewer words than ``width``
is one shingle; a component's id is its smallest doc_id, null if it has none; rows that repeat a doc_id stand each for themselves;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import written
from hazeline.llm.components import components
from hazeline.llm.shingle_sets import document_sets, live_classes

FRAGMENTS = 8
#: The order is surveyed in cells: shingles of up to ``CELL_SPREAD`` classes each have a row of cells, by the top bits of their hash.
CELL_SPREAD, CELL_SLICES = 64, 4
SEGMENTS_SQL = "class long, fragment int, segment array<long>"
ENTRIES_SQL = "shingle long, class long, n long, central long, upto long"
#: Sizes are put into bins of this ratio; a partner's size is in one of the bins that an entry allows.
BIN_RATIO = 1.1


def _cells(shingles: np.ndarray, spread: np.ndarray) -> np.ndarray:
    slices = (shingles.view(np.uint64) & np.uint64((1 << 40) - 1)) >> np.uint64(38)
    return (np.minimum(spread, CELL_SPREAD).astype(np.int64) * CELL_SLICES + slices.astype(np.int64))


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(name)
    return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)


def _pivots(live: DataFrame) -> list[int]:
    """Last cell of each fragment but the final one, so that fragments hold about as many shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CELL_SPREAD + 1) * CELL_SLICES, np.int64)
        for batch in batches:
            (ends, shingles), (_, spread) = _lists(batch, "shingles"), _lists(batch, "spread")
            part = slice(ends[0], ends[-1])
            total += np.bincount(_cells(shingles[part], spread[part]), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    cells = live.select("shingles", "spread").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    rows = sorted(cells.collect())  # at most (CELL_SPREAD + 1) * CELL_SLICES
    upto = np.cumsum([r.n for r in rows])
    at = np.searchsorted(upto, [upto[-1] * k / FRAGMENTS for k in range(1, FRAGMENTS)]) if len(rows) else []
    return sorted({rows[i].cell for i in at})


def segments(live: DataFrame) -> DataFrame:
    """Each class's shared shingles, cut at the pivots of the global order."""
    pivots = np.array(_pivots(live), np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ends, shingles), (_, spread) = _lists(batch, "shingles"), _lists(batch, "spread")
            fragment = np.searchsorted(pivots, _cells(shingles, spread))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            shingles, fragment = shingles[ends[0]:ends[-1]], fragment[ends[0]:ends[-1]]
            order = np.lexsort((fragment, owner))
            key = owner[order] * (len(pivots) + 1) + fragment[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            classes = batch.column("class").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes[owner[order][starts]]), pa.array(fragment[order][starts], pa.int32()),
                 pa.ListArray.from_arrays(pa.array(np.r_[starts, len(key)], pa.int32()), pa.array(shingles[order]))],
                names=["class", "fragment", "segment"])

    return live.select("class", "shingles", "spread").mapInArrow(cut, SEGMENTS_SQL)


def entries(live: DataFrame, percent: int) -> DataFrame:
    """Places of shingles at which a class can have its first common shingle, with the largest partner each allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, shingles = _lists(batch, "shingles")
            counts = np.diff(ends)
            owner = np.repeat(np.arange(batch.num_rows), counts)
            n = batch.column("n").to_numpy()[owner]
            left = np.concatenate([np.arange(c, 0, -1) for c in counts]) if len(counts) else np.empty(0, np.int64)
            # overlap / (n + m - overlap) >= percent / 100 for a partner of m shingles, with at most ``left`` common ones
            upto = left * (100 + percent) // percent - n
            meant = (100 * upto >= percent * n) & (100 * left >= percent * n)
            owner = owner[meant]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shingles[ends[0]:ends[-1]][meant]), *(pa.array(batch.column(c).to_numpy()[owner]) for c in ("class", "n", "central")),
                 pa.array(upto[meant])], names=["shingle", "class", "n", "central", "upto"])

    return live.select("class", "n", "central", "shingles").mapInArrow(run, ENTRIES_SQL)


def linked(pairs: DataFrame, sizes: DataFrame, pieces: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose overlaps, counted per fragment and summed, reach the threshold."""
    own = pieces.select(F.col("class").alias("a"), "fragment", F.col("segment").alias("own"))
    other = pieces.select(F.col("class").alias("b"), "fragment", F.col("segment").alias("other"))
    partial = pairs.join(own, "a").join(other, ["b", "fragment"]).select(
        "a", "b", F.size(F.array_intersect("own", "other")).alias("partial"))
    overlap = partial.groupBy("a", "b").agg(F.sum("partial").alias("overlap"))
    for x in ("a", "b"):
        overlap = overlap.join(sizes.select(F.col("class").alias(x), F.col("n").alias("n_" + x)), x)
    return overlap.where(100 * F.col("overlap") >= percent * (F.col("n_a") + F.col("n_b") - F.col("overlap"))).select("a", "b")


def _meets(a: str, b: str) -> F.Column:
    """Two entries of a shingle allow each other's size."""
    return (F.col(f"{a}.n") <= F.col(f"{b}.upto")) & (F.col(f"{b}.n") <= F.col(f"{a}.upto"))


def _bin(n: F.Column) -> F.Column:
    return F.floor(F.log(n) / F.log(F.lit(BIN_RATIO))).cast("int")


def links_between(live: DataFrame, percent: int = 75) -> DataFrame:
    """Links (a, b) that connect all classes which any links connect. ``live`` is a written table."""
    at, sizes, pieces = entries(live, percent), live.select("class", "n"), segments(live)
    centre = at.groupBy("shingle").agg(F.max(F.struct("central", "class", "n", "upto")).alias("c"), F.count("*").alias("members"))
    centre = centre.where("members > 1").select("shingle", "c.*")
    met = (at.alias("x").join(centre.alias("c"), "shingle").where(F.col("x.class") != F.col("c.class")).where(_meets("x", "c"))
           .select(F.col("c.class").alias("a"), F.col("x.class").alias("b")).distinct())
    first = written(linked(met, sizes, pieces, percent), "first-links")
    found = components(first)

    # A class without links is a component of its own.
    labelled = at.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    open_lists = labelled.groupBy("shingle").agg(F.max(F.struct("central", "class", "label")).alias("c"), F.min("label").alias("low"),
                                                 F.max("label").alias("high")).where("low <> high")
    rest = labelled.join(open_lists.select("shingle", F.col("c.class").alias("centre"), F.col("c.label").alias("home")), "shingle")
    rest = written(rest.where("class <> centre").drop("centre", "central"), "open-entries")
    # An entry outside its centre's component looks in the bins of the sizes that it allows.
    outside = rest.where("label <> home")
    lowest, highest = F.ceil(F.col("n") * percent / 100), F.least(F.col("upto"), F.floor(F.col("n") * 100 / percent))
    outside = outside.withColumn("bin", F.explode(F.sequence(_bin(lowest), _bin(highest))))
    met = (outside.alias("x").join(rest.withColumn("bin", _bin(F.col("n"))).alias("y"), ["shingle", "bin"])
           .where((F.col("x.label") != F.col("y.label")) & _meets("x", "y"))
           .select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct())
    second = linked(met, sizes, pieces, percent)
    return written(first.union(second), "links")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """Per document: set size, class, component id and its class's representative (``copy_of``, the smallest doc_id of the class)."""
    sets = written(document_sets(docs, width), "sets")
    classes = sets.where("class IS NOT NULL").groupBy("class").agg(F.first("n_shingles").alias("n"), F.min("doc_id").alias("copy_of"))
    live = written(live_classes(docs, classes.select("class", "n"), width, percent), "live-classes")
    labels = components(links_between(live, percent))
    named = classes.select("class", "copy_of").join(labels.withColumnRenamed("node", "class"), "class", "left")
    named = named.withColumn("label", F.coalesce("label", "class"))
    smallest = named.groupBy("label").agg(F.min("copy_of").alias("component_id"))
    named = named.join(smallest, "label").select("class", "copy_of", "component_id")
    return sets.join(named, "class", "left").select(
        "doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"))
