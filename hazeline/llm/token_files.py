"""Token ids in ORC files: encoding, writing in order of doc_id, stripe-parallel reading, look-up by metadata.

Files hold ``part`` (file number in order of doc_id), ``ordinal`` (row in the file), ``doc_id`` and ``ids``. ORC stores integers with
its run-length encodings (version 2), keeps minimum and maximum of every stripe and of every ``ROW_STRIDE`` rows, and a Bloom filter
on ``doc_id``, so a range of ids or a single id reads few stripes, and stripes are read in parallel.

Texts are encoded by the ``tokenizers`` library. A text is cut where its pre-tokeniser cuts, a megabyte of texts at a time; each distinct
piece of these is looked up once, a new one goes to the library's model, and its ids are kept while it repeats. A text with characters that versions of Unicode class
differently, or with an added token, is encoded whole. Scale: one range shuffle of the texts; encoding and writing happen behind it, so ids are
never shuffled. Reading back, only a line per document is; offsets need a sum per file, and the number of files is bounded by the
write's tasks.

Edge cases: null text is the empty text, which holds the end id alone; rows with a null doc_id come first; rows that repeat a doc_id
stand side by side, ordered by text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazeline.llm.common import mix, rows_of, work_dir, worker_store, written

ROW_STRIDE, STRIPE_BYTES, BLOOM_RATE = 10_000, 64 << 20, 0.01
FILE_SQL = "part int, ordinal long, doc_id long, ids array<int>"
#: Pieces kept by a worker; longer ones are not kept.
MOST_PIECES, LONGEST_PIECE = 800_000, 48
#: Characters of texts that are cut and looked up together.
MOST_JOINED = 1 << 20
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


#: What a character is to the pre-tokeniser.
LETTER, NUMBER, MARK, BLANK, OTHER_WHITE, UNSURE = range(6)


def _ranges(codes: list[int]) -> str:
    """A regular expression's character class."""
    steps = np.flatnonzero(np.diff(codes) > 1)
    pairs = zip(np.r_[0, steps + 1], np.r_[steps, len(codes) - 1])
    return "".join(f"\\u{codes[a]:04x}-\\u{codes[b]:04x}" for a, b in pairs)


@functools.cache
def character_kinds() -> np.ndarray:
    """Kind of each character of the basic plane; ``UNSURE`` where it can't be said here what the pre-tokeniser takes it for.

    What is letter or number depends on the version of Unicode, so only characters count that were the same in version 3.2 and are now.
    """
    kinds, white = np.full(1 << 16, MARK, np.uint8), re.compile(f"[{WHITE}]")
    for code in range(1 << 16):
        kind, early = unicodedata.category(chr(code))[0], unicodedata.ucd_3_2_0.category(chr(code))[0]
        if (kind == "L") != (early == "L") or (kind == "N") != (early == "N") or (kind == "Z") != (early == "Z") or early == "C" and code >= 0xA0:
            kinds[code] = UNSURE
        elif kind in "LN":
            kinds[code] = LETTER if kind == "L" else NUMBER
        elif white.match(chr(code)):
            kinds[code] = BLANK if code == 32 else OTHER_WHITE
    return kinds


@functools.cache
def pre_tokeniser() -> tuple[re.Pattern, re.Pattern]:
    """The byte-level pre-tokeniser's pieces, and the characters of which it can't be said here what they are."""
    letter, number, unsure = (_ranges(np.flatnonzero(character_kinds() == k).tolist()) for k in (LETTER, NUMBER, UNSURE))
    pieces = (f" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{number}]+| ?[^{WHITE}{letter}{number}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
    return re.compile(pieces), re.compile(f"[{unsure}\U00010000-\U0010ffff]")


def piece_starts(codes: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pre-tokeniser's pieces start in joined texts, given as code points, their kinds and the start of each text.

    A piece is a run of one kind with the space before it. A run of white space gives its last character up to what follows, which
    takes a space and nothing else; a contraction's apostrophe takes its letters.
    """
    n = len(codes)
    white, opens = (kinds == BLANK) | (kinds == OTHER_WHITE), np.zeros(n + 1, bool)
    opens[first] = opens[n] = True
    starts = opens.copy()
    text = ~white
    starts[1:n] |= np.where(white[1:], text[:-1], np.where(white[:-1], kinds[:-1] == OTHER_WHITE, kinds[1:] != kinds[:-1]))
    starts[:n - 1] |= white[:-1] & text[1:] & ~opens[1:n]
    marks = np.flatnonzero((codes == ord("'")) & starts[:n])
    if len(marks):
        near = np.zeros((2, len(marks)), codes.dtype)  # the next two characters of the same text
        for k in (1, 2):
            there = marks + k < n
            there[there] &= ~opens[marks[there] + k]
            there &= (near[0] > 0) if k == 2 else True
            near[k - 1, there] = codes[marks[there] + k]
        one = np.isin(near[0], [ord(c) for c in "stmd"])
        two = np.zeros(len(marks), bool)
        for a, b in ("re", "ve", "ll"):
            two |= (near[0] == ord(a)) & (near[1] == ord(b))
        starts[marks[one | two] + 1] = False
        starts[marks[two] + 2] = False
        starts[marks[one] + 2] = True
        starts[marks[two] + 3] = True
    return np.flatnonzero(starts[:n])


def distinct_pieces(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """A place for each distinct piece, and for every piece which of these it is; None if two pieces share a hash."""
    sizes = np.diff(np.r_[starts, len(codes)])
    inside = np.arange(len(codes), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
        h = mix(np.add.reduceat(mix_table().take(codes) * powers.take(inside), starts))
    which = pa.array(h).dictionary_encode().indices.to_numpy()
    place = np.empty(int(which.max()) + 1, np.int64)
    place[which[::-1]] = np.arange(len(which))[::-1]
    same = (sizes == sizes[place][which]).all()
    same = same and (codes == codes.take(np.repeat(starts[place].astype(np.int32)[which], sizes) + inside)).all()
    return (place, which) if same else None


@functools.cache
def mix_table() -> np.ndarray:
    """A number of its own for each character of the basic plane."""
    return mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


@functools.cache
def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: its own if that can be seen, else one from 256 on."""
    seen = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    return seen | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in seen)}


class ChunkEncoder:
    """Ids of texts by way of the pieces into which the pre-tokeniser cuts them: merges never cross a piece."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cut, self.unsure = pre_tokeniser()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
    def library(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces by the library's model alone, which has nothing left to cut; kept where a piece is not too long."""
        if len(self.known) + len(pieces) > MOST_PIECES:
            self.known.clear()
        found, tokens_of, spelling, pack = [], self.model.tokenize, byte_characters(), struct.pack
        for p in pieces:
            ids = [t.id for t in tokens_of(p.encode().decode("latin-1").translate(spelling))]
            found.append(pack(f"<{len(ids)}I", *ids))
        self.known.update((p, ids) for p, ids in zip(pieces, found) if len(p) <= LONGEST_PIECE)
        return found

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces; those not known yet are learnt."""
        packed = [*map(self.known.get, pieces)]
        if None in packed:
            new = [i for i, ids in enumerate(packed) if ids is None]
            for i, ids in zip(new, self.learn([pieces[i] for i in new])):
                packed[i] = ids
        return packed

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        out = [b""] * len(texts)
        group, size = [], 0
        for i, t in enumerate(texts):
            if any(a in t for a in self.added):
                out[i] = self.library(t)
            elif t:
                group.append(i)
                size += len(t)
                if size > MOST_JOINED:
                    self.together(texts, group, out)
                    group, size = [], 0
        if group:
            self.together(texts, group, out)
        return out

    def together(self, texts: list[str], group: list[int], out: list[bytes]) -> None:
        """Ids of some texts, none of them empty: each distinct piece is looked up once."""
        joined = "".join([texts[i] for i in group])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        first = np.cumsum([0, *(len(texts[i]) for i in group)])
        kinds = character_kinds().take(codes, mode="clip")  # the last character of the plane is none, so it is not sure
        unsure = np.logical_or.reduceat(kinds == UNSURE, first[:-1])
        if unsure.any():
            for i in np.compress(unsure, group).tolist():
                out[i] = self.library(texts[i])
            if rest := np.compress(~unsure, group).tolist():
                self.together(texts, rest, out)
            return
        starts = piece_starts(codes, kinds, first[:-1])
        found = distinct_pieces(codes, starts)
        if found is None:
            for i in group:
                out[i] = self.one_by_one(texts[i])
            return
        place, which = found
        ends = np.r_[starts[1:], len(codes)]
        pieces = [joined[a:b] for a, b in zip(starts[place].tolist(), ends[place].tolist())]
        packed = self.ids_of(pieces)
        ids = np.frombuffer(b"".join(packed), "<u4")
        counts = np.fromiter(map(len, packed), np.int64, len(packed)) >> 2
        own = counts[which]
        before = np.r_[0, np.cumsum(own)]
        # Each piece's ids from where those of its like lie.
        at = np.repeat((np.cumsum(counts) - counts)[which] - before[:-1], own) + np.arange(before[-1])
        data = ids[at].tobytes()
        cuts = (4 * before[np.searchsorted(starts, first)]).tolist()
        for i, a, b in zip(group, cuts, cuts[1:]):
            out[i] = data[a:b]

    def one_by_one(self, text: str) -> bytes:
        parts = self.cut.findall(text)
        distinct = list(dict.fromkeys(parts))
        return b"".join(map(dict(zip(distinct, self.ids_of(distinct))).__getitem__, parts))


def write_token_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Write the ids of every text, each with ``end_id`` behind it, in ascending doc_id order."""
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    dealt = dealt.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_store(("byte chunks", tokenizer_path), lambda: ChunkEncoder(tokenizer_path))
        part, ordinal, end = TaskContext.get().partitionId(), 0, struct.pack("<I", end_id)
        for batch in rows_of(batches):
            packed = own.encode([(t.as_py() or b"").decode("utf-8", "replace") for t in batch.column("text")])
            data = b"".join(x for p in packed for x in (p, end))
            ends = np.cumsum([0, *(len(p) // 4 + 1 for p in packed)])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(ordinal, ordinal + n)), batch.column("doc_id"),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(data, "<i4")))],
                names=["part", "ordinal", "doc_id", "ids"])
            ordinal += n

    (dealt.mapInArrow(encode, FILE_SQL).write.format("orc")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", str(BLOOM_RATE))
     .option("orc.create.index", "true").option("orc.row.index.stride", str(ROW_STRIDE))
     .option("orc.stripe.size", str(STRIPE_BYTES)).option("compression", "zstd").save(path))


def read_token_ids(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The files' rows; bounds on doc_id reach the reader, which skips files, stripes and row groups by their metadata."""
    rows = spark.read.schema(FILE_SQL).orc(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return rows


def token_summary(rows: DataFrame) -> DataFrame:
    """Per document its count of ids, their crc32, and ``start``: the ids of all documents before it."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            ends, values = ids.offsets.to_numpy(), memoryview(np.ascontiguousarray(ids.values.to_numpy(), "<i4")).cast("B")
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("ordinal"), batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()),
                 pa.array([zlib.crc32(values[4 * a:4 * b]) for a, b in zip(ends, ends[1:])], pa.int64())],
                names=["part", "ordinal", "doc_id", "n_tokens", "ids_crc32"])

    lines = written(rows.mapInArrow(sums, "part int, ordinal long, doc_id long, n_tokens long, ids_crc32 long"), "token-lines")
    # One row per file.
    sizes = sorted(lines.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before = np.cumsum([0, *(r.n for r in sizes)])
    offsets = lines.sparkSession.createDataFrame(
        [(r.part, int(n)) for r, n in zip(sizes, before)], "part int, before long")
    in_file = Window.partitionBy("part").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return (lines.withColumn("inside", F.coalesce(F.sum("n_tokens").over(in_file), F.lit(0))).join(offsets, "part")
            .select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))


def token_file_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write the files (to the shared folder if no path is given) and summarise what they hold."""
    spark = docs.sparkSession
    path = path or work_dir(spark, "token-files")
    write_token_ids(docs, path, tokenizer_path, end_id)
    return token_summary(read_token_ids(spark, path))
