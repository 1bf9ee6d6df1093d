"""Helpers shared by the corpus operators: reading, word tables, shared intermediates.

Texts travel to Python workers as UTF-8 bytes: ``bytes.split`` and ``bytes.translate`` give exactly the word classes the operators
use (white space 0x20 and 0x09-0x0D; ASCII letters and digits plus everything above 0x7F) without a regular expression.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.session import work_dir, written

__all__ = ["ASCII_LOWER", "LETTER_DIGIT_WORDS", "WordHashes", "drop_stores", "mix", "read_table", "rows_of", "text_of", "windows", "word_hashes", "worker_store", "work_dir", "written"]

#: Lower-cases A-Z and leaves every other byte alone.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower-cases A-Z and turns every byte that is no letter, digit or part of a non-ASCII character into a space.
LETTER_DIGIT_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


#: Bytes of a record batch on its way to a Python worker. With Spark's default of 64 MB the buffers of a task, in the executor's memory
#: outside its heap and again in the worker, grow with its widest batch of 10,000 texts.
ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: The folder that holds the package, for Python workers that were started elsewhere.
ROOT = str(Path(__file__).resolve().parents[2])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; from then on the session's Python workers also look for this package where the driver found it, and get record batches
    of ``BATCH_BYTES`` unless the session has a size of its own."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        environment["PYTHONPATH"] = ":".join(filter(None, [*paths, ROOT]))
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` as bytes and ``more``: whatever else the table holds stays behind at the scan."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), *more)


def rows_of(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that the texts of each come to about ``most_bytes`` (at least one row each).

    After the last one a worker gives back what it has freed: it waits for its next task beside those of other stages."""
    for batch in batches:
        start = 0
        text = batch.column(batch.schema.get_field_index("text"))
        sizes = np.cumsum(np.nan_to_num(pa.compute.binary_length(text).to_numpy(zero_copy_only=False).astype(float)))
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0.0
            end = max(start + 1, int(np.searchsorted(sizes, base + most_bytes, side="right")))
            yield batch.slice(start, end - start)
            start = end
    batch = text = None
    give_back()


_store: dict[tuple, object] = {}


def worker_store(key: tuple, make):
    """What a worker keeps between tasks for one operator. A worker that turns to another operator drops it first: the stores of
    several operators together would be several times as large. What it drops goes back to the system before the next store grows."""
    if key not in _store:
        drop_stores()
        _store[key] = make()
    return _store[key]


def drop_stores() -> None:
    """For an operator that keeps nothing between tasks: what a worker kept for others goes."""
    if _store:
        _store.clear()
        give_back()


def give_back() -> None:
    """Freed memory back to the system, which the allocators otherwise keep for this process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words. Nothing is kept: hashing a word anew costs less than finding it in a large table."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class WordHashes(dict):
    """Word to 64-bit hash, computed once per word; emptied when it has ``most`` words. Hashes of another seed are independent."""

    def __init__(self, most: int = 400_000, seed: int = 0):
        super().__init__()
        self.most, self.seed = most, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the output."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def windows(word_hashes: np.ndarray, width: int, multiplier: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all windows of ``width`` consecutive words, by doubling; empty if there are fewer words."""
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power, block, done, total = np.uint64(multiplier), word_hashes, 0, np.zeros(n, np.uint64)
        span, weight = 1, np.uint64(1)
        while True:
            if width & span:
                total += weight * block[done:done + n]
                done += span
                weight = weight * power
            if done == width:
                return mix(total)
            block = block[:-span] + power * block[span:]
            power = power * power
            span *= 2
