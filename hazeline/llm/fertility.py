"""Quality rules from tokeniser fertility, with base rules on words, lines and repetition.

Two public vocabularies measure each text, word by word, as after a space: a piece vocabulary gives characters per token, the share of
byte-fallback tokens and the entropy of the tokens (divided by the logarithm of their number), a byte-level vocabulary characters per
token and the share of tokens of a single byte. Bands are set per language; a document outside a band of its group is rejected.
Documents without a language are grouped by the script of most of their letters.

A measure that is a mean over tokens scatters less the longer a text is. So its band reaches ``REACH`` typical scatters from the group's
median, where a scatter is the median of deviation times root of words, divided by the root of the document's own words; it is never
narrower than the group's interquartile range or ``LEAST_REACH``. Entropy falls with length by itself: its band is as wide for all.
A group's figures are drawn towards those of all documents as if by ``PRIOR`` documents, so a small group has no rule of its own kind.

Scale: one scan measures; the measures (a short line per document) are written once and read three times, for medians, scatter and
verdict. Medians are exact over values rounded to ``STEPS`` per unit (scatter: to 1 %): counts per (group, measure, value), whose number
is bounded.

Edge cases: null text has no words; a document without words or tokens fails the base rules and stays out of the bands; with no
documents there are no rows; rows that repeat count and are judged one by one; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeline.llm.common import rows_of, text_of, worker_store, written

LEAST_WORDS, MOST_REPEATED_PERCENT, REPEAT_WIDTH = 50, 50, 3
SYMBOLS = b"#*$%&|<>"
MEASURES = ("chars_per_token", "byte_share", "token_entropy", "chars_per_byte_token", "single_byte_share")
#: Values are rounded to this many steps per unit before counting.
STEPS = 2000
#: Bands reach this many typical scatters from the median; entropy's band as many interquartile ranges as ``ENTROPY_REACH``.
REACH, ENTROPY_REACH = 9.0, 3.5
#: The least half width of a band, in each measure's own unit.
LEAST_REACH = {"chars_per_token": 0.06, "byte_share": 0.1, "token_entropy": 0.1, "chars_per_byte_token": 0.06, "single_byte_share": 0.03}
#: Documents' worth of weight that the figures of all documents have in those of a group.
PRIOR = 20
#: Words and marks kept by a worker, and what closes a word.
MOST_WORDS, MOST_MARKS = 800_000, 10_000
MARKS = ".,;:!?#*$%&|<>"
WHITE = bytes(range(9, 14)) + b" "
LETTER = re.compile(r"[^\W\d_]")
MEASURED_SQL = ("doc_id long, band_group string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                "n_tokens long, chars_per_token double, byte_share double, token_entropy double, chars_per_byte_token double, "
                "single_byte_share double")


class WordPieces(dict):
    """Number of each word; by number, in arrays, its piece ids and its count of byte-level tokens and of those of one byte.
    Emptied when full."""

    def __init__(self, path: str, byte_path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
        self.kind = np.uint16 if len(self.is_byte) <= 1 << 16 else np.uint32
        self.byte_level = Tokenizer.from_file(byte_path)
        self.byte_level.encode_special_tokens = True
        #: A character of this vocabulary stands for one byte.
        vocabulary = self.byte_level.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.sizes[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self.marks: dict[str, np.ndarray] = {}
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ids, self.ends = np.empty(0, self.kind), np.zeros(1, np.int64)
        #: Byte-level tokens, and how many of them are of one byte.
        self.byte_tokens = np.empty((0, 2), np.int32)

    def learn(self, words: set[bytes]) -> None:
        missing = [w for w in words if w not in self]
        if len(self) + len(missing) > MOST_WORDS:
            self.forget()
            missing = list(words)
        if not missing:
            return
        texts = [w.decode("utf-8", "replace") for w in missing]
        found = self.model.encode(texts, num_threads=1)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), self.kind, int(counts.sum()))
        byte_tokens = self.byte_counts(missing, texts)
        self.update(zip(missing, range(len(self), len(self) + len(missing))))
        self.ids = np.concatenate([self.ids, flat])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
        self.byte_tokens = np.concatenate([self.byte_tokens, byte_tokens])

    def byte_counts(self, words: list[bytes], texts: list[str]) -> np.ndarray:
        """Byte-level tokens of each word as after a space, and those of one byte. The pre-tokeniser cuts letters from the marks behind
        them, so such a word's counts are those of its letters, often known, and of its marks."""
        out = np.zeros((len(words), 2), np.int32)
        letters: dict[str, list[int]] = {}
        known, known_at, others = [], [], []
        for i, (w, t) in enumerate(zip(words, texts)):
            stem = t.rstrip(MARKS)
            if not stem.isalpha():
                others.append(i)
                continue
            if stem != t:
                marks = t[len(stem):]
                if marks not in self.marks:
                    if len(self.marks) > MOST_MARKS:
                        self.marks.clear()
                    self.marks[marks] = self.counts_of([marks])[0]
                out[i] = self.marks[marks]
                number = self.get(w[:len(w) - len(marks)])
                if number is not None:
                    known.append(number)
                    known_at.append(i)
                    continue
            letters.setdefault(stem, []).append(i)
        out[known_at] += self.byte_tokens[known]
        if letters:
            sums = self.counts_behind_spaces(list(letters))
            out[list(chain.from_iterable(letters.values()))] += np.repeat(sums, list(map(len, letters.values())), axis=0)
        if others:
            out[others] = self.counts_of([" " + texts[i] for i in others])
        return out

    def counts_of(self, texts: list[str]) -> np.ndarray:
        out = []
        for start in range(0, len(texts), 4096):
            found = [x.ids for x in self.byte_level.encode_batch_fast(texts[start:start + 4096], add_special_tokens=False)]
            n = np.fromiter(map(len, found), np.int64, len(found))
            single = np.r_[0, np.cumsum(self.sizes[np.fromiter(chain.from_iterable(found), np.int64, int(n.sum()))] == 1)]
            ends = np.cumsum(n)
            out.append(np.stack([n, single[ends] - single[ends - n]], axis=1))
        return np.concatenate(out).astype(np.int32)

    def counts_behind_spaces(self, words: list[str]) -> np.ndarray:
        """For words of letters, many of them encoded as one text: the pre-tokeniser cuts it at each space."""
        out = []
        for start in range(0, len(words), 4096):
            part = words[start:start + 4096]
            ids = np.array(self.byte_level.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids)
            sizes = self.sizes[ids]
            ends = np.searchsorted(np.cumsum(sizes), np.cumsum([len(w.encode()) + 1 for w in part])) + 1
            single = np.r_[0, np.cumsum(sizes == 1)]
            starts = np.r_[0, ends[:-1]]
            out.append(np.stack([ends - starts, single[ends] - single[starts]], axis=1))
        return np.concatenate(out).astype(np.int32)

    def tokens(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the words in turn, and how many each word has."""
        starts = self.ends[numbers]
        n = self.ends[numbers + 1] - starts
        upto = np.cumsum(n)
        return self.ids[np.repeat(starts - (upto - n), n) + np.arange(upto[-1] if len(n) else 0)], n


def repeated_words(words: list[bytes], width: int = REPEAT_WIDTH) -> int:
    """Words inside windows that the text holds twice or more."""
    known: dict[bytes, int] = {}
    return repeated_numbers(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)), len(known), width)


def repeated_numbers(ids: np.ndarray, most: int, width: int = REPEAT_WIDTH) -> int:
    """The same for words given as numbers below ``most``."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    key = ids[:n]
    for k in range(1, width):
        if int(key.max() + 1) * most >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * most + ids[k:n + k]
    ordered = np.sort(key)
    again = ordered[1:] == ordered[:-1]
    if not again.any():
        return 0
    repeated = ordered[1:][again]
    twice = repeated[np.minimum(np.searchsorted(repeated, key), len(repeated) - 1)] == key
    covered = np.zeros(len(ids), bool)
    for k in range(width):
        covered[k:n + k] |= twice
    return int(covered.sum())


def repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(WHITE)]
    return len(lines) - len(set(lines))


def script_of(text: str) -> str:
    """Script of most letters, from the first word of their Unicode names; ties go to the first in the alphabet."""
    counts = Counter(LETTER.findall(text))
    scripts: Counter[str] = Counter()
    for letter, n in counts.items():
        scripts[unicodedata.name(letter, "UNKNOWN").split(" ")[0].lower()] += n
    return min(scripts, key=lambda s: (-scripts[s], s)) if scripts else "none"


def measure(docs: DataFrame, model_path: str, byte_path: str) -> DataFrame:
    """Base counts and fertility measures of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_store(("word pieces", model_path, byte_path), lambda: WordPieces(model_path, byte_path))
        for batch in rows_of(batches):
            texts = [t.as_py() or b"" for t in batch.column("text")]
            split = [t.split() for t in texts]
            pieces.learn(set(chain.from_iterable(split)))
            n_words = np.fromiter(map(len, split), np.int64, len(split))
            ends = np.r_[0, np.cumsum(n_words)]
            numbers = np.fromiter(map(pieces.__getitem__, chain.from_iterable(split)), np.int64, int(ends[-1]))
            del split
            all_ids, n_ids = pieces.tokens(numbers)
            id_ends = np.r_[0, np.cumsum(n_ids)][ends]
            byte_sums = np.r_[np.zeros((1, 2), np.int64), np.cumsum(pieces.byte_tokens[numbers], axis=0, dtype=np.int64)][ends]
            byte_sums = np.diff(byte_sums, axis=0).tolist()
            rows = []
            for i, (text, lang) in enumerate(zip(texts, batch.column("lang").to_pylist())):
                ids = all_ids[id_ends[i]:id_ends[i + 1]]
                ordered = np.sort(ids)
                counts = np.diff(np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True])) if len(ids) else np.empty(0, np.int64)
                share = counts / max(1, len(ids))
                chars = len(text.translate(None, WHITE).decode("utf-8", "replace"))
                # An even spread over n tokens has the entropy log n.
                entropy = float(-(share * np.log(share)).sum() / np.log(len(ids))) if len(ids) > 1 else 0.0
                n_bytes, n_single = byte_sums[i]
                group = lang if lang is not None else "script " + script_of(text.decode("utf-8", "replace"))
                rows.append((group, int(n_words[i]), chars, len(text) - len(text.translate(None, SYMBOLS)), repeated_lines(text),
                             repeated_numbers(numbers[ends[i]:ends[i + 1]], len(pieces)), len(ids), chars / max(1, len(ids)),
                             float(pieces.is_byte[ids].mean()) if len(ids) else 0.0, entropy,
                             chars / max(1, n_bytes), n_single / max(1, n_bytes)))
            group, *columns = zip(*rows)
            kinds = [pa.int64()] * 6 + [pa.float64()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(group, pa.string()),
                 *(pa.array(x, t) for x, t in zip(columns, kinds))],
                names=[c.split(" ")[0] for c in MEASURED_SQL.split(", ")])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return text_of(docs, lang.alias("lang")).mapInArrow(run, MEASURED_SQL)


def _long(measured: DataFrame) -> DataFrame:
    return measured.where("n_tokens > 0").select("band_group", "n_words", F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES])).alias("x")).select(
            "band_group", "n_words", "x.*")


def _quarters(rows: DataFrame, step: F.Column, names: dict[str, int]) -> DataFrame:
    """Per group and measure the named quarters of ``step`` (the smallest value that so many quarters do not exceed) and ``n_group``,
    under the group null those of all documents."""
    counts = rows.groupBy("band_group", "measure", step.cast("long").alias("step")).agg(F.count("*").alias("n"))
    both = counts.unionByName(counts.groupBy("measure", "step").agg(F.sum("n").alias("n"))
                              .withColumn("band_group", F.lit(None).cast("string")))
    group = Window.partitionBy("band_group", "measure")
    both = both.withColumn("upto", F.sum("n").over(group.orderBy("step"))).withColumn("total", F.sum("n").over(group))
    return both.groupBy("band_group", "measure").agg(F.max("total").alias("n_group"), *[
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("step"))).cast("double").alias(name) for name, k in names.items()])


def _drawn_in(found: DataFrame, names: list[str]) -> DataFrame:
    """Figures of each group, drawn towards those of all documents."""
    every = found.where("band_group IS NULL").select("measure", *[F.col(c).alias(f"all_{c}") for c in names])
    own = F.col("n_group") / (F.col("n_group") + F.lit(float(PRIOR)))
    return found.where("band_group IS NOT NULL").join(every, "measure").select(
        "band_group", "measure", *[(own * F.col(c) + (1 - own) * F.col(f"all_{c}")).alias(c) for c in names])


def bands(measured: DataFrame) -> DataFrame:
    """Per group and measure: the centre of the band, its least half width, and the scatter to divide by the root of the words."""
    long = _long(measured)
    centres = _quarters(long, F.round(F.col("value") * STEPS), {"q1": 1, "centre": 2, "q3": 3})
    centres = _drawn_in(centres.select("band_group", "measure", "n_group", *[(F.col(c) / STEPS).alias(c) for c in ("q1", "centre", "q3")]),
                        ["q1", "centre", "q3"])
    away = F.abs(F.col("value") - F.col("centre")) * F.sqrt("n_words")
    scatter = _quarters(long.join(centres.select("band_group", "measure", "centre"), ["band_group", "measure"]),
                        F.round(F.log(F.greatest(away, F.lit(1e-9))) * 100), {"scatter": 2})
    scatter = _drawn_in(scatter.withColumn("scatter", F.exp(F.col("scatter") / 100)), ["scatter"])
    range_, least = F.col("q3") - F.col("q1"), F.create_map(*[F.lit(x) for m in MEASURES for x in (m, LEAST_REACH[m])])
    entropy = F.col("measure") == "token_entropy"
    return centres.join(scatter, ["band_group", "measure"]).select(
        "band_group", "measure", "centre", F.greatest(F.when(entropy, ENTROPY_REACH * range_).otherwise(range_), least[F.col("measure")]).alias("least"),
        F.when(entropy, 0.0).otherwise(REACH * F.col("scatter")).alias("scatter"))


def judged(measured: DataFrame) -> DataFrame:
    """Verdicts: ``base_failed`` by the base rules, ``kept`` if neither they nor a band speak against the document."""
    groups = bands(measured).groupBy("band_group").agg(F.map_from_entries(F.collect_list(
        F.struct("measure", F.struct("centre", "least", "scatter")))).alias("limits"))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))

    def beyond(m):
        own = F.col("limits")[m]
        return F.abs(F.col(m) - own["centre"]) > F.greatest(own["least"], F.try_divide(own["scatter"], F.sqrt("n_words")))

    outside = [F.when(beyond(m), F.lit(m)) for m in MEASURES]
    return (measured.join(groups, "band_group", "left").withColumn("base_failed", base)
            .withColumn("outside", F.array_compact(F.array(*outside)))
            .withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0)).drop("limits", "band_group"))


def quality_rules(docs: DataFrame, model_path: str, byte_path: str) -> DataFrame:
    return judged(written(measure(docs, model_path, byte_path), "fertility"))
