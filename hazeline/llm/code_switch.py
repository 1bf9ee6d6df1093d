"""Language of documents by a linear-chain conditional random field over their words.

Each word gets a score per language from hashed features (the word, prefixes and suffixes up to four letters, letter pairs and
triples, and a lexicon of frequent words); transitions between languages are learned. Forward-backward labels every word, so mixed
texts are seen as such; the document takes the language with most of its letters, and the score is that share. A run of letters longer
than ``LONGEST_PIECE`` bytes, as scripts without spaces have, is read in pieces that are each labelled; ``n_words`` counts the run once.

Fitting: labelled rows with a non-null language; a hash of doc_id picks about ``SAMPLE_DOCS`` of each language (a bound on the fit,
not on what is labelled). Runs of their words are strung together across languages, which teaches the transitions. Scale: one scan
labels all; the model (weights of ``BUCKETS`` features) is what travels.

Edge cases: null text and text without a letter give ``und`` and score 0; so does everything if no row is labelled; a tie goes to the
language that is first in the alphabet; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import rows_of, text_of, worker_store

SAMPLE_DOCS = 500
BUCKETS = 1 << 16
#: Training sequences, their length, and the longest run of one document's words in them.
SEQUENCES, LENGTH, LONGEST_RUN = 1500, 32, 24
ROUNDS, RATE, SHRINK = 40, 0.25, 1e-4
LEXICON_SHARE, LEXICON_LEAST = 0.9, 5
MOST_WORDS = 400_000
#: Bytes of a run of letters that are one place of the chain.
LONGEST_PIECE = 40
#: Words to a step of the scan over a document.
BLOCK = 32
LETTER = re.compile(r"[^\W\d_]")
#: ASCII that is no letter separates words.
LETTERS_ONLY = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long"


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(LETTERS_ONLY).split()


def pieces_of(words: list[bytes]) -> list[bytes]:
    """The words, those longer than ``LONGEST_PIECE`` cut between characters."""
    if not words or max(map(len, words)) <= LONGEST_PIECE:
        return words
    out = []
    for w in words:
        at = 0
        while len(w) - at > LONGEST_PIECE:
            end = at + LONGEST_PIECE
            while w[end] & 0xC0 == 0x80:
                end -= 1
            out.append(w[at:end])
            at = end
        out.append(w[at:])
    return out


def features(word: bytes, lexicon: dict[bytes, int]) -> list[int]:
    """Buckets of a word's features."""
    w = b"^" + word + b"$"
    n, crc = len(w), zlib.crc32
    found = [crc(w)]
    found += [crc(w[:k], 1) for k in range(2, min(5, n) + 1)]
    found += [crc(w[-k:], 2) for k in range(2, min(5, n) + 1)]
    found += [crc(w[i:i + 2], 3) for i in range(1, n - 2)]
    found += [crc(w[i:i + 3], 4) for i in range(n - 2)]
    if word in lexicon:
        found.append(crc(b"%d" % lexicon[word], 5))
    return [f % BUCKETS for f in found]


@dataclass
class Field:
    """A fitted field: languages, feature weights, transition scores."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[bytes, int]


def marginals(unary: np.ndarray, counts: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    return forward_backward(unary, counts, transitions)[1]


def forward_backward(unary: np.ndarray, counts: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each label at each word, given the words up to it and given all; ``unary`` holds all sequences in a row.

    Sequences are cut in blocks. A block's steps multiply to one matrix, a scan over the matrices gives what enters each block from
    both sides, and the inside of all blocks is then done side by side. The label before a sequence counts as evenly spread.
    """
    k, step = unary.shape[1], np.exp(transitions)
    blocks = -(-counts // BLOCK)
    first = np.cumsum(blocks) - blocks
    starts = np.cumsum(counts) - counts
    number = np.arange(blocks.sum()) - np.repeat(first, blocks)
    place = np.repeat(starts, blocks)[:, None] + number[:, None] * BLOCK + np.arange(BLOCK)
    real = place < np.repeat(starts + counts, blocks)[:, None]
    seen = np.exp(unary - unary.max(1, keepdims=True))[np.where(real, place, 0)]

    product = np.broadcast_to(np.eye(k), (len(place), k, k)).copy()
    for t in range(BLOCK):
        moved = (product.reshape(-1, k) @ step).reshape(-1, k, k) * seen[:, t, None, :]
        product = np.where(real[:, t, None, None], moved / moved.sum((1, 2), keepdims=True), product)
    left, right = np.full((len(place), k), 1 / k), np.full((len(place), k), 1 / k)
    for j in range(1, int(blocks.max(initial=0))):
        at = (first + j)[blocks > j]
        moved = np.einsum("bi,bij->bj", left[at - 1], product[at - 1])
        left[at] = moved / moved.sum(1, keepdims=True)
        at = (first + blocks - 1 - j)[blocks > j]
        moved = np.einsum("bij,bj->bi", product[at + 1], right[at + 1])
        right[at] = moved / moved.sum(1, keepdims=True)

    forward = np.empty(seen.shape)
    for t in range(BLOCK):
        moved = (left @ step) * seen[:, t]
        left = np.where(real[:, t, None], moved / moved.sum(1, keepdims=True), left)
        forward[:, t] = left
    upto, out = np.empty(unary.shape), np.empty(unary.shape)
    upto[place[real]] = forward[real]
    for t in range(BLOCK - 1, -1, -1):
        both = forward[:, t] * right
        out[place[real[:, t], t]] = (both / both.sum(1, keepdims=True))[real[:, t]]
        moved = (seen[:, t] * right) @ step.T
        right = np.where(real[:, t, None], moved / moved.sum(1, keepdims=True), right)
    return upto, out


def fit(sample: list[tuple[str, str]], seed: int = 7) -> Field:
    """Field from (language, text) rows."""
    by_language: dict[str, list[list[bytes]]] = {}
    for lang, text in sample:
        if words := pieces_of(words_of(text or "")):
            by_language.setdefault(lang, []).append(words)
    languages = sorted(by_language)
    k = len(languages)
    spread = {lang: Counter(w for words in texts for w in set(words)) for lang, texts in by_language.items()}
    total = sum(spread.values(), Counter())
    lexicon = {w: i for i, lang in enumerate(languages) for w, n in spread[lang].items()
               if total[w] >= LEXICON_LEAST and n >= LEXICON_SHARE * total[w]}
    field = Field(languages, np.zeros((BUCKETS, k)), np.zeros((k, k)), lexicon)
    if k < 2:
        return field

    rng = np.random.default_rng(seed)
    words, labels = [], np.empty(SEQUENCES * LENGTH, np.int64)
    while len(words) < len(labels):
        i = int(rng.integers(k))
        texts = by_language[languages[i]]
        text = texts[int(rng.integers(len(texts)))]
        n = min(int(rng.integers(1, LONGEST_RUN + 1)), len(text), len(labels) - len(words))
        at = int(rng.integers(len(text) - n + 1))
        labels[len(words):len(words) + n] = i
        words += text[at:at + n]
    found = [features(w, lexicon) for w in words]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat, ends = np.concatenate([np.array(f) for f in found]), np.cumsum(sizes) - sizes
    counts, truth = np.full(SEQUENCES, LENGTH), np.eye(k)[labels]
    inner = np.arange(len(labels)).reshape(SEQUENCES, LENGTH)
    before, after = inner[:, :-1].ravel(), inner[:, 1:].ravel()
    squares = [np.full(x.shape, 1e-8) for x in (field.weights, field.transitions)]
    for _ in range(ROUNDS):
        unary = np.add.reduceat(field.weights[flat], ends)
        upto, p = forward_backward(unary, counts, field.transitions)
        wide = np.repeat(truth - p, sizes, axis=0)
        slope = np.stack([np.bincount(flat, wide[:, i], BUCKETS) for i in range(k)], 1) - SHRINK * len(labels) * field.weights
        # Pairs expected: what comes before moves by the transitions, and each label after has its share of what moved there.
        step = np.exp(field.transitions)
        pair = upto[before][:, :, None] * step * (p[after] / (upto[before] @ step))[:, None, :]
        move = truth[before].T @ truth[after] - pair.sum(0) - SHRINK * len(labels) * field.transitions
        for x, g, q in ((field.weights, slope, squares[0]), (field.transitions, move, squares[1])):
            q += g * g
            x += RATE * g / np.sqrt(q)
    return field


def training_sample(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """About ``per_language`` labelled documents of each language, chosen by a hash of doc_id."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text",
                                                                      F.xxhash64("doc_id").alias("h"))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    parts = 1 << 62
    chosen = F.lit(False)
    for lang, n in sizes.items():
        share = min(1.0, per_language / n)
        chosen = chosen | ((F.col("lang") == lang) & (F.pmod("h", F.lit(parts)) < int(share * parts)))
    return [(r.lang, r.text) for r in known.where(chosen).select("lang", "text", "h").orderBy("h", "lang").collect()]


class WordScores(dict):
    """Row numbers of word scores; the store empties when full."""

    def __init__(self, field: Field):
        super().__init__()
        self.field = field
        self.weights = field.weights.astype(np.float32)
        self.rows = np.zeros((MOST_WORDS, max(1, len(field.languages))), np.float32)

    def of(self, words: list[bytes]) -> np.ndarray:
        missing = {w for w in words if w not in self}
        if len(self) + len(missing) > len(self.rows):
            self.clear()
            missing = set(words)
            if len(missing) > len(self.rows):
                self.rows = np.zeros((2 * len(missing), self.rows.shape[1]), np.float32)
        lexicon, start = self.field.lexicon, len(self)
        if missing:
            found = [features(w, lexicon) for w in missing]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((f for x in found for f in x), np.int64, int(sizes.sum()))
            self.rows[start:start + len(found)] = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes)
            self.update(zip(missing, range(start, start + len(found))))
        return self.rows[np.fromiter(map(self.__getitem__, words), np.int64, len(words))]


def label_documents(docs: DataFrame, field: Field, held_out: F.Column) -> DataFrame:
    """Language, score, words and language switches of every document."""
    model = docs.sparkSession.sparkContext.broadcast(field)
    key = np.array([zlib.crc32(x.tobytes()) for x in (field.weights, field.transitions)]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = worker_store(("word scores", key), lambda: WordScores(model.value))
        languages = scores.field.languages
        for batch in rows_of(batches, 2 << 20):
            texts = [(t.as_py() or b"").decode("utf-8", "replace") for t in batch.column("text")]
            split = [words_of(t) if languages and LETTER.search(t) else [] for t in texts]
            n_words = np.fromiter(map(len, split), np.int64, len(split))
            split = list(map(pieces_of, split))
            counts = np.fromiter(map(len, split), np.int64, len(split))
            names, shares, switches = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            words = [w for s in split for w in s]
            if words:
                p = marginals(scores.of(words).astype(np.float64), counts[counts > 0], scores.field.transitions)
                some = np.flatnonzero(counts)
                starts = (np.cumsum(counts) - counts)[some]
                weight = np.fromiter(map(len, words), np.float64, len(words))
                mass = np.add.reduceat(p * weight[:, None], starts)
                mass /= mass.sum(1, keepdims=True)
                best, label = mass.argmax(1), p.argmax(1)
                turns = np.r_[0, label[1:] != label[:-1]]
                turns[starts] = 0
                switches[some], shares[some] = np.add.reduceat(turns, starts), mass.max(1)
                for d, b in zip(some, best):
                    names[d] = languages[b]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(names, pa.string()), pa.array(shares),
                 pa.array(n_words), pa.array(switches)], names=[c.split(" ")[0] for c in SCHEMA.split(", ")])

    return text_of(docs, held_out.alias("held_out")).mapInArrow(run, SCHEMA)


def identify_languages(docs: DataFrame, parts: int = 3, held_part: int = 1) -> DataFrame:
    """Fit on the labelled documents outside the held-out part of doc_id, label all."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == held_part, F.lit(False))
    return label_documents(docs, fit(training_sample(docs.where(~held_out))), held_out)
