"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton of all items (one block of items at a time, each block bounded in words) is walked by every document's words; the walk
carries the length of the longest item passage that ends at the current word. A word is hit when it lies inside an occurrence of an
item window (``n`` consecutive item words, or a whole item that is shorter). Hit spans can be cut from the text, and documents whose
hit share exceeds a limit can be refused.

Scale: documents are only scanned, never shuffled; the items are the stated query set. They travel in blocks of ``BLOCK_WORDS`` words,
each a broadcast of its own that workers turn into an automaton; a worker holds ``HELD`` automata at most.

Edge cases: null text has no words, like an empty one; null item text has no windows; rows with a null item_id are hit like others and
their id counts as the empty string; repeated items (same id) count once; an empty benchmark or document table gives zero counts or no
rows; other columns are ignored by name, so none can clash.
"""

from __future__ import annotations

import hashlib
import re
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import LETTER_DIGIT_WORDS, rows_of, text_of, worker_store

#: Words of items in one automaton; about 100,000 states.
BLOCK_WORDS = 50_000
#: Automata that a worker keeps.
HELD = 4
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
          "longest_match long, item_ids array<string>, clean_text string")


class ItemAutomaton:
    """Suffix automaton of several word sequences; states know which items' windows they stand for."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.n = n
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        split = [(item_id, text.translate(LETTER_DIGIT_WORDS).split()) for item_id, text in items]
        for _, words in split:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self._find_windows(split)

    def _state(self, length: int, link: int, edges: dict[bytes, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.length) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """State for the strings of ``q`` no longer than those of ``p`` plus ``w``; ``q`` itself if it has only those."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        known = self.next[last].get(w)
        if known is not None:
            return self._split(last, w, known)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.next[p][w])
        return new

    def _shortest(self, state: int) -> int:
        """The state that holds the last ``n`` words of the strings of ``state``."""
        while self.length[self.link[state]] >= self.n:
            state = self.link[state]
        return state

    def _find_windows(self, split: list[tuple[str, list[bytes]]]) -> None:
        n, own, whole = self.n, {}, {}
        for item_id, words in split:
            state = 0
            for i, w in enumerate(words):
                state = self.next[state][w]
                if i + 1 >= n:
                    own.setdefault(self._shortest(state), set()).add(item_id)
            if 0 < len(words) < n:
                whole.setdefault(state, []).append((len(words), item_id))
        #: Items whose window is the last n words at a state.
        self.window_items: list[set[str] | None] = [
            own.get(self._shortest(v)) if length >= n else None for v, length in enumerate(self.length)]
        #: Short items that end at a state, over its whole chain of suffixes.
        self.short_items: list[tuple[tuple[int, str], ...]] = [()] * len(self.length)
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.short_items[v] = (*whole.get(v, ()), *self.short_items[self.link[v]])

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit spans (first word, word after the last) in order of their ends, items found, longest item passage."""
        nexts, link, lengths, n = self.next, self.link, self.length, self.n
        root, window_items, short_items = nexts[0], self.window_items, self.short_items
        spans, items, longest, state, length = [], set(), 0, 0, 0
        for i, w in enumerate(words):
            to = nexts[state].get(w)
            if to is None:
                if not state:
                    continue
                if w not in root:
                    state = length = 0
                    continue
                while to is None:
                    state = link[state]
                    to = nexts[state].get(w)
                length = lengths[state]
            state, length = to, length + 1
            if length > longest:
                longest = length
            if length >= n:
                spans.append((i + 1 - n, i + 1))
                items |= window_items[state]
            if short_items[state]:
                for m, item_id in short_items[state]:
                    if m <= length:
                        spans.append((i + 1 - m, i + 1))
                        items.add(item_id)
        return spans, items, longest


def _automaton(digest: str, block, n: int) -> ItemAutomaton:
    held, key = worker_store(("automata",), OrderedDict), (digest, n)
    if key not in held:
        while len(held) >= HELD:
            held.popitem(last=False)
        held[key] = ItemAutomaton(block.value, n)
    held.move_to_end(key)
    return held[key]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of the spans and what stands between them."""
    places = [m.span() for m in WORD.finditer(text)]
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, text[at:]])


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about ``block_words`` words; one block at a time is in the driver's memory."""
    block, words = [], 0
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                        F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    for row in rows.toLocalIterator():
        n = len(row.text.translate(LETTER_DIGIT_WORDS).split())
        if block and words + n > block_words:
            yield block
            block, words = [], 0
        block.append((row.item_id, bytes(row.text)))
        words += n
    if block:
        yield block


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, max_share: float = 1.0, clean: bool = False) -> DataFrame:
    """One row per document: counts, items found, and with ``clean`` the text without its hit spans.

    ``clean_text`` is null where more than ``max_share`` of the words are hit: such a document is to be refused.
    """
    spark = docs.sparkSession
    blocks = [(hashlib.sha256(repr(b).encode()).hexdigest(), spark.sparkContext.broadcast(b)) for b in item_blocks(items)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            out = {name: [] for name in ("n_words", "n_hit", "n_items", "sha", "longest", "ids", "clean")}
            for text in batch.column("text"):
                text = text.as_py() or b""
                words = text.translate(LETTER_DIGIT_WORDS).split()
                spans, ids, longest = [], set(), 0
                for digest, block in blocks:
                    more, found, length = _automaton(digest, block, n).match(words)
                    spans += more
                    ids |= found
                    longest = max(longest, length)
                spans = merged(spans)
                hit, ids = sum(b - a for a, b in spans), sorted(ids)
                out["n_words"].append(len(words))
                out["n_hit"].append(hit)
                out["n_items"].append(len(ids))
                out["sha"].append(hashlib.sha256(",".join(ids).encode()).hexdigest())
                out["longest"].append(longest)
                out["ids"].append(ids)
                keep = clean and hit <= max_share * len(words)
                out["clean"].append(cut(text, spans).decode("utf-8", "replace") if keep else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(out[k], pa.int64()) for k in ("n_words", "n_hit", "n_items")),
                 pa.array(out["sha"], pa.string()), pa.array([h > 0 for h in out["n_hit"]], pa.bool_()),
                 pa.array(out["longest"], pa.int64()), pa.array(out["ids"], pa.list_(pa.string())), pa.array(out["clean"], pa.string())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "item_ids",
                       "clean_text"])

    return text_of(docs).mapInArrow(find, SCHEMA)
