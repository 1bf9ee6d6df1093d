"""Exact SentencePiece BPE encoding by backtracking over longest matches, and decoding.

A segment's longest vocabulary matches at every character come from one Aho-Corasick pass. The encoder extends a list of pieces by the
longest match that is compatible with the piece before it: two adjacent pieces are compatible when merging their joined characters
anew gives the same two pieces back. If no piece fits, the last one is replaced by its next shorter prefix, and a bit field marks the
positions from which no encoding was found, so none is tried twice. A sequence whose neighbours are all compatible is the result of
the merges. Runs of spaces are merged directly, because their pieces share one rank.

No piece of the vocabulary holds a space mark after another character, nor a line break with anything else, so a text is encoded
segment by segment, cut there; segments repeat and are kept. The segments of a batch that are not known yet take each step (a piece
tried, taken or taken back) together, in arrays; few or unusual ones are encoded one by one. Merging two pieces' characters anew replays the
merges of both, recorded once per piece, side by side. Scale: a scan; no shuffle, nothing broadcast but the model's path.

Edge cases: null text is the empty text, which is encoded as begin and end ids alone; characters outside the vocabulary become bytes;
invalid UTF-8 becomes U+FFFD first; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from hazeline.llm.common import rows_of, text_of, worker_store

SPACE = "▁"
SEGMENT = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
#: Segments longer than this are encoded anew each time; the stores of segments and pairs are emptied at these sizes. A segment costs
#: about ``SEGMENT_COST`` bytes besides its text and ids.
LONGEST_KEPT, MOST_SEGMENT_BYTES, SEGMENT_COST, MOST_PAIRS = 64, 64 << 20, 200, 200_000
#: Fewer open segments than this are gone through one by one; bits of the number of places for pairs of ids that were compared.
LEAST_TOGETHER, PAIR_BITS = 48, 20
#: A match is an id and, in the low bits, the number of characters.
SIZE_BITS, LARGEST = 16, 0xFFFF
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string"


class PieceEncoder:
    """Vocabulary and ranks of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes = [0] * 256
        self.spelt: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.spelt.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.spelt.append(b" \xe2\x81\x87 " if model.is_unknown(i) else b"")
            else:
                self.id[piece], self.score[piece] = i, model.get_score(i)
                self.spelt.append(piece.replace(SPACE, " ").encode())
        self.trie = ahocorasick.Automaton()
        for piece in self.id:
            if len(piece) > 1 and SPACE * 2 not in piece and self.merge(piece) == [piece]:
                self.trie.add_word(piece, self.id[piece] << SIZE_BITS | len(piece))
        self.trie.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.segments: dict[str, bytes] = {}
        self.held = 0
        # The same as arrays, for segments that are encoded together. An id of ``none`` stands for a character outside the vocabulary.
        self.none = model.get_piece_size()
        self.piece = {i: piece for piece, i in self.id.items()}
        self.length = np.ones(self.none + 1, np.int64)
        self.length[list(self.piece)] = [len(piece) for piece in self.piece.values()]
        single = {ord(piece): i for piece, i in self.id.items() if len(piece) == 1}
        self.single = np.full(max(single, default=0) + 2, self.none, np.int32)
        self.single[list(single)] = list(single.values())
        self.spellings = pa.array(self.spelt, pa.binary())
        self.compared = np.full(1 << PAIR_BITS, -1)
        self.traces: dict[int, tuple[list[str], list[str], list[float]]] = {}

    def merge(self, text: str, trace: list[tuple[int, int, float]] | None = None) -> list[str]:
        """Pieces of ``text`` by doing the merges: best score first, leftmost among equals. ``trace`` gets each merge: where its two
        pieces start, and its score."""
        symbols: list[str | None] = list(text)
        before, after = list(range(-1, len(text) - 1)), [*range(1, len(text)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (joined := symbols[a] + symbols[b]) in self.score:
                heapq.heappush(heap, (-self.score[joined], a, b, joined))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if symbols[a] is None or symbols[b] is None or after[a] != b or symbols[a] + symbols[b] != joined:
                continue
            symbols[a], symbols[b] = joined, None
            if trace is not None:
                trace.append((a, b, self.score[joined]))
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s in symbols if s is not None]

    def compatible(self, a: str, b: str) -> bool:
        key = (a, b)
        if key not in self.pairs:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            self.pairs[key] = self.merge(a + b) == [a, b]
        return self.pairs[key]

    def pieces(self, segment: str) -> list[str]:
        """Pieces of a segment; characters outside the vocabulary stand as they are."""
        if SPACE * 2 in segment:
            return self.merge(segment)
        # Matches come in order of their ends, so the longest from each start stays.
        longest = {last - (found & LARGEST): found & LARGEST for last, found in self.trie.iter(segment)}
        pairs, at, n, before, out = self.pairs, 0, len(segment), "", []
        while at < n:  # most segments need no step back
            piece = segment[at:at + longest.get(at - 1, 1)]
            if before and not (pairs[before, piece] if (before, piece) in pairs else self.compatible(before, piece)):
                return self.backtrack(segment)
            out.append(piece)
            before = piece
            at += len(piece)
        return out

    def backtrack(self, segment: str) -> list[str]:
        """The same with steps back: shorter matches in turn, positions without an encoding marked in a bit field."""
        n = len(segment)
        fits: dict[int, list[int]] = {}
        for last, found in self.trie.iter(segment):
            fits.setdefault(last - (found & LARGEST) + 1, [1]).append(found & LARGEST)
        alone, pairs = [1], self.pairs
        failed, starts = bytearray(n + 1), []
        at, choice, before = 0, len(fits.get(0, alone)) - 1, ""
        while at < n:
            sizes = fits.get(at, alone)
            while choice >= 0:
                end = at + sizes[choice]
                if not failed[end]:
                    piece = segment[at:end]
                    if not before or (pairs[before, piece] if (before, piece) in pairs else self.compatible(before, piece)):
                        break
                choice -= 1
            if choice >= 0:
                starts.append(at)
                at, before = end, piece
                choice = len(fits.get(at, alone)) - 1
            else:
                failed[at] = 1
                end, at = at, starts.pop()
                choice = fits.get(at, alone).index(end - at) - 1
                before = segment[starts[-1]:at] if starts else ""
        return [segment[a:b] for a, b in zip(starts, [*starts[1:], n])]

    def trace(self, i: int) -> tuple[list[str], list[str], list[float]]:
        """First and last symbol of a piece before each of its merges, in their order, and after them; the scores of the merges."""
        if i not in self.traces:
            piece, steps = self.piece[i], []
            self.merge(piece, steps)
            first, last, starts = [1], [len(piece) - 1], set(range(1, len(piece)))
            for a, b, _ in steps:
                starts.remove(b)
                first.append(min(starts, default=len(piece)))
                last.append(a if b == last[-1] else last[-1])
            self.traces[i] = [piece[:x] for x in first], [piece[x:] for x in last], [*(s for _, _, s in steps), -np.inf]
        return self.traces[i]

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether merging the characters of two pieces, given by their ids, gives the two back: no merge across their border is ever
        the best one. Merges on both sides go on as in each piece alone; among equals the left one comes first."""
        if a == self.none or b == self.none:
            return True
        (_, ends, left), (begins, _, right) = self.trace(a), self.trace(b)
        score, i, j = self.score, 0, 0
        while True:
            across = score.get(ends[i] + begins[j])
            if across is not None and across > left[i] and across >= right[j]:
                return False
            if left[i] >= right[j]:
                if left[i] == -np.inf:
                    return True
                i += 1
            else:
                j += 1

    def compatible_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``stay_apart`` of many pairs of ids; each place of the table keeps the last pair that fell there."""
        key = a * (self.none + 1) + b
        with np.errstate(over="ignore"):
            place = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        known = self.compared[place]
        out = (known & 1).astype(bool)
        new = np.flatnonzero(known >> 1 != key)
        if len(new):
            _, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            at = new[first]
            found = np.fromiter(map(self.stay_apart, a[at].tolist(), b[at].tolist()), bool, len(at))
            self.compared[place[at]] = 2 * key[at] + found
            out[new] = found[back]
        return out

    def encode_together(self, segments: list[str]) -> dict[str, bytes]:
        """Packed ids of segments without line break or two space marks in a row; all open ones take each step together.

        A position is entered once at most: one that is stepped back from has failed. So what led there can stand at the position.
        Segments with characters outside the vocabulary, or still open when few are, are missing from the result.
        """
        joined = "\n".join(segments)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        begin = np.cumsum(sizes + 1) - sizes - 1
        stop, n = begin + sizes, len(joined) + 1
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        alone = self.single[np.minimum(code, len(self.single) - 1)].astype(np.int64)
        matches = np.fromiter(chain.from_iterable(self.trie.iter(joined)), np.int64).reshape(-1, 2)
        # Matches come in order of their ends, so those from one start, kept in order, come in order of their sizes.
        start = matches[:, 0] + 1 - (matches[:, 1] & LARGEST)
        match = (matches[:, 1] >> SIZE_BITS)[np.argsort(start, kind="stable")]
        count = np.bincount(start, minlength=n)
        offset = np.cumsum(count) - count
        before, via, chosen = np.full(n, -1), np.full(n, self.none), np.zeros(n, np.int64)
        failed = np.zeros(n, bool)
        open_ = np.arange(len(segments))
        at, choice = begin.copy(), count[begin]
        while len(open_) >= LEAST_TOGETHER:
            here, c = at[open_], choice[open_]
            tried = c >= 0
            piece = alone[here]
            several = np.flatnonzero(c > 0)
            piece[several] = match[offset[here[several]] + c[several] - 1]
            end = here + self.length[piece]
            fits = tried & ~failed[end]
            asked = np.flatnonzero(fits & (here != begin[open_]))
            fits[asked] = self.compatible_all(via[here[asked]], piece[asked])
            taken, h, e = open_[fits], here[fits], end[fits]
            chosen[h], before[e], via[e], at[taken] = c[fits], h, piece[fits], e
            choice[taken] = count[np.minimum(e, n - 1)]
            choice[open_[tried & ~fits]] -= 1
            back = open_[~tried]
            failed[at[back]] = True
            at[back] = before[at[back]]
            choice[back] = chosen[at[back]] - 1
            open_ = open_[at[open_] < stop[open_]]
        done = np.ones(len(segments), bool)
        done[open_] = False
        path = np.zeros(n, bool)
        walk, first = stop[done], begin[done]
        while len(walk):
            path[walk] = True
            walk = before[walk]
            walk, first = walk[walk > first], first[walk > first]
        ids = via[path]
        ends = np.cumsum(path)[stop]  # a segment's places end where it stops; its first character is no end of a piece
        starts = ends - np.bincount(np.repeat(np.arange(len(segments)), sizes + 1), path.astype(float), len(segments)).astype(np.int64)
        done &= np.bincount(np.repeat(np.arange(len(segments)), ends - starts), ids == self.none, len(segments)) == 0
        packed = ids.astype("<u4").tobytes()
        return {segments[k]: packed[4 * starts[k]:4 * ends[k]] for k in np.flatnonzero(done).tolist()}

    def encode_segment(self, segment: str) -> bytes:
        ids: list[int] = []
        for piece in self.pieces(segment):
            known = self.id.get(piece)
            ids += [known] if known is not None else [self.bytes[b] for b in piece.encode()]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers, without begin and end."""
        cut = [SEGMENT.findall(SPACE + text.replace(" ", SPACE)) if text else [] for text in texts]
        if self.held >= MOST_SEGMENT_BYTES:
            self.segments.clear()
            self.held = 0
        known = self.segments
        missing = list(set().union(*cut).difference(known))
        plain = [s for s in missing if len(s) <= LONGEST_KEPT and SPACE * 2 not in s and s != "\n"]
        new = self.encode_together(plain) if len(plain) >= LEAST_TOGETHER else {}
        for segment in missing:
            if segment not in new:
                new[segment] = self.encode_segment(segment)
        long = {s: new.pop(s) for s in missing if len(s) > LONGEST_KEPT}
        known.update(new)
        self.held += SEGMENT_COST * len(new) + 2 * sum(map(len, new)) + sum(map(len, new.values()))
        if long:
            return [b"".join([known.get(s) or long[s] for s in segments]) for segments in cut]
        return [b"".join(map(known.__getitem__, segments)) for segments in cut]

    def encode_packed(self, text: str) -> bytes:
        """Ids of one text."""
        return self.encode_batch([text])[0]

    def decode(self, ids) -> str:
        """Text of ids: pieces joined, bytes read as UTF-8, the leading space mark dropped."""
        return self.decode_batch(np.asarray(ids, np.int64), [len(ids)])[0]

    def decode_batch(self, ids: np.ndarray, counts: list[int]) -> list[str]:
        """Texts of many sequences of ids, which follow each other in ``ids``."""
        spelt = self.spellings.take(pa.array(ids))
        ends = np.frombuffer(spelt.buffers()[1], np.int32)[np.r_[0, np.cumsum(counts, dtype=np.int64)]].tolist()
        data = memoryview(spelt.buffers()[2] or b"")
        texts = [str(data[a:b], "utf-8", "replace") for a, b in zip(ends, ends[1:])]
        return [text[1:] if text.startswith(" ") else text for text in texts]


def encoder(path: str) -> PieceEncoder:
    return worker_store(("pieces", path), lambda: PieceEncoder(path))


def encode_pieces(docs: DataFrame, model_path: str, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Ids with begin and end of every text, their digest and the digest of the decoded text; on request ids and text themselves."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        begin, end = struct.pack("<I", own.begin), struct.pack("<I", own.end)
        for batch in rows_of(batches, 1 << 20):
            texts = [(text.as_py() or b"").decode("utf-8", "replace") for text in batch.column("text")]
            packed = [begin + ids + end for ids in own.encode_batch(texts)]
            counts = [len(ids) // 4 for ids in packed]
            flat = np.frombuffer(b"".join(packed), "<i4")
            decoded = own.decode_batch(flat, counts)
            digests = [hashlib.sha256(ids).hexdigest() for ids in packed]
            decoded_digests = [hashlib.sha256(text.encode()).hexdigest() for text in decoded]
            if with_ids:  # the packed ids are the column's values, no Python number is made of them
                all_ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(flat))
            else:
                all_ids = pa.nulls(len(counts), pa.list_(pa.int32()))
            decoded_texts = decoded if with_text else [None] * len(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string()),
                 pa.array(decoded_digests, pa.string()), all_ids, pa.array(decoded_texts, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])

    return text_of(docs).mapInArrow(encode, SCHEMA)
