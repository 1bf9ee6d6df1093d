"""Secret scans: candidate strings judged by a random forest.

A pattern proposes candidates: long unbroken strings and values assigned to a name. Each gets features: length, shares of character
classes, changes of class between neighbours, entropy, how much of it a dictionary of the corpus covers, whether it reads like a path,
and what the words around it suggest. A random forest (MLlib) fitted on labelled findings removes false positives; its trees then
travel as arrays, so that documents are scanned and judged in one pass and never shuffled.

Labelled findings: rows (value, before, after, label). Where none are given, ``seed_findings`` derives them from the corpus by rules
of high precision: published key formats and values assigned to names of credentials are findings; words of letters alone, mail and
network addresses, card and phone numbers are not; whatever no rule decides is left out. All documents are read for them and for the
dictionary; only the findings of the fit are bounded (``MOST_FINDINGS``, half of either label, those with the smallest hashes).

Edge cases: null or empty text has no candidates; without findings of both kinds every candidate that a rule calls a finding is one;
an empty table gives no rows; other columns are ignored (``clean`` keeps them all and replaces ``text``).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import drop_stores, rows_of, text_of, written

MOST_FINDINGS = 6000
TREES, DEPTH, SEED = 30, 6, 11
DICTIONARY_WORDS, DICTIONARY_SHORTEST = 5000, 3
SHORTEST = 12
MASK = "<secret>"
SCHEMA = ("doc_id long, n_candidates int, n_secrets int, "
          "secrets array<struct<start: int, stop: int, kind: string, score: double>>, clean_text string")

# Published key formats and names of credentials.
FORMATS = {
    "aws_access_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[0-9A-Za-z]{36}",
    "slack_token": r"xox[abprs]-[0-9A-Za-z-]{10,}",
    "google_key": r"AIza[0-9A-Za-z_-]{35}",
    "stripe_key": r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}",
    "web_token": r"eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{5,}",
}
CREDENTIAL_NAMES = "password passwd pwd passphrase secret token apikey api_key access_key private_key auth credential bearer".split()
HINTS = [*CREDENTIAL_NAMES, "key", "login", "user", "id", "hash", "commit", "sha", "uuid", "file", "path", "mail", "phone", "card", "ip"]
FORMAT = re.compile("|".join(f"(?P<{k}>{p})" for k, p in FORMATS.items()))
ASSIGNED = re.compile(r"(?:^|[^A-Za-z])(" + "|".join(CREDENTIAL_NAMES) + r")[\"']?\s*[:=]\s*[\"']?$", re.IGNORECASE)
#: A name of a credential with its value, or an unbroken string; both keep to characters that keys are written in.
CANDIDATE = re.compile(
    r"(?:(?<![A-Za-z])(?i:" + "|".join(CREDENTIAL_NAMES) + r")[\"']?\s*[:=]\s*[\"']?)(?P<value>[^\s\"',;]{6,})"
    r"|(?P<string>[A-Za-z0-9+/_=.@-]{%d,})" % SHORTEST)
NOT_SECRET = re.compile(r"[A-Za-z]+[.,]?|[\w.+-]+@[\w.-]+\.\w+|\d{1,3}(?:\.\d{1,3}){3}|\d{12,19}|[\d()+-]{7,}|[A-Za-z]+(?:[-.][A-Za-z]+)+[.,]?")
CLASSES = ("lower", "upper", "digit", "other")
NAMES = ("length", *CLASSES, "changes", "entropy", "dictionary", "distinct", "longest_run", "path", "assigned", "quoted", *HINTS)


@dataclass
class Forest:
    """Trees as arrays: per node the feature, the threshold, both children and the share of findings below it."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    dictionary: frozenset[str]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean share of findings in the leaves."""
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                go_left = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(feature[at] < 0, at, np.where(go_left, left[at], right[at]))
            total += share[at]
        return total / max(1, len(self.trees))


def candidates(text: str) -> Iterator[tuple[int, int]]:
    for m in CANDIDATE.finditer(text):
        start, stop = m.span("value") if m["value"] else m.span("string")
        while stop > start and text[stop - 1] in ".,=-" and not (text[stop - 1] == "=" and stop - start > SHORTEST):
            stop -= 1
        if stop - start >= 6 and not text[start:stop].isalpha():
            yield start, stop


def kind_of(value: str, before: str) -> str | None:
    """Published format or credential name of a finding; None if no rule knows it."""
    if m := FORMAT.fullmatch(value):
        return m.lastgroup
    if m := ASSIGNED.search(before):
        return m[1].lower()
    return None


def seed_label(value: str, before: str) -> int | None:
    if kind_of(value, before):
        return 1
    return 0 if NOT_SECRET.fullmatch(value) else None


def covered(value: str, dictionary: frozenset[str]) -> float:
    """Share of the characters inside dictionary words, longest first from the left."""
    v, at, hit = value.lower(), 0, 0
    while at < len(v):
        for n in range(min(12, len(v) - at), DICTIONARY_SHORTEST - 1, -1):
            if v[at:at + n] in dictionary:
                hit, at = hit + n, at + n
                break
        else:
            at += 1
    return hit / max(1, len(v))


def describe(value: str, before: str, after: str, dictionary: frozenset[str]) -> list[float]:
    n = len(value)
    kinds = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in value]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    counts = np.array(list(Counter(value).values())) / n
    run = longest = 1
    for a, b in zip(kinds, kinds[1:]):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    near = (before[-24:] + " " + after[:16]).lower()
    return [n, *(kinds.count(k) / n for k in range(4)), changes / n, float(-(counts * np.log2(counts)).sum()),
            covered(value, dictionary), len(counts) / n, longest / n, float(bool(re.search(r"[\\/]|\.\w{2,4}$", value))),
            float(bool(ASSIGNED.search(before))), float(before[-1:] in "\"'" and before != ""), *(float(h in near) for h in HINTS)]


def around(text: str, start: int, stop: int) -> tuple[str, str, str]:
    return text[start:stop], text[max(0, start - 32):start], text[stop:stop + 16]


class Smallest:
    """Distinct values with the smallest hashes (those of Spark's ``xxhash64``) and the smallest surroundings of each."""

    def __init__(self, most: int):
        self.most, self.bound, self.found = most, 1 << 63, {}

    def add(self, value: str, before: str, after: str) -> None:
        if (known := self.found.get(value)) is not None:
            self.found[value] = known[0], min(known[1], (before, after))
            return
        h = xxhash.xxh64_intdigest(value.encode("utf-8", "replace"), seed=42)
        h -= (h >> 63) << 64
        if h <= self.bound:
            self.found[value] = h, (before, after)
            if len(self.found) > 4 * self.most:
                self.cut()

    def cut(self) -> None:
        kept = sorted(self.found.items(), key=lambda x: x[1][0])[:self.most]
        self.found, self.bound = dict(kept), kept[-1][1][0]


def seed_findings(docs: DataFrame, most: int = MOST_FINDINGS) -> DataFrame:
    """Findings that rules of high precision decide: value, before, after, label. Each task keeps those that ``fit`` could choose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_stores()
        kept = Smallest(most // 2), Smallest(most // 2)
        for batch in rows_of(batches):
            for t in batch.column("text"):
                text = (t.as_py() or b"").decode("utf-8", "replace")
                for m in re.finditer(r"\S{12,}", text):  # long words that are no candidates are false findings, too
                    if m[0].isalpha():
                        kept[0].add(*around(text, *m.span()))
                for start, stop in candidates(text):
                    value, before, after = around(text, start, stop)
                    if (label := seed_label(value, before)) is not None:
                        kept[label].add(value, before, after)
        rows = [(value, *near, label) for label, own in enumerate(kept) for value, (_, near) in own.found.items()]
        if rows:
            value, before, after, label = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(value, pa.string()), pa.array(before, pa.string()), pa.array(after, pa.string()),
                                              pa.array(label, pa.int32())], names=["value", "before", "after", "label"])

    return text_of(docs).mapInArrow(run, "value string, before string, after string, label int")


def dictionary_of(docs: DataFrame, words: int = DICTIONARY_WORDS) -> frozenset[str]:
    """The most frequent words of letters, by documents."""
    split = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,12}"), F.lit(0)))).alias("w"))
    top = split.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(words)
    return frozenset(r.w for r in top.collect())


def _flat(node) -> tuple[np.ndarray, ...]:
    """A tree of the JVM as arrays."""
    rows: list[list[float]] = []

    def add(n) -> int:
        at = len(rows)
        stats = list(n.impurityStats().stats())
        rows.append([-1, 0.0, 0, 0, stats[1] / max(1e-9, sum(stats))])
        if n.subtreeDepth() > 0:
            rows[at][0], rows[at][1] = n.split().featureIndex(), n.split().threshold()
            rows[at][2] = add(n.leftChild())
            rows[at][3] = add(n.rightChild())
        return at

    add(node)
    table = np.array(rows)
    return table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4]


def fit(findings: DataFrame, dictionary: frozenset[str], most: int = MOST_FINDINGS) -> Forest:
    """Forest of at most ``most`` findings, each distinct one once, of either label."""
    known = findings.where("value IS NOT NULL AND label IS NOT NULL").groupBy("value", "label").agg(
        F.min(F.struct("before", "after")).alias("near"))
    known = written(known.select("value", "near.before", "near.after", "label"), "findings")
    if {r.label for r in known.select("label").distinct().collect()} != {0, 1}:
        return Forest([], dictionary)
    rows = [r for label in (0, 1) for r in known.where(F.col("label") == label).orderBy(F.xxhash64("value"), "value").limit(most // 2).collect()]
    rows = sorted(rows, key=lambda r: (r.value, r.label))
    spark = findings.sparkSession
    points = spark.createDataFrame(
        [(float(r.label), Vectors.dense(describe(r.value, r.before or "", r.after or "", dictionary))) for r in rows], ["label", "features"])
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(points.coalesce(2))
    return Forest([_flat(t._call_java("rootNode")) for t in model.trees], dictionary)


def secrets_in(text: str, forest: Forest, threshold: float) -> tuple[int, list[tuple[int, int, str, float]]]:
    """Number of candidates, and the findings: place, kind, score."""
    places = list(candidates(text))
    if not places:
        return 0, []
    parts = [around(text, *p) for p in places]
    if forest.trees:
        scores = forest.score(np.array([describe(*p, forest.dictionary) for p in parts]))
    else:
        scores = np.array([float(kind_of(v, b) is not None) for v, b, _ in parts])
    return len(places), [(a, b, kind_of(v, before) or "unnamed", float(s))
                         for (a, b), (v, before, _), s in zip(places, parts, scores) if s >= threshold]


def masked(text: str, found: list[tuple[int, int, str, float]]) -> str:
    out, at = [], 0
    for start, stop, _, _ in found:
        out += [text[at:start], MASK]
        at = stop
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, clean: bool = False) -> DataFrame:
    """Secrets of every document; with ``clean`` also its text with each one replaced by ``MASK``."""
    dictionary = dictionary_of(docs)
    forest = fit(findings if findings is not None else seed_findings(docs), dictionary)
    model = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_stores()
        own = model.value
        for batch in rows_of(batches):
            numbers, all_found, texts = [], [], []
            for t in batch.column("text"):
                data = t.as_py()
                text = (data or b"").decode("utf-8", "replace")
                n, found = secrets_in(text, own, threshold)
                numbers.append(n)
                all_found.append([dict(zip(("start", "stop", "kind", "score"), f)) for f in found])
                texts.append(None if not clean or data is None else masked(text, found))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(numbers, pa.int32()), pa.array(list(map(len, all_found)), pa.int32()),
                 pa.array(all_found, kind), pa.array(texts, pa.string())],
                names=["doc_id", "n_candidates", "n_secrets", "secrets", "clean_text"])

    return text_of(docs).mapInArrow(run, SCHEMA)
