"""Toxicity by a weighted finite-state grammar of clauses.

Words become symbols: insult and threat words by a learned lexicon (whole words and word beginnings with weights), targets, negations,
words that report speech, and clause ends by short fixed lists. Four small transducers read the symbols and each multiplies the weight
of a matched word by a factor of its state: a target in reach raises it, a negation just before lowers it, so does reported speech up
to the end of the clause, and repeated insults in one clause saturate. Their composition is one transducer over state tuples. A
document's features are the weights of its matched clauses (largest, sum, number); a logistic curve over them is the score.

Fitting: labelled rows, of which a hash of doc_id picks about ``SAMPLE_ROWS`` of either label (a bound on the fit). In the curve each
counts for the rows it stands for, so the curve keeps the mix of labels however many there are. Lexicon entries
are chosen one by one, each for the toxic documents that the entries before it leave unexplained, so words that merely stand in copies
of a toxic document explain nothing new. Scale: one scan scores all; the fitted grammar is small and bounded by ``MOST_ENTRIES``.

Edge cases: null, empty or wordless text has no clause and gets the score of no match; without labelled rows of both kinds the
lexicon is the fixed seed list; repeated rows of ``labels`` for a document each count; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import rows_of, text_of

SAMPLE_ROWS = 3000
MOST_ENTRIES = 2000
#: An entry explains so many unexplained toxic documents of the sample at least, and is so many times as frequent in toxic ones.
LEAST_GAIN, LEAST_RATIO = 3, 8.0
SHORTEST_STEM, LONGEST_STEM = 4, 7
THRESHOLD = 0.3
MOST_WORDS = 400_000
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_clauses int, clauses array<string>"

# Word lists, in four languages.
THREATS = "kill hurt beat destroy shoot stab töten umbringen schlagen vernichten matar golpear destruir tuer frapper détruire".split()
SEED_INSULTS = ("idiot stupid moron loser scum worthless pathetic disgusting trash clown dumm blöd trottel abschaum dreckig wertlos "
                "idiota estúpido imbécil basura escoria inútil asqueroso idiote stupide imbécile minable ordure dégoûtant").split()
TARGETS = ("you your yours yourself he she they him her them du dich dir dein ihr euch sie er tú vosotros usted te él ella ellos tu toi "
           "vous votre il elle ils elles").split()
NEGATIONS = "not no never nobody isn't aren't wasn't don't nicht kein keine nie niemals ni nunca jamás pas jamais aucun aucune".split()
REPORTS = ("said says say wrote told called quote quoted reported sagte sagt schrieb nannte zitierte dijo dice escribió llamó citó dit "
           "disait écrit appelé cité").split()

WORD_OR_END = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n]+")
SYMBOLS = ("insult", "threat", "target", "negation", "report", "end", "word")


@dataclass
class Transducer:
    """``steps[state, symbol]`` is the next state and the factor put out for a matched word; a missing step stays and puts out 1."""

    start: int
    steps: dict[tuple[int, str], tuple[int, float]]

    def states(self) -> set[int]:
        return {self.start, *(s for s, _ in self.steps), *(s for s, _ in self.steps.values())}

    def step(self, state: int, symbol: str) -> tuple[int, float]:
        return self.steps.get((state, symbol), (state, 1.0))


def target_near(reach: int = 4, factor: float = 1.5) -> Transducer:
    """State: words since a target, ``reach`` for none."""
    steps = {}
    for s in range(reach + 1):
        later = min(reach, s + 1)
        steps |= {(s, x): (later, factor if s < reach else 1.0) for x in ("insult", "threat")}
        steps |= {(s, x): (later, 1.0) for x in ("word", "negation", "report")} | {(s, "target"): (0, 1.0), (s, "end"): (reach, 1.0)}
    return Transducer(reach, steps)


def negated(reach: int = 2, factor: float = 0.3) -> Transducer:
    """State: words since a negation, ``reach`` for none."""
    steps = {}
    for s in range(reach + 1):
        later = min(reach, s + 1)
        steps |= {(s, x): (later, factor if s < reach else 1.0) for x in ("insult", "threat")}
        steps |= {(s, x): (later, 1.0) for x in ("word", "target", "report")} | {(s, "negation"): (0, 1.0), (s, "end"): (reach, 1.0)}
    return Transducer(reach, steps)


def reported(factor: float = 0.5) -> Transducer:
    """State 1: speech is reported, to the end of the clause."""
    return Transducer(0, {(0, "report"): (1, 1.0), (1, "end"): (0, 1.0), (1, "insult"): (1, factor), (1, "threat"): (1, factor)})


def repeated(most: int = 3) -> Transducer:
    """State: matched words of the clause so far; each counts half of the one before."""
    steps = {(s, x): (min(most, s + 1), 0.5 ** s) for s in range(most + 1) for x in ("insult", "threat")}
    return Transducer(0, steps | {(s, "end"): (0, 1.0) for s in range(most + 1)})


def compose(*machines: Transducer) -> Transducer:
    """One transducer over the tuples of states that do occur; its factor is the product of theirs."""
    tuples = {s: i for i, s in enumerate(product(*(sorted(m.states()) for m in machines)))}
    steps = {}
    for state, i in tuples.items():
        for symbol in SYMBOLS:
            moves = [m.step(s, symbol) for m, s in zip(machines, state)]
            steps[i, symbol] = tuples[tuple(s for s, _ in moves)], float(np.prod([f for _, f in moves]))
    return Transducer(tuples[tuple(m.start for m in machines)], steps)


@dataclass
class Grammar:
    """Lexicon (``stem*`` for beginnings), the composed transducer, and the curve: intercept and weights of the features."""

    lexicon: dict[str, tuple[str, float]]
    machine: Transducer
    curve: np.ndarray


class Symbols(dict):
    """Symbol and weight of a word or clause end; emptied when full."""

    def __init__(self, lexicon: dict[str, tuple[str, float]]):
        super().__init__()
        self.lexicon = lexicon
        self.fixed = {w: (s, 0.0) for s, words in (("report", REPORTS), ("negation", NEGATIONS), ("target", TARGETS)) for w in words}

    def __missing__(self, token: str) -> tuple[str, float]:
        found = self.lexicon.get(token) or self.fixed.get(token)
        if not found and not token[0].isalpha():
            found = "end", 0.0
        for n in range(min(LONGEST_STEM, len(token)), SHORTEST_STEM - 1, -1) if not found else ():
            found = self.lexicon.get(token[:n] + "*")
            if found:
                break
        if len(self) >= MOST_WORDS:
            self.clear()
        self[token] = found = found or ("word", 0.0)
        return found


def matched_clauses(text: str, symbols: Symbols, machine: Transducer) -> list[tuple[float, str]]:
    """Weight and words of each clause with an insult or threat."""
    tokens = WORD_OR_END.findall(text.lower())
    read = list(map(symbols.__getitem__, tokens))
    if not any(weight for _, weight in read):
        return []
    clauses, state, start, total = [], machine.start, 0, 0.0
    for i, (symbol, weight) in enumerate([*read, ("end", 0.0)]):
        state, factor = machine.steps[state, symbol]
        total += weight * factor
        if symbol == "end":
            if total:
                clauses.append((total, " ".join(tokens[start:i])))
            start, total = i + 1, 0.0
    return clauses


def features(clauses: list[tuple[float, str]]) -> np.ndarray:
    weights = [w for w, _ in clauses]
    return np.array([1.0, max(weights, default=0.0), np.log1p(sum(weights)), np.log1p(len(weights))])


def _entries(words: set[str]) -> set[str]:
    return words | {w[:n] + "*" for w in words for n in range(SHORTEST_STEM, min(LONGEST_STEM, len(w) - 1) + 1)}


def learn_lexicon(rows: list[tuple[str, int]]) -> dict[str, tuple[str, float]]:
    """Insults that the labels show, on top of the fixed threats; without both labels the fixed insults."""
    lexicon = {w: ("threat", 2.0) for w in THREATS}
    texts = {text: label for text, label in rows}  # copies count once
    toxic = [_entries(set(re.findall(r"[^\W\d_]+", t.lower()))) for t, label in texts.items() if label]
    clean = Counter(e for t, label in texts.items() if not label for e in _entries(set(re.findall(r"[^\W\d_]+", t.lower()))))
    n_clean = sum(not label for label in texts.values())
    if not toxic or not n_clean:
        return lexicon | {w: ("insult", 3.0) for w in SEED_INSULTS}
    spread = Counter(e for entries in toxic for e in entries)
    weight = {e: float(np.log((n + 0.5) / (len(toxic) + 1)) - np.log((clean[e] + 0.5) / (n_clean + 1)))
              for e, n in spread.items() if n >= LEAST_GAIN}
    weight = {e: w for e, w in weight.items() if w >= np.log(LEAST_RATIO)}
    where = defaultdict(set)
    for i, entries in enumerate(toxic):
        for e in entries:
            if e in weight:
                where[e].add(i)
    # Taken together: an entry counts by how many documents it newly explains, an entry like it from other documents not at all.
    open_docs = set(range(len(toxic)))
    for _ in range(MOST_ENTRIES):
        best = max(where, key=lambda e: (len(where[e] & open_docs) * weight[e], len(e), e), default=None)
        if best is None or len(where[best] & open_docs) < LEAST_GAIN:
            break
        lexicon[best] = "insult", weight[best]
        open_docs -= where.pop(best)
    # Words that the chosen documents share with many others of theirs belong too, if they are as telling as the chosen ones.
    chosen = [w for s, w in lexicon.values() if s == "insult"]
    if chosen:
        bar, many = min(chosen), max(LEAST_GAIN, len(toxic) // 50)
        for e in sorted(where, key=lambda e: (-spread[e], e))[:MOST_ENTRIES]:
            if spread[e] >= many and weight[e] >= bar and not e.endswith("*"):
                lexicon.setdefault(e, ("insult", weight[e]))
    return lexicon


def fit_curve(x: np.ndarray, y: np.ndarray, weights: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; each row counts ``weights`` times."""
    w = np.zeros(x.shape[1])
    ridge = penalty * np.diag(np.r_[1e-3, np.ones(x.shape[1] - 1)])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (weights * (y - p)) - ridge @ w)
    return w


def fit(rows: list[tuple[str, int, float]]) -> Grammar:
    """Grammar from (text, label, how many rows of that label it stands for)."""
    lexicon = learn_lexicon([(t, label) for t, label, _ in rows])
    machine = compose(target_near(), negated(), reported(), repeated())
    symbols = Symbols(lexicon)
    if len({label for _, label, _ in rows}) < 2:
        return Grammar(lexicon, machine, np.array([-3.0, 1.0, 0.5, 0.5]))
    x = np.array([features(matched_clauses(t, symbols, machine)) for t, _, _ in rows])
    return Grammar(lexicon, machine, fit_curve(x, np.array([label for _, label, _ in rows], float), np.array([n for _, _, n in rows])))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, int, float]]:
    """About ``rows`` labelled documents of each label, chosen by a hash of doc_id; rows without text or label are left out."""
    known = (docs.select("doc_id", F.col("text").alias("text")).where("text IS NOT NULL")
             .join(labels.where("toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic")), "doc_id")
             .withColumn("h", F.xxhash64("doc_id")))
    parts, sizes = 1 << 62, {r.toxic: r.n for r in labels.where("toxic IS NOT NULL").groupBy(
        F.col("toxic").cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    chosen = F.lit(False)
    for label, n in sizes.items():
        chosen = chosen | ((F.col("toxic") == label) & (F.pmod("h", F.lit(parts)) < int(min(1.0, rows / n) * parts)))
    return [(r.text, r.toxic, max(1.0, sizes[r.toxic] / rows)) for r in known.where(chosen).orderBy("h", "doc_id", "text").collect()]


def score_documents(docs: DataFrame, grammar: Grammar, held_out: F.Column, threshold: float = THRESHOLD) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        symbols = Symbols(own.lexicon)
        for batch in rows_of(batches):
            scores, numbers, found = [], [], []
            for text in batch.column("text"):
                clauses = matched_clauses((text.as_py() or b"").decode("utf-8", "replace"), symbols, own.machine)
                scores.append(float(1 / (1 + np.exp(-np.clip(features(clauses) @ own.curve, -30, 30)))))
                numbers.append(len(clauses))
                found.append([c for _, c in clauses])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(scores, pa.float64()),
                 pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(numbers, pa.int32()),
                 pa.array(found, pa.list_(pa.string()))], names=[c.split(" ")[0] for c in SCHEMA.split(", ")])

    return text_of(docs, held_out.alias("held_out")).mapInArrow(run, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame, parts: int = 4, held_part: int = 2) -> DataFrame:
    """Fit on labelled documents outside the held-out part of doc_id, score all."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == held_part, F.lit(False))
    return score_documents(docs, fit(training_sample(docs.where(~held_out), labels.where(~held_out))), held_out)
