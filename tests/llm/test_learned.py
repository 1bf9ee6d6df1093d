"""Operators that learn: exactness of what is exact, accuracy held out, and every awkward case."""

from __future__ import annotations

import random
import re

import numpy as np
from samples import empty, frame, prose

from hazeline.llm import clause_grammar as grammar
from hazeline.llm import code_switch, secret_forest
from hazeline.llm.catalog import QUERIES
from hazeline.llm.code_switch import forward_backward, identify_languages
from hazeline.llm.common import read_table
from hazeline.llm.secret_forest import scan
from hazeline.llm.surrogates import replace_personal_data

FOLDER = "/root/testdata/sf0.01"


def test_forward_backward_in_blocks():
    rng, k, sizes = np.random.default_rng(0), 3, [1, 5, 32, 33, 100]
    step, unary = rng.normal(size=(k, k)), rng.normal(size=(sum(sizes), k))
    upto, both = forward_backward(unary, np.array(sizes), step)
    at = 0
    for n in sizes:
        left, right, u = np.empty((n, k)), np.ones((n, k)), np.exp(unary[at:at + n])
        last = np.full(k, 1 / k)
        for i in range(n):
            last = (last @ np.exp(step)) * u[i]
            left[i] = last = last / last.sum()
        for i in range(n - 2, -1, -1):
            right[i] = np.exp(step) @ (u[i + 1] * right[i + 1])
            right[i] /= right[i].sum()
        want = left * right
        assert np.allclose(upto[at:at + n], left) and np.allclose(both[at:at + n], want / want.sum(1, keepdims=True))
        at += n


def test_language_held_out(spark):
    docs = read_table(spark, FOLDER, "documents")
    got = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_edges(spark, docs, rows):
    got = {(r.doc_id, r.n_words): r for r in identify_languages(docs).collect()}
    for i in (90, 91, 92):
        assert got[i, 0].lang_pred == "und" and got[i, 0].score == 0
    assert len(rows) == identify_languages(docs).count()
    assert identify_languages(empty(spark)).count() == 0
    nothing = identify_languages(frame(spark, [(3, "ba do")]).drop("lang").selectExpr("*", "CAST(NULL AS string) AS lang"))
    assert nothing.first().lang_pred == "und"


def test_toxicity_held_out(spark):
    got = QUERIES["op6_toxicity"](spark, FOLDER).join(read_table(spark, FOLDER, "labels"), "doc_id").toPandas()
    held = got[got.held_out]
    caught = held[held.toxic == 1].predicted.mean()
    assert caught > 0.5 and held[held.toxic == 0].predicted.mean() < 0.05
    assert got.score.between(0, 1).all()


def test_grammar_composes():
    machine = grammar.compose(grammar.target_near(), grammar.negated(), grammar.reported(), grammar.repeated())
    symbols = grammar.Symbols({"oaf": ("insult", 2.0), "clod*": ("insult", 1.0)})

    def weight(text):
        return sum(w for w, _ in grammar.matched_clauses(text, symbols, machine))
    assert weight("an oaf") == 2.0 and weight("nothing here") == 0
    assert weight("you oaf") == 3.0  # a target near
    assert weight("not an oaf") == 2.0 * 0.3  # negated
    assert weight("quote oaf") == 2.0 * 0.5  # reported speech
    assert weight("quote. oaf") == 2.0  # up to the end of the clause only
    assert weight("not here now an oaf") == 2.0  # out of the negation's reach
    assert weight("clodhopper") == 1.0 and weight("oaf oaf") == 3.0


def test_toxicity_edges(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = grammar.toxicity(docs, none)
    assert got.count() == docs.count() and got.where("score IS NULL OR score NOT BETWEEN 0 AND 1").count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    assert grammar.toxicity(docs, labels).count() == docs.count()
    assert grammar.toxicity(empty(spark), labels).count() == 0


SECRETS = ['token = "%040x"', "password=%018x", "AKIA%016d"]


def secret_rows(n=400):
    rng, rows = random.Random(8), []
    for i in range(n):
        put = SECRETS[i % 3] % rng.getrandbits(50) if i % 4 == 0 else rng.choice(
            ["bob.12@mail.example.com", "10.1.2.3", "4111111111111111", "unbelievabilities", "+1 (386) 555-3733"])
        rows.append((i, f"{prose(rng, 20)} {put} {prose(rng, 20)}"))
    return rows


def test_secrets(spark):
    rows = secret_rows()
    got = {r.doc_id: r for r in scan(frame(spark, rows), clean=True).collect()}
    pattern = re.compile(r'AKIA\d{16}|[0-9a-f]{40}|[0-9a-f]{18}')
    for i, text in rows:
        want = [m.span() for m in pattern.finditer(text)] if i % 4 == 0 else []
        assert [(s.start, s.stop) for s in got[i].secrets] == want, text
        assert got[i].clean_text == pattern.sub("<secret>", text) if want else got[i].clean_text == text


def test_secret_edges(spark, docs, rows):
    got = scan(docs, clean=True)
    assert got.count() == len(rows) and got.where("doc_id = 90").first().clean_text is None
    findings = spark.createDataFrame([("a1b2c3d4e5f6a7b8", "", "", 1), (None, None, None, None), ("harmlessword", "", "", 0)],
                                     "value string, before string, after string, label int")
    assert scan(docs, findings).count() == len(rows)
    assert scan(empty(spark)).count() == 0


def test_surrogates(spark):
    rows = [(0, "Mail bob.x1@a.org or Bob.X1@a.org; 10.1.2.3, card 4111 1111 1111 1111 = 4111111111111111, +1 (386) 555-3733."),
            (1, "Frau Eva Müller und Herr Braun, 123-45-6789, DE89 3704 0044 0532 0130 00"), (2, "again 10.1.2.3 and Mr. Braun"),
            (3, None), (4, ""), (5, "nothing 1.2.3 here, 12345"), (5, "nothing 1.2.3 here, 12345"), (None, "10.1.2.3")]
    got = sorted(replace_personal_data(frame(spark, rows), "k").collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    text = {r.doc_id: r.text for r in got}
    a, b, c = re.fullmatch(r"Mail (\S+) or (\S+); (\S+), card .*", text[0]).groups()
    assert a.lower() == b.lower() and a.endswith(".example.com") and "bob" not in text[0].lower() and c != "10.1.2.3"
    assert text[2].startswith(f"again {c} and Mr. ") and text[None] == c  # one entity, one surrogate
    spaced, plain = re.search(r"card ([\d ]+) = (\d+),", text[0]).groups()
    assert spaced.replace(" ", "") == plain and len(plain) == 16 and plain[0] == "4"
    digits = [int(x) for x in plain]
    assert sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0
    assert re.fullmatch(r"Frau [A-Z]\w+ [A-Z]\w+ und Herr [A-Z]\w+, \d{3}-\d\d-\d{4}, DE\d\d( \d{4}){4} \d+( \d+)?", text[1])
    assert text[3] is None and text[4] == "" and text[5] == rows[5][1]
    assert replace_personal_data(empty(spark), "k").count() == 0


def test_surrogates_keep_people_together(spark):
    """Parts of a name have one surrogate each, with the title, without it, and in other documents."""
    rows = [(0, "Frau Eva Müller sah Frau Müller, Mrs. Müller und Eva; Müller-Braun, Müllers und Berlin. Müller@a.org, Eva.Müller@b.org"),
            (1, "Mr. Müller and Mr. Karl Müller"), (2, "Müller and Eva without a title"), (3, "Mrs. Eva Braun")]
    got = {r.doc_id: r for r in replace_personal_data(frame(spark, rows), "k").collect()}
    m = re.fullmatch(r"Frau (\w+) (\w+) sah Frau (\w+), Mrs. (\w+) und (\w+); (\w+)-Braun, Müllers und Berlin. (.*)", got[0].text)
    eva, last = m[1], m[2]
    assert {m[3], m[4], m[6]} == {last} and m[5] == eva and len({eva, last, "Eva", "Müller"}) == 4
    assert "a.org" not in m[7] and "b.org" not in m[7]
    assert got[1].text.split()[1] == got[1].text.split()[5] == last and got[1].n_entities == 3 and got[1].n_distinct == 2
    assert got[2].text == rows[2][1] and got[2].n_entities == 0
    assert got[3].text.split()[1] == eva


def test_surrogates_match_script_and_gender(spark):
    rows = [(0, "Mr. Иван Иванов"), (1, "Herr Μιχάλης Παπάς"), (2, "Frau Ольга Петрова"), (3, "Mrs. Ann Lee"), (4, "Mr. Ann Lee")]
    got = {r.doc_id: r.text for r in replace_personal_data(frame(spark, rows), "k").collect()}
    assert re.fullmatch(r"Mr\. [А-Я][а-я]+н [А-Я][а-я]+", got[0])
    assert re.fullmatch(r"Herr [Α-Ω][α-ω]+ς [Α-Ω][α-ω]+", got[1])
    assert re.fullmatch(r"Frau [А-Я][а-я]+на [А-Я][а-я]+", got[2])
    assert re.fullmatch(r"Mrs\. [A-Z][a-z]+na [A-Z][a-z]+", got[3]) and re.fullmatch(r"Mr\. [A-Z][a-z]+n [A-Z][a-z]+", got[4])


def test_surrogates_stay_distinct(spark):
    """Names have few surrogates, so many clash at first."""
    rows = [(i, f"Mrs. {chr(65 + i % 26)}{chr(97 + i // 26)}nor Quill") for i in range(150)]
    got = replace_personal_data(frame(spark, rows), "k").collect()
    assert len({r.text for r in got}) == 150
    assert not {r.text for r in got} & {t for _, t in rows}


def test_surrogates_never_run_out(spark):
    """More names of a title, short phone numbers of a shape and one-letter mail boxes than short lists have surrogates for."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    last = ["X" + a + b + c for a in letters[:15] for b in letters[:10] for c in letters[:20]]
    rows = [(i, f"Mr. {x}") for i, x in enumerate(last)] + [(10_000 + i, f"Herr Jo {x}") for i, x in enumerate(last)]
    rows += [(20_000 + i, f"+1{i:04d}") for i in range(10_000)] + [(30_000 + i, f"a@d{i}.org") for i in range(3000)] + [(40_000, "Mr. Иванов")]
    got = {r.doc_id: r.text for r in replace_personal_data(frame(spark, rows), "k").collect()}
    assert len(set(got.values())) == len(rows) and not set(got.values()) & {t for _, t in rows}
    assert re.fullmatch(r"Mr\. [А-Я][а-я]+", got[40_000])
    assert all(re.fullmatch(r"Mr\. [A-Z][a-z]+", got[i]) and re.fullmatch(r"Herr [A-Z][a-z]+ [A-Z][a-z]+", got[10_000 + i]) for i in range(3000))


def test_surrogates_of_national_phones_and_cards_of_all_lengths(spark):
    found = ["386-555-3733", "1.386.555.3733", "030 1234567", "0171/1234567", "01 23 45 67 89", "020 7946 0958", "01711234567",
             "0049 30 1234567", "+491511234567", "378282246310005", "3782 822463 10005", "4222222222222", "6304000000000000000",
             "4111 1111 1111 1111", "4111111111111112"]
    kept = ["378282246310006", "4222222222223", "2024-01-02", "01.02.2024", "01/2024", "1234567890", "12345678901234567890", "3.14159"]
    rows = [(i, f"x {t}, y") for i, t in enumerate(found + kept)] + [(100, "call +1 (386) 555-3733 or +13865553733")]
    got = {r.doc_id: r for r in replace_personal_data(frame(spark, rows), "k").collect()}
    for i, t in enumerate(found):
        assert got[i].n_entities == 1 and got[i].text != rows[i][1], t
        assert re.sub(r"\d", "0", got[i].text) == re.sub(r"\d", "0", rows[i][1]), t
    for i, t in enumerate(kept, len(found)):
        assert got[i].n_entities == 0 and got[i].text == rows[i][1], t
    one, other = re.fullmatch(r"call (.*) or (.*)", got[100].text).groups()
    assert re.sub(r"\D", "", one) == re.sub(r"\D", "", other)
    for i in (9, 10, 11, 12, 13):
        digits = [int(c) for c in re.sub(r"\D", "", got[i].text)]
        assert sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def test_toxicity_keeps_the_mix_of_labels(spark):
    """A bounded sample gives about the scores that all rows give."""
    rng, rows, labels = random.Random(4), [], []
    for i in range(4400):
        toxic = i % 11 == 0
        weak = rng.random() < (0.8 if toxic else 0.05)
        rows.append((i, f"{prose(rng, 12)} {'you oaf ' if weak else ''}{prose(rng, 12)}"))
        labels.append((i, int(toxic)))
    docs, labels = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    curves = []
    for n in (100, 10_000):
        sample = grammar.training_sample(docs, labels, n)
        x = np.array([[1.0, float("oaf" in t)] for t, _, _ in sample])
        curve = grammar.fit_curve(x, np.array([y for _, y, _ in sample], float), np.array([w for _, _, w in sample]))
        curves.append(1 / (1 + np.exp(-np.array([curve[0], curve.sum()]))))
    assert np.abs(curves[0] - curves[1]).max() < 0.2 and curves[0][0] < 0.05
    whole, part = (grammar.fit(grammar.training_sample(docs, labels, n)) for n in (10_000, 100))
    score = [1 / (1 + np.exp(-grammar.features([]) @ g.curve)) for g in (whole, part)]
    assert abs(score[0] - score[1]) < 0.05


def test_language_reads_long_runs_whole(spark):
    """The language of a run without spaces is not that of its first 40 bytes."""
    rng = random.Random(5)
    one, other = "абвгде", "жзиклм"
    rows = [(i, "".join(rng.choice((one, other)[i % 2]) for _ in range(60)), ("aa", "bb")[i % 2]) for i in range(200)]
    sample = [(lang, text) for _, text, lang in rows]
    mixed = "".join(rng.choice(one) for _ in range(20)) + "".join(rng.choice(other) for _ in range(400))
    field = code_switch.fit(sample)
    got = code_switch.label_documents(frame(spark, [(1, mixed)]), field, code_switch.F.lit(False)).first()
    assert got.lang_pred == "bb" and got.n_words == 1 and 0.9 < got.score < 1
    pieces = code_switch.pieces_of([mixed.encode(), b"x" * 40, b"y" * 81])
    assert b"".join(pieces) == mixed.encode() + b"x" * 40 + b"y" * 81 and all(p.decode() and len(p) <= 40 for p in pieces)


def test_secret_findings_come_from_all_documents(spark, monkeypatch):
    """One document of 9,000 holds a key; a word in every document is in the dictionary."""
    rows = [(i, "plain 110.120.130.140 words") for i in range(9000)] + [(9000, "password=a1b2c3d4e5f6a7b8")]
    seen = []
    real = secret_forest.fit
    monkeypatch.setattr(secret_forest, "fit", lambda findings, words: seen.append((findings, words)) or real(findings, words))
    scan(frame(spark, rows)).count()
    assert {(r.value, r.label) for r in seen[0][0].collect()} == {("a1b2c3d4e5f6a7b8", 1), ("110.120.130.140", 0)}
    assert seen[0][1] == {"plain", "words", "password"}


def test_secret_findings_of_a_task_are_the_smallest_hashes(spark):
    rows = [(i, f"198.151.{100 + i // 250}.{100 + i % 250}") for i in range(1000)]
    docs = frame(spark, rows).coalesce(1)
    got = {r.value for r in secret_forest.seed_findings(docs, 40).collect()}
    want = [r.text for r in docs.orderBy(code_switch.F.xxhash64("text")).limit(20).collect()]
    assert set(want) <= got and len(got) <= 80
