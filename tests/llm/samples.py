"""Documents with every awkward case, and plain versions of what the operators compute."""

from __future__ import annotations

import random
import re

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n_words long, block long, bucket long, label string, "
          "score double, entities string")
WHITE_WORD = re.compile("[^ \t-\r]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def prose(rng: random.Random, n: int, stem: str = "") -> str:
    parts = ["ba", "do", "ki", "lu", "me", "no", "pa", "ri", "su", "ti", "vo", "zé"]
    return " ".join(stem + "".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def texts(seed: int = 3) -> list[tuple[int | None, str | None]]:
    """(doc_id, text): copies, near copies in a chain and around one text, shared passages, short, empty, null and long ones."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    base = prose(rng, 150).split(" ")
    rows: list[tuple[int | None, str | None]] = []
    for i in range(30):  # around one text
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = prose(rng, 1, "x")
        rows.append((i, " ".join(w)))
    chain = prose(rng, 120).split(" ")
    for i in range(30, 45):  # each a small step from the one before
        chain = chain[6:] + prose(rng, 6).split(" ")
        rows.append((i, " ".join(chain)))
    for i in range(45, 70):
        rows.append((i, prose(rng, 40) + "\n" + passage + "\n" + prose(rng, rng.randint(0, 30))))
    for i in range(70, 90):
        rows.append((i, prose(rng, rng.randint(1, 100))))
    rows += [(90, None), (91, ""), (92, " \n\t "), (93, "ba do"), (94, "ba do"), (95, "BA  DO"), (96, prose(rng, 30_000)), (97, "w" * 20_000),
             (98, rows[0][1]), (99, rows[0][1].upper()), (100, "ba " * 200), (101, "é ß 日本語 \U0001f600 ▁▁ x\x00y"), (None, rows[1][1]),
             (None, None), (102, rows[50][1]), (102, rows[50][1])]
    return rows


def frame(spark, rows):
    full = [(i, t, "en" if i is None or i % 3 else None, "src", None if t is None else len(t), -1, -2, -3, "?", -0.5, "e") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[str]:
    return WHITE_WORD.findall(text or "")
