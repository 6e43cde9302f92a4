"""Small document tables with the awkward cases: nulls, empty and long texts, repeats, clashing columns."""

from __future__ import annotations

import random

SYLLABLES = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row long, score string, label string, r1 string, sig string, word string"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(spark, rows):
    """(doc_id, text) rows with further columns whose names operators also use."""
    return spark.createDataFrame([(i, t, "en", "src", len(t or ""), -1, "x", "y", "z", "s", "w") for i, t in rows], DOCS)


def awkward(rng: random.Random) -> list[tuple[int | None, str | None]]:
    base = sentence(rng, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    return [
        (1, base), (2, base), (3, near), (4, base.upper() + "!"), (5, None), (6, ""), (7, "   \n\t"), (8, "?!"), (9, "one two"), (10, "One, two."), (11, sentence(rng, 5000)),
        (12, "x" * 30_000), (13, sentence(rng, 40)), (14, " ".join(words[:50])), (None, "a text without an id " + sentence(rng, 20)), (15, sentence(rng, 30)), (15, sentence(rng, 30)), (13, "éà \U0001f600 " * 10),
    ]
