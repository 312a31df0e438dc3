"""Documents with the awkward cases: nulls, empties, ties, copies and clashing column names."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta épsilon zeta Eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts(seed: int = 5) -> list[str | None]:
    rng = random.Random(seed)
    long = sentence(rng, 3000)
    base = [sentence(rng, rng.randint(1, 120)) for _ in range(30)]
    return [None, "", "   ", "\n\n", "x", *base, base[0], base[0], base[1] + " end", long, "Ünï <|endoftext|> code 　 x  y\t\tz", "a" * 500]


def documents(spark, rows: list[str | None] | None = None):
    """A documents table with extra columns named like those that the operators add."""
    rows = texts() if rows is None else rows
    data = [(i, t, "en", f"src{i % 3}", len(t or ""), "id", 7) for i, t in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, id string, length int")
