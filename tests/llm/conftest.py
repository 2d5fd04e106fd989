"""Documents with every awkward kind of value, and the same columns without rows."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, kept string, size string, embedding string"
PROSE = "the and of on stone river light over green hill morning water walks slowly under bright old bridge while seven birds sing about rain".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(PROSE) for _ in range(n))


def awkward() -> list[tuple]:
    rng = random.Random(4)
    base = sentence(rng, 300)
    texts = [None, "", " \n\t", "A", "a", "Ärger", "äRGER", "12 34", "é", base, base, base.upper(), base + " end", base.replace("river", "rivers", 1), sentence(rng, 2), "x" * 500, "x" * 500 + "y", sentence(rng, 20_000), "ß don't <|endoftext|> naïve  二三 😀"]
    rows = [(k, t, "en", f"s{k % 3}", len(t or ""), 1, "no", "big", "clash") for k, t in enumerate(texts)]
    rows += [(3, "A", "en", "s0", 1, 1, "no", "big", "clash"), (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (99, "orphan text", None, None, 11, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
