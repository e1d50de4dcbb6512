from __future__ import annotations

import random

import pytest

WORDS = [f"w{k}" for k in range(400)]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture
def rng() -> random.Random:
    return random.Random(7)


@pytest.fixture
def docs_of(spark):
    """Documents from (id, text) with other columns, some named like an operator's own."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", "web", None if t is None else len(t), "x", 1.5) for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long, keep_id string, rate double",
        )

    return make
