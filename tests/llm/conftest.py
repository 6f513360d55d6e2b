from __future__ import annotations

import random

import pytest

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, tie string, id int, key string, "
    "n_tokens double, component_id string, N_Lines string, name string, weight string, pass string"
)


def text_of(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "lo", "mi", "ret", "sun", "é"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts() -> list[tuple]:
    """(doc_id, text): nulls, empty and very long texts, copies, repeated rows, ids that occur twice."""
    base = text_of(1, 120)
    near = base.replace(" ", "  ", 3) + " ending"
    shared = "this line is found in many documents"
    return [
        (1, base), (2, base), (3, near), (4, ""), (5, None), (None, base), (None, None), (6, "   \n\t "),
        (7, f"{shared}\nown line of seven here\n{shared}"), (8, f"  {shared.upper()} \nsecond own line of eight"), (9, f"{shared}\n"),
        (10, text_of(2, 40_000)), (11, "x" * 90_000), (12, "one"), (12, "one"), (13, "same id first text"), (13, "same id other text"),
        (14, "word"), (15, "WORD"), (16, text_of(3, 300)), (17, "\n\n\n"), (18, "ünï 日本 😀 ▁ tokens"), (-5, base + " more"),
    ]


@pytest.fixture(scope="session")
def odd_documents(spark, odd_texts):
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"s{k % 2}", k, "r", "t", k, "k", 1.5, "c", "n", "m", "w", "p")
            for k, (i, t) in enumerate(odd_texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
