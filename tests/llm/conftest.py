from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size string, key string, doc int, n int, label string, copies int, `range` int"
CLASH = (1, "s", "k", 2, 3, "l", 4, 5)


def words(rng: random.Random, n: int, alphabet: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, blanks, a very long text, near and exact copies, repeated rows, a null id; and columns with clashing names."""
    rng = random.Random(3)
    base = words(rng, 120)
    near = base.split(" ")
    near[60] = "changed"
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "one two three"), (9, words(rng, 30_000)),
        (10, "12345 !!! 678"), (11, base + " " + words(rng, 400)), (7, "one"), (None, base), (None, "und kein id"), (12, "x" * 50_000),
        (13, "mail a.b@c.de or +1 (234) 555-6789, ip 10.0.0.1 and 4111 1111 1111 1111"),
    ]
    rows = [(i, t, [None, "en", "de"][k % 3], [None, "a", "b"][k % 3], None if t is None else len(t), *CLASH) for k, (i, t) in enumerate(texts)]
    return rows + [rows[6]] * 3


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
