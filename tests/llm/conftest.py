import random

import pytest


def words(generator, n, kind="abcdefgh"):
    return " ".join("".join(generator.choice(kind) for _ in range(generator.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, one giant word, near copies and shared passages."""
    g = random.Random(4)
    passage = words(g, 60)
    base = words(g, 200)
    near = base.split()
    near[7] = "changed"
    return [
        (1, "one two three four five six"), (1, "one two three four five six"), (1, "another text with the same id"), (None, "text without id"), (None, None), (2, None), (3, ""), (4, "   \n \n"), (5, "x"), (6, "X"),
        (7, base), (8, " ".join(near)), (9, base), (10, words(g, 40) + " " + passage + " " + words(g, 40)), (11, words(g, 30) + "\n" + passage + "\n" + words(g, 50)), (12, "a" * 3000), (13, words(g, 8000)),
        (14, "Ünïcödé İstanbul ǅ 漢字 é <|endoftext|> it's 12 ½"), (15, "line\n" * 300), (16, "Licensed under the Apache License, Version 2.0."),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """``odd_rows`` with columns whose names the operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, h string, set string, _range int, a int, component_id string"
    return spark.createDataFrame([(*r, None, "s", len(r[1] or ""), "r", "h", "s", 1, 2, "c") for r in odd_rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
