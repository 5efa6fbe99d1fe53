import random

import pytest

#: Rows that every operator meets: nulls, blanks, repeats, ties, a very long text, odd characters.
ODD = [(900, None), (901, ""), (902, " \t\n "), (903, "same few words"), (904, "same few words"), (905, "w" * 70_000), (906, "Ünïcödé 😀 ß   x y <|endoftext|> l'sa"), (None, "a text without an id that has some words in it")]


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages and repeats within a text."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(900)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    passage, base = make(40), make(120)
    rows = []
    for i in range(60):
        rows.append(make(rng.randint(1, 150)))
    for i in range(12):
        rows.append([w if rng.random() > 0.01 * i else rng.choice(words) for w in base])
    for i in range(10):
        rows.append(make(rng.randint(5, 60)) + passage + make(rng.randint(5, 60)))
    rows += [list(base) for _ in range(4)] + [make(25) * 3, rows[3][:], rows[5] + ["Tail."]]
    rng.shuffle(rows)
    return [(i, " ".join(r) if i % 3 else "\n".join(" ".join(r[k : k + 9]) for k in range(0, len(r), 9)).capitalize()) for i, r in enumerate(rows)]


@pytest.fixture(scope="session")
def odd_docs(spark, corpus):
    """The corpus and the odd rows, with columns whose names clash with those that operators add."""
    rows = [(i, t, "x", 1.0, t) for i, t in [*corpus, *ODD]]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double, spans string").repartition(5).cache()


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, score double, spans string")
