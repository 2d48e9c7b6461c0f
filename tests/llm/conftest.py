import random

import pytest


def words_text(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def mixed_rows():
    """Nulls, empties, blanks, copies, repeated rows and ids, near copies, shared passages, one long text."""
    rng = random.Random(5)
    base = [words_text(rng, n) for n in (3, 40, 120, 260, 400)]
    shared = words_text(rng, 70)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(10, base[3]), (11, base[3]), (12, base[3] + " more"), (13, "X " + base[3]), (14, base[4].upper())]
    for i in range(6):
        cut = base[4].split(" ")
        cut[rng.randrange(len(cut))] = "changed" + str(i)
        rows.append((20 + i, " ".join(cut)))
    rows += [(30 + i, words_text(rng, 30) + " " + shared + "\n" + words_text(rng, 20)) for i in range(4)]
    rows += [(40, None), (41, ""), (42, " \t\n"), (43, "a"), (44, "A b"), (45, "a b"), (None, base[2]), (None, None)]
    rows += [(46, "ab " * 300), (47, words_text(rng, 6000) + " " + shared), (0, base[0]), (48, "\x00\xff" * 250 + base[1])]
    return rows


@pytest.fixture(scope="session")
def mixed_docs(spark, mixed_rows):
    """The same as a table, with columns whose names the operators use inside."""
    rows = [(i, t, 1, "x", b"k") for i, t in mixed_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, n long, spans string, class_key binary")


@pytest.fixture(scope="session")
def no_docs(mixed_docs):
    return mixed_docs.limit(0)
