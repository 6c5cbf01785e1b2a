import random

import pytest


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture
def docs(spark):
    """Documents from (id, text) pairs; the schema is fixed so that all may be null or absent."""

    def make(rows, extra=""):
        return spark.createDataFrame(rows, "doc_id long, text string" + extra)

    return make


def random_texts(rng, n, vocabulary=400, words=(0, 160)):
    """Texts of common words with exact and near copies and shared passages."""
    v = ["".join(rng.choice("abcdeéñßTH.") for _ in range(rng.randint(1, 7))) for _ in range(vocabulary)]
    passage = [" ".join(rng.choices(v, k=30)) for _ in range(4)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.2:
            out.append(rng.choice(out))
        elif out and kind < 0.35:
            w = (rng.choice(out) or "x").split(" ")
            w[rng.randrange(len(w))] = rng.choice(v)
            out.append(" ".join(w))
        else:
            t = " ".join(rng.choices(v, k=rng.randint(*words)))
            for _ in range(rng.randint(0, 2)):
                t += rng.choice([" ", "\n"]) + rng.choice(passage) + "\n"
            out.append(t)
    return out
