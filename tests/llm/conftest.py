import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, sha string, word string, v string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "été", "straße"]
    long = " ".join(rng.choice(words) + str(rng.randint(0, 400)) for _ in range(4000))
    base = " ".join(rng.choice(words) + str(rng.randint(0, 400)) for _ in range(120))
    edited = base.replace(base.split()[60], "changed", 1)
    texts = [
        None, "", "   ", "one", "one two", long, base, base, edited, base.upper() + "!", base.replace(" ", "\n"), "x" * 3000,
        "mail a.b@c.example.org and 10.0.0.1, 4111 1111 1111 1111, +1 (212) 555-0100 end", "\ta b\n", "a b \U0001f600", "idiot " * 5 + base,
    ]
    rows = [(i, t, "en", "s", len(t or ""), "r", "s", "w", "v") for i, t in enumerate(texts)]
    rows += [rows[6], (None, None, None, None, None, None, None, None, None), (99, long, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
