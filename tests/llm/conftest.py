import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None, source=None):
        rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}" if source is None else source[i], len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def prose():
    """Sentences of invented words from a seed."""

    def text(seed, n):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(["ba", "do", "ri", "ne", "su", "lo", "ma", "ti", "ke"]) for _ in range(rng.randint(1, 4))) for _ in range(n))

    return text
