import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, text_hash long, words string, bands long, leaf int"


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing names."""
    r = random.Random(4)
    vocabulary = [a + b for a in ("an", "to", "re", "mi", "su") for b in ("la", "ber", "x", "ond")]
    base = [" ".join(r.choices(vocabulary, k=r.randint(20, 120))) for _ in range(30)]
    texts = [None, "", "  \t\n ", "word", "one two three four", "a b ▁ cé", "x" * 50_000, "long " * 20_000, "\U0001f600 é \x00"]
    texts += base + base[:6] + [t.replace("anla", "tola", 1) for t in base[:6]] + [t.replace(" ", "\n") for t in base[:2]]
    rows = [(k, t, None if k % 5 else "en", "src0", None if t is None else len(t), "n", None, "w", k, 1) for k, t in enumerate(texts)]
    rows += [rows[12], rows[12], (12, "another text under the id of an earlier one", None, None, None, None, None, None, None, None)]
    rows += [(None, base[3], None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).coalesce(2)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
