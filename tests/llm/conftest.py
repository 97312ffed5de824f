import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, words: int, syllables=("the", "an", "er", "ing", "tion", "re", "sh", "ble", "ou")) -> str:
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="session")
def texts():
    """Prose with near copies, exact copies, empty and null texts, one very long text, passages that many share."""
    rng = random.Random(3)
    rows = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    for k in range(10):
        words = rows[k].split()
        for j in range(3):
            copy = list(words)
            if copy:
                copy[rng.randrange(len(copy))] = f"new{j}"
            rows.append(" ".join(copy))
    rows += [rows[0], rows[0], "", None, " \n ", "one", "One", "a b c d", "a b c d e", prose(rng, 5000), "ÀÉ ß 日本語  x", "~<s>[INST]"]
    passage = prose(rng, 60)
    rows += [f"{prose(rng, 5)} {passage} {prose(rng, 20)}" for _ in range(8)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Repeated rows, a null doc_id, null columns, and columns that clash with names that operators use."""
    rows = [(i, x, "en" if i % 3 else None, None, len(x or "")) for i, x in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[3], "en", "s", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.selectExpr("*", "1 AS mark", "'x' AS root", "2 AS seed", "3 AS text_hash", "4 AS accepted", "5 AS score").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
