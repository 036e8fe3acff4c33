"""Shared small inputs: every kind of odd row a table can hold."""

import hashlib
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def odd_rows(seed: int = 1) -> list[tuple]:
    """Nulls, empty, blank and long texts, copies, a repeated row and a null id."""
    random.seed(seed)
    vocabulary = ["".join(random.choices("abcdeé", k=random.randint(1, 7))) for _ in range(200)]

    def prose(n):
        return " ".join(random.choices(vocabulary, k=n)) + "."

    texts = [prose(random.randint(5, 60)) for _ in range(20)]
    texts += [None, "", "   ", "\n\n", "x", "one two three", prose(9000), texts[0], texts[0]]
    rows = [(i, t, None if i % 5 == 0 else "en", f"s{i % 3}" if i % 4 else None, None)
            for i, t in enumerate(texts)]
    return rows + [rows[3], (None, "no id here at all", "en", "s", 3)]


def odd_docs(spark, seed: int = 1):
    return spark.createDataFrame(odd_rows(seed), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
