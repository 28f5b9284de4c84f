import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside; a table may have columns of these names.
CLASHES = ("row", "key", "h", "size", "id", "fp", "bucket", "copies", "line", "c", "label", "unit", "place")


def sentence(rng: random.Random, n: int, letters: str = "abcdefghiklmnoprstuvw") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n))


def make_docs(seed: int = 1, n: int = 120) -> list[tuple]:
    """Documents with nulls in every column, blank and long texts, repeated rows, near copies and ties."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = ".\n".join(sentence(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 4)))
        rows.append((i, text, rng.choice(["en", "de"]), f"s{rng.randrange(4)}", len(text)))
    words = rows[3][1].split(" ")
    near = " ".join([*words[:-1], words[-1] + "x"])
    rows += [(n, near, "en", "s1", len(near)), (n + 1, rows[3][1], "en", None, 7), (n + 2, rows[3][1].upper(), None, "s1", None)]
    rows += [(n + 3, None, "en", "s0", None), (n + 4, "", "en", "s0", 0), (n + 5, " \t\n\x0b\x0c\r ", "de", "s0", 7), (n + 6, "!!! 123", "de", "s2", 7), (n + 7, "Ünïcödé 中国 😀", None, None, 3)]
    rows += [rows[5], rows[5], (None, sentence(rng, 12), "en", "s3", 3), (None, None, None, None, None)]
    rows.append((n + 8, sentence(rng, 30_000), "en", "s3", 0))
    return rows


@pytest.fixture(scope="session")
def doc_rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    """The documents with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(doc_rows, SCHEMA)
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASHES})


@pytest.fixture(scope="session")
def none(docs):
    return docs.filter("false")
