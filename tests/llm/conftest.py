import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """The documents of the smallest scale."""
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with names in use."""
    pick = random.Random(5)
    word = lambda: "".join(pick.choice("abcdeé") for _ in range(pick.randint(1, 7)))
    prose = [" ".join(word() for _ in range(120)) for _ in range(6)]
    lines = "\n".join(" ".join(word() for _ in range(8)) for _ in range(12))
    texts = [
        None, "", " \t\n", "\n\n", "word", prose[0], prose[0], prose[1], prose[1] + " end",
        "A B C " + prose[2], "a b c " + prose[2], prose[3] + "\n" + lines, prose[4] + "\n" + lines,
        prose[5] + "\n" + lines.upper(), "x" * 5000, "very " * 3000, " ".join(prose) * 3,
        "ünïcödé #*$%&|<> \x00 \x1c   end", "<|endoftext|> a's don't",
    ]
    rows = [(i, t, "n", 1, "k") for i, t in enumerate(texts)]
    rows += [rows[5], (None, prose[0], None, None, None), (None, None, None, None, None), (None, lines, None, 2, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n_words int, row string")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string")
