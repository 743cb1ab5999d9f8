import pytest

WORDS = "the quick brown fox jumps over a lazy dog while rain falls on old stone roofs and wind moves every tall tree".split()


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, odd characters, and columns that clash with internal names."""
    texts = [
        (1, "The cat sat on the mat. It was warm.", "en"),
        (2, "the CAT sat on the mat. It was warm.", "en"),
        (3, None, "en"),
        (4, "", None),
        (5, " \t\n ", "de"),
        (6, prose(1, 40000), "en"),
        (7, prose(2, 300) + "\n" + prose(2, 300), "fr"),
        (8, prose(3, 50), None),
        (9, prose(3, 50), "es"),
        (10, prose(3, 50).replace(" ", "  ") + " ", "es"),
        (10, prose(3, 50).replace(" ", "  ") + " ", "es"),
        (11, "a  b   c\n\n d\t e  f ▁▁ g<|endoftext|>h <s>x</s>", "en"),
        (12, "日本語テキスト 123456 🙂🙂 é İstanbul \x1c\x1d x\x85y", "und"),
        (13, "x" * 5000 + " " + "ab" * 700, "en"),
        (14, "1234 5678 !!! ***", "en"),
        (15, " " * 70000 + "word" + " " * 300, "en"),
        (16, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", "en"),
        (None, "a row without an id but with several words in it, more than ten of them", None),
        (18, "don't we'll they've I'm he'd it's", "en"),
    ]
    rows = [(i, t, lang, "src0" if n % 3 else None, len(t) if t else None, 1, b"x", "clash", [1], "y") for n, (i, t, lang) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, fp binary, key string, hashes array<int>, tail string").coalesce(2)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("doc_id < 0")


@pytest.fixture(scope="session")
def sf_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
