import pytest

LONG = " ".join(f"word{i % 977} and {i}." for i in range(40_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank"),
    (3, ""),
    (4, None),
    (None, "a row without an id but with words enough for a shingle"),
    (5, " \n\t\n "),
    (6, "l'été d'ÉTÉ: ÀÉÎ Σίσυφος 漢字 🙂 it's we'll ́x"),
    (7, "<|endoftext|> special <s> </s> <|startoftext|>"),
    (8, "1234 !!!! ????"),
    (9, LONG),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names the operators use themselves."""
    rows = [(i, t, "en" if k % 2 else None, "src", len(t or ""), 0.5, 7, "x") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, node int, kept string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
